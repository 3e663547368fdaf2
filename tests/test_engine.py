"""Filters, aggregations and sorts on small frames with nulls."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillseek.api import EngineConfig, QueryEngine
from quillseek.lang import Op
from quillseek.lang.ast import walk
from quillseek.operators.predicate import Unsupported
from quillseek.rewrite import ValidationError
from quillseek.sources import FieldCatalog, Relation
from quillseek.streaming import UnsupportedInStreaming, windowed_counts


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "ann", "open", 30, dt.datetime(2024, 1, 5, 12), True), (2, "bob", None, None, None, None), (3, "cid", "closed", 50, dt.datetime(2024, 1, 10), False), (4, "a*b", "open", 41, dt.datetime(2024, 2, 1), True), (5, None, "held", 30, dt.datetime(2024, 1, 5, 23), False)]
    return spark.createDataFrame(rows, "id int, name string, status string, age int, at timestamp_ntz, ok boolean").cache()


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("", [1, 2, 3, 4, 5]), ("status:open", [1, 4]), ("NOT status:open", [2, 3, 5]), ("-status:open", [2, 3, 5]), ("NOT -status:open", [2, 3, 5]),
        ("NOT (status:open OR age:>40)", [2, 5]), ("STATUS:open", [1, 4]), ("age:30", [1, 5]), ("age:abc", []), ("NOT age:abc", [1, 2, 3, 4, 5]), ("age:99999999999", []),
        ("age:[30 TO 41}", [1, 5]), ("NOT age:[30 TO 41}", [2, 3, 4]), ("age:>=41", [3, 4]), ("age:[* TO *]", [1, 3, 4, 5]), ("ok:true", [1, 4]), ("ok:maybe", []),
        ("_exists_:age", [1, 3, 4, 5]), ("NOT _exists_:age", [2]), ("_missing_:status", [2]), ("_missing_:nothing", [1, 2, 3, 4, 5]), ("nothing:1", []), ("NOT nothing:1", [1, 2, 3, 4, 5]),
        ("name:a*", [1, 4]), ('name:"a*"', []), (r"name:a\*b", [4]), ("status:*", [1, 3, 4, 5]), ("at:2024-01-05", [1, 5]), ("NOT at:2024-01-05", [2, 3, 4]), ("at:>2024-01-05", [3, 4]), ("at:<=2024-01-05", [1, 5]),
        ("at:[2024-01-05 TO 2024-01-10]", [1, 3, 5]), ("at:soon", []), ("status:(open OR held) age:30", [1, 5]), ("ann", [1]), ("status:open OR status:held OR status:closed", [1, 3, 4, 5]),
        ("NOT (status:open OR status:held)", [2, 3]), ("status:open OR +age:50", [3]), ("+status:open OR -age:30", [4]), ("status:open AND age:30 OR age:41", [1, 4]),
    ],
)
def test_filters(people, query, want):
    assert ids(QueryEngine().filter(people, query)) == want


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.recursive(st.sampled_from(["status:open", "age:>30", "NOT ok:true", "_missing_:age", "name:a*", "at:2024-01-05", "-age:[30 TO 40]"]), lambda q: st.builds(lambda a, op, b, n: f"{n}({a}{op}{b})", q, st.sampled_from([" AND ", " OR ", " "]), q, st.sampled_from(["", "NOT "])), max_leaves=6))
def test_a_query_and_its_inverse_split_all_rows(people, q):
    engine = QueryEngine()
    yes, no = ids(engine.filter(people, q)), ids(engine.filter(people, engine.invert(q)))
    assert sorted(yes + no) == [1, 2, 3, 4, 5]


def test_long_or_is_one_list(people):
    q = " OR ".join(f"age:{i}" for i in range(2000))
    df = QueryEngine().filter(people, q)
    assert ids(df) == [1, 3, 4, 5]
    mixed = " OR ".join(f"(age:{i} status:s{i})" for i in range(600)) + " OR (age:30 status:open)"
    assert ids(QueryEngine().filter(people, mixed)) == [1]


def test_filters_reach_the_scan(spark, tmp_path, people):
    people.write.parquet(str(tmp_path / "p"))
    df = QueryEngine().filter(spark.read.parquet(str(tmp_path / "p")), 'NOT status:open AND age:[30 TO 41} OR name:a*').select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "StringStart" in plan and "EqualNullSafe" in plan and "Python" not in plan
    assert "ok" not in plan.split("ReadSchema")[1]


def test_relational_mode(people):
    e = QueryEngine(mode="relational", default_fields=("name", "status"))
    assert ids(e.filter(people, "name:*i*")) == [3] and ids(e.filter(people, "name:a*")) == [1, 4] and ids(e.filter(people, "op")) == [1, 4]
    assert ids(QueryEngine(mode="relational", default_fields=("name",), default_search_op="contains").filter(people, "n")) == [1]
    with pytest.raises(Unsupported):
        e.filter(people, "at:>now/d")
    blank = QueryEngine(mode="relational", default_fields=("name",), tokenizer=lambda f, t: [" "])
    assert ids(blank.filter(people, "x")) == []


def test_search_mode_and_required_groups(people):
    assert ids(QueryEngine(default_operator="or").filter(people, "status:held age:50")) == [3, 5]
    assert ids(QueryEngine(default_operator=Op.OR).filter(people, "status:held age:50")) == [3, 5]
    assert ids(QueryEngine(required_mode="search").filter(people, "+(status:open OR age:30)")) == [1]


def test_overrides_runtime_fields_and_errors(people):
    e = QueryEngine(runtime_fields={"half": ("age / 2", T.DoubleType())}, aliases={"state": "status"}, field_map={"x": "age"})
    assert ids(e.filter(people, "half:>20")) == [3, 4] and ids(e.filter(people, "state:held")) == [5] and ids(e.filter(people, "x:50")) == [3]
    with pytest.raises(ValidationError):
        e.filter(people, "@include:none")
    assert "Term" in e.explain("a:1 b:2")


@pytest.fixture(scope="module")
def nested(spark):
    """Farms with fields of crops; 1 grows beans on clay and rye on sand, 2 rye on clay."""
    kind = "id string, plots array<struct<soil: string, crops: array<struct<sort: string, tons: int>>>>, tags array<string>"
    rows = [("A", [("clay", [("bean", 3)]), ("sand", [("rye", 9)])], ["x", "y"]), ("B", [("clay", [("rye", 4), ("oat", None)])], ["y"]), ("C", None, None), ("D", [], [])]
    return spark.createDataFrame(rows, kind).cache()


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("plots.soil:clay AND plots.crops.sort:rye", "B"), ("plots.soil:clay AND NOT plots.crops.sort:rye", "A"), ("NOT plots.soil:sand", "BCD"),
        ("plots:(plots.soil:sand plots.crops.sort:rye)", "A"), ("NOT plots:(plots.soil:clay plots.crops.sort:rye)", "ACD"),
        ("_exists_:plots", "AB"), ("_missing_:plots", "CD"), ("tags:y", "AB"), ("NOT tags:x", "BCD"), ("plots.soil:sand OR plots.crops.sort:oat", "AB"),
        ("plots.crops.sort:rye AND plots.crops.tons:>5", "A"), ("_missing_:plots.crops.tons", "B"),
    ],
)
def test_nested_arrays(nested, query, want):
    assert "".join(ids(QueryEngine().filter(nested, query))) == want


def test_nested_sort_and_filter(nested):
    order = [r.id for r in QueryEngine().sort(nested, "-plots.soil id").collect()]
    assert order == ["A", "B", "C", "D"]
    e = QueryEngine(nested_filter=lambda path: "plots.soil:clay" if path == "plots" else None)
    assert [r.id for r in e.filter(nested, "_exists_:plots.crops.sort plots.soil:*").collect()] == ["A", "B"]


def test_relations(spark):
    company = spark.createDataFrame([(1, "Acme"), (2, None), (3, "Zed")], "cid int, cname string")
    staff = spark.createDataFrame([(10, 1), (11, 2), (12, None), (13, 9)], "id int, company int")
    one = QueryEngine(mode="relational", relations={"company": Relation(company, "company", "cid", "one")})
    assert ids(one.filter(staff, "company.cname:Acme")) == [10]
    assert ids(one.filter(staff, "NOT company.cname:Acme")) == [11, 12, 13]
    assert ids(one.filter(staff, "_missing_:company.cname")) == [11, 12, 13]
    assert ids(one.filter(staff, "_exists_:company")) == [10, 11]
    plan = one.filter(staff, "company.cname:Acme OR id:13")._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistenceJoin" in plan


def flat(df):
    return [tuple(r) for r in df.collect()]


def test_aggregations(people):
    e = QueryEngine()
    got = e.aggregate(people, "min:age max:age~99 missing:age terms:(status~2 avg:age) cardinality:status")
    assert flat(got["min_age"]) == [(30,)] and flat(got["max_age"]) == [(99,)] and flat(got["missing_age"]) == [(1,)] and flat(got["cardinality_status"]) == [(3,)]
    assert flat(got["terms_status"]) == [("open", 2, 35.5), ("closed", 1, 50.0)]
    tree = e.aggregate_tree(people, "terms:(ok terms:status)")["terms_ok"].collect()
    assert {r.ok: sorted(x.status for x in r.terms_status) for r in tree} == {True: ["open"], False: ["closed", "held"]}
    assert flat(e.aggregate(people, "terms:(status~5 @missing:none @include:/o.*|none/)")["terms_status"]) == [("open", 2), ("none", 1)]
    assert e.aggregate(people, "count:x") == {}
    days = flat(e.aggregate(people, "date:at~month")["date_at"])
    assert days == [(dt.datetime(2024, 1, 1), 3), (dt.datetime(2024, 2, 1), 1)]
    gaps = flat(e.aggregate(people, "date:(at~day max:age)")["date_at"])
    assert len(gaps) == 28 and gaps[0][1:] == (2, 30) and gaps[1][1:] == (0, None)
    assert flat(e.aggregate(people, "histogram:age~10")["histogram_age"]) == [(30.0, 2), (40.0, 1), (50.0, 1)]
    hits = e.aggregate(people, "tophits:_~2 terms:(status~1 tophits:(_~1 @exclude:at))")
    assert [h.id for h in hits["tophits"].first()[0]] == [1, 2] and "at" not in hits["terms_status"].first().tophits[0].asDict()


def test_empty_frames(people):
    none = people.where("false")
    got = QueryEngine().aggregate(none, "terms:(status max:age) date:at~day histogram:age sum:age")
    assert [df.count() for df in got.values()] == [1, 0, 0, 0]


def test_search_pages(people):
    found = QueryEngine().search(people, "NOT age:50", aggs="max:age", sort="-age id", limit=2, offset=1, fields=["id"])
    assert flat(found.rows) == [(1,), (5,)] and flat(found.aggregations["max_age"]) == [(41,)]


def test_catalog(spark):
    c = FieldCatalog(spark.createDataFrame([], "a struct<B: int>, `x.y` string, m map<string,int>, t string").schema).add_keyword_field("t").add_sort_field("t")
    assert c.resolve("A.b").path == ("a", "B") and c.resolve("x.y").path == ("x.y",) and c.resolve("m.k").path == ("m", "k") and c.resolve("a.z") is None
    assert c.resolve("t").analyzed and not c.resolve("t.keyword").analyzed and c.resolve("t").sort_form
    assert set(c.field_names()) == {"a.B", "x.y", "m", "t"}


def test_streams(spark, people, tmp_path):
    path = str(tmp_path / "s")
    people.write.parquet(path)
    stream = spark.readStream.schema(people.schema).parquet(path)
    e = QueryEngine()
    assert e.filter(stream, "status:open").isStreaming
    for bad in ("terms:status", "date:at~day"):
        with pytest.raises(UnsupportedInStreaming):
            e.aggregate(stream, bad)
    with pytest.raises(UnsupportedInStreaming):
        e.sort(stream, "id")
    query = windowed_counts(e.filter(stream, "status:open"), "at", "1 day", "1 day").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counted").agg(F.sum("doc_count")).first()[0] == 2


def test_config_is_shared():
    base = EngineConfig(default_fields=("a",))
    assert QueryEngine(base, mode="relational").config.default_fields == ("a",)


def test_extensions_and_set_aggregates(people):
    e = QueryEngine(extensions=frozenset({"dots", "count"}))
    assert ids(e.filter(people, "age:30..41")) == [1, 4, 5] and ids(QueryEngine().filter(people, "age:30..41")) == []
    assert flat(e.aggregate(people, "terms:(ok count:_)")["terms_ok"]) == [(False, 2, 2), (True, 2, 2)]

    def spread(node, context):
        for n in walk(node):
            if n.field == "spread":
                n.data["agg"] = F.max("age") - F.min("age")
        return node

    e.chains["aggregation"].add(spread, 20)
    assert flat(e.metrics(people, "spread:age max:age")) == [(20, 50)]


def test_fixed_intervals_with_bounds_and_metadata(people):
    df = QueryEngine().aggregate(people, "date:at~10d", start=dt.datetime(2023, 12, 20), end=dt.datetime(2024, 2, 15))["date_at"]
    rows = flat(df)
    assert sum(n for _, n in rows) == 4 and rows[0][0] <= dt.datetime(2023, 12, 20) and rows[-1][0] > dt.datetime(2024, 2, 5)
    assert df.schema["at"].metadata == {"field_type": "timestamp_ntz", "timezone": "UTC"}


def test_allow_list(people):
    e = QueryEngine()
    options = e.allow_list(people)
    assert e.validate_query("AGE:1 name:x", options).is_valid and not e.validate_query("other:1", options).is_valid


def test_unordered_and_approximate(people):
    e = QueryEngine(ordered=False, approx=True)
    df = e.aggregate(people, "terms:(status~0 cardinality:age percentiles:age~50)")["terms_status"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and {r.status: r.cardinality_age for r in df.collect()} == {"open": 2, "closed": 1, "held": 1}


@pytest.mark.parametrize(("query", "want"), [("age:3_0", []), ("age:+30", [1, 5]), ("age:٣٠", []), ("age:[29.5 TO 1e2}", [1, 3, 4, 5]), ("age:>nan", []), ("age:<99999999999999999999", [1, 3, 4, 5]), ("at:>now-999999y", []), ("at:[0001-01-01||-1y TO *]", []), ("at:[9999-12-31||+1d TO *]", [])])
def test_literals_that_are_none(people, query, want):
    assert ids(QueryEngine().filter(people, query)) == want


def test_decimals_and_doubles(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1.50BD, double('NaN')), (2, 2.00BD, 1.5) AS t(id, m, d)")
    e = QueryEngine()
    assert ids(e.filter(df, "m:nan OR m:1.5")) == [1] and ids(e.filter(df, "m:inf")) == [] and ids(e.filter(df, "d:nan")) == [1] and ids(e.filter(df, "d:1_5")) == []


def test_gaps_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0.0, dt.datetime(2014, 1, 1)), (1, 1e13, dt.datetime(2024, 1, 1))], "g int, v double, t timestamp_ntz")
    for agg in ("histogram:v~1", "date:t~second", "terms:(g histogram:v~1)"):
        found = next(f for n, f in QueryEngine().aggregate(df, agg).items() if n != "terms_g")
        with pytest.raises(Exception, match="buckets with gaps"):
            found.collect()
    assert QueryEngine().aggregate(df, "histogram:(v~1 @min:1)")["histogram_v"].count() == 2
    monkeypatch.setattr("quillseek.plans.gaps.STRETCH", 7)
    for agg, n in (("date:t~day", 3653), ("date:t~month", 121), ("date:t~90d", 42), ("histogram:v~1e11", 101)):
        rows = [*QueryEngine().aggregate(df, agg).values()][-1].collect()
        assert len(rows) == len({r[0] for r in rows}) == n and sum(r.doc_count for r in rows) == 2


@pytest.mark.parametrize("agg", ["histogram:age~0", "histogram:age~x", "histogram:age~-1", "percentiles:age~150", "percentiles:age~a", "date:at~foo", "date:at~0d", "date:(at~day @offset:x)", "geogrid:age~13", "terms:(status histogram:age~0)"])
def test_wrong_arguments_are_validation_errors(people, agg):
    with pytest.raises(ValidationError):
        QueryEngine().aggregate(people, agg)
    assert not QueryEngine().validate_aggregations(agg).is_valid


def test_points_that_are_none(spark):
    df = spark.createDataFrame([(1, "10,20"), (2, "nowhere"), (3, "1,2,3"), (4, None), (5, "x,y"), (6, "")], "id int, place string")
    e = QueryEngine(geo_fields=("place",))
    assert ids(e.filter(df, 'place:"10,20"~1km')) == [1] and ids(e.filter(df, 'NOT place:"10,20"~1km')) == [2, 3, 4, 5, 6]
    assert ids(e.filter(df, 'place:["11,19" TO "9,21"]')) == [1]
    assert sum(r.doc_count for r in e.aggregate(df, "geogrid:place~2")["geogrid_place"].collect()) == 2


def test_text_matches_whole_tokens(spark):
    rows = [(1, "The cat_1 sat."), (2, "concatenate"), (3, "CAT; of, the!"), (4, "of the"), (5, None), (6, "of--the cats"), (7, "été, L'ÉTÉ"), (8, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    e = QueryEngine(analyzed_fields=("t",))
    want = {"t:cat": [3], "t:cat_1": [1], "t:cat*": [1, 3, 6], "t:*": [1, 2, 3, 4, 6, 7, 8], 't:"of the"': [3, 4, 6], 't:"the of"': [], "t:été": [7], "t:cat-sat": [1, 3], "NOT t:the": [2, 5, 7, 8], 't:"!"': [], "t:c.t": []}
    assert {q: ids(e.filter(df, q)) for q in want} == want


def test_logging_and_reports(people, caplog, tmp_path, spark):
    with caplog.at_level("DEBUG", logger="quillseek"):
        e = QueryEngine()
        e.filter(people, "nothing:1")
        e.aggregate(people, "avg:name")
    text = caplog.text
    assert "nothing:1" in text and "unknown fields nothing" in text and "no number" in text and "resolve" in text
    people.write.parquet(str(tmp_path / "p"))
    found = QueryEngine().report(spark.read.parquet(str(tmp_path / "p")).select("id", "age", "name"), "age:>30 AND name:/x/")
    assert "GreaterThan(age,30)" in found["pushed"] and set(found["read"]) == {"id", "age", "name"} and found["joins"] == []


def test_sort_form_folds_latin_letters():
    from quillseek.functions.text import FOLDS

    assert {FOLDS[c] for c in "àåçéñöýžșǎłđøế"} == set("aacenoyzsaldoe") and all(len(v) == 1 for v in FOLDS.values())


def test_sliding_and_session_windows(spark):
    rows = [(1, dt.datetime(2024, 1, 1, h)) for h in (0, 1, 2, 9)] + [(2, dt.datetime(2024, 1, 1, 5))]
    df = spark.createDataFrame(rows, "u int, t timestamp_ntz")
    assert sum(r.doc_count for r in windowed_counts(df, "t", "2 hours", "1 hour", ["u"], slide="1 hour").collect()) == 10
    assert sorted((r.u, r.doc_count) for r in windowed_counts(df, "t", "3 hours", "1 hour", ["u"], session=True).collect()) == [(1, 1), (1, 3), (2, 1)]
    with pytest.raises(UnsupportedInStreaming):
        windowed_counts(df, "t", "3 hours", "1 hour", session=True)


def test_shared_reading(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    e, agg = QueryEngine(), "terms:(status~2 terms:(ok avg:age)) date:at~month"
    apart, shared = e.aggregate(df, agg), e.aggregate(df, agg, read_once=True)
    assert {n: flat(f) for n, f in shared.items()} == {n: flat(f) for n, f in apart.items()}
    plan = shared["date_at"]._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan and "name" not in plan.split("ReadSchema")[1]
    e.release()
    assert not e._kept and flat(e.search(df, "age:>30", aggs="max:age", read_once=True).aggregations["max_age"]) == [(50,)]
