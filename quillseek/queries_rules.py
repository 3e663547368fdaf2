"""Registered queries of the language's finer rules: literals, escapes, scopes, rewrites, validation, streams.

What has no rows of its own (syntax errors, printed forms, validation) is a small frame of
expressions and outcomes, with the same rows as SQL values.
"""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import QueryEngine
from .lang import Op, QueryParseError, Term, parse
from .rewrite import ValidationOptions, Visitor, cleanup, hierarchical, referenced_fields

CLOCK = dt.datetime(2024, 1, 31)


def _values(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([tuple(str(x) for x in r) for r in rows], ", ".join(f"{n} string" for n in names.split()))


def _values_sql(names: str, rows: list[tuple]) -> str:
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({', '.join(names.split())})"


#: (expression, message, column)
SYNTAX = [(":", "Unexpected character ':'.", 0), ("c:a:a", "Unexpected character ':'.", 3), ('Hello "world', "Unterminated quoted string", 12), ("a AND b", "", -1)]
#: (expression, as printed)
PRINTED = [
    ("f :x", "f:x"), ("a : >= 10", "a:>=10"), ("( ( a AND b ))", "((a AND b))"), ("OR a", "a"), ("a AND ", "a"), ("d:[* TO 2012-12-31]", "d:[* TO 2012-12-31]"),
    ('"a b"~1', '"a b"~1'), ("x:[* TO 10]^zone", "x:[* TO 10]^zone"), (r"type:\(11\)2\+", r"type:\(11\)2\+"), ("!Test", "!Test"), ("(NOT -(stuff))", "(NOT -(stuff))"),
]
CLEANED = [("(((v)))", "v"), ("t:((v))", "t:(v)"), ("NOT (v)", "NOT v"), ("NOT (s:f)", "NOT s:f"), ("p:1 NOT (s:o OR s:r)", "p:1 NOT (s:o OR s:r)")]
FIELDS = [("a:1 (b:2 OR c:(x y)) z", "a,b,c,dflt"), ("x", "dflt"), ("_exists_:e _missing_:m r:[1 TO 2]", "e,m,r"), ("@include:i a:1", "a")]
NAMES = [("f.x", "direct"), ("F.y", "q.r.y"), ("f", "q.r"), ("g", "g")]
#: (rule, expression, valid)
RULES = [
    ("allowed", "ok:1", True), ("allowed", "no:1", False), ("restricted", "a:1", True), ("restricted", "a:1 NO:2", False), ("operations", "min:f", True), ("operations", "min:f max:g", False),
    ("only operations", "terms:(f min:g)", False), ("only operations", "min:f", True), ("leading", "f:*x", False), ("leading", "f:x*", True), ("resolved", "known:1", True), ("resolved", "other:1", False),
    ("includes", "@include:none", False), ("includes allowed", "@include:none", True), ("depth", "(a (b))", True), ("depth", "(a (b (c)))", False), ("syntax", "a:(b", False), ("at", "@x:1 ok:1", True),
]
ARGUMENTS = [("histogram:v~0", False), ("histogram:v~5", True), ("percentiles:v~150", False), ("percentiles:v~50,95", True), ("date:t~foo", False), ("date:t~1d", True), ("geogrid:g~13", False), ("geogrid:g~12", True), ("terms:", False)]


def _syntax(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for text, *_ in SYNTAX:
        try:
            parse(text)
            rows.append((text, "", -1))
        except QueryParseError as e:
            rows.append((text, e.message, e.column))
    return _values(spark, "expression message place", rows)


def _rule(engine: QueryEngine, rule: str, text: str) -> bool:
    options = {
        "allowed": {"allowed_fields": {"ok"}}, "restricted": {"restricted_fields": {"no"}}, "operations": {"restricted_operations": {"max"}}, "only operations": {"allowed_operations": {"min"}},
        "leading": {"allow_leading_wildcards": False}, "resolved": {"allow_unresolved_fields": False}, "includes allowed": {"allow_unresolved_includes": True}, "depth": {"max_depth": 3}, "at": {"allowed_fields": {"ok"}},
    }.get(rule, {})
    check = engine.validate_aggregations if "operations" in rule else engine.validate_query
    return check(text, ValidationOptions(**options)).is_valid


def _rules(spark: SparkSession, d: str) -> DataFrame:
    plain, strict = QueryEngine(), QueryEngine()
    strict.chains["query"].add(_only_known, 11)
    return _values(spark, "rule expression valid", [(r, t, _rule(strict if r == "resolved" else plain, r, t)) for r, t, _ in RULES])


def _only_known(node, context):
    """A rewrite of a caller's: every field but `known` is unresolved."""
    context.result.unresolved_fields |= referenced_fields(node) - {"known"}
    return node


class _Counter(Visitor[int]):
    """How many terms an expression has."""

    def __init__(self) -> None:
        self.result = 0

    def term(self, node: Term, context: object) -> None:
        self.result += 1


def _visited(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, "expression terms", [(t, _Counter().visit(parse(t))) for t in ("a:1 (b:2 OR NOT c:3) d:[1 TO 2] _exists_:e", "x", "")])


def _thrown(spark: SparkSession, d: str) -> DataFrame:
    """Validation that throws, and what a result tells: operations by field, depth."""
    engine = QueryEngine()
    result = engine.validate_aggregations("terms:(f min:g) max:g")
    try:
        engine.validate_query("no:1", ValidationOptions(allowed_fields={"ok"}, throw=True))
        thrown = "no"
    except ValueError as e:
        thrown = type(e).__name__
    several = engine.validate_query("no:1 f:*x", ValidationOptions(allowed_fields={"ok", "f"}, allow_leading_wildcards=False))
    return _values(spark, "what value", [("operations", ";".join(f"{o}={','.join(sorted(f))}" for o, f in sorted(result.operations.items()))), ("depth", engine.validate_query("(a (b))").depth), ("thrown", thrown), ("errors", len(several.errors)), ("lines", several.message.count("\n") + 1)])


def _bag(spark: SparkSession, d: str) -> DataFrame:
    """A caller's rewrite reads values that the caller has put beside the expression."""
    engine = QueryEngine()

    def only_mine(node, context):
        return node if context.get_boolean("all") else parse(f"({node}) AND o_orderstatus:{context.get_string('status', 'F')}")

    engine.chains["query"].add(only_mine, 20)
    from .queries import table

    tree = engine.parse("o_totalprice:>300000", context=engine.context(status="O", all="false"))
    return QueryEngine().filter(table(spark, d, "orders"), tree).select("o_orderkey")


def _names_of(spark: SparkSession, d: str, expression: str, **config) -> DataFrame:
    from .queries import table

    found = QueryEngine(**config).aggregate(table(spark, d, "orders"), expression)
    return _values(spark, "name rows", [(n, df.count()) for n, df in found.items()])


def _meta(spark: SparkSession, d: str) -> DataFrame:
    from .queries import table

    out = QueryEngine().aggregate(table(spark, d, "events"), 'date:(ts~day^"America/Chicago") terms:event_type')
    rows = [(name, f.name, f.metadata.get("field_type", ""), f.metadata.get("timezone", "")) for name, df in out.items() for f in df.schema.fields if f.metadata]
    return _values(spark, "frame field type zone", rows)


def _siblings(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders, each with two arrays beside one another."""
    from .queries import table

    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("name"))).alias("a"), F.collect_list(F.struct(F.col("l_linenumber").alias("name"))).alias("b"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.groupBy("o_custkey").agg(F.collect_list(F.struct("a", "b")).alias("parent"))


def _noted(spark: SparkSession, d: str) -> DataFrame:
    """Orders' lines with a note that some lack, and a kind beside them."""
    from .queries import table

    item = F.struct(F.col("l_returnflag").alias("flag"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("note"))
    out = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    return out.withColumn("kind", F.when(F.col("l_orderkey") % 7 == 0, "R").otherwise("x"))


_STARS = "(SELECT *, CASE p_size WHEN 7 THEN 'a*' WHEN 8 THEN 'ab' WHEN 9 THEN '*13' WHEN 10 THEN 'B?13' ELSE p_brand END AS s FROM part)"


def _starred(spark: SparkSession, d: str) -> DataFrame:
    from .queries import table

    size = F.col("p_size")
    return table(spark, d, "part").withColumn("s", F.when(size == 7, "a*").when(size == 8, "ab").when(size == 9, "*13").when(size == 10, "B?13").otherwise(F.col("p_brand")))


def _odd_names(spark: SparkSession, d: str) -> DataFrame:
    from .queries import table

    return table(spark, d, "part").withColumnsRenamed({"p_size": "size-of.part", "p_brand": "brand@2"})


def _accented(spark: SparkSession, d: str) -> DataFrame:
    """Parts with names in several cases and with accents."""
    from .queries import table

    n = F.pmod("p_partkey", F.lit(6))
    return table(spark, d, "part").withColumn("word", F.element_at(F.array(*map(F.lit, ["Zebra", "élan", "Eagle", "ÉCOLE", "straße", "strate"])), (n + 1).cast("int")))


_WORDS = "(SELECT *, (ARRAY['zebra', 'elan', 'eagle', 'ecole', 'strasse', 'strate'])[p_partkey % 6 + 1] AS form FROM part)"


def _sorted(source, expression: str, columns: list[str], spark: SparkSession, d: str, **config) -> DataFrame:
    from .queries import table

    df = source(spark, d) if callable(source) else table(spark, d, source)
    return QueryEngine(**config).sort(df, expression).select(*columns)


def _sort_override(spark: SparkSession, d: str) -> DataFrame:
    """A rewrite of the caller's own sets a ready ordering: `weekend` puts some first."""
    from .lang.ast import walk
    from .queries import table

    def ready(node, context):
        for n in walk(node):
            if isinstance(n, Term) and n.field == "weekend":
                n.data["sort"] = (F.dayofweek("o_orderdate").isin(1, 7)).desc()
        return node

    engine = QueryEngine()
    engine.chains["sort"].add(ready, 20)
    return engine.sort(table(spark, d, "orders"), "weekend o_orderkey").select("o_orderkey")


def _relational_override(spark: SparkSession, d: str) -> DataFrame:
    from .lang.ast import walk
    from .queries import table

    def big(node, context):
        for n in walk(node):
            if n.field == "big":
                n.data["column"] = F.col("o_totalprice") > 400000
        return node

    engine = QueryEngine(mode="relational")
    engine.chains["query"].add(big, 20)
    return engine.filter(table(spark, d, "orders"), "NOT big:yes AND o_orderstatus:O").select("o_orderkey")


def _rewritten(change: str, spark: SparkSession, d: str) -> DataFrame:
    """Orders filtered by an expression that a rewrite has changed first."""
    from .queries import table

    engine = QueryEngine()
    text = {
        "removed": lambda: engine.remove_fields("o_orderstatus:F AND (o_totalprice:>400000 OR o_orderpriority:nothing)", ["O_TOTALPRICE", "o_orderpriority"]),
        "cleaned": lambda: engine.cleanup("(((o_orderstatus:F))) NOT (o_totalprice:>400000)"),
        "shown": lambda: parse("(o_orderstatus:F o_totalprice:>1000) OR (o_orderstatus:P o_totalprice:>2000)").shown(Op.AND),
    }[change]()
    return engine.filter(table(spark, d, "orders"), text).select("o_orderkey")


def _dumped(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of nodes in the order of the debug dump."""
    lines = QueryEngine().explain("a:1 OR b:[1 TO 2]").splitlines()
    return _values(spark, "kind count", [(k, sum(line.strip().startswith(k) for line in lines)) for k in ("Group", "Term", "Range")])


def _windows(kind: str, spark: SparkSession, d: str) -> DataFrame:
    """Counts of a stream of events: windows of a day, of a day every twelve hours, sessions of a user."""
    from .queries import table
    from .sources.streams import drained
    from .streaming import windowed_counts

    more = {"tumbling": {"by": ["event_type"]}, "sliding": {"by": ["event_type"], "slide": "12 hours"}, "session": {"by": ["user_id"], "session": True}}[kind]
    length = "2 days" if kind == "session" else "1 day"
    out = drained(spark, table(spark, d, "events"), f"{d}/events.parquet", lambda df: windowed_counts(df.where("value > 10"), "ts", length, "1 hour", **more), complete=True)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end") if c in out.columns})


def _report(spark: SparkSession, d: str) -> DataFrame:
    from .queries import table

    found = QueryEngine().report(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus:F AND o_totalprice:>1000")
    return _values(spark, "what value", [("pushed", ";".join(sorted(x for x in found["pushed"] if "NotNull" not in x))), ("read", ",".join(sorted(found["read"]))), ("joins", len(found["joins"]))])


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Customers at places in text, some of which are none."""
    from .queries import _located

    where = F.when(F.col("c_custkey") % 5 == 0, "nowhere").when(F.col("c_custkey") % 7 == 0, "12;x").otherwise(F.concat_ws(",", F.col("loc.lat").cast("string"), F.col("loc.lon").cast("string")))
    return _located(spark, d).withColumn("place", where)


def rule_queries() -> dict[str, tuple]:
    from .queries import _LOCATED, _agg, _filter, _located

    f = lambda source, expression, columns, sql, **config: (partial(_filter, source, expression, columns, **config), sql)
    s = lambda source, expression, columns, sql, **config: (partial(_sorted, source, expression, columns, **config), sql)
    key, order, line, event, cust = ["p_partkey"], ["o_orderkey"], ["l_orderkey"], ["event_id"], ["c_custkey"]
    tokens = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
    near = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(lat - 10) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(lon - 20) / 2), 2))))"
    sessions = "SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 DAY THEN 0 ELSE 1 END AS new FROM events WHERE value > 10)"
    return {
        "p_range_literals": f("orders", 'o_orderpriority:["1-URGENT" TO "3-MEDIUM"}', order, "SELECT o_orderkey FROM orders WHERE o_orderpriority >= '1-URGENT' AND o_orderpriority < '3-MEDIUM'"),
        "p_escapes": f(_starred, r"s:B\?13 OR s:\*13 OR s:\(none\)", key, f"SELECT p_partkey FROM {_STARS} WHERE s IN ('B?13', '*13', '(none)')"),
        "p_odd_fields": f(_odd_names, "size-of.part:7 OR brand@2:Brand#13", key, "SELECT p_partkey FROM part WHERE p_size = 7 OR p_brand = 'Brand#13'"),
        "p_leading": f("orders", "OR o_orderstatus:F", order, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
        "p_trailing": f("orders", "o_orderstatus:F AND ", order, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
        "p_errors": (_syntax, _values_sql("expression message place", SYNTAX)),
        "p_printed": (lambda sp, d: _values(sp, "expression printed", [(t, parse(t)) for t, _ in PRINTED]), _values_sql("expression printed", PRINTED)),
        "p_not_numbers": f("part", "p_size:1_0 OR p_size:٧ OR p_retailprice:1_000.5 OR p_size:7", key, "SELECT p_partkey FROM part WHERE p_size = 7"),
        "f_default_one": f("orders", "F", order, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", default_fields=("o_orderstatus",)),
        "f_default_mixed": f("documents", "de", ["doc_id"], f"SELECT doc_id FROM documents WHERE list_contains({tokens}, 'de') OR lang = 'de'", default_fields=("text", "lang"), analyzed_fields=("text",)),
        "f_default_nested": f(_noted, "R", line, "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') OR l_orderkey % 7 = 0", default_fields=("items.flag", "kind")),
        "f_boosted": f("orders", "o_orderstatus:F^3 AND o_totalprice:>100000", order, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000"),
        "f_star_quoted": f(_starred, 's:"a*"', key, f"SELECT p_partkey FROM {_STARS} WHERE s = 'a*'"),
        "f_star_escaped": f(_starred, r"s:a\*", key, f"SELECT p_partkey FROM {_STARS} WHERE s = 'a*'"),
        "f_stars_rel": f(_starred, "s:*13 OR s:B?13", key, f"SELECT p_partkey FROM {_STARS} WHERE s IN ('*13', 'B?13')", mode="relational"),
        "f_any_case": f("orders", "O_OrderStatus:F AND O_TOTALPRICE:<200000", order, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 200000"),
        "f_hierarchy": f(_noted, "lines.flag:R AND kind_:x", line, "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND l_orderkey % 7 <> 0", field_map={"lines": "items", "kind_": "kind"}),
        "f_date_strict": f("events", "ts:>now-7d", event, "SELECT event_id FROM events WHERE ts > '2024-01-24'", mode="relational", clock=lambda: CLOCK),
        "f_date_parser": f("events", "ts:[first TO second}", event, "SELECT event_id FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-06'", date_parser=lambda t: dt.datetime(2024, 1, {"first": 5}.get(t, 6))),
        "f_date_zone_offset": f("events", "ts:[2024-01-05 TO 2024-01-06}^1h", event, "SELECT event_id FROM events WHERE ts >= '2024-01-04 23:00:00' AND ts < '2024-01-05 23:00:00'"),
        "f_date_zone_default": f("events", "ts:[2024-01-05 TO 2024-01-06}", event, "SELECT event_id FROM events WHERE ts >= '2024-01-05 06:00:00' AND ts < '2024-01-06 06:00:00'", timezone="America/Chicago"),
        "f_date_out_of_range": f("events", "ts:>now-999999y OR event_type:click", event, "SELECT event_id FROM events WHERE event_type = 'click'", clock=lambda: CLOCK),
        "f_geo_named": f(_located, "loc:here~2500km", cust, f"SELECT c_custkey FROM {_LOCATED} WHERE {near} <= 2500000", geo_resolver=lambda name: {"here": "10,20"}.get(name)),
        "f_geo_text": f(_points, 'place:"10,20"~2500km', cust, f"SELECT c_custkey FROM {_LOCATED} WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND {near} <= 2500000", geo_fields=("place",)),
        "f_dots_ext": f("part", "p_size:5..9", key, "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9", extensions=frozenset({"dots"})),
        "n_siblings": f(_siblings, "parent.a.name:R AND parent.b.name:6", ["o_custkey"], "SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND bool_or(l_linenumber = 6))"),
        "n_exists": f(_noted, "_exists_:items.note", line, "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag <> 'N')"),
        "n_missing": f(_noted, "_missing_:items.note", line, "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'N')"),
        "v_names": (lambda sp, d: _values(sp, "name found", [(n, hierarchical({"f": "q.r", "f.x": "direct"})(n)) for n, _ in NAMES]), _values_sql("name found", NAMES)),
        "v_rules": (_rules, _values_sql("rule expression valid", RULES)),
        "v_arguments": (lambda sp, d: _values(sp, "expression valid", [(t, QueryEngine().validate_aggregations(t).is_valid) for t, _ in ARGUMENTS]), _values_sql("expression valid", ARGUMENTS)),
        "v_results": (_thrown, _values_sql("what value", [("operations", "max=g;min=g;terms=f"), ("depth", 3), ("thrown", "ValidationError"), ("errors", 2), ("lines", 2)])),
        "v_removed": (partial(_rewritten, "removed"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
        "v_cleaned": (partial(_rewritten, "cleaned"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice > 400000"),
        "v_cleaned_forms": (lambda sp, d: _values(sp, "expression cleaned", [(t, cleanup(parse(t))) for t, _ in CLEANED]), _values_sql("expression cleaned", CLEANED)),
        "v_shown": (partial(_rewritten, "shown"), "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 1000) OR (o_orderstatus = 'P' AND o_totalprice > 2000)"),
        "v_dumped": (_dumped, _values_sql("kind count", [("Group", 1), ("Term", 1), ("Range", 1)])),
        "v_fields": (lambda sp, d: _values(sp, "expression fields", [(t, ",".join(sorted(referenced_fields(parse(t), ["dflt"])))) for t, _ in FIELDS]), _values_sql("expression fields", FIELDS)),
        "v_visitor": (_visited, _values_sql("expression terms", [("a:1 (b:2 OR NOT c:3) d:[1 TO 2] _exists_:e", 3), ("x", 1), ("", 0)])),
        "v_override_rel": (_relational_override, "SELECT o_orderkey FROM orders WHERE NOT o_totalprice > 400000 AND o_orderstatus = 'O'"),
        "k_bag": (_bag, "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'"),
        "c_report": (_report, _values_sql("what value", [("pushed", "EqualTo(o_orderstatus,F);GreaterThan(o_totalprice,1000.0)"), ("read", "o_orderkey,o_orderstatus,o_totalprice"), ("joins", 0)])),
        "a_meta": (_meta, _values_sql("frame field type zone", [("date_ts", "ts", "timestamp_ntz", "America/Chicago"), ("terms_event_type", "event_type", "string", "")])),
        "a_unknown": (partial(_names_of, expression="count:x nosuch:(a min:o_totalprice) max:o_totalprice"), _values_sql("name rows", [("min_o_totalprice", 1), ("max_o_totalprice", 1)])),
        "a_group_forms": (partial(_names_of, expression="min:(o_totalprice max:o_totalprice) terms:(o_orderstatus~2)"), _values_sql("name rows", [("max_o_totalprice", 1), ("terms_o_orderstatus", 2)])),
        "a_keyword": (partial(_agg, "documents", "terms:lang.keyword", "terms_lang.keyword", analyzed_fields=("lang",)), 'SELECT lang AS "lang.keyword", count(*) AS doc_count FROM documents WHERE lang IS NOT NULL GROUP BY 1'),
        "a_count_ext": (partial(_agg, "orders", "terms:(o_orderstatus count:_)", "terms_o_orderstatus", extensions=frozenset({"count"})), "SELECT o_orderstatus, count(*) AS doc_count, count(*) AS count__ FROM orders GROUP BY 1"),
        "a_root_hits": (lambda sp, d: QueryEngine(tophits_order="-o_totalprice o_orderkey").aggregate(_orders(sp, d), "tophits:(_~4 @exclude:o_orderstatus)")["tophits"].select(F.explode("tophits").alias("h")).select("h.o_orderkey", "h.o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 4"),
        "s_form": s(_accented, "word p_partkey", key, f"SELECT p_partkey FROM {_WORDS} ORDER BY form, p_partkey", sort_fields=("word",)),
        "s_sub_field": s(_accented, "-word.sort p_partkey", key, f"SELECT p_partkey FROM {_WORDS} ORDER BY form DESC, p_partkey", sort_fields=("word",)),
        "s_keyword": s("part", "p_brand.keyword -p_partkey", key, "SELECT p_partkey FROM part ORDER BY p_brand, p_partkey DESC", sort_fields=("p_brand",), analyzed_fields=("p_brand",)),
        "s_unmapped": s("orders", "nosuch -o_orderkey", order, "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC"),
        "s_geo": s(_located, 'loc:"10,20" c_custkey', cust, f"SELECT c_custkey FROM {_LOCATED} ORDER BY round({near}, 3), c_custkey"),
        "s_override": (_sort_override, "SELECT o_orderkey FROM orders ORDER BY dayofweek(o_orderdate) IN (0, 6) DESC, o_orderkey"),
        "s_relational": s("orders", "-o_totalprice o_orderkey", order, "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey", mode="relational"),
        "st_tumbling": (partial(_windows, "tumbling"), "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS doc_count FROM events WHERE value > 10 GROUP BY 1, 2"),
        "st_sliding": (partial(_windows, "sliding"), "SELECT (time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR * k)::TIMESTAMP AS start, event_type, count(*) AS doc_count FROM events, (VALUES (0), (1)) v(k) WHERE value > 10 GROUP BY 1, 2"),
        "st_session": (partial(_windows, "session"), f'SELECT min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 2 DAY)::TIMESTAMP AS "end", user_id, count(*) AS doc_count FROM ({sessions}) GROUP BY user_id, n'),
    }


def _orders(spark: SparkSession, d: str) -> DataFrame:
    from .queries import table

    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
