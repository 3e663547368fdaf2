"""Registered queries of the engine, each with the SQL that gives the same rows.

A query names its table (or a derived input), its expression and the SQL. Doubles that come
from sums are rounded on both sides, as the order of additions differs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .api import EngineConfig, QueryEngine
from .sources import FieldCatalog, Relation

CLOCK = dt.datetime(2024, 1, 31)
Query = Callable[[SparkSession, str], DataFrame]


_schemas: dict[tuple[str, str], T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is read from the files once in an application."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def _orders_null(spark: SparkSession, d: str) -> DataFrame:
    """orders with a priority that is null for one of its values."""
    return table(spark, d, "orders").withColumn("pri", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))


def _events_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Orders' lines as arrays of structs."""
    item = F.struct(F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))


def _counted_items(spark: SparkSession, d: str) -> DataFrame:
    """_items with how many lines an order has, a field beside the nested ones."""
    return _items(spark, d).withColumn("n_lines", F.size("items"))


def _deep(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an array of orders, each with an array of lines."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"))).alias("child"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("status"), F.col("child"))).alias("parent"))


def _located(spark: SparkSession, d: str) -> DataFrame:
    """Customers at places made from their keys."""
    lat = (F.pmod(F.col("c_custkey") * 37, F.lit(1700)) / 10 - 85).alias("lat")
    lon = (F.pmod(F.col("c_custkey") * 101, F.lit(3590)) / 10 - 179).alias("lon")
    return table(spark, d, "customer").withColumn("loc", F.struct(lat, lon))


_LOCATED = "(SELECT *, ((c_custkey * 37) % 1700) / 10.0 - 85 AS lat, ((c_custkey * 101) % 3590) / 10.0 - 179 AS lon FROM customer)"
_ORDERS_NULL = "(SELECT *, nullif(o_orderpriority, '5-LOW') AS pri FROM orders)"
_EVENTS_NULL = "(SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)"


def _filter(source, expression: str, columns: list[str], spark: SparkSession, d: str, **config) -> DataFrame:
    df = source(spark, d) if callable(source) else table(spark, d, source)
    return QueryEngine(**config).filter(df, expression).select(*columns)


def _relations(spark: SparkSession, d: str) -> dict[str, dict[str, Relation]]:
    customer = Relation(table(spark, d, "customer"), "o_custkey", "c_custkey", "one")
    lines = Relation(table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")
    orders = Relation(table(spark, d, "orders"), "c_custkey", "o_custkey")
    parts = Relation(table(spark, d, "part"), "o_orderkey", "p_partkey", bridge=(table(spark, d, "lineitem"), "l_orderkey", "l_partkey"))
    return {"orders": {"customer": customer, "lineitem": lines, "parts": parts}, "customer": {"orders": orders}}


def _related(name: str, expression: str, columns: list[str], spark: SparkSession, d: str) -> DataFrame:
    return QueryEngine(mode="relational", relations=_relations(spark, d)[name]).filter(table(spark, d, name), expression).select(*columns)


def _agg(source, expression: str, name: str, spark: SparkSession, d: str, rounded: tuple[str, ...] = (), start=None, end=None, **config) -> DataFrame:
    df = source(spark, d) if callable(source) else table(spark, d, source)
    out = QueryEngine(**config).aggregate(df, expression, start=start, end=end)[name]
    return out.withColumns({c: F.round(c, 4) for c in rounded})


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    out = QueryEngine().metrics(table(spark, d, "events"), "min:value max:value avg:value sum:value")
    return out.withColumns({c: F.round(c, 4) for c in ("avg_value", "sum_value")})


def _exstats(spark: SparkSession, d: str) -> DataFrame:
    out = QueryEngine().metrics(table(spark, d, "events"), "stats:value exstats:value")
    s, x = F.col("stats_value"), F.col("exstats_value")
    columns = [s[c].alias(f"s_{c}") for c in ("count", "min", "max")] + [F.round(s[c], 4).alias(f"s_{c}") for c in ("avg", "sum")]
    return out.select(*columns, *[F.round(x[c], 4).alias(f"x_{c}") for c in ("sum_of_squares", "variance", "std_deviation", "std_upper", "std_lower")])


def _percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = QueryEngine().metrics(table(spark, d, "events"), "percentiles:value~50,95 cardinality:user_id")
    return out.select(F.round(F.col("percentiles_value")[0], 6).alias("p50"), F.round(F.col("percentiles_value")[1], 6).alias("p95"), "cardinality_user_id")


def _top_orders(spark: SparkSession, d: str) -> DataFrame:
    found = QueryEngine().search(table(spark, d, "orders"), "NOT o_orderstatus:P", sort="-o_totalprice +o_orderkey", limit=100, offset=10, fields=["o_orderkey", "o_totalprice"])
    return found.rows


def _hits(spark: SparkSession, d: str) -> DataFrame:
    out = QueryEngine(tophits_order="-o_totalprice o_orderkey").aggregate(table(spark, d, "orders"), "terms:(o_orderstatus tophits:(_~3 @include:o_orderkey))")
    return out["terms_o_orderstatus"].select("o_orderstatus", "doc_count", F.array_join(F.transform("tophits", lambda h: h["o_orderkey"].cast("string")), ",").alias("hits"))


def _inverted(spark: SparkSession, d: str) -> DataFrame:
    engine = QueryEngine()
    inverse = engine.invert("o_orderstatus:F AND o_totalprice:[1000 TO 200000}")
    return engine.filter(table(spark, d, "orders"), inverse).select("o_orderkey")


def _override(spark: SparkSession, d: str) -> DataFrame:
    """A rewrite of the caller's own sets a ready predicate: `big:yes` is a price over 400000."""
    from .lang.ast import walk

    def big(node, context):
        for n in walk(node):
            if n.field == "big":
                n.data["column"] = F.col("o_totalprice") > 400000
        return node

    engine = QueryEngine()
    engine.chains["query"].add(big, 20)
    return engine.filter(table(spark, d, "orders"), "NOT big:yes AND o_orderstatus:O").select("o_orderkey")


def _runtime(spark: SparkSession, d: str) -> DataFrame:
    fields = {"k": ("cast(get_json_object(props, '$.k') AS bigint)", T.LongType())}
    return QueryEngine(runtime_fields=fields).filter(table(spark, d, "events"), "k:>=50 AND event_type:(click OR view)").select("event_id")


def _streaming_safe(spark: SparkSession, d: str) -> DataFrame:
    """The compiled filter over a stream of the table's files, drained into a memory sink."""
    from .sources.streams import drained

    source = table(spark, d, "events")
    return drained(spark, source, f"{d}/events.parquet", lambda df: QueryEngine().filter(df, "event_type:click AND value:>100").select("event_id", "value"))


ORDER = ["o_orderkey"]
EVENT = ["event_id"]


def _filters() -> dict[str, tuple[Query, str]]:
    f = lambda source, expression, columns, sql, **config: (partial(_filter, source, expression, columns, **config), sql)
    analyzed = {"analyzed_fields": ("text",)}
    tokens = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
    clock = {"clock": lambda: CLOCK}
    return {
        "f_all": f("orders", "", ORDER, "SELECT o_orderkey FROM orders"),
        "f_term": f("events", "event_type:click", EVENT, "SELECT event_id FROM events WHERE event_type = 'click'"),
        "f_number": f("part", "p_size:7 OR p_size:nine", ["p_partkey"], "SELECT p_partkey FROM part WHERE p_size = 7"),
        "f_and_range": f("orders", "o_orderstatus:F AND o_totalprice:[1000 TO 200000}", ORDER, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_totalprice < 200000"),
        "f_open_range": f("lineitem", "l_quantity:{10 TO *] l_tax:[* TO 0.02]", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_tax <= 0.02"),
        "f_dots_range": f("part", "p_size:[5..9}", ["p_partkey"], "SELECT p_partkey FROM part WHERE p_size >= 5 AND p_size < 9"),
        "f_or_assoc": f("lineitem", "l_returnflag:A OR l_returnflag:R AND l_quantity:>45 OR l_tax:<0.01", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' OR (l_returnflag = 'R' AND (l_quantity > 45 OR l_tax < 0.01))"),
        "f_symbols": f("lineitem", "l_returnflag:A && !l_linestatus:O || -l_tax:>0.01", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND (l_linestatus <> 'O' OR NOT l_tax > 0.01)"),
        "f_search_mode": f("orders", "o_orderstatus:F o_orderpriority:\"1-URGENT\"", ORDER, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'", default_operator=_or()),
        "f_not_null": f(_orders_null, 'NOT pri:"1-URGENT"', ORDER, f"SELECT o_orderkey FROM {_ORDERS_NULL} WHERE pri IS DISTINCT FROM '1-URGENT'"),
        "f_not_group": f(_orders_null, 'NOT (pri:"1-URGENT" OR o_totalprice:<100000)', ORDER, f"SELECT o_orderkey FROM {_ORDERS_NULL} WHERE pri IS DISTINCT FROM '1-URGENT' AND o_totalprice >= 100000"),
        "f_not_range": f(_events_null, "-v:[10 TO 50]", EVENT, f"SELECT event_id FROM {_EVENTS_NULL} WHERE v IS NULL OR v < 10 OR v > 50"),
        "f_prefix": f("part", "p_brand:Brand#1*", ["p_partkey"], "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%'"),
        "f_any_value": f(_orders_null, "pri:*", ORDER, f"SELECT o_orderkey FROM {_ORDERS_NULL} WHERE pri IS NOT NULL"),
        "f_contains_rel": f("part", "p_name:*a*", ["p_partkey"], "SELECT p_partkey FROM part WHERE contains(p_name, 'a')", mode="relational"),
        "f_starts_rel": f("part", "p_brand:Brand#2*", ["p_partkey"], "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#2')", mode="relational"),
        "f_default_or": f("part", "Brand#13", ["p_partkey"], "SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' OR p_type = 'Brand#13'", default_fields=("p_brand", "p_type")),
        "f_default_rel": f("part", "Brand#1", ["p_partkey"], "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1') OR starts_with(p_name, 'Brand#1')", mode="relational", default_fields=("p_brand", "p_name")),
        "f_tokenizer_rel": f("part", "13,22", ["p_partkey"], "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#13', 'Brand#22')", mode="relational", default_fields=("p_brand",), tokenizer=lambda field, text: ([f"Brand#{t}" for t in text.split(",")], "equals")),
        "f_fulltext_rel": f("documents", "the", ["doc_id"], f"SELECT doc_id FROM documents WHERE len(list_filter({tokens}, lambda t: starts_with(t, 'the'))) > 0", mode="relational", default_fields=("text",), fulltext_fields=("text",)),
        "f_required": f("orders", "o_orderstatus:O OR +o_totalprice:>250000", ORDER, "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000"),
        "f_required_group": f("orders", "+(o_orderstatus:O OR o_totalprice:>250000)", ORDER, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 250000", required_mode="search"),
        "f_prohibited": f("orders", "o_orderstatus:O OR -o_orderpriority:\"5-LOW\"", ORDER, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_orderpriority <> '5-LOW'"),
        "f_field_group": f("orders", 'o_orderpriority:("1-URGENT" OR "2-HIGH")', ORDER, "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
        "f_group_range": f("orders", "o_totalprice:(>100000 AND <=150000)", ORDER, "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 150000"),
        "f_exists": f(_orders_null, "_exists_:pri", ORDER, f"SELECT o_orderkey FROM {_ORDERS_NULL} WHERE pri IS NOT NULL"),
        "f_missing": f(_orders_null, "_missing_:pri", ORDER, f"SELECT o_orderkey FROM {_ORDERS_NULL} WHERE pri IS NULL"),
        "f_unmapped": f("orders", "nosuch:1 OR _missing_:nosuch AND o_orderstatus:P", ORDER, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
        "f_date_range": f("events", "ts:[2024-01-05 TO 2024-01-10}", EVENT, "SELECT event_id FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-10'"),
        "f_date_tz": f("events", 'ts:[2024-01-05 TO 2024-01-09]^"America/Chicago"', EVENT, "SELECT event_id FROM events WHERE ts >= '2024-01-05 06:00:00' AND ts < '2024-01-10 06:00:00'"),
        "f_date_math": f("events", "ts:>now-7d", EVENT, "SELECT event_id FROM events WHERE ts > '2024-01-24'", **clock),
        "f_date_round": f("events", "ts:[now-10d/d TO 2024-01-01||+22d/d]", EVENT, "SELECT event_id FROM events WHERE ts >= '2024-01-21' AND ts < '2024-01-24'", **clock),
        "f_match": f("documents", "text:the", ["doc_id"], f"SELECT doc_id FROM documents WHERE list_contains({tokens}, 'the')", **analyzed),
        "f_match_any": f("documents", "text:the-une", ["doc_id"], f"SELECT doc_id FROM documents WHERE list_has_any({tokens}, ['the', 'une'])", **analyzed),
        "f_phrase": f("documents", 'text:"of the"', ["doc_id"], f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({tokens}, ' ') || ' ', ' of the ')", **analyzed),
        "f_match_prefix": f("documents", "text:idio*", ["doc_id"], f"SELECT doc_id FROM documents WHERE len(list_filter({tokens}, lambda t: starts_with(t, 'idio'))) > 0", **analyzed),
        "f_include": f("orders", "@include:big AND o_orderstatus:F", ORDER, "SELECT o_orderkey FROM orders WHERE (o_totalprice > 300000 OR o_orderpriority = '1-URGENT') AND o_orderstatus = 'F'", includes={"big": "o_totalprice:>300000 OR @include:urgent", "urgent": 'o_orderpriority:"1-URGENT"'}),
        "f_alias": f("orders", "price:>300000 status:F", ORDER, "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'", field_map={"price": "o_totalprice"}, aliases={"status": "o_orderstatus"}),
        "f_wildcard_ext": f("part", "p_brand:Br?nd#*3", ["p_partkey"], "SELECT p_partkey FROM part WHERE p_brand LIKE 'Br_nd#%3'", extensions=frozenset({"wildcards"})),
        "f_regex_ext": f("part", "p_brand:/Brand#[12]./", ["p_partkey"], "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[12].')", extensions=frozenset({"regex"})),
        "f_fuzzy_ext": f("events", "event_type:clik~1", EVENT, "SELECT event_id FROM events WHERE levenshtein(event_type, 'clik') <= 1", extensions=frozenset({"fuzzy"})),
        "f_geo_box": f(_located, 'loc:["40,-100" TO "-10,50"]', ["c_custkey"], f"SELECT c_custkey FROM {_LOCATED} WHERE lat BETWEEN -10 AND 40 AND lon BETWEEN -100 AND 50"),
        "f_geo_across": f(_located, 'loc:["60,150" TO "-60,-150"]', ["c_custkey"], f"SELECT c_custkey FROM {_LOCATED} WHERE lat BETWEEN -60 AND 60 AND (lon >= 150 OR lon <= -150)"),
        "f_geo_distance": f(_located, 'loc:"10,20"~2500km', ["c_custkey"], f"SELECT c_custkey FROM {_LOCATED} WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(lat - 10) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(lon - 20) / 2), 2)))) <= 2500000"),
        "n_same_elem": f(_items, "items:(items.qty:>45 items.flag:R)", ["l_orderkey"], "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'"),
        "n_coalesced": f(_counted_items, "items.qty:>45 AND n_lines:>3 AND items.flag:R", ["l_orderkey"], "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 3 AND bool_or(l_quantity > 45 AND l_returnflag = 'R')"),
        "n_or": f(_items, "items.qty:>49 OR items.flag:R", ["l_orderkey"], "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49 OR l_returnflag = 'R'"),
        "n_neg": f(_items, "NOT items.flag:R", ["l_orderkey"], "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
        "n_filter": f(_items, "items.flag:R", ["l_orderkey"], "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1", nested_filter=lambda path: "items.line:1"),
        "n_deep": f(_deep, "parent.status:F AND parent.child.flag:R", ["o_custkey"], "SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R'"),
        "n_deep_neg": f(_deep, "parent.status:F AND NOT parent.child.flag:R", ["o_custkey"], "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    }


def _or():
    from .lang import Op

    return Op.OR


def _joins() -> dict[str, tuple[Query, str]]:
    j = lambda name, expression, columns, sql: (partial(_related, name, expression, columns), sql)
    return {
        "j_lookup": j("orders", "customer.c_mktsegment:BUILDING AND o_orderstatus:F", ORDER, "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'"),
        "j_semi": j("customer", "orders.o_totalprice:>400000", ["c_custkey"], "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
        "j_anti": j("customer", "NOT orders.o_orderstatus:P", ["c_custkey"], "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
        "j_under_or": j("orders", "o_orderstatus:P OR lineitem.l_quantity:>49 OR NOT customer.c_acctbal:>0", ORDER, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)"),
        "j_separate": j("orders", "lineitem.l_quantity:>45 AND lineitem.l_returnflag:R", ORDER, "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"),
        "j_many_to_many": j("orders", "parts.p_brand:Brand#13", ORDER, "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_brand = 'Brand#13')"),
        "j_missing": j("orders", "_missing_:lineitem", ORDER, "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    }


def _aggs() -> dict[str, tuple[Query, str]]:
    a = lambda source, expression, name, sql, **more: (partial(_agg, source, expression, name, **more), sql)
    days = "SELECT unnest(generate_series((SELECT min(k) FROM g), (SELECT max(k) FROM g), INTERVAL {step})) AS ts"
    dates = lambda key, step, extra="", table="events", more="": f"WITH g AS (SELECT {key} AS k, count(*) AS n{extra} FROM {table} GROUP BY 1), s AS ({days.format(step=step)}) SELECT s.ts::TIMESTAMP AS ts, coalesce(n, 0)::BIGINT AS doc_count{more} FROM s LEFT JOIN g ON g.k = s.ts"
    return {
        "a_metrics": (_metrics, "SELECT min(value) AS min_value, max(value) AS max_value, round(avg(value), 4) AS avg_value, round(sum(value), 4) AS sum_value FROM events"),
        "a_stats": (_exstats, "SELECT count(value) AS s_count, min(value) AS s_min, max(value) AS s_max, round(avg(value), 4) AS s_avg, round(sum(value), 4) AS s_sum, round(sum(value * value), 4) AS x_sum_of_squares, round(var_pop(value), 4) AS x_variance, round(stddev_pop(value), 4) AS x_std_deviation, round(avg(value) + 2 * stddev_pop(value), 4) AS x_std_upper, round(avg(value) - 2 * stddev_pop(value), 4) AS x_std_lower FROM events"),
        "a_percentiles": (_percentiles, "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(DISTINCT user_id) AS cardinality_user_id FROM events"),
        "a_missing_value": a(_events_null, "avg:v~0", "avg_v", f"SELECT round(avg(coalesce(v, 0)), 4) AS avg_v FROM {_EVENTS_NULL}", rounded=("avg_v",)),
        "a_terms": a("events", "terms:event_type", "terms_event_type", "SELECT event_type, count(*) AS doc_count FROM events GROUP BY 1"),
        "a_terms_size": a("events", "terms:(user_id~5)", "terms_user_id", "SELECT user_id, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
        "a_terms_min": a("orders", "terms:(o_custkey~0 @min:15)", "terms_o_custkey", "SELECT o_custkey, count(*) AS doc_count FROM orders GROUP BY 1 HAVING count(*) >= 15"),
        "a_terms_missing": a(_orders_null, "terms:(pri @missing:none)", "terms_pri", f"SELECT coalesce(pri, 'none') AS pri, count(*) AS doc_count FROM {_ORDERS_NULL} GROUP BY 1"),
        "a_terms_incl_excl": a("events", "terms:(event_type @exclude:error @include:/c.*|p.*|e.*/)", "terms_event_type", "SELECT event_type, count(*) AS doc_count FROM events WHERE event_type <> 'error' AND regexp_full_match(event_type, 'c.*|p.*|e.*') GROUP BY 1"),
        "a_terms_order": a("orders", "terms:(o_custkey~7 -max:o_totalprice min:o_totalprice)", "terms_o_custkey", "SELECT o_custkey, count(*) AS doc_count, max(o_totalprice) AS max_o_totalprice, min(o_totalprice) AS min_o_totalprice FROM orders GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 7"),
        "a_terms_nested": a("lineitem", "terms:(l_returnflag terms:(l_linestatus sum:l_quantity))", "terms_l_returnflag>terms_l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS doc_count, round(sum(l_quantity), 4) AS sum_l_quantity FROM lineitem GROUP BY 1, 2", rounded=("sum_l_quantity",)),
        "a_terms_perparent": a("events", "terms:(event_type terms:(user_id~3))", "terms_event_type>terms_user_id", "SELECT event_type, user_id, doc_count FROM (SELECT event_type, user_id, count(*) AS doc_count, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rn FROM events GROUP BY 1, 2) WHERE rn <= 3"),
        "a_terms_survivors": a("orders", "terms:(o_custkey~5 -sum:o_totalprice terms:o_orderstatus)", "terms_o_custkey>terms_o_orderstatus", "SELECT o_custkey, o_orderstatus, count(*) AS doc_count FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 5) GROUP BY 1, 2"),
        "a_date_day": a("events", "date:(ts~day sum:value)", "date_ts", dates("date_trunc('day', ts)::TIMESTAMP", "1 DAY", ", round(sum(value), 4) AS sum_value", more=", sum_value"), rounded=("sum_value",)),
        "a_date_month": a("orders", "date:o_orderdate~month", "date_o_orderdate", dates("date_trunc('month', o_orderdate)::TIMESTAMP", "1 MONTH", table="orders").replace("s.ts::TIMESTAMP AS ts", "s.ts::TIMESTAMP AS o_orderdate")),
        "a_date_quarter": a("orders", "date:(o_orderdate~1q sum:o_totalprice)", "date_o_orderdate", dates("date_trunc('quarter', o_orderdate)::TIMESTAMP", "3 MONTH", ", round(sum(o_totalprice), 4) AS sum_o_totalprice", table="orders", more=", sum_o_totalprice").replace("s.ts::TIMESTAMP AS ts", "s.ts::TIMESTAMP AS o_orderdate"), rounded=("sum_o_totalprice",)),
        "a_date_tz": a("events", 'date:(ts~1d^"America/Chicago")', "date_ts", dates("(date_trunc('day', ts - INTERVAL 6 HOUR) + INTERVAL 6 HOUR)::TIMESTAMP", "1 DAY")),
        "a_date_offset": a("events", "date:(ts~day @offset:6h)", "date_ts", dates("(date_trunc('day', ts - INTERVAL 6 HOUR) + INTERVAL 6 HOUR)::TIMESTAMP", "1 DAY")),
        "a_date_fixed": a("events", "date:(ts~36h)", "date_ts", dates("make_timestamp((epoch_us(ts) // 129600000000) * 129600000000)", "36 HOUR")),
        "a_date_bounds": a("events", "date:ts~week", "date_ts", "WITH g AS (SELECT date_trunc('week', ts)::TIMESTAMP AS k, count(*) AS n FROM events GROUP BY 1), s AS (SELECT unnest(generate_series(least(TIMESTAMP '2023-12-04', (SELECT min(k) FROM g)), greatest(TIMESTAMP '2024-02-26', (SELECT max(k) FROM g)), INTERVAL 7 DAY)) AS ts) SELECT ts, coalesce(n, 0)::BIGINT AS doc_count FROM s LEFT JOIN g ON g.k = s.ts", start=dt.datetime(2023, 12, 5), end=dt.datetime(2024, 3, 1)),
        "a_hist": a("orders", "histogram:(o_totalprice~50000 sum:o_totalprice)", "histogram_o_totalprice", "WITH g AS (SELECT floor(o_totalprice / 50000)::BIGINT AS k, count(*) AS n, round(sum(o_totalprice), 4) AS m FROM orders GROUP BY 1) SELECT i * 50000.0::DOUBLE AS o_totalprice, coalesce(n, 0)::BIGINT AS doc_count, m AS sum_o_totalprice FROM (SELECT unnest(generate_series((SELECT min(k) FROM g), (SELECT max(k) FROM g))) AS i) LEFT JOIN g ON k = i", rounded=("sum_o_totalprice",)),
        "a_hist_gaps": a("events", "terms:(event_type histogram:(value~20))", "terms_event_type>histogram_value", "WITH g AS (SELECT event_type, floor(value / 20)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT event_type, unnest(generate_series(min(k), max(k))) AS i FROM g GROUP BY 1) SELECT b.event_type, i * 20.0::DOUBLE AS value, coalesce(n, 0)::BIGINT AS doc_count FROM b LEFT JOIN g ON g.event_type = b.event_type AND k = i"),
        "a_missing_bucket": a(_orders_null, "terms:(o_orderstatus missing:pri)", "terms_o_orderstatus>missing_pri", f"SELECT o_orderstatus, count(*) AS doc_count FROM {_ORDERS_NULL} WHERE pri IS NULL GROUP BY 1"),
        "a_tophits": (_hits, "SELECT o_orderstatus, doc_count, hits FROM (SELECT o_orderstatus, count(*) AS doc_count FROM orders GROUP BY 1) JOIN (SELECT o_orderstatus, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3 GROUP BY 1) USING (o_orderstatus)"),
        "n_agg": a(_items, "terms:(items.flag max:items.qty)", "terms_items.flag", 'SELECT l_returnflag AS "items.flag", count(*) AS doc_count, max(l_quantity) AS "max_items.qty" FROM lineitem GROUP BY 1'),
        "n_agg_filter": a(_items, "terms:items.flag", "terms_items.flag", 'SELECT l_returnflag AS "items.flag", count(*) AS doc_count FROM lineitem WHERE l_linenumber = 1 GROUP BY 1', nested_filter=lambda path: "items.line:1"),
    }


def _geogrid_sql(precision: int) -> str:
    """A geohash in SQL: bits of both coordinates, interleaved, in groups of five."""
    n = precision * 5
    x, y = (n + 1) // 2, n // 2
    bits = [f"((lonb >> {x - 1 - i // 2}) & 1)" if i % 2 == 0 else f"((latb >> {y - 1 - i // 2}) & 1)" for i in range(n)]
    chars = " || ".join(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', ({' + '.join(f'{b} * {16 >> j}' for j, b in enumerate(bits[k : k + 5]))} + 1)::BIGINT, 1)" for k in range(0, n, 5))
    cells = f"(SELECT *, least(floor((lon + 180) / 360 * {1 << x})::BIGINT, {(1 << x) - 1}) AS lonb, least(floor((lat + 90) / 180 * {1 << y})::BIGINT, {(1 << y) - 1}) AS latb FROM {_LOCATED})"
    return f"SELECT {chars} AS loc, count(*) AS doc_count, round(avg(lat), 4) AS avg_lat, round(avg(lon), 4) AS avg_lon FROM {cells} GROUP BY 1"


def _others() -> dict[str, tuple[Query, str | None]]:
    return {
        "a_geogrid": (partial(_agg, _located, "geogrid:(loc~3)", "geogrid_loc", rounded=("avg_lat", "avg_lon")), _geogrid_sql(3)),
        "s_multi": (_top_orders, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 10"),
        "s_group": (lambda s, d: QueryEngine().sort(table(s, d, "part"), "-(p_size p_brand +p_partkey)").select("p_partkey"), "SELECT p_partkey FROM part ORDER BY p_size DESC, p_brand DESC, p_partkey"),
        "s_nulls": (lambda s, d: QueryEngine().sort(_orders_null(s, d), "pri -o_orderkey").select("pri", "o_orderkey"), f"SELECT pri, o_orderkey FROM {_ORDERS_NULL} ORDER BY pri NULLS LAST, o_orderkey DESC"),
        "s_nested": (lambda s, d: QueryEngine().sort(_items(s, d), "-items.qty l_orderkey").select("l_orderkey"), "SELECT l_orderkey FROM lineitem GROUP BY 1 ORDER BY max(l_quantity) DESC, 1"),
        "v_invert": (_inverted, "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_totalprice < 200000)"),
        "v_override": (_override, "SELECT o_orderkey FROM orders WHERE NOT o_totalprice > 400000 AND o_orderstatus = 'O'"),
        "c_runtime": (_runtime, "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::BIGINT >= 50 AND event_type IN ('click', 'view')"),
        "st_filter": (_streaming_safe, "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 100"),
    }


def engine_queries() -> dict[str, tuple[Query, str | None]]:
    from .queries_rules import rule_queries

    return {**_filters(), **_joins(), **_aggs(), **_others(), **rule_queries()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, then buckets in the order of a metric."""
    engine = QueryEngine(EngineConfig(), None)
    found = engine.filter(table(spark, sf_dir, "orders"), 'o_orderstatus:F AND o_totalprice:[1000 TO 200000} AND NOT o_orderpriority:"5-LOW"')
    return engine.aggregate(found, "terms:(o_orderpriority -sum:o_totalprice)")["terms_o_orderpriority"]


__all__ = ["FieldCatalog", "engine_queries", "flagship"]
