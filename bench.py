"""Wall-clock seconds of headline queries, as one JSON line.

Each query runs twice to warm up and then RUNS times, in turn with its counterpart `hand`, the same
query written with the DataFrame API; the medians count. `compile_ms` is the time to compile an expression alone.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from quillseek.api import QueryEngine
from quillseek.queries import engine_queries, table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
HEADLINE = (
    "f_and_range", "f_or_assoc", "f_not_null", "f_prefix", "f_date_range", "f_match", "f_phrase", "n_same_elem", "n_deep_neg",
    "j_semi", "j_anti", "j_under_or", "a_metrics", "a_percentiles", "a_terms_order", "a_terms_nested", "a_terms_perparent",
    "a_terms_survivors", "a_date_day", "a_date_tz", "a_hist", "a_tophits", "a_geogrid", "s_multi",
)


def by_hand(spark: SparkSession) -> dict[str, object]:
    """Counterparts without the engine, made anew for each run as the engine's are."""
    orders, lines, events, customer, part, docs = (lambda t=t: table(spark, SF_DIR, t) for t in ("orders", "lineitem", "events", "customer", "part", "documents"))
    c = F.col
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    token = r"[\p{L}\p{N}_]"
    size = F.count("*").alias("n")

    def items():
        return lines().groupBy("l_orderkey").agg(F.collect_list(F.struct(c("l_quantity").alias("qty"), c("l_returnflag").alias("flag"), c("l_linenumber").alias("line"))).alias("items"))

    def deep():
        inner = lines().groupBy("l_orderkey").agg(F.collect_list(F.struct(c("l_returnflag").alias("flag"))).alias("child"))
        both = orders().join(inner, c("o_orderkey") == c("l_orderkey"))
        return both.groupBy("o_custkey").agg(F.collect_list(F.struct(c("o_orderstatus").alias("status"), c("child"))).alias("parent"))

    def related(how):
        some = orders().where(c("o_totalprice") > 400000 if how == "left_semi" else c("o_orderstatus") == "P").select("o_custkey")
        return customer().join(some, c("c_custkey") == c("o_custkey"), how).select("c_custkey")

    def under_or():
        big = lines().where(c("l_quantity") > 49).select("l_orderkey").distinct().withColumn("big", F.lit(True))
        rich = customer().where(c("c_acctbal") > 0).select("c_custkey").withColumn("rich", F.lit(True))
        both = orders().join(big, c("o_orderkey") == c("l_orderkey"), "left").join(rich, c("o_custkey") == c("c_custkey"), "left")
        return both.where((c("o_orderstatus") == "P") | c("big").isNotNull() | c("rich").isNull()).select("o_orderkey")

    def filled(counts, key, step, by=()):
        ends = (counts.groupBy(*by) if by else counts.groupBy()).agg(F.min(key).alias("a"), F.max(key).alias("z"))
        every = ends.select(*by, F.explode(F.sequence("a", "z", step)).alias(key))
        return every.join(counts, [*by, key], "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy(*by, key)

    def days(shift):
        start = F.date_trunc("day", c("ts") - F.expr(shift)).cast("timestamp_ntz") + F.expr(shift)
        more = [F.sum("value")] if shift == "INTERVAL 0 HOUR" else []
        return filled(events().groupBy(start.alias("k")).agg(size, *more), "k", F.expr("INTERVAL 1 DAY"))

    def top(df, keys, order, n):
        return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(c("rn") <= n)

    def nested():
        rows = lines().groupBy("l_returnflag", "l_linestatus").agg(size, F.sum("l_quantity"))
        best = lines().groupBy("l_returnflag").agg(size).orderBy(F.desc("n"), "l_returnflag").limit(10).select("l_returnflag")
        return top(rows.join(best, "l_returnflag", "left_semi"), ["l_returnflag"], [F.desc("n"), "l_linestatus"], 10).orderBy("l_returnflag", F.desc("n"), "l_linestatus")

    def per_parent():
        best = events().groupBy("event_type").agg(size).orderBy(F.desc("n"), "event_type").limit(10).select("event_type")
        rows = events().join(best, "event_type", "left_semi").groupBy("event_type", "user_id").agg(size)
        return top(rows, ["event_type"], [F.desc("n"), "user_id"], 3).orderBy("event_type", F.desc("n"), "user_id")

    def survivors():
        best = orders().groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).orderBy(F.desc("s"), "o_custkey").limit(5).select("o_custkey")
        rows = orders().join(best, "o_custkey", "left_semi").groupBy("o_custkey", "o_orderstatus").agg(size)
        return top(rows, ["o_custkey"], [F.desc("n"), "o_orderstatus"], 10).orderBy("o_custkey", F.desc("n"), "o_orderstatus")

    def hits():
        best = top(orders(), ["o_orderstatus"], [F.desc("o_totalprice"), "o_orderkey"], 3).groupBy("o_orderstatus").agg(F.sort_array(F.collect_list(F.struct("rn", "o_orderkey"))).alias("h"))
        return orders().groupBy("o_orderstatus").agg(size).orderBy(F.desc("n")).limit(10).join(best, "o_orderstatus", "left")

    def grid():
        at = customer().withColumn("lat", F.pmod(c("c_custkey") * 37, F.lit(1700)) / 10 - 85).withColumn("lon", F.pmod(c("c_custkey") * 101, F.lit(3590)) / 10 - 179)
        x, y = F.floor((c("lon") + 180) / 360 * 256).cast("long"), F.floor((c("lat") + 90) / 180 * 128).cast("long")
        bit = lambda v, k: F.shiftright(v, k).bitwiseAND(F.lit(1).cast("long"))
        bits = [bit(x, 7 - i // 2) if i % 2 == 0 else bit(y, 6 - i // 2) for i in range(15)]
        letters = [F.substring(F.lit("0123456789bcdefghjkmnpqrstuvwxyz"), sum((b * (16 >> j) for j, b in enumerate(bits[k : k + 5])), F.lit(0)).cast("int") + 1, F.lit(1)) for k in (0, 5, 10)]
        return at.groupBy(F.concat(*letters).alias("cell")).agg(size, F.avg("lat"), F.avg("lon")).orderBy("cell")

    return {
        "f_and_range": lambda: orders().where((c("o_orderstatus") == "F") & (c("o_totalprice") >= 1000) & (c("o_totalprice") < 200000)).select("o_orderkey"),
        "f_or_assoc": lambda: lines().where((c("l_returnflag") == "A") | ((c("l_returnflag") == "R") & ((c("l_quantity") > 45) | (c("l_tax") < 0.01)))).select("l_orderkey", "l_linenumber"),
        "f_not_null": lambda: orders().withColumn("pri", F.nullif("o_orderpriority", F.lit("5-LOW"))).where(c("pri").isNull() | (c("pri") != "1-URGENT")).select("o_orderkey"),
        "f_prefix": lambda: part().where(c("p_brand").startswith("Brand#1")).select("p_partkey"),
        "f_date_range": lambda: events().where((c("ts") >= day("2024-01-05")) & (c("ts") < day("2024-01-10"))).select("event_id"),
        "f_match": lambda: docs().where(F.lower("text").rlike(f"(?<!{token})the(?!{token})")).select("doc_id"),
        "f_phrase": lambda: docs().where(F.lower("text").rlike(f"(?<!{token})of[^\\p{{L}}\\p{{N}}_]+the(?!{token})")).select("doc_id"),
        "n_same_elem": lambda: items().where(F.exists("items", lambda e: (e["qty"] > 45) & (e["flag"] == "R"))).select("l_orderkey"),
        "n_deep_neg": lambda: deep().where(F.exists("parent", lambda p: (p["status"] == "F") & ~F.exists(p["child"], lambda x: x["flag"] == "R"))).select("o_custkey"),
        "j_semi": lambda: related("left_semi"),
        "j_anti": lambda: related("left_anti"),
        "j_under_or": under_or,
        "a_metrics": lambda: events().agg(F.min("value"), F.max("value"), F.avg("value"), F.sum("value")),
        "a_percentiles": lambda: events().agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.95))), F.count_distinct("user_id")),
        "a_terms_order": lambda: orders().groupBy("o_custkey").agg(F.count("*"), F.max("o_totalprice").alias("m"), F.min("o_totalprice")).orderBy(F.desc("m"), "o_custkey").limit(7),
        "a_terms_nested": nested,
        "a_terms_perparent": per_parent,
        "a_terms_survivors": survivors,
        "a_date_day": lambda: days("INTERVAL 0 HOUR"),
        "a_date_tz": lambda: days("INTERVAL 6 HOUR"),
        "a_hist": lambda: filled(orders().groupBy(F.floor(c("o_totalprice") / 50000).alias("k")).agg(size, F.sum("o_totalprice")), "k", F.lit(1)),
        "a_tophits": hits,
        "a_geogrid": grid,
        "s_multi": lambda: orders().where(c("o_orderstatus") != "P").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(100).select("o_orderkey", "o_totalprice"),
    }


def once(make) -> float:
    began = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def in_turn(*makes) -> list[float]:
    """The median seconds of each, run in turn."""
    took = [[once(make) for make in makes] for _ in range(RUNS + 2)][2:]
    return [round(statistics.median(x), 4) for x in zip(*took, strict=True)]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("quillseek-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = engine_queries()
    hands, seconds, hand = by_hand(spark), {}, {}
    for name in HEADLINE:
        seconds[name], hand[name] = in_turn(lambda q=every[name][0]: q(spark, SF_DIR), hands[name])
    orders = table(spark, SF_DIR, "orders")
    engine, compiled = QueryEngine(), []
    for i in range(40):
        began = time.perf_counter()
        engine.predicate(orders, f"o_orderstatus:F AND o_totalprice:[{i} TO 200000}} AND NOT o_orderpriority:5*")
        compiled.append((time.perf_counter() - began) * 1000)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "hand": hand, "hand_total": round(sum(hand.values()), 3), "compile_ms": round(statistics.median(compiled[20:]), 2), "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
