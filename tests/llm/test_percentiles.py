"""Percentiles by radix selection, against sorted lists and SQL."""

import math
import random

from oracle import check
from pyspark.sql import functions as F

from evalmill.llm import percentiles as radix

Q = [0.0, 0.5, 0.9, 1.0]
SETS = [{"g": "g"}]


def exact(spark, rows, sets=SETS):
    keys = radix.encoded(spark.createDataFrame(rows, "g string, day int, v double"), ["g", "day"], "v")
    targets = radix.first_digit(radix.merge(radix.summarise(keys, ["g", "day"]), ["g"]), sets, Q)
    return {(r._g.g, r.q): (r.value, r.total) for r in radix.select_exactly(keys, targets, sets).collect()}, {(r._g.g, r.q): (r.lo, r.hi) for r in radix.within_bounds(targets).collect()}


def test_queries_equal_sql(spark, small):
    check("p2_summaries", spark, small)
    check("p2_percentiles", spark, small)


def test_bounds_hold_the_exact_values(spark, small, q):
    a = q["p2_percentiles"](spark, small).collect()
    b = {(r.dimension, r.level, r.group_value, r.batch_no): r for r in q["p2_bounds"](spark, small).collect()}
    for r in a:
        s = b[r.dimension, r.level, r.group_value, r.batch_no]
        for p in ("p50", "p90", "p95", "p99"):
            assert s[f"{p}_lo"] <= r[p] <= s[f"{p}_hi"] and s[f"{p}_hi"] - s[f"{p}_lo"] <= abs(r[p]) / 15.9 + 1e-300


def test_against_sorted_lists(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), rng.randrange(3), rng.choice([rng.gauss(0, 1e-3), rng.expovariate(1e-6), -rng.random(), 0.0, -0.0, round(rng.random(), 1)])) for _ in range(900)]
    rows += [("a", 1, None), ("nothing", 1, None), ("one", 2, 5.5), ("inf", 0, math.inf), ("inf", 0, -math.inf), ("inf", 1, math.nan)]
    got, bounds = exact(spark, rows)
    assert not any(k[0] == "nothing" for k in got)
    for g in ("a", None, "one"):
        values = sorted(v for x, _, v in rows if x == g and v is not None)
        for p in Q:
            want = values[max(1, math.ceil(p * len(values) - 1e-9)) - 1]
            assert got[g, p] == (want, len(values)) and bounds[g, p][0] <= want <= bounds[g, p][1]
    assert got["inf", 0.0][0] == -math.inf and got["inf", 1.0][0] is None


def test_order_of_bits(spark):
    values = [-math.inf, -1e300, -1.5, -1e-320, 0.0, 1e-320, 1.0, math.inf]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", radix.ordered_bits("v").alias("b"), "v").orderBy("b").collect()
    assert [r.i for r in rows] == list(range(len(values)))
    back = spark.createDataFrame([(r.b,) for r in rows], "b bigint").select(radix.from_bits("b").alias("v")).collect()
    assert [r.v for r in back] == values


def test_parts_merge(spark):
    df = radix.encoded(spark.range(1000).select(F.lit("a").alias("g"), (F.col("id") % 5).cast("int").alias("day"), F.rand(1).alias("v")), ["g", "day"], "v")
    parts = None
    for d in range(5):
        one = radix.summarise(df.where(F.col("day") == d), ["g", "day"])
        parts = one if parts is None else parts.unionByName(one)
    whole = {(r.prefix): r.n for r in radix.summarise(df, ["g"]).collect()}
    assert {(r.prefix): r.n for r in radix.merge(parts, ["g"]).collect()} == whole


def test_empty(spark):
    assert exact(spark, [("a", 1, None)]) == ({}, {})
