"""Percentiles by radix selection.

A double becomes an integer of the same order. A histogram of its leading digit is a summary that
can be added to those of other partitions, batches or days. The percentiles of any union of them are
found by following, digit by digit, only the bins that hold a target rank: after the first digit with
the error that a bin's width states, after all four exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch

DIGIT = 16
DIGITS = 64 // DIGIT


@F.pandas_udf(T.LongType())
def ordered_bits(values: pd.Series) -> pd.Series:
    """Integers in the order of the doubles; -0.0 as 0.0, NaN above all."""
    v = values.to_numpy("float64") + 0.0
    bits = np.where(np.isnan(v), np.float64("nan"), v).view("int64")
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(T.DoubleType())
def from_bits(bits: pd.Series) -> pd.Series:
    b = bits.to_numpy("int64")
    return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b).view("float64"))


def encoded(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The key columns and ``_bits`` of the rows with a value; nulls are no values."""
    return df.where(F.col(value).isNotNull()).select(*keys, ordered_bits(F.col(value).cast("double")).alias("_bits"))


def summarise(keys: DataFrame, by: list[str], digits: int = 1) -> DataFrame:
    """(by, prefix, n): the mergeable summary of ``encoded`` rows. Add them with ``merge``."""
    return keys.groupBy(*by, F.shiftright("_bits", 64 - DIGIT * digits).alias("prefix")).agg(F.count("*").alias("n"))


def merge(summaries: DataFrame, by: list[str]) -> DataFrame:
    """Summaries of several parts as one of their union, for coarser keys ``by``."""
    return summaries.groupBy(*by, "prefix").agg(F.sum("n").alias("n"))


def follow(summary: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` (_g, q, parent, rank) moved into the bin of ``summary`` (_g, parent, prefix, n) that holds
    the rank; the rank then counts within that bin. A window holds at most 2^16 bins."""
    w = Window.partitionBy("_g", "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    bins = summary.withColumn("_upto", F.sum("n").over(w))
    hit = (F.col("rank") > F.col("_upto") - F.col("n")) & (F.col("rank") <= F.col("_upto"))
    return targets.join(bins, ["_g", "parent"]).where(hit).select("_g", "q", "total", (F.col("rank") - F.col("_upto") + F.col("n")).alias("rank"), F.col("prefix").alias("parent"))


def _groups(sets: list[dict[str, str]]):
    """Each row's groups, one for each grouping set, as an array to explode."""
    return F.explode(F.array(*(F.struct(*(F.expr(e).alias(k) for k, e in s.items())) for s in sets))).alias("_g")


def first_digit(summary: DataFrame, sets: list[dict[str, str]], quantiles: list[float]) -> DataFrame:
    """Where each quantile of each group lies after one digit: (_g, q, total, rank, parent)."""
    bins = summary.select(_groups(sets), "prefix", "n").groupBy("_g", "prefix").agg(F.sum("n").alias("n")).withColumn("parent", F.lit(0).cast("bigint"))
    q = F.explode(F.array(*(F.lit(float(x)) for x in quantiles))).alias("q")
    totals = bins.groupBy("_g").agg(F.sum("n").alias("total"))
    # The smallest value with at least a share q of the values up to it; the term keeps 0.9 * 10 at 9.
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("total") - 1e-9)).cast("bigint")
    targets = totals.select("_g", "total", q, F.lit(0).cast("bigint").alias("parent")).withColumn("rank", rank)
    return follow(bins, targets)


def within_bounds(targets: DataFrame, digits: int = 1) -> DataFrame:
    """(_g, q, total, lo, hi): the limits between which the quantile lies.

    With the 16 bits of one digit (sign, exponent, 4 bits of the mantissa), hi - lo is at most 1/16 of
    the value; each further digit divides that by 65,536.
    """
    width = 64 - DIGIT * digits
    lo = F.shiftleft(F.col("parent"), width)
    return targets.select("_g", "q", "total", from_bits(lo).alias("lo"), from_bits(lo + ((1 << width) - 1)).alias("hi"))


def select_exactly(keys: DataFrame, targets: DataFrame, sets: list[dict[str, str]]) -> DataFrame:
    """(_g, q, total, value): the targets of ``first_digit`` followed to the last digit.

    NaN counts above all numbers; a quantile that falls on one is null.

    The rows outside the bins that hold a target are dropped after the first digit; what is left is
    written once and read for each further digit.
    """
    targets = scratch(targets, "targets")
    wanted = targets.select("_g", "parent").distinct()
    # Rows outside every group's bins go before they are multiplied by their groups; there are at most 2^16 bins.
    parents = F.broadcast(wanted.select("parent").distinct())
    inside = keys.withColumn("parent", F.shiftright("_bits", 64 - DIGIT)).join(parents, "parent", "left_semi")
    long = inside.select(_groups(sets), "_bits", "parent")
    rest = scratch(long.join(wanted, ["_g", "parent"], "left_semi").groupBy("_g", "_bits").agg(F.count("*").alias("n")), "survivors")
    for k in range(2, DIGITS + 1):
        at, up = 64 - DIGIT * k, 64 - DIGIT * (k - 1)
        bins = rest.groupBy("_g", F.shiftright("_bits", up).alias("parent"), F.shiftright("_bits", at).alias("prefix")).agg(F.sum("n").alias("n"))
        targets = scratch(follow(bins.join(targets.select("_g", "parent").distinct(), ["_g", "parent"], "left_semi"), targets), "targets")
    return targets.select("_g", "q", "total", from_bits("parent").alias("value"))
