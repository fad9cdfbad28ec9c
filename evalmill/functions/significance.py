"""Significance tests on aggregated counts and on paired answers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def mcnemar_p(a_only: pd.Series, b_only: pd.Series) -> pd.Series:
    """Two-sided p: exact below 25 discordant pairs, else by chi squared with continuity correction; 1 for none."""

    def p(a: int, b: int) -> float:
        n = a + b
        if not n:
            return 1.0
        if n < 25:
            return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(a, b) + 1)) / 2**n)
        return math.erfc(math.sqrt((abs(a - b) - 1) ** 2 / n / 2))

    return pd.Series([p(int(a), int(b)) for a, b in zip(a_only, b_only)])


def bootstrap_interval(cells: DataFrame, keys: list[str], iterations: int = 5000, seed: int = 42) -> DataFrame:
    """95 % limits of accuracy_a - accuracy_b by resampling questions, for each pair of runs.

    A question's pair of verdicts is one of four cells, so that a resample is a draw from the
    multinomial of the four counts (``both``, ``a_only``, ``b_only``, ``neither``): the same
    distribution as drawing questions one by one, from one row for each pair of runs.
    """
    schema = T.StructType([*(f for f in cells.schema.fields if f.name in keys), T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType())])

    def resample(batches):
        for b in batches:
            low, high = [], []
            for counts in b[["both", "a_only", "b_only", "neither"]].to_numpy("int64"):
                n = counts.sum()
                draws = np.random.default_rng(seed).multinomial(n, counts / n, iterations) if n else np.zeros((1, 4))
                lo, hi = np.percentile((draws[:, 1] - draws[:, 2]) / max(n, 1), [2.5, 97.5])
                low.append(float(lo))
                high.append(float(hi))
            yield b[keys].assign(ci_low=low, ci_high=high)

    return cells.select(*keys, "both", "a_only", "b_only", "neither").mapInPandas(resample, schema)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + i - 1) * (a + i))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + i - 1) * (a + i))
        d = 1.0 / (1.0 + term * d or tiny)
        c = 1.0 + term / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * (f - 1.0) / a


@F.pandas_udf(T.DoubleType())
def student_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation of n pairs, by Student's t with n - 2 degrees of freedom; 0 for a perfect one, null for fewer than 3."""

    def p(r: float | None, k: int) -> float | None:
        if r is None or r != r or k < 3:
            return None
        return 0.0 if abs(r) >= 1.0 else _incomplete_beta((k - 2) / 2, 0.5, 1.0 - r * r)

    return pd.Series([p(r, int(k)) for r, k in zip(rho, n)], dtype="float64")


def average_rank(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """``counts`` (keys, value, n rows with it) with ``rank``: the mean rank of those rows."""
    w = Window.partitionBy(*keys).orderBy(value)
    upto = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("rank", upto - (F.col(n) - 1) / 2.0)


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of x and y for each group, with its two-sided p; NaN below 3 rows. Rows with a null are left out.

    Ranks are made from counts of distinct values, so that a group of any size is ranked by no more
    rows than it has different values.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("_n"))
    ranks = [average_rank(rows.groupBy(*keys, c).agg(F.sum("_n").alias("_k")), keys, c, "_k").select(*keys, c, F.col("rank").alias(f"_r{c}")) for c in (x, y)]
    joined = rows.join(ranks[0], [*keys, x]).join(ranks[1], [*keys, y])
    a, b, w = F.col(f"_r{x}"), F.col(f"_r{y}"), F.col("_n")
    s = joined.groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"))
    covariance = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    spread = F.sqrt((F.col("n") * F.col("saa") - F.col("sa") ** 2) * (F.col("n") * F.col("sbb") - F.col("sb") ** 2))
    rho = F.when(F.col("n") < 3, F.lit(float("nan"))).otherwise(F.try_divide(covariance, spread))
    return s.select(*keys, "n", rho.alias("rho")).withColumn("p_value", F.when(F.col("n") < 3, F.lit(float("nan"))).otherwise(student_p("rho", "n")))
