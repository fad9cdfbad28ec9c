"""The last line of an append-only log counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(log: DataFrame, keys: list[str], position: str, numbered: bool = False) -> DataFrame:
    """One row for each key, that of the greatest ``position``; combined before the shuffle, so that a
    key with any number of lines is as cheap as others. Of lines with one position the greatest row is taken.

    If positions are ``numbered``, no two lines of the log having the same one, only the positions of superseded
    lines are looked up, and no line is sorted with its texts.
    """
    if numbered:
        best = log.groupBy(*keys).agg(F.max(position).alias("_best"), F.count("*").alias("_lines")).where("_lines > 1").withColumnsRenamed({k: f"_{k}" for k in keys})
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
        superseded = log.select(*keys, position).join(best, same).where(F.col(position) < F.col("_best")).select(position)
        return log.join(superseded, position, "left_anti").select(*log.columns)
    rest = [c for c in log.columns if c not in keys and c != position]
    best = log.groupBy(*keys).agg(F.max(F.struct(position, *rest)).alias("_r"))
    return best.select(*(F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in log.columns))


def first_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row for each key, that of the smallest ``position``."""
    rest = [c for c in rows.columns if c not in keys and c != position]
    best = rows.groupBy(*keys).agg(F.min(F.struct(position, *rest)).alias("_r"))
    return best.select(*(F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in rows.columns))
