"""Joins of a large table with a lookup of unique keys when some keys hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(big: DataFrame, lookup: DataFrame, on: list[str], weight: str, total: int, hot_keys: int = 1000, how: str = "inner") -> DataFrame:
    """``big`` joined with ``lookup``, whose keys ``on`` are unique.

    ``weight`` is the lookup's column with the number of rows of ``big`` that have the key, ``total``
    the sum of it. Keys with more than a ``1 / hot_keys`` share of the rows are joined by broadcast:
    there can be no more than ``hot_keys`` of them, whatever the input. The rest has no hot key and is
    joined as Spark plans it. ``weight`` isn't part of the result. Null keys match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    limit = max(1, total // hot_keys)
    values = [c for c in lookup.columns if c not in {*on, weight}]
    hot = lookup.where(F.col(weight) > limit).drop(weight)
    cold = lookup.where(F.col(weight) <= limit).drop(weight)
    marked = big.join(F.broadcast(hot.select(*on, F.struct(*values).alias("_hot"))), on, "left")
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(cold, on, how)
    done = marked.where(F.col("_hot").isNotNull()).select(*big.columns, *(F.col("_hot")[c].alias(c) for c in values))
    return done.unionByName(rest.select(*big.columns, *values))
