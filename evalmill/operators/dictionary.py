"""Exact dictionary encoding: one integer for each distinct value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch


def assign_codes(distinct: DataFrame, keys: list[str], code: str, start: int = 0, n_parts: int | None = None) -> DataFrame:
    """``distinct`` (one row for each key) with a column ``code`` of different non-negative integers.

    Rows are hashed into partitions; partition p of P gives its i-th row the code ``start + i*P + p``,
    so that no counts have to be gathered and codes leave few gaps. The result is written to the
    scratch folder, as a second run could number the rows otherwise.
    """
    spark = distinct.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*distinct.schema.fields, T.StructField(code, T.LongType(), False)])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, p = 0, TaskContext.get().partitionId()
        for b in batches:
            b[code] = start + (at + np.arange(len(b), dtype="int64")) * n + p
            at += len(b)
            yield b

    return scratch(distinct.repartition(n, *keys).mapInPandas(number, schema), f"dict-{code}")
