"""Parquet tables of a base directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import hadoop_path


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def stamp(spark: SparkSession, base: str, name: str) -> tuple[int, int, int]:
    """(files, bytes, latest change) of a table: another stamp, another content."""
    fs, p = hadoop_path(spark, f"{base.rstrip('/')}/{name}.parquet")
    at = fs.getFileStatus(p)
    files = list(fs.listStatus(p)) if at.isDirectory() else [at]
    return len(files), sum(f.getLen() for f in files), max([at.getModificationTime(), *(f.getModificationTime() for f in files)])


def run_sql(spark: SparkSession, base: str, names: list[str], sql: str, args: dict | list | None = None) -> DataFrame:
    """A query over tables of ``base``, given as ``{name}`` in ``sql``; values come in as parameters, so that none is read as SQL."""
    return spark.sql(sql, args=args, **{n: table(spark, base, n) for n in names})
