"""Writers: appended logs, partitions that are replaced, tables that are published at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import hadoop_path


def append_csv(df: DataFrame, path: str) -> None:
    """Blanks at the ends of texts stay."""
    df.write.mode("append").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_parquet(df: DataFrame, path: str, files: int | None = None) -> None:
    (df.coalesce(files) if files else df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str = "run_id") -> None:
    """Replace exactly the partitions that ``df`` has rows of; a run of any size is spread over several files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(by).parquet(path)


def publish(tables: dict[str, DataFrame], root: str, checks: list[DataFrame] = ()) -> str:
    """Write a version of all tables, check it, then make it the current one by a single rename.

    A violated check or an empty result raises and leaves what was published as it is.
    """
    if not tables:
        raise ValueError("nothing to publish")
    spark = next(iter(tables.values())).sparkSession
    version = f"build-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        write_parquet(df, f"{root}/{version}/{name}")
    problems = [i for i, c in enumerate(checks) if c.limit(1).count()]
    empty = all(not spark.read.parquet(f"{root}/{version}/{n}").limit(1).count() for n in tables)
    fs, at = hadoop_path(spark, f"{root}/{version}")
    if problems or empty:
        fs.delete(at, True)
        raise ValueError("nothing was built" if empty else f"checks failed: {problems}")
    _, pointer = hadoop_path(spark, f"{root}/CURRENT")
    _, new = hadoop_path(spark, f"{root}/CURRENT-{version}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(fs.makeQualified(new), fs.makeQualified(pointer), how)
    return version


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current version."""
    version = json.loads(spark.read.text(f"{root}/CURRENT").first().value)["version"]
    return spark.read.parquet(f"{root}/{version}/{name}")
