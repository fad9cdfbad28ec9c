"""Session defaults and the shared scratch area of an application."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Defaults for a session this package builds itself; a session handed in is used as it is.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
}

_roots: dict[str, str] = {}


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with this package's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName("evalmill")
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, one for each application.

    It lies in the folder that the cluster names in ``spark.checkpoint.dir``, which every executor
    shares. Where that is unset a temporary folder is made, but only for a local master: executors on other
    machines would write to disks of their own.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-evalmill-")
            spark.sparkContext.setCheckpointDir(base)
        _roots[app] = f"{base.rstrip('/')}/evalmill-{uuid.uuid4().hex[:12]}"
        atexit.register(_forget, spark, app)
    return _roots[app]


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop objects."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _forget(spark: SparkSession, app: str) -> None:
    try:
        fs, p = hadoop_path(spark, _roots.pop(app))
        fs.delete(p, True)
    except Exception:  # the session may be gone already
        pass


def scratch(df: DataFrame, label: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once into the shared scratch folder and return it as read from there.

    This cuts the lineage in a way that survives lost executors, and fixes whatever a plan computes
    that another run of it would number or order differently.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Tasks for work that costs far more than moving its rows."""
    return max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *by: str, tasks_per_core: int = 2) -> DataFrame:
    """``df`` moved by a hash of ``by`` to enough tasks to keep all cores busy.

    A compressed file of a few MB, one row group and so one task, holds rows whose judging takes minutes.
    """
    return df.repartition(max(1, tasks(df.sparkSession) * tasks_per_core // 2), *by)
