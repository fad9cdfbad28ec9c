"""Structured Streaming editions of the silver stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.compaction import last_wins
from ..operators.messages import SeenMessages
from ..session import scratch
from ..sources.sinks import replace_partitions


def deduplicated(stream: DataFrame, keys: list[str], order: str, store: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append to ``out`` the first arrival of each message, over all micro-batches.

    What was seen lies in the bitmaps under ``store``. A micro-batch writes its rows under its own
    number and only then unites its bits; run again after a failure, it replaces what it wrote.
    """
    spark = stream.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        SeenMessages(spark, store, keys).admit(batch, order, lambda kept: kept.write.mode("overwrite").parquet(f"{out}/batch={number}"), mark=f"batch-{number}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compacted(spark: SparkSession, stream: DataFrame, position: str, out: str, checkpoint: str) -> StreamingQuery:
    """Keep under ``out``, by run, the last logged call of each question; only the runs of a micro-batch are rewritten."""

    def handle(batch: DataFrame, number: int) -> None:
        runs = batch.select("run_id").distinct()
        try:
            old = spark.read.parquet(out).join(runs, "run_id", "left_semi").select(*batch.columns)
            rows = batch.unionByName(old)
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            rows = batch
        replace_partitions(scratch(last_wins(rows, ["run_id", "question_id"], position), "compacted"), out)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers_per_window(stream: DataFrame, time: str = "called_at", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Answers, right ones and mean time by window of event time and run; later rows than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "run_id").agg(
        F.count("*").alias("n"), F.count_if("ai_correct").alias("n_correct"), F.avg("response_time").alias("mean_response_time")
    )
