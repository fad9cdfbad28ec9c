"""Tables written as the files they came from, and read back by the bronze readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..session import scratch_root
from ..sources import bronze, sinks
from ..sources.schemas import QUESTIONS_CSV
from ..sources.tables import table

catalog = Catalog()
CSV = [c.strip().split()[0] for c in QUESTIONS_CSV.split(",")]
LOG = ["run_id", "question_id", "run_order", "content", "reasoning", "completion_tokens", "response_time", "finish_reason", "error", "attempt"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@catalog.add("bronze_questions", f"SELECT {', '.join(CSV)} FROM raw_questions")
def bronze_questions(spark: SparkSession, base: str) -> DataFrame:
    """Raw questions as CSV with line breaks, quotes and blanks in their texts."""
    path = _folder(spark, "csv")
    sinks.append_csv(table(spark, base, "raw_questions").select(*CSV), path)
    return bronze.questions_csv(spark, path)


@catalog.add("bronze_log", f"SELECT {', '.join(LOG)} FROM llm_responses")
def bronze_log(spark: SparkSession, base: str) -> DataFrame:
    """Logged calls as JSON lines."""
    path = _folder(spark, "log")
    sinks.append_json(table(spark, base, "llm_responses").select(*LOG), path)
    return bronze.response_log(spark, path).select(*LOG)


@catalog.add("finished_calls", "SELECT DISTINCT run_id, question_id FROM llm_responses WHERE error IS NULL")
def finished_calls(spark: SparkSession, base: str) -> DataFrame:
    """What a run needn't ask again, as its log tells."""
    path = _folder(spark, "log")
    sinks.append_json(table(spark, base, "llm_responses").select("run_id", "question_id", "error"), path)
    return bronze.finished_ids(spark, path)


@catalog.add("partitioned_answers", "SELECT run_id, count(*) AS n, sum(answer_id)::bigint AS ids FROM fct_answer GROUP BY 1")
def partitioned_answers(spark: SparkSession, base: str) -> DataFrame:
    """Answers in a folder for each run, of which one run's is written anew: nothing of the others changes."""
    path = _folder(spark, "answers")
    rows = table(spark, base, "fct_answer").select("run_id", "answer_id", "question_id")
    sinks.replace_partitions(rows, path)
    again = rows.agg(F.max("run_id")).first()[0]
    sinks.replace_partitions(rows.where(F.col("run_id") == again), path)
    read = bronze.answers(spark, path, "run_id string, answer_id bigint, question_id string, later string")
    return read.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("answer_id").alias("ids"))
