"""Queries of repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog
from ..operators.messages import keep_one, surplus_arrivals
from ..sources.tables import table

catalog = Catalog()
KEYS = ["run_id", "question_id"]


@catalog.add(
    "p6_found",
    """SELECT kept_id, answer_id AS copy_id FROM (
         SELECT answer_id, min(answer_id) OVER (PARTITION BY run_id, question_id) AS kept_id
         FROM fct_answer WHERE run_id IS NOT NULL AND question_id IS NOT NULL)
       WHERE answer_id <> kept_id""",
)
def p6_found(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "fct_answer").select(*KEYS, "answer_id", "batch_no")
    return surplus_arrivals(rows, KEYS, "answer_id", "batch_no").withColumnsRenamed({"kept": "kept_id", "copy": "copy_id"})


@catalog.add(
    "p6_kept",
    """SELECT * EXCLUDE (rn) FROM (
         SELECT answer_id, run_id, question_id, grade, response_time, batch_no,
                row_number() OVER (PARTITION BY run_id, question_id ORDER BY answer_id) AS rn FROM fct_answer)
       WHERE rn = 1""",
)
def p6_kept(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "fct_answer").select("answer_id", *KEYS, "grade", "response_time", "batch_no")
    return keep_one(rows, KEYS, "answer_id", "batch_no")
