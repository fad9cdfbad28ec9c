"""Bronze to silver: questions from the raw records, graded answers from the response log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.grading import grade
from ..functions.ids import option_seed, question_id, shuffled_options
from ..functions.text import category_group, clean_text, clean_texts, word_count
from ..operators.compaction import first_wins, last_wins
from ..sources.tables import table

catalog = Catalog()
FEWSHOT_CATEGORY, FEWSHOT_PER_TYPE = "General Knowledge", 2


def with_fewshot(questions: DataFrame, category: str = FEWSHOT_CATEGORY, per_type: int = FEWSHOT_PER_TYPE) -> DataFrame:
    """Mark the first identifiers of each type in ``category`` (in all categories, for a type that has none there)."""
    order = Window.partitionBy("type").orderBy(F.when(F.col("category") == category, 0).otherwise(1), "question_id")
    ranked = questions.select("type", "category", "question_id").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_type)
    # Of a type that has some in the category, only those count.
    has = ranked.groupBy("type").agg(F.max(F.coalesce(F.col("category") == category, F.lit(False))).alias("_has"))
    chosen = ranked.join(has, "type").where(~F.col("_has") | (F.col("category") == category)).select("question_id", F.lit(True).alias("is_fewshot_example"))
    return questions.join(F.broadcast(chosen), "question_id", "left").withColumn("is_fewshot_example", F.coalesce("is_fewshot_example", F.lit(False)))


def clean(raw: DataFrame, position: str = "raw_id") -> DataFrame:
    """Silver questions: displayed texts, an identifier from content, the first record of each, options in their order."""
    texts = raw.select(
        position, "category_id", clean_text("category").alias("category"), "type", "difficulty", clean_text("question").alias("question"),
        clean_text("correct_answer").alias("correct_answer"), clean_texts(F.from_json("incorrect_answers", "array<string>")).alias("incorrect_answers"),
        F.to_timestamp("scraped_at").alias("scraped_at"),
    )
    keyed = texts.withColumn("question_id", question_id(*(F.col(c) for c in ("category", "type", "difficulty", "question", "correct_answer"))))
    unique = first_wins(keyed, ["question_id"], position)
    # A true or false that is written with other signs or case is still the option.
    word = F.initcap(F.regexp_replace("correct_answer", r"\P{L}+", ""))
    spelt = (F.col("type") == "boolean") & word.isin("True", "False")
    other = F.when(word == "True", "False").otherwise("True")
    unique = unique.withColumns({"incorrect_answers": F.when(spelt, F.array(other)).otherwise(F.col("incorrect_answers")), "correct_answer": F.when(spelt, word).otherwise(F.col("correct_answer"))})
    shuffled = unique.withColumn("_s", shuffled_options(option_seed(F.col("question_id")), "type", "correct_answer", "incorrect_answers"))
    out = shuffled.select(
        "question_id", F.col("category_id").cast("smallint").alias("category_id"), "category", category_group(F.col("category")).alias("category_group"), "type", "difficulty", "question",
        "correct_answer", "incorrect_answers", F.col("_s.options").alias("options"), F.col("_s.correct_index").alias("correct_index"),
        F.substring(F.lit("ABCD"), F.col("_s.correct_index") + 1, F.lit(1)).alias("correct_letter"), F.size("_s.options").cast("tinyint").alias("n_options"),
        F.char_length("question").alias("question_chars"), word_count(F.col("question")).alias("question_words"), "scraped_at",
    )
    return with_fewshot(out)


@catalog.add("clean_questions", """SELECT question_id, category, category_group, type, difficulty, question, correct_answer, incorrect_answers, options, correct_index, correct_letter,
  n_options, question_chars, question_words FROM questions""")  # fmt: skip
def clean_questions(spark: SparkSession, base: str) -> DataFrame:
    """Silver questions rebuilt from the raw records; the given table's columns that depend on them alone."""
    return clean(table(spark, base, "raw_questions")).drop("is_fewshot_example", "scraped_at", "category_id")


@catalog.add("clean_summary", """WITH q AS (SELECT * FROM questions) SELECT category, count(*) AS n, count(*) FILTER (WHERE type = 'multiple') AS n_multiple, count(*) FILTER (WHERE type = 'boolean') AS n_boolean FROM q GROUP BY category
  UNION ALL SELECT NULL, count(*), count(*) FILTER (WHERE type = 'multiple'), count(*) FILTER (WHERE type = 'boolean') FROM q""")  # fmt: skip
def clean_summary(spark: SparkSession, base: str) -> DataFrame:
    q = table(spark, base, "questions").where("category is not null")
    return q.rollup("category").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "multiple").alias("n_multiple"), F.count_if(F.col("type") == "boolean").alias("n_boolean"))


LOG = "run_id question_id run_order prompt_variant prompt_version transport reasoning_mode max_tokens content reasoning prompt_tokens completion_tokens reasoning_tokens tokens_per_second ttft_s finish_reason response_time attempt error called_at prompt_sha256".split()


@catalog.add("compacted_log", f"SELECT response_id, {', '.join(LOG)} FROM (SELECT *, row_number() OVER (PARTITION BY run_id, question_id ORDER BY response_id DESC) AS rn FROM llm_responses) WHERE rn = 1")
def compacted_log(spark: SparkSession, base: str) -> DataFrame:
    """The last logged call of each run and question."""
    return last_wins(table(spark, base, "llm_responses").select("response_id", *LOG), ["run_id", "question_id"], "response_id", numbered=True)


@catalog.add("unmatched_log", """SELECT run_id, count(*) AS n_missing FROM (SELECT DISTINCT run_id, question_id FROM llm_responses) l
  WHERE NOT EXISTS (SELECT 1 FROM questions q WHERE q.question_id = l.question_id) GROUP BY run_id""")  # fmt: skip
def unmatched_log(spark: SparkSession, base: str) -> DataFrame:
    """Calls whose question isn't known, by run."""
    calls = table(spark, base, "llm_responses").select("run_id", "question_id").distinct()
    return calls.join(table(spark, base, "questions").select("question_id"), "question_id", "left_anti").groupBy("run_id").agg(F.count("*").alias("n_missing"))


def graded(log: DataFrame, questions: DataFrame, runs: DataFrame) -> DataFrame:
    """Silver answers from a compacted log; calls without their question or run are left out."""
    q = questions.select("question_id", "type", "options", "correct_index", "correct_letter", "correct_answer")
    r = runs.select("run_id", "model_key", "model_quant", *(F.col(c).alias(f"_{c}") for c in ("prompt_variant", "prompt_version", "reasoning_mode", "transport")))
    zero = lambda c, d=0: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(d))
    manifest = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"))
    joined = log.join(q, "question_id").join(r, "run_id").withColumns({
        "prompt_version": manifest("prompt_version"), "transport": manifest("transport"), "prompt_variant": F.col("_prompt_variant"), "reasoning_mode": F.col("_reasoning_mode"),
        "is_truncated": (zero("max_tokens") > 0) & (zero("completion_tokens") >= zero("max_tokens")),
        **{c: zero(c) for c in ("max_tokens", "completion_tokens", "prompt_tokens", "reasoning_tokens", "run_order")},
        "attempt": zero("attempt", 1).cast("tinyint"), "response_time": F.coalesce("response_time", F.lit(0.0)),
    })
    return grade(joined).select(
        "run_id", "question_id", "model_key", "model_quant", "prompt_variant", "prompt_version", "reasoning_mode", "transport", "prompt_sha256", F.coalesce("content", F.lit("")).alias("ai_answer"),
        F.col("reasoning").alias("ai_reasoning"), "predicted_letter", "predicted_text", "ai_correct", "grade", "grade_score", "response_time", "ttft_s", "tokens_per_second", "prompt_tokens",
        "completion_tokens", "reasoning_tokens", "max_tokens", "is_truncated", "finish_reason", "run_order", "attempt", "called_at", "error",
    )


@catalog.add("graded_answers")
def graded_answers(spark: SparkSession, base: str) -> DataFrame:
    return graded(compacted_log(spark, base), table(spark, base, "questions"), table(spark, base, "runs"))


@catalog.add("grading_summary")
def grading_summary(spark: SparkSession, base: str) -> DataFrame:
    """By run: answers, accuracy, share that can't be read, errors and median time."""
    return graded_answers(spark, base).groupBy("run_id").agg(
        F.count("*").alias("n"), F.avg(F.col("ai_correct").cast("int")).alias("accuracy"), F.avg((F.col("grade") == "unparseable").cast("int")).alias("unparseable_rate"),
        F.count_if(F.col("grade") == "error").alias("n_errors"), F.median("response_time").alias("median_response_time"),
    )
