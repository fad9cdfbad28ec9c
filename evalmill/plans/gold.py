"""Staging views, dimensions, the fact and the marts of answers.

The base of every mart is the fact with one row for each (run, question): of repeated deliveries the
one with the smallest answer_id counts. It is made once for an application, in the scratch folder, and
made anew when the files that it came from change; the marts only read and add up its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.intervals import ratio, wilson
from ..session import scratch
from ..sources.tables import stamp, table

catalog = Catalog()

RUN = ["run_id", "model_short", "prompt_variant", "variant_label", "reasoning_mode"]
#: Decimals kept of order statistics and intervals, and of standard deviations, whose last digits depend on the order of addition.
EXACT, SUMMED = 9, 6

#: The fact with one row for each message, for oracle SQL.
FACT_SQL = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, question_id ORDER BY answer_id) AS rn FROM fct_answer) WHERE rn = 1)"


_facts: dict[tuple, DataFrame] = {}


def deduplicated(answers: DataFrame, order: str = "answer_id") -> DataFrame:
    """``answers`` with one row for each (run, question), that of the smallest ``order``.

    Only the numbers of the rows that lose are looked up: one small row for each message is shuffled, its
    columns aren't. Null identifiers are a message like any other.
    """
    first = answers.groupBy("run_id", "question_id").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").withColumnsRenamed({"run_id": "_run", "question_id": "_question"})
    same = F.col("run_id").eqNullSafe(F.col("_run")) & F.col("question_id").eqNullSafe(F.col("_question"))
    losers = answers.select("run_id", "question_id", order).join(first, same).where(F.col(order) > F.col("_first")).select(order)
    return answers.join(losers, order, "left_anti").select(*answers.columns)


def fact(spark: SparkSession, base: str, columns: list[str]) -> DataFrame:
    """The fact's ``columns``, one row for each (run, question)."""
    key = (spark.sparkContext.applicationId, base, stamp(spark, base, "fct_answer"))
    if key not in _facts:
        _facts[key] = scratch(deduplicated(table(spark, base, "fct_answer")), "fact")
    return _facts[key].select(*columns)


def forget_facts() -> None:
    """Have facts made anew on next use."""
    _facts.clear()


def median(c: str) -> Column:
    return F.round(F.median(F.col(c).cast("double")), EXACT)


def quantile(c: str, q: float) -> Column:
    return F.round(F.percentile(F.col(c).cast("double"), q), EXACT)


def total(c: str) -> Column:
    """Summed in micro units, so that the result doesn't depend on the order of addition."""
    return F.sum(F.col(c).cast("decimal(20,6)")).cast("double")


def mean(c: str) -> Column:
    return total(c) / F.nullif(F.count(c), F.lit(0))


def chance() -> Column:
    return F.avg(F.when(F.col("type") == "multiple", F.lit(0.25)).otherwise(F.lit(0.5)))


def count_if(condition: str) -> Column:
    return F.count_if(F.expr(condition))


SQL_MEDIAN = f"round(median({{0}}::double), {EXACT}) AS median_{{0}}"
SQL_ACC = """n_correct::double / nullif(n, 0) AS accuracy, n_correct::double / nullif(n, 0) - chance_baseline AS accuracy_above_chance,
  round((n_correct::double / n + 3.8416 / (2.0 * n) - 1.96 * sqrt(n_correct::double / n * (1 - n_correct::double / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 9) AS wilson_lo,
  round((n_correct::double / n + 3.8416 / (2.0 * n) + 1.96 * sqrt(n_correct::double / n * (1 - n_correct::double / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 9) AS wilson_hi"""
SQL_CHANCE = "avg(CASE WHEN type = 'multiple' THEN 0.25::double ELSE 0.5::double END) AS chance_baseline"


def medians(*columns: str) -> str:
    return ", ".join(SQL_MEDIAN.format(c) for c in columns)


def with_accuracy(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "accuracy": ratio("n_correct", "n"), "accuracy_above_chance": ratio("n_correct", "n") - F.col("chance_baseline"),
        "wilson_lo": F.round(wilson("n_correct", "n", -1), EXACT), "wilson_hi": F.round(wilson("n_correct", "n", 1), EXACT),
    })


# --- staging and dimensions -----------------------------------------------------------------------


@catalog.add("stg_questions", """SELECT question_id, category_id::smallint AS category_id, category, category_group, type, difficulty, question, correct_answer, incorrect_answers, options,
  correct_index::tinyint AS correct_index, correct_letter, n_options::tinyint AS n_options, question_chars::int AS question_chars, question_words::int AS question_words, is_fewshot_example, scraped_at FROM questions""")  # fmt: skip
def stg_questions(spark: SparkSession, base: str) -> DataFrame:
    casts = {"category_id": "smallint", "correct_index": "tinyint", "n_options": "tinyint", "question_chars": "int", "question_words": "int"}
    q = table(spark, base, "questions")
    return q.select(*(F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in q.columns))


STG_ANSWERS = """run_id question_id model_key prompt_variant prompt_version reasoning_mode transport prompt_sha256 ai_answer ai_reasoning predicted_letter
predicted_text ai_correct grade grade_score response_time ttft_s tokens_per_second prompt_tokens completion_tokens reasoning_tokens max_tokens is_truncated
finish_reason run_order attempt called_at error""".split()


@catalog.add("stg_answers", f"WITH {FACT_SQL} SELECT {', '.join(c + '::double AS ' + c if c == 'grade_score' else c for c in STG_ANSWERS)} FROM f")
def stg_answers(spark: SparkSession, base: str) -> DataFrame:
    return fact(spark, base, STG_ANSWERS).withColumn("grade_score", F.col("grade_score").cast("double"))


@catalog.add("stg_runs", "SELECT * FROM runs")
def stg_runs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "runs")


@catalog.add("dim_question", "SELECT * FROM questions")
def dim_question(spark: SparkSession, base: str) -> DataFrame:
    return stg_questions(spark, base)


@catalog.add("dim_run", """SELECT *, regexp_replace(model_key, '^[^/]+/', '') AS model_short, CASE WHEN reasoning_mode = 'on' THEN 'reasoning' ELSE 'no reasoning' END AS reasoning_label,
  date_diff('second', started_at, finished_at) AS duration_s FROM runs""")  # fmt: skip
def dim_run(spark: SparkSession, base: str) -> DataFrame:
    """Runs with labels; ``duration_s`` counts the full seconds begun between start and finish."""
    second = lambda c: F.unix_timestamp(F.date_trunc("second", c))
    return table(spark, base, "runs").withColumns({
        "model_short": F.regexp_replace("model_key", "^[^/]+/", ""),
        "reasoning_label": F.when(F.col("reasoning_mode") == "on", "reasoning").otherwise("no reasoning"),
        "duration_s": second("finished_at") - second("started_at"),
    })


FACT_FROM_ANSWERS = """run_id question_id model_key prompt_variant reasoning_mode transport prompt_version prompt_sha256 ai_answer ai_reasoning predicted_letter predicted_text
ai_correct grade grade_score response_time ttft_s tokens_per_second prompt_tokens completion_tokens reasoning_tokens max_tokens is_truncated finish_reason run_order attempt called_at error""".split()
FACT_FROM_QUESTIONS = "question_id category category_group difficulty type n_options correct_letter correct_answer question question_chars question_words".split()


@catalog.add("fct_answer_built", f"""WITH {FACT_SQL}
  SELECT {', '.join('f.' + c for c in FACT_FROM_ANSWERS if c not in ('grade_score', 'question_id', 'run_id'))}, f.run_id, f.question_id, f.grade_score::double AS grade_score, {', '.join('q.' + c for c in FACT_FROM_QUESTIONS[1:])},
    regexp_replace(r.model_key, '^[^/]+/', '') AS model_short, r.variant_label, f.grade NOT IN ('unparseable', 'error') AS is_parsed,
    (q.type = 'multiple' AND f.grade = 'letter') OR (q.type = 'boolean' AND f.grade IN ('exact', 'letter')) AS is_expected_format,
    CASE WHEN q.type = 'multiple' THEN 0.25::double ELSE 0.5::double END AS chance_baseline,
    f.response_time / nullif(f.completion_tokens, 0) AS time_per_token, length(f.ai_answer)::int AS answer_chars
  FROM f JOIN questions q ON f.question_id = q.question_id JOIN runs r ON f.run_id = r.run_id""")  # fmt: skip
def fct_answer_built(spark: SparkSession, base: str) -> DataFrame:
    """The fact rebuilt from answers, questions and runs; answers without their question or run drop out."""
    answers = fact(spark, base, FACT_FROM_ANSWERS).withColumn("grade_score", F.col("grade_score").cast("double"))
    questions = table(spark, base, "questions").select(*FACT_FROM_QUESTIONS)
    runs = dim_run(spark, base).select("run_id", "model_short", "variant_label")
    multiple, boolean = F.col("type") == "multiple", F.col("type") == "boolean"
    return answers.join(questions, "question_id").join(runs, "run_id").withColumns({
        "is_parsed": ~F.col("grade").isin("unparseable", "error"),
        "is_expected_format": (multiple & (F.col("grade") == "letter")) | (boolean & F.col("grade").isin("exact", "letter")),
        "chance_baseline": F.when(multiple, F.lit(0.25)).otherwise(F.lit(0.5)),
        "time_per_token": F.col("response_time") / F.nullif("completion_tokens", F.lit(0)),
        "answer_chars": F.char_length("ai_answer"),
    })


# --- marts of one run -------------------------------------------------------------------------------


@catalog.add("mart_run_summary", f"""WITH {FACT_SQL}, a AS (SELECT {', '.join(RUN)}, model_key, count(*) AS n, count_if(ai_correct)::bigint AS n_correct, count_if(grade = 'unparseable')::bigint AS n_unparseable,
    count_if(grade = 'error')::bigint AS n_error, count_if(is_parsed)::bigint AS n_parsed, count_if(is_expected_format)::bigint AS n_expected_format, count(*) FILTER (WHERE is_truncated) AS n_truncated,
    count_if(ai_correct AND is_parsed)::bigint AS n_correct_parsed, {SQL_CHANCE}, {medians('response_time', 'tokens_per_second', 'ttft_s', 'time_per_token')},
    round(quantile_cont(response_time, 0.9), 9) AS p90_response_time, round(quantile_cont(response_time, 0.95), 9) AS p95_response_time, sum(response_time::decimal(20,6))::double / nullif(count(response_time), 0) AS mean_response_time,
    sum(prompt_tokens::decimal(20,6))::double / nullif(count(prompt_tokens), 0) AS mean_prompt_tokens, sum(completion_tokens::decimal(20,6))::double / nullif(count(completion_tokens), 0) AS mean_completion_tokens, sum(response_time::decimal(20,6))::double AS total_duration_s FROM f GROUP BY ALL)
  SELECT *, n_correct_parsed::double / nullif(n_parsed, 0) AS accuracy_parsed_only, n_unparseable::double / nullif(n, 0) AS unparseable_rate,
    n_expected_format::double / nullif(n, 0) AS format_compliance_rate, n_truncated::double / nullif(n, 0) AS truncation_rate, {SQL_ACC} FROM a""")  # fmt: skip
def mart_run_summary(spark: SparkSession, base: str) -> DataFrame:
    f = fact(spark, base, [*RUN, "question_id", "model_key", "type", "ai_correct", "grade", "is_parsed", "is_expected_format", "is_truncated", "response_time", "tokens_per_second", "ttft_s", "time_per_token", "prompt_tokens", "completion_tokens"])
    a = f.groupBy(*RUN, "model_key").agg(
        F.count("*").alias("n"), count_if("ai_correct").alias("n_correct"), count_if("grade = 'unparseable'").alias("n_unparseable"), count_if("grade = 'error'").alias("n_error"),
        count_if("is_parsed").alias("n_parsed"), count_if("is_expected_format").alias("n_expected_format"), count_if("is_truncated").alias("n_truncated"),
        count_if("ai_correct and is_parsed").alias("n_correct_parsed"), chance().alias("chance_baseline"),
        *(median(c).alias(f"median_{c}") for c in ("response_time", "tokens_per_second", "ttft_s", "time_per_token")),
        quantile("response_time", 0.9).alias("p90_response_time"), quantile("response_time", 0.95).alias("p95_response_time"), mean("response_time").alias("mean_response_time"),
        mean("prompt_tokens").alias("mean_prompt_tokens"), mean("completion_tokens").alias("mean_completion_tokens"), total("response_time").alias("total_duration_s"),
    )
    return with_accuracy(a).withColumns({
        "accuracy_parsed_only": ratio("n_correct_parsed", "n_parsed"), "unparseable_rate": ratio("n_unparseable", "n"),
        "format_compliance_rate": ratio("n_expected_format", "n"), "truncation_rate": ratio("n_truncated", "n"),
    })


def _accuracy_sql(keys: str, more: str = "", after: str = "") -> str:
    return f"WITH {FACT_SQL}, a AS (SELECT {', '.join(RUN)}, {keys}, count(*) AS n, count_if(ai_correct)::bigint AS n_correct, {SQL_CHANCE}{more} FROM f GROUP BY ALL) SELECT *, {SQL_ACC}{after} FROM a"


def _accuracy(spark: SparkSession, base: str, keys: list[str], *more: Column) -> DataFrame:
    f = fact(spark, base, list(dict.fromkeys([*RUN, "question_id", *keys, "type", "ai_correct", *["response_time"] * bool(more)])))
    return with_accuracy(f.groupBy(*RUN, *keys).agg(F.count("*").alias("n"), count_if("ai_correct").alias("n_correct"), chance().alias("chance_baseline"), *more))


SQL_TIME = ", " + medians("response_time")


@catalog.add("mart_accuracy_by_category", _accuracy_sql("category, category_group", SQL_TIME, ", n < 30 AS n_flag_low, rank() OVER (PARTITION BY run_id ORDER BY n_correct::double / nullif(n, 0) DESC) AS rank_in_run"))
def mart_accuracy_by_category(spark: SparkSession, base: str) -> DataFrame:
    a = _accuracy(spark, base, ["category", "category_group"], median("response_time").alias("median_response_time"))
    return a.withColumns({"n_flag_low": F.col("n") < 30, "rank_in_run": F.rank().over(Window.partitionBy("run_id").orderBy(F.desc("accuracy")))})


@catalog.add("mart_accuracy_by_category_difficulty", _accuracy_sql("category, difficulty", "", ", n < 30 AS n_flag_low"))
def mart_accuracy_by_category_difficulty(spark: SparkSession, base: str) -> DataFrame:
    return _accuracy(spark, base, ["category", "difficulty"]).withColumn("n_flag_low", F.col("n") < 30)


@catalog.add("mart_accuracy_by_difficulty", _accuracy_sql("difficulty, CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS difficulty_rank", SQL_TIME))
def mart_accuracy_by_difficulty(spark: SparkSession, base: str) -> DataFrame:
    a = _accuracy(spark, base, ["difficulty"], median("response_time").alias("median_response_time"))
    return a.withColumn("difficulty_rank", F.when(F.col("difficulty") == "easy", 1).when(F.col("difficulty") == "medium", 2).otherwise(3))


@catalog.add("mart_accuracy_by_type", _accuracy_sql("type"))
def mart_accuracy_by_type(spark: SparkSession, base: str) -> DataFrame:
    return _accuracy(spark, base, ["type"])


@catalog.add("mart_grade_breakdown", f"""WITH {FACT_SQL}, a AS (SELECT {', '.join(RUN)}, grade, count(*) AS n, count_if(is_expected_format)::bigint AS n_expected_format FROM f GROUP BY ALL),
  t AS (SELECT run_id, sum(n)::bigint AS n_total FROM a GROUP BY 1)
  SELECT a.*, n_total, n::double / nullif(n_total, 0) AS share, grade IN ('letter', 'exact', 'fuzzy', 'contains') AS counts_as_correct, n_expected_format::double / nullif(n, 0) AS share_expected_format FROM a JOIN t USING (run_id)""")  # fmt: skip
def mart_grade_breakdown(spark: SparkSession, base: str) -> DataFrame:
    f = fact(spark, base, [*RUN, "question_id", "grade", "is_expected_format"])
    a = f.groupBy(*RUN, "grade").agg(F.count("*").alias("n"), count_if("is_expected_format").alias("n_expected_format"))
    return a.withColumn("n_total", F.sum("n").over(Window.partitionBy("run_id"))).withColumns({
        "share": ratio("n", "n_total"), "counts_as_correct": F.col("grade").isin("letter", "exact", "fuzzy", "contains"), "share_expected_format": ratio("n_expected_format", "n"),
    })


@catalog.add("mart_position_bias", f"""WITH {FACT_SQL}, m AS (SELECT * FROM f WHERE type = 'multiple'),
  c AS (SELECT {', '.join(RUN)}, correct_letter AS letter, count(*) AS n_is_correct_letter, count_if(ai_correct)::bigint AS n_correct FROM m GROUP BY ALL),
  p AS (SELECT run_id, predicted_letter AS letter, count(*) AS n_predicted FROM m WHERE predicted_letter IS NOT NULL GROUP BY ALL),
  t AS (SELECT run_id, count(*) AS n_total, count_if(predicted_letter IS NULL)::bigint AS n_no_letter FROM m GROUP BY 1)
  SELECT c.*, n_correct::double / nullif(n_is_correct_letter, 0) AS accuracy_when_correct_letter, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_predicted, 0)::double / nullif(n_total, 0) AS share_predicted,
    n_is_correct_letter::double / nullif(n_total, 0) AS share_is_correct_letter, n_no_letter, n_no_letter::double / nullif(n_total, 0) AS share_no_letter
  FROM c LEFT JOIN p ON c.run_id = p.run_id AND c.letter = p.letter JOIN t ON c.run_id = t.run_id""")  # fmt: skip
def mart_position_bias(spark: SparkSession, base: str) -> DataFrame:
    """One scan: each answer counts once under its correct letter and once under the one it predicts."""
    m = fact(spark, base, [*RUN, "question_id", "type", "correct_letter", "predicted_letter", "ai_correct"]).where("type = 'multiple'")
    cells = m.groupBy(*RUN, "correct_letter", "predicted_letter").agg(F.count("*").alias("n"), count_if("ai_correct").alias("ok"))
    correct = cells.groupBy(*RUN, F.col("correct_letter").alias("letter")).agg(F.sum("n").alias("n_is_correct_letter"), F.sum("ok").alias("n_correct"))
    predicted = cells.where("predicted_letter is not null").groupBy("run_id", F.col("predicted_letter").alias("letter")).agg(F.sum("n").alias("n_predicted"))
    totals = cells.groupBy("run_id").agg(F.sum("n").alias("n_total"), F.coalesce(F.sum(F.when(F.col("predicted_letter").isNull(), F.col("n"))), F.lit(0)).alias("n_no_letter"))
    joined = correct.join(predicted, ["run_id", "letter"], "left").join(totals, "run_id").withColumn("n_predicted", F.coalesce("n_predicted", F.lit(0)))
    return joined.withColumns({
        "accuracy_when_correct_letter": ratio("n_correct", "n_is_correct_letter"), "share_predicted": ratio("n_predicted", "n_total"),
        "share_is_correct_letter": ratio("n_is_correct_letter", "n_total"), "share_no_letter": ratio("n_no_letter", "n_total"),
    }).drop("n_total")


@catalog.add("mart_latency_by_run", f"""WITH {FACT_SQL} SELECT {', '.join(RUN)}, type, count(*) AS n, {medians('response_time', 'ttft_s', 'tokens_per_second', 'time_per_token', 'prompt_tokens', 'completion_tokens')},
  round(quantile_cont(response_time, 0.9), 9) AS p90_response_time, round(quantile_cont(response_time, 0.95), 9) AS p95_response_time, sum(response_time::decimal(20,6))::double / nullif(count(response_time), 0) AS mean_response_time,
  round(stddev_samp(response_time), 6) AS stddev_response_time, min(response_time) AS min_response_time, max(response_time) AS max_response_time, sum(response_time::decimal(20,6))::double AS total_duration_s FROM f GROUP BY ALL""")  # fmt: skip
def mart_latency_by_run(spark: SparkSession, base: str) -> DataFrame:
    numbers = ["response_time", "ttft_s", "tokens_per_second", "time_per_token", "prompt_tokens", "completion_tokens"]
    return fact(spark, base, [*RUN, "question_id", "type", *numbers]).groupBy(*RUN, "type").agg(
        F.count("*").alias("n"), *(median(c).alias(f"median_{c}") for c in numbers),
        quantile("response_time", 0.9).alias("p90_response_time"), quantile("response_time", 0.95).alias("p95_response_time"), mean("response_time").alias("mean_response_time"),
        F.round(F.stddev_samp("response_time"), SUMMED).alias("stddev_response_time"), F.min("response_time").alias("min_response_time"), F.max("response_time").alias("max_response_time"),
        total("response_time").alias("total_duration_s"),
    )


@catalog.add("mart_latency_drift", f"""WITH {FACT_SQL} SELECT {', '.join(RUN)}, ((run_order // 100) * 100)::int AS run_order_bucket, count(*) AS n, {medians('response_time', 'tokens_per_second', 'ttft_s')},
  avg(ai_correct::int) AS accuracy FROM f GROUP BY ALL""")  # fmt: skip
def mart_latency_drift(spark: SparkSession, base: str) -> DataFrame:
    f = fact(spark, base, [*RUN, "question_id", "run_order", "response_time", "tokens_per_second", "ttft_s", "ai_correct"])
    return f.groupBy(*RUN, F.expr("cast((run_order div 100) * 100 as int)").alias("run_order_bucket")).agg(
        F.count("*").alias("n"), *(median(c).alias(f"median_{c}") for c in ("response_time", "tokens_per_second", "ttft_s")), F.avg(F.col("ai_correct").cast("int")).alias("accuracy")
    )


@catalog.add("mart_question_consistency", f"""WITH {FACT_SQL}, a AS (SELECT model_short, question_id, category, difficulty, type, question, correct_answer, count(*) AS n_runs, count_if(ai_correct)::bigint AS n_correct,
    count_if(grade = 'unparseable')::bigint AS n_unparseable, {medians('response_time')} FROM f GROUP BY ALL)
  SELECT *, n_correct::double / nullif(n_runs, 0) AS correct_rate, n_correct = n_runs AS all_correct, n_correct = 0 AS all_wrong, n_correct > 0 AND n_correct < n_runs AS is_mixed FROM a""")  # fmt: skip
def mart_question_consistency(spark: SparkSession, base: str) -> DataFrame:
    keys = ["model_short", "question_id", "category", "difficulty", "type", "question", "correct_answer"]
    a = fact(spark, base, ["run_id", *keys, "ai_correct", "grade", "response_time"]).groupBy(*keys).agg(
        F.count("*").alias("n_runs"), count_if("ai_correct").alias("n_correct"), count_if("grade = 'unparseable'").alias("n_unparseable"), median("response_time").alias("median_response_time")
    )
    n, k = F.col("n_correct"), F.col("n_runs")
    return a.withColumns({"correct_rate": ratio("n_correct", "n_runs"), "all_correct": n == k, "all_wrong": n == 0, "is_mixed": (n > 0) & (n < k)})


@catalog.add("mart_answer_length", f"""WITH {FACT_SQL} SELECT {', '.join(RUN)}, ai_correct, grade, count(*) AS n, {medians('completion_tokens', 'answer_chars', 'response_time')},
  sum(completion_tokens::decimal(20,6))::double / nullif(count(completion_tokens), 0) AS mean_completion_tokens, sum(answer_chars::decimal(20,6))::double / nullif(count(answer_chars), 0) AS mean_answer_chars FROM f GROUP BY ALL""")  # fmt: skip
def mart_answer_length(spark: SparkSession, base: str) -> DataFrame:
    f = fact(spark, base, [*RUN, "question_id", "ai_correct", "grade", "completion_tokens", "answer_chars", "response_time"])
    return f.groupBy(*RUN, "ai_correct", "grade").agg(
        F.count("*").alias("n"), *(median(c).alias(f"median_{c}") for c in ("completion_tokens", "answer_chars", "response_time")), mean("completion_tokens").alias("mean_completion_tokens"), mean("answer_chars").alias("mean_answer_chars")
    )


# --- marts of two runs ------------------------------------------------------------------------------
# The pairs of runs are joined first: there are few of them, and no pair of answers is made whose runs aren't compared.


def run_pairs(spark: SparkSession, base: str, on: list[str], condition: Column) -> DataFrame:
    """(run_a, run_b, columns of both) of the runs that agree in ``on`` and meet ``condition`` on a and b."""
    runs = dim_run(spark, base).select("run_id", "model_key", "model_short", "prompt_variant", "variant_label", "reasoning_mode")
    a, b = (runs.select(*(F.col(c).alias(f"{side}_{c}") for c in runs.columns)) for side in "ab")
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in on]
    return a.join(b, [*same, condition])


def paired(spark: SparkSession, base: str, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each question that both runs of a pair answered; columns as a_… and b_…."""
    f = fact(spark, base, ["run_id", "question_id", *columns])
    a = f.select(F.col("run_id").alias("a_run_id"), "question_id", *(F.col(c).alias(f"a_{c}") for c in columns))
    b = f.select(F.col("run_id").alias("b_run_id"), "question_id", *(F.col(c).alias(f"b_{c}") for c in columns))
    return a.join(pairs, "a_run_id").join(b, ["b_run_id", "question_id"])


def contingency(names: list[str], a: str = "a_ai_correct", b: str = "b_ai_correct") -> list[Column]:
    both, only_a, only_b, acc_a, acc_b, diff = names
    mean_a, mean_b = (F.avg(F.col(c).cast("int")) for c in (a, b))
    gain = mean_b - mean_a if diff == "accuracy_gain" else mean_a - mean_b
    return [
        F.count("*").alias("n"), count_if(f"{a} and {b}").alias(both), count_if(f"{a} and not {b}").alias(only_a), count_if(f"not {a} and {b}").alias(only_b),
        count_if(f"not {a} and not {b}").alias("both_wrong"), mean_a.alias(acc_a), mean_b.alias(acc_b), gain.alias(diff),
    ]


def _paired_sql(condition: str, select: str) -> str:
    return f"""WITH {FACT_SQL}, r AS (SELECT *, regexp_replace(model_key, '^[^/]+/', '') AS model_short FROM runs),
  p AS (SELECT ra.run_id AS run_a, rb.run_id AS run_b, ra.model_short AS model_a, rb.model_short AS model_b, ra.prompt_variant AS variant_a, rb.prompt_variant AS variant_b, ra.variant_label AS label_a, rb.variant_label AS label_b,
      ra.reasoning_mode AS mode, a.ai_correct AS ca, b.ai_correct AS cb, a.response_time AS ta, b.response_time AS tb, b.reasoning_tokens AS rt
    FROM r ra JOIN r rb ON {condition} JOIN f a ON a.run_id = ra.run_id JOIN f b ON b.run_id = rb.run_id AND a.question_id = b.question_id)
  SELECT {select} FROM p GROUP BY ALL"""


SQL_TABLE = "count(*) AS n, count_if(ca AND cb)::bigint AS both_correct, count_if(ca AND NOT cb)::bigint AS {0}_only, count_if(NOT ca AND cb)::bigint AS {1}_only, count_if(NOT ca AND NOT cb)::bigint AS both_wrong, avg(ca::int) AS accuracy_{0}, avg(cb::int) AS accuracy_{1}"


@catalog.add("mart_variant_pairwise", _paired_sql("ra.model_key = rb.model_key AND ra.reasoning_mode = rb.reasoning_mode AND ra.prompt_variant < rb.prompt_variant",
    "model_a AS model_short, mode AS reasoning_mode, variant_a, variant_b, label_a AS variant_a_label, label_b AS variant_b_label, run_a, run_b, " + SQL_TABLE.format("a", "b") + ", avg(ca::int) - avg(cb::int) AS accuracy_diff, count_if(ca != cb)::bigint AS n_discordant"))
def mart_variant_pairwise(spark: SparkSession, base: str) -> DataFrame:
    pairs = run_pairs(spark, base, ["model_key", "reasoning_mode"], F.col("a_prompt_variant") < F.col("b_prompt_variant"))
    keys = {"model_short": "a_model_short", "reasoning_mode": "a_reasoning_mode", "variant_a": "a_prompt_variant", "variant_b": "b_prompt_variant", "variant_a_label": "a_variant_label", "variant_b_label": "b_variant_label", "run_a": "a_run_id", "run_b": "b_run_id"}
    return paired(spark, base, pairs, ["ai_correct"]).groupBy(*(F.col(c).alias(k) for k, c in keys.items())).agg(
        *contingency(["both_correct", "a_only", "b_only", "accuracy_a", "accuracy_b", "accuracy_diff"]), count_if("a_ai_correct <> b_ai_correct").alias("n_discordant")
    )


@catalog.add("mart_model_pairwise", _paired_sql("ra.prompt_variant = rb.prompt_variant AND ra.reasoning_mode = rb.reasoning_mode AND ra.model_key < rb.model_key",
    "model_a, model_b, variant_a AS prompt_variant, label_a AS variant_label, mode AS reasoning_mode, run_a, run_b, " + SQL_TABLE.format("a", "b") + ", avg(ca::int) - avg(cb::int) AS accuracy_diff, round(median(ta), 9) AS median_time_a, round(median(tb), 9) AS median_time_b"))
def mart_model_pairwise(spark: SparkSession, base: str) -> DataFrame:
    pairs = run_pairs(spark, base, ["prompt_variant", "reasoning_mode"], F.col("a_model_key") < F.col("b_model_key"))
    keys = {"model_a": "a_model_short", "model_b": "b_model_short", "prompt_variant": "a_prompt_variant", "variant_label": "a_variant_label", "reasoning_mode": "a_reasoning_mode", "run_a": "a_run_id", "run_b": "b_run_id"}
    return paired(spark, base, pairs, ["ai_correct", "response_time"]).groupBy(*(F.col(c).alias(k) for k, c in keys.items())).agg(
        *contingency(["both_correct", "a_only", "b_only", "accuracy_a", "accuracy_b", "accuracy_diff"]), median("a_response_time").alias("median_time_a"), median("b_response_time").alias("median_time_b")
    )


@catalog.add("mart_reasoning_pairwise", _paired_sql("ra.model_key = rb.model_key AND ra.prompt_variant = rb.prompt_variant AND ra.reasoning_mode = 'off' AND rb.reasoning_mode = 'on'",
    "model_a AS model_short, variant_a AS prompt_variant, label_a AS variant_label, run_a AS run_off, run_b AS run_on, " + SQL_TABLE.format("off", "on") + ", avg(cb::int) - avg(ca::int) AS accuracy_gain, round(median(ta), 9) AS median_time_off, round(median(tb), 9) AS median_time_on, round(median(tb) / nullif(median(ta), 0), 9) AS time_factor, round(median(rt::double), 9) AS median_reasoning_tokens"))
def mart_reasoning_pairwise(spark: SparkSession, base: str) -> DataFrame:
    pairs = run_pairs(spark, base, ["model_key", "prompt_variant"], (F.col("a_reasoning_mode") == "off") & (F.col("b_reasoning_mode") == "on"))
    keys = {"model_short": "a_model_short", "prompt_variant": "a_prompt_variant", "variant_label": "a_variant_label", "run_off": "a_run_id", "run_on": "b_run_id"}
    off, on = (F.median(F.col(c)) for c in ("a_response_time", "b_response_time"))
    return paired(spark, base, pairs, ["ai_correct", "response_time", "reasoning_tokens"]).groupBy(*(F.col(c).alias(k) for k, c in keys.items())).agg(
        *contingency(["both_correct", "off_only", "on_only", "accuracy_off", "accuracy_on", "accuracy_gain"]), F.round(off, EXACT).alias("median_time_off"), F.round(on, EXACT).alias("median_time_on"),
        F.round(on / F.nullif(off, F.lit(0.0)), EXACT).alias("time_factor"), median("b_reasoning_tokens").alias("median_reasoning_tokens"),
    )
