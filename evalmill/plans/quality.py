"""Data checks, from a list: each counts the rows that violate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..sources.tables import table
from .gold import FACT_SQL, dim_run, fact, mart_run_summary

catalog = Catalog()
GRADES = ["letter", "exact", "fuzzy", "contains", "wrong", "unparseable", "error"]
DIFFICULTIES = ["easy", "medium", "hard"]
#: Of each table the columns that mustn't be null, and those that hold only certain values (null being no violation).
REQUIRED = {
    "questions": ["question_id", "category_id", "correct_letter"], "runs": ["run_id", "transport"],
    "answers": ["run_id", "question_id", "grade", "ai_correct", "response_time"], "summary": ["run_id", "accuracy"],
}
ALLOWED = {
    "questions": {"type": ["multiple", "boolean"], "difficulty": DIFFICULTIES, "correct_letter": list("ABCD")},
    "runs": {"prompt_variant": ["v1_letter", "v2_fewshot", "v3_json"], "reasoning_mode": ["off", "on"], "status": ["running", "partial", "complete"], "transport": ["native", "api_v0"]},
    "answers": {"grade": GRADES},
}
#: Further conditions that rows must not meet, in SQL.
FORBIDDEN = {"answers": {"reasoning_when_off": "reasoning_mode = 'off' AND reasoning_tokens > 0", "response_time_positive": "error IS NULL AND (response_time IS NULL OR response_time <= 0)"}}
KEYS = {"questions": "question_id", "runs": "run_id", "summary": "run_id"}


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(" and ".join(f"`{c}` is not null" for c in columns)).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def accepted_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Nulls are no violation; ``not_null`` is their check."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values)).groupBy(column).agg(F.count("*").alias("n"))


def relationships(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def valid_question() -> Column:
    """Whether a silver question is consistent: options, index, letter and answers fit each other."""
    n_wrong = F.when(F.col("type") == "multiple", 3).otherwise(1)
    return (
        (F.length("question_id") == 64) & F.col("type").isin("multiple", "boolean") & F.col("difficulty").isin(DIFFICULTIES)
        & (F.size("incorrect_answers") == n_wrong) & ~F.array_contains("incorrect_answers", F.col("correct_answer"))
        & (F.size("options") == F.col("n_options")) & (F.get("options", F.col("correct_index")) == F.col("correct_answer"))
        & (F.col("correct_letter") == F.substring(F.lit("ABCD"), F.col("correct_index") + 1, F.lit(1)))
    )


VALID_SQL = """length(question_id) = 64 AND type IN ('multiple', 'boolean') AND difficulty IN ('easy', 'medium', 'hard') AND len(incorrect_answers) = CASE WHEN type = 'multiple' THEN 3 ELSE 1 END
  AND NOT list_contains(incorrect_answers, correct_answer) AND len(options) = n_options AND options[correct_index + 1] = correct_answer AND correct_letter = substr('ABCD', correct_index + 1, 1)"""


def row_conditions(name: str) -> dict[str, Column]:
    """Conditions that no row of a table may meet, by the name of their check."""
    out = {f"{name}.{c} is null": F.col(c).isNull() for c in REQUIRED.get(name, [])}
    out |= {f"{name}.{c} not accepted": ~F.col(c).isin(v) for c, v in ALLOWED.get(name, {}).items()}
    out |= {f"{name}.{c}": F.expr(e) for c, e in FORBIDDEN.get(name, {}).items()}
    if name == "questions":
        out["questions.invalid"] = ~F.coalesce(valid_question(), F.lit(False))
    return out


def _counted(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(check_name, n_violations) of all conditions, in one pass over ``df``."""
    one = df.agg(*(F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions.values())))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("n_violations")) for i, n in enumerate(conditions)))))


def checked(tables: dict[str, DataFrame]) -> DataFrame:
    """(check_name, n_violations) of every check on questions, runs, answers and summary: a pass for each table, and one
    count of answers by question and by run that keys and relationships share."""
    parts = [_counted(df, row_conditions(name)) for name, df in tables.items() if row_conditions(name)]
    for name, key in KEYS.items():
        parts.append(unique(tables[name], key).agg(F.lit(f"{name}.{key} repeated").alias("check_name"), F.count("*").alias("n_violations")))
    answers = tables["answers"]
    for parent, key in (("questions", "question_id"), ("runs", "run_id")):
        fewshot = F.col("is_fewshot_example") if parent == "questions" else F.lit(None).cast("boolean")
        known = tables[parent].groupBy(key).agg(F.lit(True).alias("_known"), F.max(fewshot).alias("_fewshot"))
        held = answers.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).join(known, key, "left")
        total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
        rows = [F.struct(F.lit(f"answers.{key} unknown").alias("check_name"), F.col("u").alias("n_violations"))]
        rows += [F.struct(F.lit("answers.fewshot example").alias("check_name"), F.col("w").alias("n_violations"))] if parent == "questions" else []
        parts.append(held.agg(total(F.col("_known").isNull()).alias("u"), total(F.col("_fewshot")).alias("w")).select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def _sql() -> str:
    of = {"answers": "f", "summary": "(SELECT run_id, count(*) FILTER (WHERE ai_correct)::double / count(*) AS accuracy FROM f GROUP BY 1)"}
    lines = []
    for name in ("questions", "runs", "answers", "summary"):
        conditions = {f"{c} is null": f"{c} IS NULL" for c in REQUIRED.get(name, [])}
        conditions |= {f"{c} not accepted": f"{c} NOT IN ({', '.join(repr(x) for x in v)})" for c, v in ALLOWED.get(name, {}).items()} | FORBIDDEN.get(name, {})
        if name == "questions":
            conditions["invalid"] = f"NOT coalesce({VALID_SQL}, false)"
        lines += [f"SELECT '{name}.{n}' AS check_name, count(*) AS n_violations FROM {of.get(name, name)} AS t WHERE {c}" for n, c in conditions.items()]
        if name in KEYS:
            lines.append(f"SELECT '{name}.{KEYS[name]} repeated', count(*) FROM (SELECT {KEYS[name]} FROM {of.get(name, name)} AS t GROUP BY 1 HAVING count(*) > 1 AND {KEYS[name]} IS NOT NULL)")
    lines += [f"SELECT 'answers.{k} unknown', count(*) FROM f WHERE {k} NOT IN (SELECT {k} FROM {p})" for k, p in (("question_id", "questions"), ("run_id", "runs"))]
    lines.append("SELECT 'answers.fewshot example', count(*) FROM f JOIN questions q USING (question_id) WHERE q.is_fewshot_example")
    return f"WITH {FACT_SQL} " + " UNION ALL ".join(lines)


def gold_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """What the checks look at."""
    columns = ["run_id", "question_id", "grade", "ai_correct", "reasoning_mode", "reasoning_tokens", "error", "response_time"]
    f = fact(spark, base, columns)
    summary = f.groupBy("run_id").agg(F.avg(F.col("ai_correct").cast("int")).alias("accuracy"))
    return {"questions": table(spark, base, "questions"), "runs": dim_run(spark, base), "answers": f, "summary": summary}


@catalog.add("q_checks", _sql())
def q_checks(spark: SparkSession, base: str) -> DataFrame:
    """The number of violations of each check."""
    return checked(gold_tables(spark, base))


@catalog.add("q_one_answer_per_question", "SELECT run_id, question_id, count(*) AS n FROM fct_answer GROUP BY ALL HAVING count(*) > 1")
def q_one_answer_per_question(spark: SparkSession, base: str) -> DataFrame:
    return unique(table(spark, base, "fct_answer"), "run_id", "question_id")


def unbalanced_grades(answers: DataFrame) -> DataFrame:
    """Runs with answers of no known grade, or whose right answers are more or fewer than the recognised ones."""
    recognised = F.coalesce(F.col("grade").isin(GRADES[:4]), F.lit(False)).cast("int")
    right = F.coalesce("ai_correct", F.lit(False)).cast("int")
    return answers.groupBy("run_id").agg(F.count_if(~F.coalesce(F.col("grade").isin(GRADES), F.lit(False))).alias("unknown_grades"), F.sum(right - recognised).alias("right_beyond_recognised")).where("unknown_grades > 0 or right_beyond_recognised <> 0")


@catalog.add("q_counts", f"""SELECT run_id, count(*) FILTER (WHERE grade IS NULL OR grade NOT IN ({', '.join(map(repr, GRADES))})) AS unknown_grades,
  (count(*) FILTER (WHERE ai_correct) - count(*) FILTER (WHERE grade IN ({', '.join(map(repr, GRADES[:4]))})))::bigint AS right_beyond_recognised
  FROM fct_answer GROUP BY run_id HAVING unknown_grades > 0 OR right_beyond_recognised <> 0""")  # fmt: skip
def q_counts(spark: SparkSession, base: str) -> DataFrame:
    return unbalanced_grades(table(spark, base, "fct_answer"))


def outside_interval(summary: DataFrame, slack: float = 1e-9) -> DataFrame:
    """Rows whose accuracy lies outside its own interval."""
    return summary.where((F.col("accuracy") < F.col("wilson_lo") - slack) | (F.col("accuracy") > F.col("wilson_hi") + slack)).select("run_id", "accuracy", "wilson_lo", "wilson_hi")


@catalog.add("q_accuracy_within_interval", f"""WITH {FACT_SQL}, a AS (SELECT run_id, avg(ai_correct::int) AS p, count(*) AS n FROM f GROUP BY 1), w AS (SELECT run_id, p AS accuracy,
    (p + 3.8416 / (2.0 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n) AS wilson_lo, (p + 3.8416 / (2.0 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n) AS wilson_hi FROM a)
  SELECT * FROM w WHERE accuracy < wilson_lo - 1e-9 OR accuracy > wilson_hi + 1e-9""")  # fmt: skip
def q_accuracy_within_interval(spark: SparkSession, base: str) -> DataFrame:
    """There must be none."""
    return outside_interval(mart_run_summary(spark, base))


def mixed_runtimes(runs: DataFrame) -> DataFrame:
    """Engines of the runs, if there is more than one, or if one is unknown, bears no version or served another format."""
    engines = runs.groupBy("runtime_engine").agg(F.count("*").alias("n_runs"), F.count_if(F.col("model_format") != "gguf").alias("n_other_format"))
    several = engines.where("runtime_engine is not null").count() > 1
    doubtful = F.col("runtime_engine").isNull() | ~F.contains("runtime_engine", F.lit("@")) | (F.col("n_other_format") > 0)
    return engines.where(F.lit(several) | doubtful)


@catalog.add("q_runtime", """WITH e AS (SELECT runtime_engine, count(*) AS n_runs, count(*) FILTER (WHERE model_format <> 'gguf') AS n_other_format FROM runs GROUP BY 1)
  SELECT * FROM e WHERE (SELECT count(runtime_engine) FROM e) > 1 OR runtime_engine IS NULL OR NOT contains(runtime_engine, '@') OR n_other_format > 0""")  # fmt: skip
def q_runtime(spark: SparkSession, base: str) -> DataFrame:
    return mixed_runtimes(table(spark, base, "runs"))
