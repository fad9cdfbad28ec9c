"""Named queries over the gold tables, with parameters; each is registered over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.ids import prompt_hash
from ..functions.prompts import leaks_markers, rendered, run_slug
from ..functions.significance import bootstrap_interval, mcnemar_p, spearman
from ..operators.ordering import ecdf
from ..operators.sampling import sample
from ..sources.bronze import decoded
from ..sources.tables import run_sql, table
from .gold import FACT_SQL, dim_run, fact, mart_accuracy_by_category, mart_grade_breakdown, mart_position_bias, mart_question_consistency, mart_reasoning_pairwise, mart_run_summary, mart_variant_pairwise

catalog = Catalog()


def apply_selection(df: DataFrame, selection: dict[str, list[str]]) -> DataFrame:
    """Each column of the selection restricts ``df`` if it is there and any values are chosen."""
    for column, values in selection.items():
        if column in df.columns and values:
            df = df.where(F.col(column).isin(values))
    return df


def explorer_rows(spark: SparkSession, base: str, run_ids: list[str] | None, filters: dict[str, list[str]] | None = None, search: str = "", limit: int = 500) -> DataFrame:
    """Answers of the chosen runs (all for None, none for an empty list), filtered, the first by question."""
    columns = ["run_id", "question_id", "variant_label", "category", "difficulty", "type", "question", "correct_answer", "ai_answer", "predicted_text", "ai_correct", "grade", "response_time", "completion_tokens"]
    f = fact(spark, base, columns)
    if run_ids is not None:
        f = f.where(F.col("run_id").isin(run_ids) if run_ids else F.lit(False))
    f = apply_selection(f, filters or {})
    if search:
        f = f.where(F.col("question").ilike(f"%{search}%") | F.col("correct_answer").ilike(f"%{search}%"))
    return f.orderBy("question_id", "run_id").limit(limit)


@catalog.add("explorer_rows", f"""WITH {FACT_SQL} SELECT run_id, question_id, variant_label, category, difficulty, type, question, correct_answer, ai_answer, predicted_text, ai_correct, grade, response_time, completion_tokens
  FROM f WHERE type IN ('multiple') AND grade IN ('wrong', 'unparseable') AND (question ILIKE '%bridge%' OR correct_answer ILIKE '%bridge%') ORDER BY question_id, run_id LIMIT 500""")  # fmt: skip
def q_explorer(spark: SparkSession, base: str) -> DataFrame:
    return explorer_rows(spark, base, None, {"type": ["multiple"], "grade": ["wrong", "unparseable"], "nowhere": ["x"], "difficulty": []}, "bridge")


@catalog.add("dataset_overview", """SELECT count(*) FILTER (WHERE NOT is_fewshot_example) AS n_questions, count(*) FILTER (WHERE NOT is_fewshot_example AND type = 'multiple') AS n_multiple,
  count(*) FILTER (WHERE NOT is_fewshot_example AND type = 'boolean') AS n_boolean, count(DISTINCT category) AS n_categories FROM questions""")  # fmt: skip
def dataset_overview(spark: SparkSession, base: str) -> DataFrame:
    kept = ~F.col("is_fewshot_example")
    return table(spark, base, "questions").agg(
        F.count_if(kept).alias("n_questions"), F.count_if(kept & (F.col("type") == "multiple")).alias("n_multiple"), F.count_if(kept & (F.col("type") == "boolean")).alias("n_boolean"), F.count_distinct("category").alias("n_categories")
    )


@catalog.add("latency_samples", f"""WITH {FACT_SQL} SELECT run_id, variant_label, type, response_time, prompt_tokens, completion_tokens
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY run_order, question_id) AS k FROM f WHERE error IS NULL) WHERE k <= 4000""")  # fmt: skip
def latency_samples(spark: SparkSession, base: str, per_run: int = 4000) -> DataFrame:
    """The first answers of each run in its order."""
    f = fact(spark, base, ["run_id", "question_id", "run_order", "variant_label", "type", "response_time", "prompt_tokens", "completion_tokens", "error"]).where("error is null")
    first = f.withColumn("_k", F.row_number().over(Window.partitionBy("run_id").orderBy("run_order", "question_id"))).where(F.col("_k") <= per_run)
    return first.select("run_id", "variant_label", "type", "response_time", "prompt_tokens", "completion_tokens")


@catalog.add("latency_ecdf", f"""WITH {FACT_SQL} SELECT variant_label, response_time, row_number() OVER (PARTITION BY variant_label ORDER BY response_time)::double / count(*) OVER (PARTITION BY variant_label) AS share
  FROM f WHERE response_time IS NOT NULL""")  # fmt: skip
def latency_ecdf(spark: SparkSession, base: str) -> DataFrame:
    """One point for each answer, ties not merged: its place in the order of times, as a share of its variant's answers."""
    return ecdf(fact(spark, base, ["variant_label", "response_time"]), "variant_label", "response_time")


@catalog.add("answers_by_question", f"""WITH {FACT_SQL} SELECT question_id, count(*) AS n_answers, count(DISTINCT model_short) AS n_models, min(response_time) AS fastest, count(*) FILTER (WHERE ai_correct) AS n_correct FROM f GROUP BY 1""")
def answers_by_question(spark: SparkSession, base: str) -> DataFrame:
    return fact(spark, base, ["run_id", "question_id", "model_short", "ai_correct", "response_time"]).groupBy("question_id").agg(
        F.count("*").alias("n_answers"), F.count_distinct("model_short").alias("n_models"), F.min("response_time").alias("fastest"), F.count_if("ai_correct").alias("n_correct")
    )


@catalog.add("mcnemar_variants")
def mcnemar_variants(spark: SparkSession, base: str) -> DataFrame:
    """Paired tests of the variants of each model, with bootstrap limits of the difference."""
    m = mart_variant_pairwise(spark, base)
    cells = m.withColumnsRenamed({"both_correct": "both", "both_wrong": "neither"})
    limits = bootstrap_interval(cells, ["run_a", "run_b"])
    tested = m.select("model_short", "reasoning_mode", "variant_a", "variant_b", "run_a", "run_b", "n", "a_only", "b_only", "accuracy_diff", mcnemar_p("a_only", "b_only").alias("p_value"))
    return tested.withColumn("significant", F.col("p_value") < 0.05).join(limits, ["run_a", "run_b"])


@catalog.add("mcnemar_statistic", """SELECT a.run_id AS run_a, b.run_id AS run_b, count(*) FILTER (WHERE a.ok AND NOT b.ok) AS a_only, count(*) FILTER (WHERE NOT a.ok AND b.ok) AS b_only,
    CASE WHEN count(*) FILTER (WHERE a.ok <> b.ok) > 0 THEN pow(abs(count(*) FILTER (WHERE a.ok AND NOT b.ok) - count(*) FILTER (WHERE NOT a.ok AND b.ok)) - 1, 2)::double / count(*) FILTER (WHERE a.ok <> b.ok) END AS chi2
  FROM (SELECT f.run_id, f.question_id, arg_min(f.ai_correct, f.answer_id) AS ok, any_value(r.model_key) AS m, any_value(r.reasoning_mode) AS mode, any_value(r.prompt_variant) AS v FROM fct_answer f JOIN runs r USING (run_id) GROUP BY 1, 2) a
  JOIN (SELECT f.run_id, f.question_id, arg_min(f.ai_correct, f.answer_id) AS ok, any_value(r.model_key) AS m, any_value(r.reasoning_mode) AS mode, any_value(r.prompt_variant) AS v FROM fct_answer f JOIN runs r USING (run_id) GROUP BY 1, 2) b
    ON a.question_id = b.question_id AND a.m = b.m AND a.mode = b.mode AND a.v < b.v GROUP BY 1, 2""")  # fmt: skip
def mcnemar_statistic(spark: SparkSession, base: str) -> DataFrame:
    m = mart_variant_pairwise(spark, base)
    n, gap = F.col("a_only") + F.col("b_only"), F.abs(F.col("a_only") - F.col("b_only")) - 1
    return m.select("run_a", "run_b", "a_only", "b_only", F.when(n > 0, (gap * gap).cast("double") / n).alias("chi2"))


@catalog.add("variant_p_matrix")
def variant_p_matrix(spark: SparkSession, base: str) -> DataFrame:
    """p of each pair of variants of a model, in both directions, as a matrix."""
    m = mart_variant_pairwise(spark, base).groupBy("model_short", "reasoning_mode", "variant_a", "variant_b").agg(F.sum("a_only").alias("a_only"), F.sum("b_only").alias("b_only"))
    p = m.withColumn("p", mcnemar_p("a_only", "b_only"))
    one = p.select("model_short", "reasoning_mode", "variant_a", "variant_b", "p")
    both = one.union(p.select("model_short", "reasoning_mode", "variant_b", "variant_a", "p"))
    return both.groupBy("model_short", "reasoning_mode", "variant_a").pivot("variant_b", ["v1_letter", "v2_fewshot", "v3_json"]).agg(F.first("p"))


def _difficulty_shares(spark: SparkSession, base: str) -> DataFrame:
    f = fact(spark, base, ["run_id", "question_id", "model_short", "difficulty", "ai_correct"])
    q = f.groupBy("model_short", "question_id", "difficulty").agg(F.avg(F.col("ai_correct").cast("int")).alias("share"))
    return q.withColumn("level", F.when(F.col("difficulty") == "easy", 1).when(F.col("difficulty") == "medium", 2).otherwise(3))


@catalog.add("difficulty_rank_correlation", f"""WITH {FACT_SQL}, q AS (SELECT model_short, question_id, difficulty, avg(ai_correct::int) AS share, CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS level FROM f GROUP BY ALL),
  r AS (SELECT model_short, rank() OVER (PARTITION BY model_short ORDER BY level) + (count(*) OVER (PARTITION BY model_short, level) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY model_short ORDER BY share) + (count(*) OVER (PARTITION BY model_short, share) - 1) / 2.0 AS b FROM q WHERE share IS NOT NULL)
  SELECT model_short, count(*) AS n, CASE WHEN count(*) < 3 THEN NULL ELSE round(corr(a, b), 9) END AS rho FROM r GROUP BY 1""")  # fmt: skip
def difficulty_rank_correlation(spark: SparkSession, base: str) -> DataFrame:
    """Rank correlation of a question's difficulty with the share of its right answers, by model."""
    return spearman(_difficulty_shares(spark, base), ["model_short"], "level", "share").select("model_short", "n", F.round("rho", 9).alias("rho"))


@catalog.add("difficulty_rank_p_value")
def difficulty_rank_p_value(spark: SparkSession, base: str) -> DataFrame:
    """The same with its p."""
    return spearman(_difficulty_shares(spark, base), ["model_short"], "level", "share")


@catalog.add("category_difficulty_matrix", f"""WITH {FACT_SQL}, a AS (SELECT category, difficulty, avg(ai_correct::int) AS x FROM f GROUP BY ALL)
  SELECT category, max(x) FILTER (difficulty = 'easy') AS easy, max(x) FILTER (difficulty = 'medium') AS medium, max(x) FILTER (difficulty = 'hard') AS hard FROM a GROUP BY category""")  # fmt: skip
def category_difficulty_matrix(spark: SparkSession, base: str) -> DataFrame:
    f = fact(spark, base, ["run_id", "question_id", "category", "difficulty", "ai_correct"])
    return f.groupBy("category").pivot("difficulty", ["easy", "medium", "hard"]).agg(F.avg(F.col("ai_correct").cast("int")))


@catalog.add("hardest_categories", f"WITH {FACT_SQL} SELECT category, count(*) AS n, avg(ai_correct::int) AS accuracy FROM f GROUP BY category ORDER BY accuracy, category LIMIT 12")
def hardest_categories(spark: SparkSession, base: str) -> DataFrame:
    f = fact(spark, base, ["run_id", "question_id", "category", "ai_correct"])
    return f.groupBy("category").agg(F.count("*").alias("n"), F.avg(F.col("ai_correct").cast("int")).alias("accuracy")).orderBy("accuracy", "category").limit(12)


@catalog.add("family_accuracy", f"WITH {FACT_SQL} SELECT model_short, category_group, count(*) AS n, count(*) FILTER (WHERE ai_correct) AS n_correct, count(*) FILTER (WHERE ai_correct)::double / count(*) AS accuracy FROM f GROUP BY ALL")
def family_accuracy(spark: SparkSession, base: str) -> DataFrame:
    """The category mart added up to families, weighted by its counts."""
    m = mart_accuracy_by_category(spark, base).groupBy("model_short", "category_group").agg(F.sum("n").alias("n"), F.sum("n_correct").alias("n_correct"))
    return m.withColumn("accuracy", F.col("n_correct").cast("double") / F.nullif("n", F.lit(0)))


@catalog.add("best_and_worst_runs", f"""WITH {FACT_SQL}, a AS (SELECT run_id, count(*) AS n, avg(ai_correct::int) AS accuracy FROM f GROUP BY 1)
  (SELECT 'best' AS place, run_id, n, accuracy FROM a ORDER BY accuracy DESC, run_id LIMIT 1) UNION ALL (SELECT 'worst', run_id, n, accuracy FROM a ORDER BY accuracy, run_id LIMIT 1)""")  # fmt: skip
def best_and_worst_runs(spark: SparkSession, base: str) -> DataFrame:
    s = mart_run_summary(spark, base).select("run_id", "n", "accuracy")
    best = s.orderBy(F.desc("accuracy"), "run_id").limit(1).select(F.lit("best").alias("place"), "*")
    return best.unionByName(s.orderBy("accuracy", "run_id").limit(1).select(F.lit("worst").alias("place"), "*"))


@catalog.add("letter_shares_long", f"""WITH {FACT_SQL}, m AS (SELECT * FROM f WHERE type = 'multiple'), t AS (SELECT run_id, count(*) AS n FROM m GROUP BY 1), c AS (SELECT run_id, correct_letter AS letter, count(*) AS k FROM m GROUP BY ALL),
  p AS (SELECT run_id, predicted_letter AS letter, count(*) AS k FROM m WHERE predicted_letter IS NOT NULL GROUP BY ALL)
  SELECT run_id, letter, 'correct' AS kind, k::double / n AS share FROM c JOIN t USING (run_id) UNION ALL SELECT c.run_id, c.letter, 'predicted', coalesce(p.k, 0)::double / n FROM c JOIN t ON c.run_id = t.run_id LEFT JOIN p ON p.run_id = c.run_id AND p.letter = c.letter""")  # fmt: skip
def letter_shares_long(spark: SparkSession, base: str) -> DataFrame:
    m = mart_position_bias(spark, base).select("run_id", "letter", F.col("share_is_correct_letter").alias("correct"), F.col("share_predicted").alias("predicted"))
    return m.unpivot(["run_id", "letter"], ["correct", "predicted"], "kind", "share")


@catalog.add("answer_verdicts", f"""WITH {FACT_SQL} SELECT run_id, CASE WHEN ai_correct THEN 'right' WHEN grade IN ('unparseable', 'error') THEN 'unusable' ELSE 'wrong' END AS verdict, count(*) AS n FROM f GROUP BY ALL""")
def answer_verdicts(spark: SparkSession, base: str) -> DataFrame:
    verdict = F.when(F.col("ai_correct"), "right").when(F.col("grade").isin("unparseable", "error"), "unusable").otherwise("wrong")
    return fact(spark, base, ["run_id", "question_id", "ai_correct", "grade"]).groupBy("run_id", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@catalog.add("run_labels", """SELECT run_id, CASE WHEN (SELECT count(DISTINCT model_key) FROM runs) > 1 THEN regexp_replace(model_key, '^[^/]+/', '') || ' · ' || coalesce(variant_label, '?') ELSE coalesce(variant_label, '?') END AS label,
  model_size_bytes / 1e9 AS size_gb FROM runs""")  # fmt: skip
def run_labels(spark: SparkSession, base: str) -> DataFrame:
    """The model is part of a run's label only if there are several."""
    runs = dim_run(spark, base)
    several = runs.agg(F.count_distinct("model_key") > 1).scalar()
    variant = F.coalesce("variant_label", F.lit("?"))
    label = F.when(several, F.concat_ws(" · ", "model_short", variant)).otherwise(variant)
    return runs.select("run_id", label.alias("label"), (F.col("model_size_bytes") / 1e9).alias("size_gb"))


@catalog.add("latest_resumable_run", """SELECT model_key, prompt_variant, reasoning_mode, run_id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY model_key, prompt_variant, reasoning_mode ORDER BY started_at DESC, run_id DESC) AS k FROM runs WHERE status = 'partial') WHERE k = 1""")
def latest_resumable_run(spark: SparkSession, base: str) -> DataFrame:
    keys = ["model_key", "prompt_variant", "reasoning_mode"]
    last = table(spark, base, "runs").where("status = 'partial'").groupBy(*keys).agg(F.max(F.struct("started_at", "run_id")).alias("r"))
    return last.select(*keys, "r.run_id", "r.started_at")


@catalog.add("pending_questions", """SELECT r.run_id, count(*) AS n_pending FROM runs r, questions q WHERE r.status = 'partial' AND NOT q.is_fewshot_example
  AND NOT EXISTS (SELECT 1 FROM llm_responses l WHERE l.run_id = r.run_id AND l.question_id = q.question_id AND l.error IS NULL) GROUP BY 1""")  # fmt: skip
def pending_questions(spark: SparkSession, base: str) -> DataFrame:
    """Questions a partial run has no answer to: all of them but those it has, counted without making the pairs."""
    open_ = table(spark, base, "questions").where("not is_fewshot_example").select("question_id")
    runs = table(spark, base, "runs").where("status = 'partial'").select("run_id")
    done = table(spark, base, "llm_responses").where("error is null").select("run_id", "question_id").distinct().join(open_, "question_id", "left_semi")
    counted = done.groupBy("run_id").agg(F.count("*").alias("_done"))
    total = open_.agg(F.count("*")).scalar()
    return runs.join(counted, "run_id", "left").select("run_id", (total - F.coalesce("_done", F.lit(0))).alias("n_pending")).where("n_pending > 0")


@catalog.add("sample_stratified")
def sample_stratified(spark: SparkSession, base: str) -> DataFrame:
    """A tenth of the questions, each category, difficulty and type in proportion."""
    q = table(spark, base, "questions")
    n = q.where("not is_fewshot_example").count()
    strata = q.where("not is_fewshot_example").select("category_group", "difficulty", "type").distinct().count()
    return sample(q, f"stratified:{max(n // 10, strata)}", ["category_group", "difficulty", "type"])


@catalog.add("sample_first", "SELECT * FROM questions WHERE NOT is_fewshot_example ORDER BY question_id LIMIT 500")
def sample_first(spark: SparkSession, base: str) -> DataFrame:
    return sample(table(spark, base, "questions"), "limit:500")


@catalog.add("expected_format_by_label", f"""WITH {FACT_SQL} SELECT coalesce(variant_label, '?') AS label, sum(is_expected_format::int)::bigint AS n_expected, count(*) AS n FROM f GROUP BY ALL""")
def expected_format_by_label(spark: SparkSession, base: str) -> DataFrame:
    m = mart_grade_breakdown(spark, base)
    return m.groupBy(F.coalesce("variant_label", F.lit("?")).alias("label")).agg(F.sum("n_expected_format").alias("n_expected"), F.sum("n").alias("n"))


PROMPT_SQL = """WITH o AS (SELECT *, CASE WHEN type = 'multiple' THEN 'A) ' || options[1] || chr(10) || 'B) ' || options[2] || chr(10) || 'C) ' || options[3] || chr(10) || 'D) ' || options[4] END AS lettered FROM questions),
  e AS (SELECT type, string_agg(CASE WHEN type = 'multiple' THEN 'Question: ' || question || chr(10) || lettered || chr(10) || 'Answer: ' || correct_letter ELSE 'Statement: ' || question || chr(10) || 'Answer: ' || correct_answer END, chr(10) || chr(10) ORDER BY question_id) AS examples FROM o WHERE is_fewshot_example GROUP BY type),
  q AS (SELECT o.*, e.examples, CASE WHEN o.type = 'multiple' THEN 'Question: ' ELSE 'Statement: ' END || question AS head FROM o LEFT JOIN e USING (type) WHERE NOT is_fewshot_example),
  p AS (SELECT question_id, 'v1_letter' AS variant, NULL AS system, CASE WHEN type = 'multiple' THEN head || chr(10) || chr(10) || lettered || chr(10) || chr(10) || 'Answer with the letter only (A, B, C, or D). Do not explain.'
      ELSE head || chr(10) || chr(10) || 'Is this statement True or False?' || chr(10) || chr(10) || 'Answer with one word only: True or False.' END AS prompt FROM q
    UNION ALL SELECT question_id, 'v2_fewshot', NULL, CASE WHEN type = 'multiple' THEN 'Answer each multiple choice question with only the letter of the correct answer.' ELSE 'Answer each statement with only True or False.' END
      || chr(10) || chr(10) || examples || chr(10) || chr(10) || head || chr(10) || CASE WHEN type = 'multiple' THEN lettered || chr(10) ELSE '' END || 'Answer:' FROM q WHERE examples IS NOT NULL
    UNION ALL SELECT question_id, 'v3_json', 'You answer trivia questions. Respond only with a single JSON object matching the given schema. Do not include any text outside the JSON object.', CASE WHEN type = 'multiple' THEN head || chr(10) || chr(10) || lettered ELSE head END FROM q)"""


@catalog.add("rendered_prompts", PROMPT_SQL + " SELECT *, length(prompt)::int AS n_chars FROM p")
def rendered_prompts(spark: SparkSession, base: str) -> DataFrame:
    return rendered(table(spark, base, "questions")).withColumn("n_chars", F.char_length("prompt"))


@catalog.add("prompt_hashes", PROMPT_SQL + " SELECT question_id, variant, sha256(coalesce(system, '') || chr(0) || prompt) AS prompt_sha256 FROM p")
def prompt_hashes(spark: SparkSession, base: str) -> DataFrame:
    """The fingerprint of each rendered prompt, system part included."""
    return rendered(table(spark, base, "questions")).select("question_id", "variant", prompt_hash(F.col("system"), F.col("prompt")).alias("prompt_sha256"))


@catalog.add("marker_leaks", """SELECT run_id, count(*) AS n, count(*) FILTER (WHERE content LIKE '%<|%' OR content LIKE '%|>%' OR content LIKE '%</s>%' OR content LIKE '%<s>%' OR content LIKE '%[INST]%' OR content LIKE '%[/INST]%'
  OR content LIKE '%<end_of_turn>%' OR content LIKE '%<eos>%') AS n_leaks FROM llm_responses GROUP BY run_id""")
def marker_leaks(spark: SparkSession, base: str) -> DataFrame:
    """Replies that hold a mark of a chat template, by run."""
    return table(spark, base, "llm_responses").groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(leaks_markers(F.col("content"))).alias("n_leaks"))


@catalog.add("run_slugs", """SELECT run_id, trim(regexp_replace(lower(regexp_extract(model_key, '([^/]*)$', 1)), '[^a-z0-9.-]+', '-', 'g'), '-') || '__' || prompt_variant || '__r' || reasoning_mode || '__' || strftime(started_at, '%Y%m%d-%H%M') AS slug FROM runs""")
def run_slugs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "runs").select("run_id", run_slug(*map(F.col, ("model_key", "prompt_variant", "reasoning_mode", "started_at"))).alias("slug"))


@catalog.add("tradeoff_sizes", f"""WITH {FACT_SQL}, a AS (SELECT run_id, avg(ai_correct::int) AS accuracy, round(median(response_time), 9) AS median_time, max(r.model_size_bytes) AS size FROM f JOIN runs r USING (run_id) GROUP BY run_id)
  SELECT run_id, accuracy, median_time, round(14 + 22 * (size - min(size) OVER ()) / greatest(max(size) OVER () - min(size) OVER (), 1e-9), 6) AS diameter FROM a""")
def tradeoff_sizes(spark: SparkSession, base: str) -> DataFrame:
    """Accuracy against time, and the model's size scaled between the smallest and the largest."""
    s = mart_run_summary(spark, base).select("run_id", "accuracy", F.col("median_response_time").alias("median_time"))
    runs = table(spark, base, "runs").select("run_id", F.col("model_size_bytes").cast("double").alias("size"))
    low, high = (runs.join(s, "run_id", "left_semi").agg(f("size")).scalar() for f in (F.min, F.max))
    scaled = F.lit(14.0) + 22.0 * (F.col("size") - low) / F.greatest(high - low, F.lit(1e-9))
    return s.join(runs, "run_id").select("run_id", "accuracy", "median_time", F.round(scaled, 6).alias("diameter"))


ANSWER = ["run_id", "model_short", "variant_label", "prompt_variant", "reasoning_mode", "ai_answer", "ai_reasoning", "predicted_letter", "predicted_text", "ai_correct", "grade", "response_time", "completion_tokens"]


def answers_for(spark: SparkSession, base: str, question_id: str) -> DataFrame:
    """All answers to a question, by variant."""
    return fact(spark, base, ["question_id", *ANSWER]).where(F.col("question_id") == question_id).orderBy("prompt_variant", "run_id").select(*ANSWER)


@catalog.add("answers_for_question", f"WITH {FACT_SQL} SELECT {', '.join(ANSWER)} FROM f WHERE question_id = (SELECT max(question_id) FROM fct_answer)")
def answers_for_question(spark: SparkSession, base: str) -> DataFrame:
    """Those to the last question by identifier."""
    return answers_for(spark, base, fact(spark, base, ["question_id"]).agg(F.max("question_id")).first()[0])


def paired_by_runs(spark: SparkSession, base: str, run_a: str, run_b: str) -> DataFrame:
    """(question_id, correct_a, correct_b) of the questions that both runs answered."""
    f = fact(spark, base, ["run_id", "question_id", "ai_correct"])
    a = f.where(F.col("run_id") == run_a).select("question_id", F.col("ai_correct").alias("correct_a"))
    return a.join(f.where(F.col("run_id") == run_b).select("question_id", F.col("ai_correct").alias("correct_b")), "question_id")


@catalog.add("paired_answers", f"""WITH {FACT_SQL}, r AS (SELECT run_id, row_number() OVER (ORDER BY count(*) DESC, run_id) AS k FROM f GROUP BY run_id)
  SELECT a.question_id, a.ai_correct AS correct_a, b.ai_correct AS correct_b FROM f a JOIN f b USING (question_id) WHERE a.run_id = (SELECT run_id FROM r WHERE k = 1) AND b.run_id = (SELECT run_id FROM r WHERE k = 2)""")  # fmt: skip
def paired_answers(spark: SparkSession, base: str) -> DataFrame:
    """Those of the two runs with the most answers."""
    largest = fact(spark, base, ["run_id"]).groupBy("run_id").count().orderBy(F.desc("count"), "run_id").limit(2).collect()
    a, b = (largest[min(i, len(largest) - 1)].run_id if largest else None for i in (0, 1))
    return paired_by_runs(spark, base, a, b)


def weighted(mean: str, n: str) -> F.Column:
    """The mean of means that stand for ``n`` rows each; 0 for none."""
    return F.coalesce(F.sum(F.col(mean) * F.col(n)) / F.greatest(F.sum(n), F.lit(1)), F.lit(0.0))


PAIRS_SQL = """, r AS (SELECT * FROM runs), p AS (SELECT ra.run_id AS run_a, rb.run_id AS run_b, ra.prompt_variant AS va, rb.prompt_variant AS vb, a.ai_correct AS ca, b.ai_correct AS cb FROM r ra JOIN r rb
  ON ra.model_key = rb.model_key AND ra.reasoning_mode = rb.reasoning_mode AND ra.prompt_variant < rb.prompt_variant JOIN f a ON a.run_id = ra.run_id JOIN f b ON b.run_id = rb.run_id AND a.question_id = b.question_id)"""


@catalog.add("variant_gains", f"""WITH {FACT_SQL}{PAIRS_SQL} SELECT va AS variant_a, vb AS variant_b, count(*) AS n, count(*) FILTER (WHERE ca AND NOT cb) AS a_only, count(*) FILTER (WHERE NOT ca AND cb) AS b_only,
  round(avg(ca::int), 9) AS accuracy_a, round(avg(cb::int), 9) AS accuracy_b, round(avg(cb::int) - avg(ca::int), 9) AS gain FROM p GROUP BY ALL""")  # fmt: skip
def variant_gains(spark: SparkSession, base: str) -> DataFrame:
    """Totals over all pairs of runs of two variants, with means weighted by the pairs' questions."""
    m = mart_variant_pairwise(spark, base).groupBy("variant_a", "variant_b").agg(F.sum("n").alias("questions"), F.sum("a_only").alias("a_only"), F.sum("b_only").alias("b_only"), weighted("accuracy_a", "n").alias("a"), weighted("accuracy_b", "n").alias("b"))
    return m.select("variant_a", "variant_b", F.col("questions").alias("n"), "a_only", "b_only", F.round("a", 9).alias("accuracy_a"), F.round("b", 9).alias("accuracy_b"), F.round(F.col("b") - F.col("a"), 9).alias("gain"))


@catalog.add("reasoning_gain", f"""WITH {FACT_SQL}, p AS (SELECT a.ai_correct AS ca, b.ai_correct AS cb FROM runs ra JOIN runs rb ON ra.model_key = rb.model_key AND ra.prompt_variant = rb.prompt_variant AND ra.reasoning_mode = 'off' AND rb.reasoning_mode = 'on'
    JOIN f a ON a.run_id = ra.run_id JOIN f b ON b.run_id = rb.run_id AND a.question_id = b.question_id)
  SELECT count(*) AS n, count(*) FILTER (WHERE ca AND NOT cb) AS off_only, count(*) FILTER (WHERE NOT ca AND cb) AS on_only, round(coalesce(avg(cb::int) - avg(ca::int), 0), 9) AS gain FROM p""")  # fmt: skip
def reasoning_gain(spark: SparkSession, base: str) -> DataFrame:
    """What reasoning gains over all pairs of runs together."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return mart_reasoning_pairwise(spark, base).agg(total("n"), total("off_only"), total("on_only"), F.round(weighted("accuracy_gain", "n"), 9).alias("gain"))


def with_order(pairs: DataFrame, first: str) -> DataFrame:
    """Pairs of variants so that ``first`` is variant_a wherever it is one of the two: all columns of a and b change places."""
    flip = F.col("variant_b") == first
    both = [(c, f"{other}{c[1:]}" if c.startswith(f"{side}_") else f"{c[:-1]}{other}") for c in pairs.columns for side, other in (("a", "b"), ("b", "a")) if (c.startswith(f"{side}_only") or c.endswith(f"_{side}")) and c != "run_" + side]
    both += [("run_a", "run_b"), ("run_b", "run_a")]
    swapped = {c: F.when(flip, F.col(o)).otherwise(F.col(c)) for c, o in both if o in pairs.columns}
    return pairs.withColumns(swapped | {"accuracy_diff": F.when(flip, -F.col("accuracy_diff")).otherwise(F.col("accuracy_diff"))})


@catalog.add("variants_against_json", f"""WITH {FACT_SQL}{PAIRS_SQL} SELECT CASE WHEN vb = 'v3_json' THEN vb ELSE va END AS variant_a, CASE WHEN vb = 'v3_json' THEN va ELSE vb END AS variant_b, CASE WHEN vb = 'v3_json' THEN run_b ELSE run_a END AS run_a,
  CASE WHEN vb = 'v3_json' THEN run_a ELSE run_b END AS run_b, count(*) AS n, count(*) FILTER (WHERE CASE WHEN vb = 'v3_json' THEN cb AND NOT ca ELSE ca AND NOT cb END) AS a_only, count(*) FILTER (WHERE CASE WHEN vb = 'v3_json' THEN ca AND NOT cb ELSE cb AND NOT ca END) AS b_only,
  round(CASE WHEN vb = 'v3_json' THEN avg(cb::int) - avg(ca::int) ELSE avg(ca::int) - avg(cb::int) END, 9) AS accuracy_diff FROM p GROUP BY va, vb, p.run_a, p.run_b""")  # fmt: skip
def variants_against_json(spark: SparkSession, base: str) -> DataFrame:
    """The pairs of variants seen from one of them."""
    return with_order(mart_variant_pairwise(spark, base), "v3_json").select("variant_a", "variant_b", "run_a", "run_b", "n", "a_only", "b_only", F.round("accuracy_diff", 9).alias("accuracy_diff"))


@catalog.add("selectors", f"""WITH {FACT_SQL} SELECT DISTINCT 'model_short' AS selector, model_short AS value FROM f UNION SELECT 'variant_label', variant_label FROM f UNION SELECT 'category', category FROM f UNION SELECT 'grade', grade FROM f""")
def selectors(spark: SparkSession, base: str) -> DataFrame:
    """The values to choose from, in order."""
    names = ["model_short", "variant_label", "category", "grade"]
    f = fact(spark, base, names).groupBy(*names).count()
    return f.select(F.inline(F.array(*(F.struct(F.lit(n).alias("selector"), F.col(n).alias("value")) for n in names)))).distinct().orderBy("selector", "value")


@catalog.add("compared_variants", """SELECT DISTINCT v FROM (SELECT unnest([ra.prompt_variant, rb.prompt_variant]) AS v FROM runs ra JOIN runs rb ON ra.model_key = rb.model_key AND ra.reasoning_mode = rb.reasoning_mode AND ra.prompt_variant < rb.prompt_variant
  WHERE EXISTS (SELECT 1 FROM fct_answer a JOIN fct_answer b ON a.question_id = b.question_id WHERE a.run_id = ra.run_id AND b.run_id = rb.run_id))""")  # fmt: skip
def compared_variants(spark: SparkSession, base: str) -> DataFrame:
    """Variants that are either side of a pair."""
    m = mart_variant_pairwise(spark, base)
    return m.select(F.col("variant_a").alias("v")).union(m.select("variant_b")).distinct()


def by_prefix(questions: DataFrame, prefix: str) -> DataFrame:
    """The first question whose identifier begins so."""
    return questions.where(F.col("question_id").startswith(prefix)).orderBy("question_id").limit(1)


@catalog.add("question_by_prefix", "SELECT * FROM questions WHERE starts_with(question_id, (SELECT substr(max(question_id), 1, 4) FROM questions)) ORDER BY question_id LIMIT 1")
def question_by_prefix(spark: SparkSession, base: str) -> DataFrame:
    q = table(spark, base, "questions")
    last = q.agg(F.max("question_id")).first()[0]
    return by_prefix(q, (last or "")[:4])


@catalog.add("letter_gaps", f"""WITH {FACT_SQL}, m AS (SELECT * FROM f WHERE type = 'multiple'), t AS (SELECT run_id, count(*) AS n FROM m GROUP BY 1), c AS (SELECT run_id, correct_letter AS letter, count(*) AS k FROM m GROUP BY ALL),
  p AS (SELECT run_id, predicted_letter AS letter, count(*) AS k FROM m WHERE predicted_letter IS NOT NULL GROUP BY ALL)
  SELECT c.run_id, c.letter, round((coalesce(p.k, 0) - c.k)::double / n, 9) AS gap FROM c JOIN t ON c.run_id = t.run_id LEFT JOIN p ON p.run_id = c.run_id AND p.letter = c.letter""")  # fmt: skip
def letter_gaps(spark: SparkSession, base: str) -> DataFrame:
    """How much oftener a letter is predicted than right."""
    return mart_position_bias(spark, base).select("run_id", "letter", F.round(F.col("share_predicted") - F.col("share_is_correct_letter"), 9).alias("gap"))


@catalog.add("consistency_totals", f"""WITH {FACT_SQL}, a AS (SELECT model_short, question_id, category, difficulty, type, question, correct_answer, count(*) AS n, count(*) FILTER (WHERE ai_correct) AS k FROM f GROUP BY ALL)
  SELECT model_short, count(*) AS n_questions, count(*) FILTER (WHERE k = n) AS n_all_correct, count(*) FILTER (WHERE k = 0) AS n_all_wrong, count(*) FILTER (WHERE k > 0 AND k < n) AS n_mixed FROM a GROUP BY 1""")  # fmt: skip
def consistency_totals(spark: SparkSession, base: str) -> DataFrame:
    """How many questions each model always, never and sometimes answers rightly."""
    counts = (F.count_if(c).alias(f"n_{c.removeprefix('is_')}") for c in ("all_correct", "all_wrong", "is_mixed"))
    return mart_question_consistency(spark, base).groupBy("model_short").agg(F.count("*").alias("n_questions"), *counts)


@catalog.add("small_categories", f"""WITH {FACT_SQL}, a AS (SELECT run_id, category, count(*) AS n FROM f GROUP BY run_id, category) SELECT run_id, count(*) AS n_categories, count(*) FILTER (WHERE n < 30) AS n_small FROM a GROUP BY 1""")
def small_categories(spark: SparkSession, base: str) -> DataFrame:
    """Categories of a run with too few answers to say much."""
    return mart_accuracy_by_category(spark, base).groupBy("run_id").agg(F.count("*").alias("n_categories"), F.count_if("n_flag_low").alias("n_small"))


def relabelled(df: DataFrame, column: str, labels: dict[str, str], out: str) -> DataFrame:
    """``out``: the label of a column's value, ``?`` where there is none."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)) if labels else F.lit(None).cast("map<string,string>")
    return df.withColumn(out, F.coalesce(known[F.col(column)], F.lit("?")))


@catalog.add("grade_labels", f"""WITH {FACT_SQL} SELECT grade, coalesce(CASE grade WHEN 'letter' THEN 'letter found' WHEN 'exact' THEN 'exact text' WHEN 'fuzzy' THEN 'similar text' WHEN 'contains' THEN 'contained' WHEN 'wrong' THEN 'wrong' END, '?') AS label, count(*) AS n FROM f GROUP BY ALL""")
def grade_labels(spark: SparkSession, base: str) -> DataFrame:
    counts = fact(spark, base, ["grade"]).groupBy("grade").agg(F.count("*").alias("n"))
    return relabelled(counts, "grade", {"letter": "letter found", "exact": "exact text", "fuzzy": "similar text", "contains": "contained", "wrong": "wrong"}, "label")


def of_categories(questions: DataFrame, ids: list[int] | None) -> DataFrame:
    """Questions of certain categories; of all for None."""
    return questions if ids is None else questions.where(F.col("category_id").isin(ids))


@catalog.add("category_subset", "SELECT category_id, category, count(*) AS n FROM questions WHERE category_id IN (9, 17, 22, 23) GROUP BY ALL")
def category_subset(spark: SparkSession, base: str) -> DataFrame:
    return of_categories(table(spark, base, "questions"), [9, 17, 22, 23]).groupBy("category_id", "category").agg(F.count("*").alias("n"))


def not_collected(records: DataFrame, collected: DataFrame, key: str = "question_id") -> DataFrame:
    """Records whose identifier wasn't collected before."""
    return records.join(collected.select(key).distinct(), key, "left_anti")


@catalog.add("unanswered_questions", "SELECT question_id, category FROM questions q WHERE NOT EXISTS (SELECT 1 FROM llm_responses l WHERE l.question_id = q.question_id AND l.error IS NULL)")
def unanswered_questions(spark: SparkSession, base: str) -> DataFrame:
    """Questions that no call answered yet."""
    done = table(spark, base, "llm_responses").where("error is null")
    return not_collected(table(spark, base, "questions").select("question_id", "category"), done)


@catalog.add("decoded_records", """SELECT raw_id, category, type, difficulty, question, correct_answer, from_json(incorrect_answers, '["VARCHAR"]') AS incorrect_answers FROM raw_questions""")
def decoded_records(spark: SparkSession, base: str) -> DataFrame:
    """Raw records as they come over the wire, in base64, and decoded again."""
    plain = ["category", "type", "difficulty", "question", "correct_answer"]
    raw = table(spark, base, "raw_questions").select("raw_id", *(F.base64(F.encode(c, "UTF-8")).alias(c) for c in plain), F.transform(F.from_json("incorrect_answers", "array<string>"), lambda x: F.base64(F.encode(x, "UTF-8"))).alias("incorrect_answers"))
    return decoded(raw, plain, ["incorrect_answers"])


@catalog.add("slow_answers", f"WITH {FACT_SQL} SELECT run_id, count(*) AS n FROM f WHERE response_time > 5.0 AND grade = 'wrong' GROUP BY run_id")
def slow_answers(spark: SparkSession, base: str) -> DataFrame:
    """A query with parameters."""
    fact(spark, base, ["run_id", "grade", "response_time"]).createOrReplaceTempView("evalmill_answers")
    return run_sql(spark, base, [], "SELECT run_id, count(*) AS n FROM evalmill_answers WHERE response_time > :seconds AND grade = :grade GROUP BY run_id", {"seconds": 5.0, "grade": "wrong"})
