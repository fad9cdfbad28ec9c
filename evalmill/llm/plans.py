"""The llm subpackage's queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..session import scratch
from ..sources.tables import table
from . import percentiles as radix
from .canonical import canonical_entries
from .encoding import encode_corpus
from .formatting import collapse, further_copies
from .language import fit_languages
from .packing import neighbourhood, pack_along_curve, with_curve_key
from .pairs import defective_pairs
from .personal import find_personal, learned_names, redacted
from .truncation import prior_odds, truncated_replies

catalog = Catalog()
RECORD = ["category", "type", "difficulty", "question", "correct_answer"]


@catalog.add("p1_found")
def p1_found(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "raw_questions").select("raw_id", *RECORD, "incorrect_answers")
    return further_copies(collapse(rows, "raw_id", RECORD, ["incorrect_answers"]))


@catalog.add("p1_records")
def p1_records(spark: SparkSession, base: str) -> DataFrame:
    """Each record once, as its first row has it, with the number of its copies."""
    rows = table(spark, base, "raw_questions").select("raw_id", *RECORD, "incorrect_answers")
    groups = collapse(rows, "raw_id", RECORD, ["incorrect_answers"]).groups
    return groups.select(F.col("first_id").alias("raw_id"), F.col("n").alias("n_copies")).join(rows, "raw_id")


QUANTILES = [0.5, 0.9, 0.95, 0.99]
#: Percentiles by run and by variant, each over all batches (batch_no null) and for each batch.
SETS = [{"dimension": f"'{c}'", "level": f"'{level}'", "group_value": c, "batch_no": b} for c in ("run_id", "variant_label") for level, b in (("all", "cast(null as int)"), ("batch", "batch_no"))]
BY = ["run_id", "variant_label", "batch_no"]
P2_SQL = """WITH g AS (
  SELECT 'run_id' AS dimension, 'all' AS level, run_id AS group_value, NULL::int AS batch_no, response_time AS v FROM fct_answer
  UNION ALL SELECT 'run_id', 'batch', run_id, batch_no, response_time FROM fct_answer
  UNION ALL SELECT 'variant_label', 'all', variant_label, NULL, response_time FROM fct_answer
  UNION ALL SELECT 'variant_label', 'batch', variant_label, batch_no, response_time FROM fct_answer),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension, level, group_value, batch_no ORDER BY v) AS rn,
             count(*) OVER (PARTITION BY dimension, level, group_value, batch_no) AS n FROM g WHERE v IS NOT NULL)
SELECT dimension, level, group_value, batch_no, n, """ + ", ".join(f"max(v) FILTER (rn = greatest(1, ceil({q} * n - 1e-9))) AS p{q * 100:g}" for q in QUANTILES) + """
FROM r GROUP BY ALL"""


def _wide(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each group, its quantiles side by side."""
    names = {(q, c): f"p{q * 100:g}".replace(".", "_") + ("" if c == "value" else f"_{c}") for q in QUANTILES for c in columns}
    out = df.groupBy("_g").agg(F.max("total").alias("n"), *(F.max(F.when(F.col("q") == q, F.col(c))).alias(n) for (q, c), n in names.items()))
    return out.select("_g.*", "n", *names.values())


def _daily(spark: SparkSession, base: str, again: bool = False) -> tuple[DataFrame, DataFrame]:
    """The values as ordered integers, written once if they are read ``again``, and their summaries for each run, variant, batch and day."""
    rows = table(spark, base, "fct_answer").withColumn("day", F.to_date("called_at"))
    keys = radix.encoded(rows, [*BY, "day"], "response_time")
    keys = scratch(keys, "bits") if again else keys
    return keys, scratch(radix.summarise(keys, [*BY, "day"]), "daily")


@catalog.add(
    "p2_summaries",
    """WITH v AS (SELECT run_id, variant_label, batch_no, called_at::date AS day, response_time AS v, floor(log2(nullif(response_time, 0))) AS e0
               FROM fct_answer WHERE response_time IS NOT NULL),
     x AS (SELECT *, CASE WHEN v >= pow(2, e0 + 1) THEN e0 + 1 WHEN v < pow(2, e0) THEN e0 - 1 ELSE e0 END AS e FROM v)
     SELECT run_id, variant_label, batch_no, day, coalesce(pow(2, e) * floor(v / pow(2, e) * 16) / 16, 0) AS lo, count(*) AS n FROM x GROUP BY ALL""",
)
def p2_summaries(spark: SparkSession, base: str) -> DataFrame:
    """The mergeable form: bins (by their lower limit) of the values of each run, variant, batch and day."""
    _, daily = _daily(spark, base)
    return daily.select(*BY, "day", radix.from_bits(F.shiftleft("prefix", 64 - radix.DIGIT)).alias("lo"), "n")


@catalog.add("p2_percentiles", P2_SQL)
def p2_percentiles(spark: SparkSession, base: str) -> DataFrame:
    """Exact: the merged summaries tell which bins to follow to the last digit."""
    keys, daily = _daily(spark, base, again=True)
    return _wide(radix.select_exactly(keys, radix.first_digit(radix.merge(daily, BY), SETS, QUANTILES), SETS), ["value"])


@catalog.add("p2_bounds")
def p2_bounds(spark: SparkSession, base: str) -> DataFrame:
    """The same groups from the summaries alone, with the limits of each quantile (within 1/16 of it)."""
    _, daily = _daily(spark, base)
    return _wide(radix.within_bounds(radix.first_digit(radix.merge(daily, BY), SETS, QUANTILES)), ["lo", "hi"])


@catalog.add("p3_found")
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "fct_answer").select("answer_id", "predicted_text")
    return canonical_entries(rows, table(spark, base, "answer_entries"), "predicted_text").select("answer_id", "entry_id")


@catalog.add("p7_ids")
def p7_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode_corpus(table(spark, base, "documents"), "doc_id", "text")


#: Tokens a container holds.
CAPACITY = 2048


def _sized(spark: SparkSession, base: str) -> DataFrame:
    return scratch(with_curve_key(encode_corpus(table(spark, base, "documents"), "doc_id", "text"), "doc_id"), "sized")


@catalog.add("p8_packed")
def p8_packed(spark: SparkSession, base: str) -> DataFrame:
    return pack_along_curve(_sized(spark, base), "doc_id", CAPACITY)


@catalog.add("p8_quality")
def p8_quality(spark: SparkSession, base: str) -> DataFrame:
    """How full containers are and how close their items lie on the curve, beside items packed in random order and beside whole ranges."""
    sized = _sized(spark, base)
    along = pack_along_curve(sized, "doc_id", CAPACITY, with_key=True)
    mixed = sized.withColumn("key", F.xxhash64("doc_id"))
    random = pack_along_curve(mixed, "doc_id", CAPACITY).join(sized.select("doc_id", "key"), "doc_id")
    ranges = along.withColumn("container_id", F.shiftright("container_id", 40))
    rows = (neighbourhood(d, CAPACITY).select(F.lit(n).alias("packed"), "n_containers", F.when(F.lit(n != "ranges"), F.col("fill")).alias("fill"), "spread") for n, d in (("curve", along), ("random", random), ("ranges", ranges)))
    return reduce(DataFrame.unionByName, rows)


@catalog.add("p8_containers")
def p8_containers(spark: SparkSession, base: str) -> DataFrame:
    packed = p8_packed(spark, base)
    return packed.groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), (CAPACITY - F.sum("n_tokens")).alias("unused"))


def _names(spark: SparkSession, base: str) -> tuple[list[str], list[str]]:
    """(given names, names that are no person's): of the reference list, which is fixed and small, and given names that the documents show."""
    entries = table(spark, base, "answer_entries").select("kind", "name").dropna().collect()
    others = [r.name for r in entries if r.kind != "person"]
    learned = learned_names(table(spark, base, "documents"), "text", others)
    return sorted({r.name.split(" ")[0] for r in entries if r.kind == "person"}.union(learned)), others


@catalog.add("p9_found")
def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return find_personal(table(spark, base, "documents"), "doc_id", "text", *_names(spark, base))


@catalog.add("p9_redacted")
def p9_redacted(spark: SparkSession, base: str) -> DataFrame:
    return redacted(table(spark, base, "documents").select("doc_id", "text"), "text", *_names(spark, base)).drop("text")


def _truncated(spark: SparkSession, base: str, rows: DataFrame) -> DataFrame:
    """Of rows (question_id, text, finish_reason, max_tokens, completion_tokens, more) those with a truncated text."""
    questions = table(spark, base, "questions").select("question_id", "options")
    told = rows.withColumn("prior", prior_odds(*map(F.col, ("text", "finish_reason", "completion_tokens", "max_tokens")))).drop("finish_reason", "max_tokens", "completion_tokens")
    return truncated_replies(told, "text", "question_id", "prior", questions)


@catalog.add("p4_found")
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "llm_responses").select("response_id", "question_id", F.col("content").alias("text"), "finish_reason", "max_tokens", "completion_tokens")
    return _truncated(spark, base, rows).select("response_id")


@catalog.add("p4_shares")
def p4_shares(spark: SparkSession, base: str) -> DataFrame:
    """The share of truncated replies among those with a content, by run, model and transport."""
    rows = table(spark, base, "llm_responses").select("response_id", "run_id", "transport", "question_id", F.col("content").alias("text"), "finish_reason", "max_tokens", "completion_tokens")
    cut = _truncated(spark, base, rows).groupBy("run_id", "transport").agg(F.count("*").alias("n_truncated"))
    all_ = rows.groupBy("run_id", "transport").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"\S")).alias("n_content"))
    models = table(spark, base, "runs").select("run_id", "model_key").dropDuplicates(["run_id"])
    same = F.col("a.run_id").eqNullSafe(F.col("c.run_id")) & F.col("a.transport").eqNullSafe(F.col("c.transport"))
    joined = all_.alias("a").join(cut.alias("c"), same, "left").select("a.*", F.coalesce("n_truncated", F.lit(0)).alias("n_truncated"))
    return joined.join(models, "run_id", "left").select("run_id", "model_key", "transport", "n", "n_content", "n_truncated", (F.col("n_truncated") / F.nullif("n_content", F.lit(0))).alias("truncated_share"))


@catalog.add("p5_found")
def p5_found(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "fct_answer").select("answer_id", "question_id", "question", "ai_answer", prior_odds(*map(F.col, ("ai_answer", "finish_reason", "completion_tokens", "max_tokens"))).alias("prior"))
    return defective_pairs(rows, "answer_id", "question", "ai_answer", "question_id", "prior", table(spark, base, "questions").select("question_id", "options"), fit_languages(table(spark, base, "documents")))


@catalog.add("p5_by_type")
def p5_by_type(spark: SparkSession, base: str) -> DataFrame:
    """Defects by type beside what grade and finish_reason say of the same rows."""
    answers = table(spark, base, "fct_answer").select("answer_id", "grade", "finish_reason")
    return p5_found(spark, base).join(answers, "answer_id").groupBy("defect", "grade", "finish_reason").agg(F.count("*").alias("n"))
