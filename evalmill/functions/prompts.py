"""Prompts of the variants, rendered as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording that answers were collected with.
LETTER_ONLY = "Answer with the letter only (A, B, C, or D). Do not explain."
WORD_ONLY = "Is this statement True or False?\n\nAnswer with one word only: True or False."
FEWSHOT_LETTER = "Answer each multiple choice question with only the letter of the correct answer."
FEWSHOT_WORD = "Answer each statement with only True or False."
SYSTEM_JSON = "You answer trivia questions. Respond only with a single JSON object matching the given schema. Do not include any text outside the JSON object."
#: Marks of chat templates that must not be part of a reply.
MARKERS = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<end_of_turn>", "<eos>"]


def question_block() -> Column:
    """The question and, of a multiple-choice one, its lettered options."""
    lines = [F.concat(F.lit(f"{letter}) "), F.get("options", i)) for i, letter in enumerate("ABCD")]
    return F.when(F.col("type") == "multiple", F.concat_ws("\n", *lines))


def fewshot_examples(questions: DataFrame) -> DataFrame:
    """(type, examples): the solved examples of each type, in the order of their identifiers."""
    multiple = F.concat_ws("\n", F.concat(F.lit("Question: "), "question"), question_block(), F.concat(F.lit("Answer: "), "correct_letter"))
    boolean = F.concat_ws("\n", F.concat(F.lit("Statement: "), "question"), F.concat(F.lit("Answer: "), "correct_answer"))
    block = F.when(F.col("type") == "multiple", multiple).otherwise(boolean)
    solved = questions.where("is_fewshot_example").groupBy("type").agg(F.array_sort(F.collect_list(F.struct("question_id", block.alias("b")))).alias("s"))
    return solved.select("type", F.concat_ws("\n\n", F.transform("s", lambda x: x["b"])).alias("examples"))


def rendered(questions: DataFrame) -> DataFrame:
    """(question_id, variant, system, prompt) of every question that isn't an example itself.

    A type without examples has no few-shot prompt.
    """
    q = questions.where("not is_fewshot_example").join(F.broadcast(fewshot_examples(questions)), "type", "left")
    multiple = F.col("type") == "multiple"
    head = F.concat(F.when(multiple, "Question: ").otherwise("Statement: "), F.col("question"))
    asked = F.when(multiple, F.concat_ws("\n\n", head, question_block())).otherwise(head)
    v1 = F.concat_ws("\n\n", asked, F.when(multiple, LETTER_ONLY).otherwise(WORD_ONLY))
    target = F.concat_ws("\n", head, question_block(), F.lit("Answer:"))
    v2 = F.when(F.col("examples").isNotNull(), F.concat_ws("\n\n", F.when(multiple, FEWSHOT_LETTER).otherwise(FEWSHOT_WORD), "examples", target))
    variants = F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(s).cast("string").alias("system"), p.alias("prompt")) for n, s, p in (("v1_letter", None, v1), ("v2_fewshot", None, v2), ("v3_json", SYSTEM_JSON, asked))))
    return q.select("question_id", F.inline(variants)).where("prompt is not null")


def leaks_markers(text: Column) -> Column:
    return F.exists(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(text, m))


def run_slug(model_key: Column, variant: Column, mode: Column, started: Column) -> Column:
    """A readable identifier of a run, by model, variant, mode and minute."""
    tail = F.lower(F.regexp_extract(model_key, r"([^/]*)$", 1))
    bare = F.regexp_replace(F.regexp_replace(tail, r"[^a-z0-9.-]+", "-"), r"^-+|-+$", "")
    return F.concat(bare, F.lit("__"), variant, F.lit("__r"), mode, F.lit("__"), F.date_format(started, "yyyyMMdd-HHmm"))
