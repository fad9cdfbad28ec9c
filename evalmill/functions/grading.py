"""Grades of free-text replies, by rules in a fixed order.

The rules are Column expressions over the reply and its question; Python only normalises texts and
measures how alike two normalised texts are, for the replies that no plain rule decides.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import normalize_answer, normalize_answers, strip

# Fixed values that results depend on.
LETTERS = "ABCD"
LETTER_FIRST = r"(?U)^\s*\(?([A-Da-d])\)?(?:[.):\-\s]|$)"
LETTER_CUE = r"(?iU)\banswer\s*(?::|is)\s*\$?\**\s*\(?([A-Da-d])\)?\b"
LETTER_LAST = r"(?iU)(?:^|\s)([A-D])\s*[.)]?\s*$"
WORD_CUE = r"(?iU)answer\s*:\s*\**\s*([A-Za-z]+)"
NEGATIONS = ["not", "n't", "never", "except", "neither", "nor", "isn", "wasn", "aren", "no"]
REFUSED = ["n a", "na", "unknown", "none", "no answer", "not sure", "no comment"]
REFUSES = ["i don t know", "i do not know", "i m not sure", "i am not sure", "not certain", "cannot answer", "can t answer", "cannot determine", "no idea", "unable to", "no information", "impossible to say"]
TRUE_ALONE, FALSE_ALONE = ["yes", "y", "t", "correct"], ["no", "n", "f", "incorrect"]
TRUE_WORDS, FALSE_WORDS = ["true", "yes", "correct"], ["false", "no", "incorrect"]
#: Flags of the prompt variants: (replies are JSON objects, the prompt ends in "Answer:").
VARIANTS = {"v1_letter": (False, False), "v2_fewshot": (False, True), "v3_json": (True, False)}


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit sets."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    free = (1 << len(a)) - 1
    full = free
    for c in b:
        hit = free & places.get(c, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def likeness(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence by the sum of the lengths."""
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def likenesses(texts: pd.Series, options: pd.Series) -> pd.Series:
    return pd.Series([None if o is None or not t else [likeness(t, x or "") for x in o] for t, o in zip(texts, options)])


def unwrapped(text: Column) -> Column:
    """The ``answer`` of a JSON reply, also of one with prose around it; null if there is none."""
    def field(candidate: Column) -> Column:
        parsed = F.from_json(candidate, "map<string,string>")
        value = strip(F.coalesce(parsed["answer"], F.lit("None")))
        return F.when(F.coalesce(F.map_contains_key(parsed, "answer"), F.lit(False)), F.when(F.length(value) == 1, F.upper(value)).otherwise(value))

    return F.coalesce(field(strip(text)), field(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def letter(text: Column) -> Column:
    """The letter a reply chooses: at its begin, after a cue, or at the end of at most three words."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (LETTER_FIRST, LETTER_CUE)]
    short = F.size(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ")) <= 3
    return F.upper(F.coalesce(*found, F.when(short, F.nullif(F.regexp_extract(text, LETTER_LAST, 1), F.lit("")))))


def negated(reply: Column, option: Column) -> Column:
    """Whether one of the two words before the first place of ``option`` negates it."""
    before = F.substring(reply, F.lit(1), F.greatest(F.instr(reply, option) - 1, F.lit(0)))
    words = F.filter(F.split(before, " "), lambda w: w != "")
    return F.arrays_overlap(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), F.array(*map(F.lit, NEGATIONS)))


def grade(rows: DataFrame, threshold: float = 90.0, margin: float = 5.0) -> DataFrame:
    """``rows`` with grade, ai_correct, predicted_letter, predicted_text and grade_score.

    Columns taken: content, error, prompt_variant, is_truncated, and of the question type, options,
    correct_index, correct_letter and correct_answer. Nulls: a null content is an empty reply, a null
    or empty error none, an unknown variant has no flags.
    """
    extra = ["_reply", "_text", "_options", "_alike", "_best", "_hits", "_letter", "_match", "_bool", "_said", "_how"]
    structured = F.col("prompt_variant").isin([v for v, f in VARIANTS.items() if f[0]])
    cued = F.coalesce(F.col("prompt_variant").isin([v for v, f in VARIANTS.items() if f[1]]), F.lit(False))
    boolean = F.col("type") == "boolean"
    reply = F.coalesce("content", F.lit(""))
    reply = F.coalesce(F.when(structured, unwrapped(reply)), reply)
    cue = F.nullif(F.regexp_extract("_reply", WORD_CUE, 1), F.lit(""))
    out = rows.withColumn("_reply", reply).withColumn("_text", normalize_answer(F.when(boolean & cued, F.coalesce(cue, "_reply")).otherwise(F.col("_reply"))))
    text = F.col("_text")

    # true or false
    words = F.split("_text", " ")
    has = lambda values: F.arrays_overlap(words, F.array(*map(F.lit, values)))
    how = (
        F.when(text.isin("true", "false"), "exact").when(text.isin(TRUE_ALONE + FALSE_ALONE), "fuzzy").when(has(TRUE_WORDS) != has(FALSE_WORDS), "contains")
    )
    out = out.withColumn("_how", F.when(boolean, how)).withColumn("_said", (text == "true") | text.isin(TRUE_ALONE) | (~text.isin("false", *FALSE_ALONE) & has(TRUE_WORDS)))

    # options: the same text, a text much like one of them, or one of them inside
    out = out.withColumn("_letter", F.when(~boolean, letter(F.col("_reply")))).withColumn("_options", F.when(~boolean & F.col("_letter").isNull(), normalize_answers("options")))
    exact = F.nullif(F.array_position("_options", text), F.lit(0)) - 1
    undecided = F.col("_options").isNotNull() & (text != "") & exact.isNull()
    out = out.withColumn("_alike", likenesses(F.when(undecided, text), "_options"))
    best = F.array_max("_alike")
    second = F.coalesce(F.get(F.sort_array("_alike", asc=False), 1), F.lit(0.0))
    fuzzy = F.when((best >= threshold) & (best - second >= margin), F.array_position("_alike", best) - 1)
    inside = F.filter(F.sequence(F.lit(0), F.size("_options") - 1), lambda i: (F.length(F.get("_options", i)) >= 3) & text.contains(F.get("_options", i)))
    plain = F.filter(inside, lambda i: ~negated(text, F.get("_options", i)))
    hits = F.when(undecided & fuzzy.isNull() & ~F.coalesce("is_truncated", F.lit(False)), plain)
    out = out.withColumn("_hits", hits)
    held = F.when(F.size("_hits") == 1, F.get("_hits", 0))
    position = lambda name, index: F.struct(F.lit(name).alias("how"), index.cast("int").alias("at"))
    out = out.withColumn("_match", F.when((text != "") & exact.isNotNull(), position("exact", exact)).when(fuzzy.isNotNull(), position("fuzzy", fuzzy)).when(held.isNotNull(), position("contains", held)))

    failed = F.coalesce(F.col("error") != "", F.lit(False))
    said = F.when(F.col("_said"), "True").otherwise("False")
    right_word = F.lower("correct_answer") == F.lower(said)
    right_letter = F.col("_letter") == F.col("correct_letter")
    right_match = F.col("_match.at") == F.col("correct_index")
    refusal = text.isin(REFUSED) | F.exists(F.array(*map(F.lit, REFUSES)), lambda p: text.contains(p))
    correct = F.when(failed, False).when(boolean, F.when(F.col("_how").isNotNull(), right_word).otherwise(False)).when(F.col("_letter").isNotNull(), right_letter).when(F.col("_match").isNotNull(), right_match).otherwise(False)
    kind = (
        F.when(failed, "error")
        .when(boolean, F.when(F.col("_how").isNull(), "unparseable").when(right_word, F.col("_how")).otherwise("wrong"))
        .when(F.col("_letter").isNotNull(), F.when(right_letter, "letter").otherwise("wrong"))
        .when(F.col("_match").isNotNull(), F.when(right_match, F.col("_match.how")).otherwise("wrong"))
        .otherwise("unparseable")
    )
    at = F.coalesce(F.instr(F.lit(LETTERS), F.col("_letter")) - 1, F.col("_match.at"))
    chosen = ~failed & ~boolean & at.isNotNull()
    word = F.when(boolean & F.col("_how").isNotNull(), said)
    rest = F.when(~boolean & (text != "") & ~refusal, F.nullif(F.substring(strip(F.col("_reply")), 1, 200), F.lit("")))
    score = F.when(chosen & F.col("_letter").isNull(), F.when(F.col("_match.how") == "exact", 100.0).when(F.col("_match.how") == "fuzzy", best)).cast("float")
    out = out.withColumns({
        "grade": kind, "ai_correct": F.coalesce(correct, F.lit(False)), "predicted_letter": F.when(chosen, F.substring(F.lit(LETTERS), at + 1, F.lit(1))),
        "predicted_text": F.when(~failed, F.when(chosen, F.get("options", at)).otherwise(F.coalesce(word, F.when(~boolean & at.isNull(), rest)))), "grade_score": score,
    })
    return out.drop(*extra)
