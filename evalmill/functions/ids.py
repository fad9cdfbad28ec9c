"""Identifiers made from content, and the order of options that follows from them."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import normalize_key


def question_id(category: Column, kind: Column, difficulty: Column, question: Column, correct: Column) -> Column:
    """SHA-256 of the five normalised parts; wrong answers have no part in it, as their order varies."""
    return F.sha2(F.concat_ws("||", *(normalize_key(c) for c in (category, kind, difficulty, question, correct))), 256)


def option_seed(qid: Column) -> Column:
    """The last 32 bits of the identifier's hash."""
    return F.conv(F.right(F.sha2(qid, 256), F.lit(8)), 16, 10).cast("bigint")


def prompt_hash(system: Column, user: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(system, F.lit("")), F.lit("\0"), user), 256)


SHUFFLED = T.StructType([T.StructField("options", T.ArrayType(T.StringType())), T.StructField("correct_index", T.ByteType())])


@F.pandas_udf(SHUFFLED)
def shuffled_options(seeds: pd.Series, kinds: pd.Series, correct: pd.Series, wrong: pd.Series) -> pd.DataFrame:
    """Options in an order that depends on the seed alone (a Mersenne Twister); true/false keep theirs."""
    rows = []
    for seed, kind, right, others in zip(seeds, kinds, correct, wrong):
        options = ["True", "False"] if kind == "boolean" else [*(others if others is not None else []), right]
        if kind != "boolean":
            random.Random(int(seed)).shuffle(options)
        rows.append((options, options.index(right) if right in options else None))
    return pd.DataFrame(rows, columns=["options", "correct_index"])
