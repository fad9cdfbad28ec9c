"""Duplicates hidden by formatting: records that agree when only letters and digits count.

Each distinct value of the records' columns is canonicalised once and gets an integer; a record
becomes a sorted tuple of integers, each of which stands for a column and a value of it; equal
tuples are equal records.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dictionary import assign_codes
from ..operators.skew import lookup_join
from ..session import scratch

OTHER = re.compile(r"[\W_]+")


def canonical(text: str | None) -> str:
    """A text's letters and digits, accents kept, case ignored, HTML escapes decoded; '' for none."""
    if not text:
        return ""
    plain = html.unescape(text) if "&" in text else text
    if plain.isascii():
        return OTHER.sub("", plain.casefold())
    plain = unicodedata.normalize("NFC", unicodedata.normalize("NFC", plain).casefold())
    return "".join(c for c in plain if c.isalnum() or unicodedata.category(c)[0] == "M")


@F.pandas_udf(T.StringType())
def canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonical)


@dataclass
class Collapsed:
    """``members``: (id, tuple) of each row; ``groups``: (tuple, first_id, n) of each record."""

    members: DataFrame
    groups: DataFrame


def collapse(rows: DataFrame, id_col: str, scalars: list[str], sets: list[str] = ()) -> Collapsed:
    """Group ``rows`` into records.

    ``scalars`` are text columns, ``sets`` columns with a JSON list whose order and repetitions don't
    count; a text there that is no JSON list is a list of that one text. Null, blank and values of
    punctuation only are the same value. Field order within a stored record doesn't matter, as a tuple
    is sorted by column. Rows written twice with one id are two copies of the record.
    """
    def cell(slot: int):  # a transform with a second argument would hand over the position
        return lambda x: F.struct(F.lit(slot).alias("slot"), F.coalesce(x.cast("string"), F.lit("")).alias("value"))

    cells = F.array(*(cell(i)(F.col(c)) for i, c in enumerate(scalars)))
    for i, c in enumerate(sets, len(scalars)):
        parsed = F.coalesce(F.from_json(c, "array<string>"), F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col(c))))
        cells = F.concat(cells, F.transform(parsed, cell(i)))
    keyed = rows.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), cells.alias("_cells"))
    long = scratch(keyed.select("_id", "_row", F.explode("_cells").alias("_c")).select("_id", "_row", "_c.slot", "_c.value"), "cells")

    values = scratch(long.groupBy("value").agg(F.count("*").alias("n")).withColumn("canonical", canonical_udf("value")), "values")
    codes = assign_codes(values.select("canonical").distinct(), ["canonical"], "code")
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lookup = scratch(values.join(codes, "canonical").select("value", "n", "code"), "lookup")
    slots = len(scalars) + len(sets)
    numbers = lookup_join(long, lookup, ["value"], "n", total).select("_id", "_row", (F.col("code") * slots + F.col("slot")).alias("_v"))
    members = scratch(numbers.groupBy("_row").agg(F.first("_id").alias("id"), F.array_sort(F.collect_set("_v")).alias("tuple")).select("id", "tuple"), "tuples")
    groups = members.groupBy("tuple").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    return Collapsed(members, groups)


def further_copies(collapsed: Collapsed) -> DataFrame:
    """(first_id, copy_id) for each row of a record but its first. A record that a third of all rows
    repeat is joined by broadcast of its one tuple, so that its rows stay where they are."""
    many = scratch(collapsed.groups.where("n > 1"), "groups")
    total = many.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = lookup_join(collapsed.members, many, ["tuple"], "n", total)
    return joined.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
