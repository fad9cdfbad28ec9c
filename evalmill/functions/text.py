"""Text normalisation that Spark has no functions for, as Arrow-batched UDFs; the rest as Columns."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: words that don't count when answers are compared.
ARTICLES = ("a", "an", "the")
NOT_WORD = re.compile(r"[^\w\s]")


def display(text: str | None) -> str | None:
    """HTML escapes decoded, white space collapsed."""
    return None if text is None else " ".join(html.unescape(text).split())


def comparable(text: str | None) -> str | None:
    """Without escapes, accents, case, punctuation and articles."""
    if text is None:
        return None
    flat = "".join(c for c in unicodedata.normalize("NFKD", html.unescape(text)) if not unicodedata.combining(c))
    return " ".join(w for w in NOT_WORD.sub(" ", flat.casefold()).split() if w not in ARTICLES)


@F.pandas_udf(T.StringType())
def clean_text(s: pd.Series) -> pd.Series:
    return s.map(display)


@F.pandas_udf(T.ArrayType(T.StringType()))
def clean_texts(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else [display(x) for x in xs])


@F.pandas_udf(T.StringType())
def normalize_key(s: pd.Series) -> pd.Series:
    """For identifiers: as displayed, case folded."""
    return s.map(lambda x: None if x is None else display(x).casefold())


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def normalize_answer(s: pd.Series) -> pd.Series:
    return s.map(comparable)


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_answers(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else [comparable(x) for x in xs])


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def category_group(category: Column) -> Column:
    """What stands before the first colon."""
    return strip(F.substring_index(category, ":", 1))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a blank text."""
    bare = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))


def contains_ignoring_case(column: Column, search: str) -> Column:
    """``%`` and ``_`` in ``search`` are wildcards, as with ILIKE."""
    return column.ilike(f"%{search}%")


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text
