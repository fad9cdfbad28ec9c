"""Duplicates hidden by formatting, against brute force."""

import html
import json
import unicodedata
from collections import defaultdict

from evalmill.llm.formatting import canonical, collapse, further_copies

SCALARS = ["category", "type", "difficulty", "question", "correct_answer"]
SCHEMA = "raw_id bigint, category string, type string, difficulty string, question string, correct_answer string, incorrect_answers string, extra string"


def key(s):
    return "".join(c for c in unicodedata.normalize("NFC", html.unescape(s or "")).casefold() if c.isalnum())


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(*(key(x) for x in r[1:6]), frozenset(key(x) for x in json.loads(r[6] or "[]")))].append(r[0])
    return sorted((min(v), x) for v in groups.values() for x in v if x != min(v))


def test_whole_small_table(spark, small, q):
    raw = spark.read.parquet(f"{small}/raw_questions.parquet").select("raw_id", *SCALARS, "incorrect_answers").collect()
    assert sorted(map(tuple, q["p1_found"](spark, small).collect())) == brute(raw)
    records = q["p1_records"](spark, small)
    assert records.agg({"n_copies": "sum"}).first()[0] == len(raw) and records.select("raw_id").distinct().count() == records.count()


def test_canonical():
    assert canonical("Caf&eacute; &quot;X&quot;!") == canonical(" CAFÉ x") == canonical("Café X")
    assert canonical("Cafe") != canonical("Café") and canonical(None) == canonical(" -- ") == ""
    assert canonical("STRASSE") == canonical("Straße") and canonical("no. 5") != canonical("no. 6")


def test_edges(spark):
    long = "x" * 200_000
    rows = [
        (1, "C", "multiple", "easy", "Q?", "A", '["b", "c", "d"]', "p"), (2, " c ", "Multiple", "easy", "q", "a.", '["D", "c", "B", "b"]', "q"),
        (3, None, "multiple", None, None, "A", None, None), (4, "", "multiple", " ", "?", "a", "[]", None), (5, "C", "multiple", "easy", "Q?", "A", "not json", None),
        (6, "C", "multiple", "easy", long, "A", "[]", None), (7, "C", "multiple", "easy", long.upper(), "A", "[]", None), (8, "C", "multiple", "easy", "Q?", "A", '["b", "c", "e"]', "p"),
    ]
    rows += [(100 + i, "hot", "boolean", "easy", "same" + "!" * (i % 7), "True", '["False"]', None) for i in range(60)]
    got = sorted(map(tuple, further_copies(collapse(spark.createDataFrame(rows, SCHEMA), "raw_id", SCALARS, ["incorrect_answers"])).collect()))
    assert got == sorted([(1, 2), (3, 4), (6, 7)] + [(100, 100 + i) for i in range(1, 60)])


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert further_copies(collapse(empty, "raw_id", SCALARS, ["incorrect_answers"])).count() == 0
    row = (1, "C", "multiple", "easy", "Q?", "A", "[]", None)
    c = collapse(spark.createDataFrame([row, row], SCHEMA), "raw_id", SCALARS, ["incorrect_answers"])
    assert c.groups.first().n == 2 and further_copies(c).count() == 0
