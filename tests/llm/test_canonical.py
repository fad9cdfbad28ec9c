"""Names mapped to a reference list, against brute force and by case."""

import random

import pytest

from evalmill.llm.canonical import Trie, aliases, canonical_entries, fold, limit, nearest, turned

ENTRIES = [(1, "Saint Callini"), (2, "Callini Falls"), (3, "Lake Vegotro"), (4, "The Burning Houkagi"), (5, "Zureand-tailed vole"), (6, "Twelve Harbours of Zendrechond"), (7, "Leila O'Bolmomjal"), (8, "Pairyôlin flatbread"), (9, "Rabralyol and the Ledger"), (10, "Yiamvondca")]


@pytest.fixture(scope="module")
def trie():
    return Trie(ENTRIES)


@pytest.mark.parametrize("text,want", [
    ("Saint Callini", 1), ("St. Callini, I think", 1), ("callini falls!", 2), ("L. Vegotro", 3), ("Answer: Lake  Vegotro (probably)", 3), ("the lake vegtro", 3), ("Houkagi, The Burning", 4), ("Houkagi, the Burning", 4),
    ("vole, Zureand-tailed", 5), ("Zurenad-tailed vole", 5), ("12 Harbours of Zendrechond", 6), ("TwelveHarboursofZendrechond", 6), ("Leila OBolmomjal", 7), ("O'Bolmomjal, Leila", 7), ("Pairyol in flatbraed", 8),
    ("Rabraly0l & the Ledger", 9), ("Yiamvodnca", 10), ("Callini", 0), ("it depends on the year", 0), ("", 0), ("???", 0), ("none of the above", 0), ("Lake Callini", 0), ("x" * 5000, 0), ("word " * 300 + "Saint Callini", 1),
])
def test_cases(trie, text, want):
    plain, again = (nearest(trie, [fold(x)])[0] for x in (text, turned(text)))
    assert (plain[0] or (again[0] if "," in text else 0)) == want


def osa(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def test_search_returns_all_entries_within_the_distance(trie):
    rng = random.Random(1)
    values = []
    for _ in range(150):
        w = list("".join(fold(rng.choice(ENTRIES)[1])))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) - 1)
            op = rng.randrange(4)
            if op == 0:
                w[k] = rng.choice("abcxyz")
            elif op == 1:
                del w[k]
            elif op == 2:
                w.insert(k, rng.choice("abcxyz"))
            else:
                w[k], w[k + 1] = w[k + 1], w[k]
        values.append("".join(w))
    found = trie.search([[v] for v in values], 3)
    for v, f in zip(values, found):
        got = {}
        for entry, _, _, e in f:
            got[entry] = min(e, got.get(entry, 9))
        for entry, name in ENTRIES:
            reach = [osa(v, a) for a in aliases(name) if osa(v, a) <= min(3, limit(len(a)))]
            if reach:  # anchored at both ends, as the value is one word
                assert got.get(entry) == min(reach), (v, name)


def test_spark(spark):
    rows = spark.createDataFrame([(1, "Saint Callini", "x"), (2, "Saint Callini", "x"), (3, None, "x"), (4, " ", None), (5, "nobody", None)], "answer_id bigint, t string, name string")
    entries = spark.createDataFrame(ENTRIES + [(11, None)], "entry_id int, name string")
    rows = rows.selectExpr("*", "7 as entry_id", "8 as score", "9 as n")
    got = {r.answer_id: r.entry_id for r in canonical_entries(rows, entries, "t").collect()}
    assert got == {1: 1, 2: 1, 4: 0, 5: 0}
    assert {r.entry_id for r in canonical_entries(rows, entries.where("entry_id < 0"), "t").collect()} == {0}
    assert canonical_entries(rows.where("answer_id < 0"), entries, "t").count() == 0


def test_blocks_give_the_same(spark):
    from evalmill.llm.canonical import match_values

    entries = spark.createDataFrame(ENTRIES, "entry_id int, name string")
    values = spark.createDataFrame([("St. Callini",), ("callini fals",), ("nobody",)], "t string")
    one = sorted(map(tuple, match_values(values, entries, "t").collect()))
    assert one == sorted(map(tuple, match_values(values, entries, "t", block=3).collect()))


def test_most_are_options_of_their_question(spark, small, q):
    """Held-out accuracy: what a value is mapped to is nearly always one of its question's options, which aren't used."""
    found = q["p3_found"](spark, small)
    rows = spark.read.parquet(f"{small}/fct_answer.parquet").select("answer_id", "question_id", "predicted_text").where("predicted_text is not null")
    assert found.count() == rows.count()
    options = {r.question_id: {"".join(fold(o)) for o in r.options} for r in spark.read.parquet(f"{small}/questions.parquet").select("question_id", "options").collect()}
    names = {r.entry_id: "".join(fold(r.name)) for r in spark.read.parquet(f"{small}/answer_entries.parquet").collect()}
    mapped = [(names[r.entry_id] in options[r.question_id]) for r in found.join(rows, "answer_id").where("entry_id > 0").collect() if r.question_id in options]
    assert len(mapped) > 50 and sum(mapped) >= 0.99 * len(mapped)
