"""Texts, identifiers, grades, statistics and samples."""

import math

import pytest
from pyspark.sql import functions as F

from evalmill.functions import ids, text
from evalmill.functions.grading import grade, likeness
from evalmill.functions.intervals import wilson
from evalmill.functions.significance import bootstrap_interval, mcnemar_p, spearman, student_p
from evalmill.operators.sampling import quotas, sample
from evalmill.plans.silver import clean

ROCKS = ["Granite", "Basalt", "Marble slab", "Sandstone"]
SCHEMA = "i int, content string, error string, prompt_variant string, is_truncated boolean, type string, options array<string>, correct_index int, correct_letter string, correct_answer string"


def graded(spark, replies, kind="multiple", variant="v1_letter", error=None, truncated=False):
    options, at, letter, right = (ROCKS, 2, "C", "Marble slab") if kind == "multiple" else (["True", "False"], 0, "A", "True")
    rows = [(i, r, error, variant, truncated, kind, options, at, letter, right) for i, r in enumerate(replies)]
    return grade(spark.createDataFrame(rows, SCHEMA)).orderBy("i").collect()


def kinds(spark, replies, **kw):
    return [r.grade if r.ai_correct == (r.grade not in ("wrong", "unparseable", "error")) else "contradiction" for r in graded(spark, replies, **kw)]


@pytest.mark.parametrize("raw,want", [
    ("MARBLE", "marble"), ("the marble", "marble"), ("An old slab", "old slab"), ("slab, a", "slab"), ("*Theodora*", "theodora"), ("Stra&szlig;e", "strasse"), ("Señor Ñu", "senor nu"), ("rock\u2019n\u2019roll", "rock n roll"), ("\t\n", ""), ("ﬁne", "fine"),
])
def test_comparable(raw, want):
    assert text.comparable(raw) == want and text.comparable(None) is None


def test_letters_are_found_at_begin_cue_and_end(spark):
    assert kinds(spark, ["c", "(c) obviously", "C: marble", "C-", "my answer: **c**", "So the answer is $C$", "surely C"]) == ["letter"] * 7
    assert kinds(spark, ["d) Sandstone", "answer is (a)", "option B"]) == ["wrong"] * 3
    assert kinds(spark, ["I would say that it is C", "Cobalt", "Dolerite"]) == ["unparseable"] * 3  # too long for a letter at the end; letters that begin words


def test_options_are_matched_whole_alike_and_inside(spark):
    assert kinds(spark, ["marble SLAB!", "the Marble slab", " *marble slab* "]) == ["exact"] * 3
    assert kinds(spark, ["marble slabb", "marbel slab"]) == ["fuzzy"] * 2
    assert kinds(spark, ["I'd carve it from a marble slab", "never basalt, rather a marble slab"]) == ["contains"] * 2
    assert kinds(spark, ["Granite", "granit e", "probably sandstone then"]) == ["wrong"] * 3
    assert kinds(spark, ["", "\n \t", None, "no idea", "unknown", "granite or basalt", "isn't a marble slab"]) == ["unparseable"] * 7


def test_white_space_of_any_kind_is_stripped(spark):
    r = graded(spark, ["\n Wholly other words\u00a0\n", "\u3000Marble slab\r\n"])
    assert r[0].predicted_text == "Wholly other words" and r[1].grade == "exact"
    j = graded(spark, ['\n{"answer": "\\n c\\t"}\u2003', '{"answer": "\\nmarble slab"}'], variant="v3_json")
    assert [x.grade for x in j] == ["letter", "exact"]


def test_json_replies(spark):
    assert kinds(spark, ['{"answer": "c"}', 'Sure. {"answer": "C"} Bye.'], variant="v3_json") == ["letter"] * 2
    assert kinds(spark, ['{"answer": "b", "why": "dark"}', '{"answer": "Sandstone"}'], variant="v3_json") == ["wrong"] * 2
    assert kinds(spark, ['{"answer": ', '{"reply": "C is it"}', "[]"], variant="v3_json") == ["unparseable"] * 3


def test_truth_values(spark):
    assert kinds(spark, ["TRUE", "*true*", "Yes", "correct", "It's true that it floats"], kind="boolean") == ["exact", "exact", "fuzzy", "fuzzy", "contains"]
    assert kinds(spark, ["f", "incorrect", "No way", "that would be false"], kind="boolean") == ["wrong"] * 4
    assert kinds(spark, ["", "true and false", "who knows"], kind="boolean") == ["unparseable"] * 3
    assert kinds(spark, ["It floats. Answer: true"], kind="boolean", variant="v2_fewshot") == ["exact"]


def test_failed_calls_and_cut_replies(spark):
    assert kinds(spark, ["C", None], error="ConnectError") == ["error"] * 2
    assert kinds(spark, ["I'd carve it from a marble slab"], truncated=True) == ["unparseable"]
    assert kinds(spark, ["c", "marble slab", "marble slabb"], truncated=True) == ["letter", "exact", "fuzzy"]


def test_two_options_much_alike(spark):
    long = "quarried in the northern valley"
    rows = [(0, long + " s", None, "v1_letter", False, "multiple", [long, long + "s", "x", "y"], 1, "B", long + "s")]
    assert grade(spark.createDataFrame(rows, SCHEMA)).first().grade in ("unparseable", "wrong")  # within the margin no option wins by likeness


def test_likeness():
    assert likeness("marbel", "marble") == pytest.approx(100 * 10 / 12) and likeness("ab", "yz") == 0 and likeness("", "") == 100


def test_identifiers_come_from_content(spark):
    day = "2026-03-01T08:30:00+00:00"
    rows = [
        (11, day, 17, "Science: Geology", "multiple", "medium", "Which rock is called the &quot;queen&quot; of stones?", "Marble", '["Slate", "Chalk", "Flint"]'),
        (12, day, 17, "Science: Geology", "multiple", "medium", "  which rock is called the \"Queen\"  of stones?", "MARBLE ", '["Flint", "Slate", "Chalk"]'),
        (13, day, None, "Science: Geology", "boolean", "easy", "Pumice floats.", "True", '["False"]'),
        (14, day, 31, "History", "multiple", "hard", "Who carved the na&iuml;ve lion?", "Zo&euml;", '["Ada", "Bo", "Cy"]'),
    ]
    df = spark.createDataFrame(rows, "raw_id bigint, scraped_at string, category_id smallint, category string, type string, difficulty string, question string, correct_answer string, incorrect_answers string")
    got = {r.question: r for r in clean(df).collect()}
    assert set(got) == {'Which rock is called the "queen" of stones?', "Pumice floats.", "Who carved the naïve lion?"}
    assert got["Pumice floats."].options == ["True", "False"] and got["Pumice floats."].correct_letter == "A" and got["Who carved the naïve lion?"].correct_answer == "Zoë"
    assert all(r.options[r.correct_index] == r.correct_answer and len(r.question_id) == 64 and r.category_group in ("Science", "History") for r in got.values())


def test_shuffle_is_uniform(spark):
    df = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("q")).select(ids.shuffled_options(ids.option_seed(F.col("q")), F.lit("multiple"), F.lit("x"), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("s"))
    counts = {r[0]: r[1] for r in df.groupBy("s.correct_index").count().collect()}
    assert set(counts) == {0, 1, 2, 3} and all(400 <= n <= 600 for n in counts.values())


def test_hashes_and_words(spark):
    r = spark.range(1).select(ids.prompt_hash(F.lit(None).cast("string"), F.lit("u")).alias("h"), text.word_count(F.lit("")).alias("none"), text.word_count(F.lit(" a b  c ")).alias("three"), text.category_group(F.lit("Science: Geology ")).alias("g"), text.escape_html(F.lit('<a & "b">')).alias("e")).first()
    import hashlib

    assert r.h == hashlib.sha256(b"\0u").hexdigest() and r.none == 0 and r.three == 3 and r.g == "Science" and r.e == "&lt;a &amp; &quot;b&quot;&gt;"


def test_wilson(spark):
    r = spark.createDataFrame([(3, 4), (0, 0)], "s int, n int").select(wilson("s", "n", -1).alias("lo"), wilson("s", "n", 1).alias("hi")).collect()
    z, p, n = 1.96, 0.75, 4
    assert r[0].lo == pytest.approx((p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))
    assert r[0].lo < 0.75 < r[0].hi and r[1].lo is None


def test_mcnemar(spark):
    p = [r.p for r in spark.createDataFrame([(0, 0), (1, 9), (40, 20)], "a int, b int").select(mcnemar_p("a", "b").alias("p")).collect()]
    assert p[0] == 1 and p[1] == pytest.approx(2 * (1 + 10) / 1024) and p[2] == pytest.approx(math.erfc(math.sqrt(19**2 / 60 / 2)))


def test_bootstrap(spark):
    r = bootstrap_interval(spark.createDataFrame([("a", 50, 30, 10, 10), ("b", 0, 0, 0, 0)], "k string, both int, a_only int, b_only int, neither int"), ["k"]).orderBy("k").collect()
    assert r[0].ci_low < 0.2 < r[0].ci_high and 0.1 < r[0].ci_high - r[0].ci_low < 0.4 and (r[1].ci_low, r[1].ci_high) == (0, 0)


def test_spearman(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 9.0), ("a", 3, 9.0), ("b", 1, 1.0), ("b", None, 2.0)], "k string, x int, y double")
    got = {r.k: r.rho for r in spearman(df, ["k"], "x", "y").collect()}
    assert got["a"] == pytest.approx(1.0) and math.isnan(got["b"])


def test_quotas_are_exact(spark):
    sizes = {"a": 100, "b": 7, "c": 1, "d": 1}
    strata = spark.createDataFrame(list(sizes.items()), "k string, n bigint")
    for n in (4, 5, 20, 60, 108):
        q = {r.k: r.take for r in quotas(strata, n, ["k"]).collect()}
        assert sum(q.values()) == n and all(1 <= q[k] <= sizes[k] for k in sizes)
    assert {r.k: r.take for r in quotas(strata, 500, ["k"]).collect()} == sizes
    with pytest.raises(ValueError):
        quotas(strata, 3, ["k"])
    many = spark.range(300).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") == 0, 100).otherwise(1).cast("bigint").alias("n"))
    assert quotas(many, 310, ["k"]).agg(F.sum("take"), F.min("take")).first()[:] == (310, 1)


def test_student_p(spark):
    rows = [(0.5, 3, 2 / 3), (0.0, 10, 1.0), (1.0, 5, 0.0), (-0.6, 10, 0.0667), (0.3, 100, 0.00242), (float("nan"), 2, math.nan)]
    got = [r.p for r in spark.createDataFrame([r[:2] for r in rows], "rho double, n int").select(student_p("rho", "n").alias("p")).collect()]
    assert got[-1] is None and got[:-1] == pytest.approx([w for _, _, w in rows[:-1]], abs=1e-4)


def test_sample(spark, small):
    q = spark.read.parquet(f"{small}/questions.parquet")
    one = sample(q, "stratified:60", ["type"])
    assert one.count() == 60 and sorted(r.question_id for r in one.collect()) == sorted(r.question_id for r in sample(q, "stratified:60", ["type"]).collect())
    assert sample(q, "limit:7").count() == 7 and sample(q, "all").count() <= q.count()
    with pytest.raises(ValueError):
        sample(q, "random:10")
