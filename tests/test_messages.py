import random

import pytest
from pyspark.sql import functions as F

from evalmill.operators.dictionary import assign_codes
from evalmill.operators.messages import Conflict, SeenMessages, bit_is_set, keep_one, surplus_arrivals
from evalmill.operators.skew import lookup_join

KEYS = ["run_id", "question_id"]
SCHEMA = "id bigint, run_id string, question_id string, payload string"


def brute(rows):
    first = {}
    for i, r, q, _ in sorted(rows, key=lambda x: x[0]):
        if r is not None and q is not None:
            first.setdefault((r, q), i)
    return first


def random_rows(n, seed, start=0):
    rng = random.Random(seed)
    hot = [(start + i, "hot", "same", "x") for i in range(n // 3)]
    rest = [(start + n // 3 + i, rng.choice(["a", "b", None]), rng.choice(["q1", "q2", "q3", None, "Ω" * 300]), "y") for i in range(n - n // 3)]
    return hot + rest


def test_surplus_and_kept_equal_brute_force(spark):
    rows = random_rows(300, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    first = brute(rows)
    want = sorted((first[r, q], i) for i, r, q, _ in rows if r is not None and q is not None and first[r, q] != i)
    assert sorted(map(tuple, surplus_arrivals(df, KEYS, "id").collect())) == want
    kept = {r.id for r in keep_one(df, KEYS, "id").collect()}
    assert kept == set(first.values()) | {i for i, r, q, _ in rows if r is None or q is None}


def test_batches_in_one_table(spark):
    rows = [(*r, i // 40) for i, r in enumerate(random_rows(300, 2))]
    df = spark.createDataFrame(rows, SCHEMA + ", batch int").withColumn("batch", F.when(F.col("batch") > 0, F.col("batch")))  # the first batch has no number
    first = brute([r[:4] for r in rows])
    want = sorted((first[r, q], i) for i, r, q, _, _ in rows if r is not None and q is not None and first[r, q] != i)
    assert sorted(map(tuple, surplus_arrivals(df, KEYS, "id", "batch").collect())) == want
    assert {r.id for r in keep_one(df, KEYS, "id", "batch").collect()} == set(first.values()) | {i for i, r, q, _, _ in rows if r is None or q is None}
    assert keep_one(df.withColumn("batch", F.lit(None).cast("int")), KEYS, "id", "batch").count() == keep_one(df, KEYS, "id").count()


def test_commit_leaves_other_shards(spark, tmp_path):
    store = SeenMessages(spark, f"file://{tmp_path}/seen", KEYS, groups=1000)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "seen").rglob("*.parquet")}
    batch = lambda ids: spark.createDataFrame([(i, f"run{i}", "q", "x") for i in ids], SCHEMA)
    store.admit(batch(range(20)), "id", lambda kept: None)
    before, held = files(), dict(store.current()["bitmaps"])
    store.admit(batch([100]), "id", lambda kept: None)
    after, now = files(), store.current()["bitmaps"]
    assert before.items() <= after.items() and sum(held.get(g) != p for g, p in now.items()) == 1
    store.admit(batch([3, 101]), "id", lambda kept: None)
    store.admit(batch([102]), "id", lambda kept: None)
    assert store.count() == 23 and len(list((tmp_path / "seen").glob("version-*.json"))) == 2
    assert sum(len(p) for p in store.current()["dictionaries"].values()) == 5  # four parts of runs, one of questions
    merged = SeenMessages(spark, store.path, KEYS, groups=1000, parts=2)
    merged.admit(batch([103]), "id", lambda kept: None)
    assert len(merged.current()["dictionaries"]["run_id"]) == 1 and merged.dictionary("run_id").count() == 24 and merged.count() == 24


def test_two_writers_conflict(spark, tmp_path):
    a, b = (SeenMessages(spark, f"file://{tmp_path}/seen", KEYS) for _ in range(2))
    df = spark.createDataFrame([(1, "a", "q", "x")], SCHEMA)
    with pytest.raises(Conflict):
        a.admit(df, "id", lambda kept: b.admit(df, "id", lambda k: None))
    assert a.version() == 1 and a.count() == 1


def test_rows_written_twice_count(spark):
    df = spark.createDataFrame([(1, "a", "q", "x"), (1, "a", "q", "x"), (2, "a", "q", "x")], SCHEMA)
    assert sorted(map(tuple, surplus_arrivals(df, KEYS, "id").collect())) == [(1, 1), (1, 2)]
    assert keep_one(df, KEYS, "id").count() == 1


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert surplus_arrivals(df, KEYS, "id").count() == 0
    assert keep_one(df, KEYS, "id").count() == 0


def test_batches_share_what_was_seen(spark, tmp_path):
    store = SeenMessages(spark, f"file://{tmp_path}/seen", KEYS)
    got = []
    batches = [random_rows(90, s, start=s * 1000) for s in range(3)]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA)
        assert store.admit(df, "id", lambda kept: got.extend(r.id for r in kept.where("run_id is not null and question_id is not null").collect()), mark=str(k))
    everything = [r for b in batches for r in b]
    assert sorted(got) == sorted(brute(everything).values())
    assert store.count() == len(brute(everything))
    assert not store.admit(spark.createDataFrame(batches[2], SCHEMA), "id", lambda kept: got.append(-1), mark="2")
    assert -1 not in got


def test_failed_write_leaves_the_store(spark, tmp_path):
    store = SeenMessages(spark, f"file://{tmp_path}/seen", KEYS)
    df = spark.createDataFrame([(1, "a", "q", "x")], SCHEMA)

    def fails(kept):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        store.admit(df, "id", fails, mark="0")
    assert store.version() is None
    assert store.admit(df, "id", lambda kept: None, mark="0")


def test_bits(spark):
    df = spark.range(1, 40000).where("id % 7 = 0").groupBy(F.bitmap_bucket_number("id").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    probe = spark.range(1, 40000).select("id", F.bitmap_bucket_number("id").alias("b"), F.bitmap_bit_position("id").alias("p")).join(df, "b")
    assert probe.where(bit_is_set(F.col("bits"), F.col("p")) != (F.col("id") % 7 == 0)).count() == 0


def test_codes_are_unique(spark):
    d = assign_codes(spark.range(1000).select(F.col("id").cast("string").alias("k")), ["k"], "code")
    assert d.select("code").distinct().count() == 1000 and d.agg(F.min("code")).first()[0] >= 0


def test_lookup_join_with_hot_and_null_keys(spark):
    big = spark.createDataFrame([("hot", i) for i in range(500)] + [(None, 1), ("cold", 2), ("missing", 3)], "k string, v int")
    look = spark.createDataFrame([("hot", 500, "H"), ("cold", 1, "C")], "k string, n bigint, x string")
    got = lookup_join(big, look, ["k"], "n", 501, hot_keys=2)
    assert got.count() == 501 and got.where("x = 'H'").count() == 500
    assert lookup_join(big, look, ["k"], "n", 501, hot_keys=2, how="left").count() == 503
