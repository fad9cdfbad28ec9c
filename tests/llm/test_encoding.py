"""The corpus' encoding, against the tokenizer itself; and packing."""

import random

import pytest
from pyspark.sql import functions as F

from evalmill.llm.encoding import Pieces, cut, encode_corpus
from evalmill.llm.packing import fullest, hilbert, neighbourhood, pack_along_curve, with_curve_key
from evalmill.llm.tokenizers import FOLDER, ranked

NAME = "byte_bpe_50k"


def reference(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/{NAME}.json")
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "a", "\n\n  \n x", "it's 's 'll''s", "x" * 5000, "1" * 3000, " " * 4000, "…" * 3000, "日本語" * 900, "<|endoftext|> a", "👩‍👩‍👧 é é ﻿", "don't " * 700, "--- *** ---  " * 400]


def noisy(rng, n):
    parts = ["the ", "don't", "'s", " ", "\n", "\t", "   ", "12", "345", "?!", "…", "naïve", "日本", "--", " ", "'ll", "a", "B", "'", "\r\n"]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("average,least,most", [(4, 1, 16), (8, 2, 8), (128, 32, 2048), (512, 128, 4096)])
def test_stitched_chunks_equal_the_whole(average, least, most):
    rng = random.Random(average)
    pieces = Pieces(NAME, FOLDER)
    enc = ranked(NAME)
    for text in TEXTS + [noisy(rng, rng.randrange(1, 300)) for _ in range(300)]:
        parts = cut(text, average, least, most) if text else [""]
        assert "".join(parts) == text
        names = ["ids", "head", "head_chars", "head_ids", "tail", "last", "whole"]
        chunks = [dict(zip(names, pieces.chunk(p))) for p in parts]
        assert pieces.stitch(chunks) == enc.encode_ordinary(text), (text[:80], parts[:4])


def test_random_cuts():
    rng = random.Random(5)
    pieces = Pieces(NAME, FOLDER)
    enc = ranked(NAME)
    names = ["ids", "head", "head_chars", "head_ids", "tail", "last", "whole"]
    for _ in range(600):
        text = noisy(rng, rng.randrange(2, 120))
        at = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(rng.randrange(1, 9)))})
        chunks = [dict(zip(names, pieces.chunk(text[a:b]))) for a, b in zip(at, at[1:])]
        assert pieces.stitch(chunks) == enc.encode_ordinary(text), text


def test_chunks_are_content_defined():
    rng = random.Random(2)
    shared = noisy(rng, 2000)
    a, b = cut("x" * 77 + shared, 64, 17), cut(noisy(rng, 50) + shared, 64, 17)
    assert len(set(a) & set(b)) > 0.8 * min(len(a), len(b))


def test_corpus(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(90, None, "x"), (91, "same", "x"), (91, "same", "x"), (None, "no id", None)], "doc_id bigint, text string, id string")
    got = encode_corpus(docs, "doc_id", "text").collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r.ids for r in got}
    assert by[0] == [] and by[90] == [] and [r.ids for r in got].count(by[91]) >= 2 and by[None] == reference("no id")
    assert all(by[i] == reference(t) for i, t in enumerate(TEXTS))
    assert encode_corpus(docs.where("doc_id < 0"), "doc_id", "text").count() == 0


def test_small_table(spark, small, q):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in q["p7_ids"](spark, small).collect()}
    assert got.keys() == texts.keys() and all(ids == reference(texts[d] or "") for d, ids in got.items())


def items(spark, sizes):
    return spark.createDataFrame([(i, s, (i * 2654435761) % 1000) for i, s in enumerate(sizes)], "doc_id bigint, size int, key bigint")


def test_packing_keeps_every_item_whole(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 5, rng.randrange(1, 100), rng.randrange(1, 700)]) for _ in range(3000)]
    got = pack_along_curve(items(spark, sizes), "doc_id", 100, n_parts=3).collect()
    used, parts = {}, {}
    for r in got:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append(r.n_tokens)
    assert max(used.values()) <= 100 and len(parts) == len(sizes)
    for i, s in enumerate(sizes):
        assert sum(parts[i]) == s and len(parts[i]) == max(1, -(-s // 100))
    assert sum(sizes) / (100 * len(used)) > 0.97


def test_packing_edges(spark):
    assert pack_along_curve(items(spark, []), "doc_id", 10).count() == 0
    hot = spark.range(500).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(3).alias("size"), F.lit(1).cast("bigint").alias("key"))
    assert pack_along_curve(hot, "doc_id", 10, n_parts=2).count() == 500
    nulls = spark.createDataFrame([(None, None, None), (1, 10, 5)], "doc_id bigint, size int, key bigint")
    assert sorted(r.n_tokens for r in pack_along_curve(nulls, "doc_id", 10).collect()) == [0, 10]
    with pytest.raises(ValueError):
        pack_along_curve(hot, "doc_id", 0)


def test_small_table_is_packed(spark, small, q):
    packed = q["p8_packed"](spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("container_id").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0] <= 2048


def test_hilbert_neighbours():
    import numpy as np

    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    key = hilbert(grid, bits=4)
    assert sorted(key) == list(range(256))
    at = grid[np.argsort(key)]
    assert (np.abs(np.diff(at, axis=0)).sum(axis=1) == 1).all()


def test_equal_texts_have_equal_keys(spark):
    enc = spark.createDataFrame([(1, [5, 6]), (2, [5, 6]), (3, [])], "doc_id int, ids array<int>")
    k = {r.doc_id: r.key for r in with_curve_key(enc, "doc_id").collect()}
    assert k[1] == k[2]


def test_fullest():
    assert fullest([3, 9, 4, 2, 4], 10) == [0, 2, 3] and fullest([5], 10) == [0] and fullest([10, 1], 10) == [0]
    from itertools import combinations

    sizes = [7, 3, 8, 5, 9, 2]
    best = max(sum(c) + 7 for k in range(6) for c in combinations(sizes[1:], k) if sum(c) + 7 <= 21)
    assert sum(sizes[i] for i in fullest(sizes, 21)) == best


def test_containers_hold_neighbours(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(700)) + 5).cast("int").alias("size"), (F.col("id") * 1000).alias("key"))
    along = neighbourhood(pack_along_curve(df, "doc_id", 2048, n_parts=2, with_key=True), 2048).first()
    random = neighbourhood(pack_along_curve(df.withColumn("key", F.xxhash64("doc_id")), "doc_id", 2048, n_parts=2).join(df.select("doc_id", "key"), "doc_id"), 2048).first()
    assert along.fill > 0.97 and random.fill > 0.97 and along.spread * 20 < random.spread
    big = pack_along_curve(df.withColumn("size", F.col("size") * 1000), "doc_id", 2_048_000, n_parts=2)
    assert big.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where("n > 2048000").count() == 0 and big.count() == 4000
