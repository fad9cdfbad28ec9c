"""Encode a corpus with a byte-level tokenizer, each content-defined chunk once.

Texts are cut where a rolling hash of the last characters says so, so that texts that share passages
share chunks. Each distinct chunk is encoded once. A chunk's ends may fall inside a piece of the
tokenizer's pattern; where two chunks meet, the last piece of the left one and the first pieces of the
right one are encoded again, until the new pieces end where a piece of the right chunk ends. From
there on its own ids hold: a piece depends only on its start and on the text up to two characters
behind its end (of "'ll", the first is a piece if the last is cut off). Ends of runs of letters or
digits, and of other signs before a blank, are piece ends whatever came before, so that a few pieces
suffice for agreement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import lookup_join
from ..session import scratch
from .tokenizers import FOLDER, PATTERN, ranked

WINDOW = 16
#: First pieces of a chunk that are kept for joins, and characters behind a piece on which it depends.
HEAD, BEHIND = 12, 2
MEMO = 400_000


def cut(text: str, average: int = 512, least: int = 128, most: int = 4096) -> list[str]:
    """The chunks of a text; ``average`` is a power of two."""
    n = len(text)
    if n <= max(least, WINDOW):
        return [text]
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(n - WINDOW + 1, dtype="uint64")
    for j in range(WINDOW):
        h = h * np.uint64(0x100000001B3) + points[j : n - WINDOW + 1 + j]
    ends = np.flatnonzero((h >> np.uint64(40)) & np.uint64(average - 1) == 0) + WINDOW
    out, at = [], 0
    for e in [*ends.tolist(), n]:
        while e - at > most:
            out.append(text[at : at + most])
            at += most
        if e - at >= least or e == n:
            if e > at:
                out.append(text[at:e])
            at = e
    return out


class Pieces:
    """Splits by the pattern and encodes pieces, each different one once."""

    def __init__(self, name: str, folder: str):
        import regex

        self.split = regex.compile(PATTERN).findall
        self.encoder = ranked(name, folder)
        self.memo: dict[str, list[int]] = {}

    def ids(self, piece: str) -> list[int]:
        got = self.memo.get(piece)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            got = self.memo[piece] = self.encoder.encode_ordinary(piece)
        return got

    def settled(self, pieces: list[str]) -> int:
        """How many of the pieces hold whatever follows."""
        n, behind = len(pieces), 0
        while n and behind < BEHIND:
            n -= 1
            behind += len(pieces[n])
        return n

    def chunk(self, text: str) -> tuple[list[int], str, list[int], list[int], str, int, bool]:
        """ids, text of the first pieces, their ends in characters and in ids, the text behind the last
        settled piece, where its ids begin, whether the first pieces are all."""
        pieces = self.split(text)
        settled = self.settled(pieces)
        ids: list[int] = []
        chars, counts, at, last = [], [], 0, 0
        for k, p in enumerate(pieces):
            if k == settled:
                last = len(ids)
            ids.extend(self.ids(p))
            at += len(p)
            if k < HEAD:
                chars.append(at)
                counts.append(len(ids))
        whole = settled <= HEAD
        return ids, text if whole else text[: chars[-1]], chars, counts, "".join(pieces[settled:]), last, whole

    def stitch(self, chunks: list) -> list[int]:
        """The ids of a text from the encodings of its chunks."""
        if len(chunks) == 1:
            return list(chunks[0]["ids"])
        out: list[int] = []
        open_ = ""  # the text behind the last settled piece
        for c in chunks:
            pieces = self.split(open_ + c["head"])
            settled = self.settled(pieces)
            if c["whole"]:
                for p in pieces[:settled]:
                    out.extend(self.ids(p))
                open_ = "".join(pieces[settled:])
                continue
            own = {len(open_) + e: k for e, k in zip(c["head_chars"], c["head_ids"])}
            at, start = 0, None
            for p in pieces[:settled]:
                out.extend(self.ids(p))
                at += len(p)
                if at in own:
                    start = own[at]
                    break
            if start is None:
                raise AssertionError("no agreement within the first pieces of a chunk")
            out.extend(c["ids"][start : c["last"]])
            open_ = c["tail"]
        for p in self.split(open_):
            out.extend(self.ids(p))
        return out


CHUNK = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("head", T.StringType()), T.StructField("head_chars", T.ArrayType(T.IntegerType())), T.StructField("head_ids", T.ArrayType(T.IntegerType())), T.StructField("tail", T.StringType()), T.StructField("last", T.IntegerType()), T.StructField("whole", T.BooleanType())])


def encode_corpus(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(id, ids) for each row of ``docs``, without special tokens.

    Null and empty texts have an empty list. Rows with one id are encoded each, a null id stays null.
    """
    id_type = docs.schema[id_col].dataType
    chunk_schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("id", id_type), T.StructField("seq", T.IntegerType()), T.StructField("text", T.StringType())])

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, ids, seqs, texts = [], [], [], []
            for row, i, text in zip(b["_row"], b["id"].tolist(), b["text"]):
                parts = cut(text) if text else [""]
                rows += [row] * len(parts)
                ids += [i] * len(parts)
                seqs += range(len(parts))
                texts += parts
            yield pd.DataFrame({"_row": rows, "id": pd.Series(ids, dtype=b["id"].dtype), "seq": seqs, "text": texts})

    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = scratch(numbered.mapInPandas(chunks, chunk_schema), "chunks")
    key = F.unhex(F.sha2("text", 256))
    counted = parts.groupBy("text").agg(F.count("*").alias("n")).select(key.alias("key"), "n", "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(tokenizer, folder)
        for b in batches:
            got = list(zip(*map(pieces.chunk, b["text"]))) or [[]] * 7
            yield pd.DataFrame({"key": b["key"], "n": b["n"], **dict(zip(["ids", "head", "head_chars", "head_ids", "tail", "last", "whole"], map(list, got)))})

    encoded = scratch(counted.mapInPandas(encode, CHUNK), "encoded")
    total = encoded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = lookup_join(parts.select("_row", "id", "seq", key.alias("key")), encoded, ["key"], "n", total)
    fields = ["seq", "ids", "head", "head_chars", "head_ids", "tail", "last", "whole"]
    whole = joined.groupBy("_row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct(*fields))).alias("chunks"))

    def stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(tokenizer, folder)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": [pieces.stitch(c) for c in b["chunks"]]})

    out = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return whole.select("id", "chunks").mapInPandas(stitch, out).withColumnRenamed("id", id_col)
