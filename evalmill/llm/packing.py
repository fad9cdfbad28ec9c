"""Fill containers of fixed capacity with items, neighbours by content together.

A document's hashed token vector is projected to four dimensions, whose place on a Hilbert curve is
its key. Items are range-sorted by key and each range is packed on its own, container by container along the
curve: the first item that is left, and of the next few those that fill its container best. The
window widens, up to ``WINDOW`` items, only as long as too much room would be left, so that a container holds neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch

DIMENSIONS, BITS, BUCKETS = 4, 8, 4096
#: Items among which a container's are chosen: the most, and how many at first; the share of its capacity that is enough.
WINDOW, NEAR, ENOUGH = 256, 16, 0.99
#: Parts of a capacity in which room is counted; sizes are rounded up to them.
UNITS = 8192


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of grid coordinates on the Hilbert curve (Skilling's transform)."""
    x = axes.astype("int64").T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_key(ids: list[np.ndarray], projection: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as token ids; 0 for empty ones."""
    v = np.zeros((len(ids), DIMENSIONS))
    for i, x in enumerate(ids):
        if len(x):
            v[i] = projection[(np.asarray(x, dtype="int64") * 2654435761 >> 8) % BUCKETS].sum(axis=0) / np.sqrt(len(x))
    # A document's words repeat, so that coordinates are wider than those of independent draws.
    grid = np.clip((v / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype("int64")
    return hilbert(grid)


def fullest(sizes: list[int], capacity: int) -> list[int]:
    """Places of items that fill ``capacity`` best, the first among them; early ones where several do as well."""
    reach = [1 << sizes[0]]  # bit k: some of the items so far, with the first, have size k
    limit = (1 << capacity + 1) - 1
    for x in sizes[1:]:
        reach.append(reach[-1] | reach[-1] << x & limit)
    left = reach[-1].bit_length() - 1
    chosen = []
    for i in range(len(sizes) - 1, 0, -1):
        if not reach[i - 1] >> left & 1:
            chosen.append(i)
            left -= sizes[i]
    return [0, *reversed(chosen)]


class Packer:
    """Fills containers from a queue of (item, size), in order but for what fits better."""

    def __init__(self, capacity: int, window: int = WINDOW):
        self.capacity, self.window, self.unit = capacity, window, max(1, capacity // UNITS)
        self.queue: list[tuple[int, int]] = []
        self.empty: list[int] = []

    def add(self, item: int, size: int) -> None:
        (self.queue.append((item, size)) if size else self.empty.append(item))

    def containers(self, last: bool = False) -> Iterator[list[int]]:
        """Items of the next containers: as long as the window is full, or until none are left. Items of no size go with any."""
        room = self.capacity // self.unit
        while self.queue and (last or len(self.queue) >= self.window):
            n = min(NEAR, self.window)
            while True:
                chosen = fullest([-(-size // self.unit) for _, size in self.queue[:n]], room)
                if n >= min(self.window, len(self.queue)) or sum(self.queue[i][1] for i in chosen) >= ENOUGH * self.capacity:
                    break
                n = min(n * 2, self.window)
            found = [self.queue[i][0] for i in chosen]
            for i in reversed(chosen):
                del self.queue[i]
            yield found + self.empty
            self.empty = []
        if last and self.empty:
            yield self.empty
            self.empty = []


def pack_along_curve(items: DataFrame, id_col: str, capacity: int, window: int = WINDOW, n_parts: int | None = None, with_key: bool = False) -> DataFrame:
    """(id, piece, n_tokens, container_id) of ``items`` (id, size, key); with the key too, if asked for.

    A piece is a whole item, or a part of one that exceeds the capacity: all parts but the last fill a
    container each. Items of size 0 or null take no room, but are assigned too. Ranges of equal keys
    are cut by id, so that a text repeated in a third of all rows spreads over the tasks; ids and rows
    may repeat, each row is an item. What ranges leave open is less than a container's room in each.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = n_parts or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = [T.StructField(id_col, items.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("container_id", T.LongType())]
    schema = T.StructType([*fields, *([T.StructField("key", T.LongType())] if with_key else [])])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made = TaskContext.get().partitionId() << 40, 0
        packer = Packer(capacity, window)
        waiting: dict[int, tuple] = {}  # of items that aren't placed yet
        number = 0

        def frame(rows: list[tuple]) -> pd.DataFrame:
            ids, piece, size, container, key = zip(*rows)
            out = {id_col: list(ids), "piece": piece, "n_tokens": size, "container_id": container}
            return pd.DataFrame(out | ({"key": key} if with_key else {}))

        def place(last: bool) -> list[tuple]:
            nonlocal made
            rows = []
            for found in packer.containers(last):
                for i in found:
                    id_, piece, size, key = waiting.pop(i)
                    rows.append((id_, piece, size, base + made, key))
                made += 1
            return rows

        for b in batches:
            rows = []
            for id_, size, key in zip(b[id_col].tolist(), b["size"].fillna(0).astype("int64").tolist(), b["key"].tolist()):
                piece = 0
                while size > capacity:
                    rows.append((id_, piece, capacity, base + made, key))
                    made, piece, size = made + 1, piece + 1, size - capacity
                waiting[number] = (id_, piece, size, key)
                packer.add(number, size)
                number += 1
                if len(packer.queue) >= 4 * window:
                    rows += place(False)
            if rows:
                yield frame(rows)
        if rows := place(True):
            yield frame(rows)

    ordered = items.repartitionByRange(n, "key", F.xxhash64(id_col)).sortWithinPartitions("key", F.xxhash64(id_col))
    return scratch(ordered.select(id_col, "size", "key").mapInPandas(pack, schema), "packed")


def neighbourhood(packed: DataFrame, capacity: int) -> DataFrame:
    """(n_containers, fill, spread) of pieces with their keys: the share of room used, and the mean width of the keys in a container of two items or more."""
    each = packed.groupBy("container_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("used"), (F.max("key") - F.min("key")).alias("width"))
    return each.agg(F.count("*").alias("n_containers"), (F.sum("used") / (F.count("*") * F.lit(float(capacity)))).alias("fill"), F.avg(F.when(F.col("n") > 1, F.col("width"))).alias("spread"))


def with_curve_key(encoded: DataFrame, id_col: str, seed: int = 7) -> DataFrame:
    """(id, size, key) of documents encoded as (id, ids)."""
    projection = np.random.default_rng(seed).choice([-1.0, 1.0], (BUCKETS, DIMENSIONS))
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("size", T.IntegerType()), T.StructField("key", T.LongType())])

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["ids"].tolist()
            yield pd.DataFrame({id_col: b[id_col], "size": [len(x) for x in ids], "key": curve_key(ids, projection)})

    return encoded.mapInPandas(keys, schema)
