"""Messages delivered at least once: keep one of each, within a batch and over batches.

Identifiers are encoded exactly by dictionaries. A message is one bit: the last identifier column
gives the position in a bitmap, the other ones together give the bitmap it lies in. Bitmaps are cut
into shards of 32,768 bits, so that neither a frequent run nor a long dictionary makes a large one,
and are built, united and counted by Spark's own bitmap functions; a store of them is compressed Parquet.

A table of many batches is taken in rounds of consecutive batches. Each shard's bitmap of a round is the
union of the bits of all earlier ones (a window over the few rows of a shard); of the arrivals of a
round one is selected for each bit that isn't set there.

Rows with a null in an identifier have no identity. They are never copies and are all kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import hadoop_path, scratch
from .dictionary import assign_codes
from .skew import lookup_join

#: Rounds that the batches of a table are put together to.
ROUNDS = 4


def bit_is_set(bitmap: Column, position: Column) -> Column:
    """Whether a bit of a bitmap as Spark's bitmap functions build it is set; null for no bitmap."""
    byte = F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))
    return F.bit_get(F.conv(F.hex(byte), 16, 10).cast("int"), position % 8) == 1


class Conflict(RuntimeError):
    """Another writer committed since this one read the store."""


class SeenMessages:
    """The identifiers seen so far: dictionaries and bitmaps in a shared folder.

    ``version-N.json`` names the files in force. A commit adds the new part of each dictionary, rewrites
    the groups of shards that got new bits and no others, and is done by renaming its list to the next
    number, which fails with ``Conflict`` if another writer was first. Readers see one version or the
    other; a job that fails half-way changes nothing. What a commit supersedes is deleted by the next one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], groups: int = 64, parts: int = 50):
        if len(keys) < 1:
            raise ValueError("no identifier columns")
        self.spark, self.path, self.keys, self.groups, self.parts = spark, path.rstrip("/"), keys, groups, parts

    def _numbers(self) -> list[int]:
        fs, p = hadoop_path(self.spark, f"{self.path}/version-*.json")
        return sorted(int(s.getPath().getName().split("-")[1].split(".")[0]) for s in fs.globStatus(p) or [])

    def current(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "mark": None, "dictionaries": {k: [] for k in self.keys}, "bitmaps": {}, "old": []}
        return json.loads(self.spark.read.text(f"{self.path}/version-{numbers[-1]}.json", wholetext=True).first().value)

    def version(self) -> int | None:
        return self.current()["number"] or None

    def dictionary(self, key: str, state: dict | None = None) -> DataFrame | None:
        parts = (state or self.current())["dictionaries"][key]
        return self.spark.read.parquet(*(f"{self.path}/{p}" for p in parts)) if parts else None

    def bitmaps(self, state: dict | None = None, groups: list[str] | None = None) -> DataFrame | None:
        held = (state or self.current())["bitmaps"]
        paths = [f"{self.path}/{p}" for g, p in held.items() if groups is None or g in groups]
        return self.spark.read.parquet(*paths) if paths else None

    def count(self) -> int:
        b = self.bitmaps()
        return 0 if b is None else b.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()[0]

    def admit(self, rows: DataFrame, order: str, write: Callable[[DataFrame], None], mark: str | None = None) -> bool:
        """Hand the rows that bring a message for the first time to ``write``, then remember the messages.

        The new bits are united with the old ones only after ``write`` returned, in one rename with the
        batch's ``mark``. A batch that failed before that is run again and writes the same rows; one that
        was remembered already is left alone, and False returned.
        """
        state = self.current()
        if mark is not None and state["mark"] == mark:
            return False
        kept, new, added = _kept(rows, self.keys, order, None, self, state)
        write(kept)
        self._commit(state, new, added, mark)
        return True

    def _commit(self, state: dict, new: DataFrame, added: dict[str, DataFrame], mark: str | None) -> None:
        folder, shards = f"v-{uuid.uuid4().hex[:12]}", _shards(self.keys)
        following = {"number": state["number"] + 1, "mark": mark, "dictionaries": dict(state["dictionaries"]), "bitmaps": dict(state["bitmaps"]), "old": []}
        for key, d in added.items():
            parts = state["dictionaries"][key]
            if len(parts) >= self.parts:
                d = d.unionByName(self.dictionary(key, state).select(*d.columns))
                following["old"] += parts
                parts = []
            name = f"{folder}/dictionary-{key}"
            d.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
            following["dictionaries"][key] = [*parts, name]
        group = F.pmod(F.xxhash64(*shards), F.lit(self.groups)).cast("string")
        built = scratch(new.groupBy(*shards).agg(F.bitmap_construct_agg("_bit").alias("bits")), "built")
        touched = [r.g for r in built.select(group.alias("g")).distinct().collect()]
        if touched:
            old = self.bitmaps(state, touched)
            both = built if old is None else built.unionByName(old).groupBy(*shards).agg(F.bitmap_or_agg("bits").alias("bits"))
            both.withColumn("_group", group).repartition("_group").write.partitionBy("_group").option("compression", "zstd").parquet(f"{self.path}/{folder}/bitmaps")
        for g in touched:
            if g in state["bitmaps"]:
                following["old"].append(state["bitmaps"][g])
            following["bitmaps"][g] = f"{folder}/bitmaps/_group={g}"
        self._publish(following)
        fs, _ = hadoop_path(self.spark, self.path)
        for name in state["old"]:
            fs.delete(hadoop_path(self.spark, f"{self.path}/{name}")[1], True)
        for n in self._numbers()[:-2]:
            fs.delete(hadoop_path(self.spark, f"{self.path}/version-{n}.json")[1], False)

    def _publish(self, state: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        fs, target = hadoop_path(self.spark, f"{self.path}/version-{state['number']}.json")
        _, draft = hadoop_path(self.spark, f"{self.path}/draft-{uuid.uuid4().hex[:12]}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(target):
            fs.delete(draft, False)
            raise Conflict(str(target))
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE  # fails if the number is taken
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(fs.makeQualified(draft), fs.makeQualified(target), how)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(str(target)) from e
            raise


def _shards(keys: list[str]) -> list[str]:
    return [*(f"_{k}" for k in keys[:-1]), "_bucket"]


def dictionaries(rows: DataFrame, keys: list[str], seen: SeenMessages | None, state: dict | None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(dictionaries with the number of rows that have each value as ``_n``, their new parts), by identifier column."""
    full, added = {}, {}
    for key in keys:
        code = f"{key}_code"
        counted = scratch(rows.groupBy(key).agg(F.count("*").alias("_n")).dropna(), f"values-{key}")
        known = seen.dictionary(key, state) if seen else None
        if known is None:
            full[key] = assign_codes(counted, [key], code)
            added[key] = full[key].drop("_n")
        else:
            first = known.agg(F.coalesce(F.max(code) + 1, F.lit(0))).first()[0]
            new = assign_codes(counted.join(known.select(key), key, "left_anti"), [key], code, start=first)
            full[key] = counted.join(known.select(key, code), key).select(key, "_n", code).unionByName(new)
            if new.limit(1).count():
                added[key] = new.drop("_n")
    return full, added


def encode_messages(rows: DataFrame, keys: list[str], order: str, codes: dict[str, DataFrame], round_of: Column | None = None) -> DataFrame:
    """``rows`` as (identifier codes, bucket, position, round, order): what tells messages apart, in integers.

    Values that hold a large share of the rows are encoded without a shuffle.
    """
    out = rows.select(*keys, F.col(order).alias("_order"), (F.lit(0) if round_of is None else round_of).cast("int").alias("_round")).dropna(subset=keys)
    for key in keys:
        d = codes[key].withColumnRenamed(f"{key}_code", f"_{key}")
        total = d.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        out = lookup_join(out, d, [key], "_n", total).drop(key)
    last = F.col(f"_{keys[-1]}") + 1  # Spark's bitmaps count from 1
    return out.select(
        *(F.col(f"_{k}") for k in keys[:-1]),
        F.bitmap_bucket_number(last).alias("_bucket"),
        F.bitmap_bit_position(last).cast("int").alias("_bit"),
        "_round",
        "_order",
    )


def rounds(rows: DataFrame, batch: str | None, n: int = ROUNDS) -> Column | None:
    """The round of a row: consecutive batches together, about as many rows in each. A null batch comes first."""
    if batch is None:
        return None
    cuts = rows.select(F.percentile_approx(batch, [i / n for i in range(1, n)], 1000)).first()[0] or []
    return sum((F.coalesce(F.col(batch) > c, F.lit(False)).cast("int") for c in sorted(set(cuts))), F.lit(0))


def first_arrivals(rows: DataFrame, keys: list[str], order: str, batch: str | None = None, seen: SeenMessages | None = None, state: dict | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame], dict[str, DataFrame]]:
    """(arrivals as codes, one row for each message and round, the dictionaries, their new parts).

    The second has the smallest ``order`` of each message in a round, its number of arrivals and, as
    ``_seen``, whether its bit is set in the union of what the store and earlier rounds brought.
    Arrivals are counted before the shuffle, so that a message delivered a billion times is as cheap as any other.
    """
    codes, added = dictionaries(rows, keys, seen, state)
    shards = _shards(keys)
    arrivals = scratch(encode_messages(rows, keys, order, codes, rounds(rows, batch)), "arrivals")
    firsts = scratch(arrivals.groupBy(*shards, "_bit", "_round").agg(F.min("_order").alias("_first"), F.count("*").alias("_n")), "firsts")
    built = firsts.groupBy(*shards, "_round").agg(F.bitmap_construct_agg("_bit").alias("bits"))
    old = seen.bitmaps(state) if seen else None
    if old is not None:
        built = built.unionByName(old.join(built.select(*shards).distinct(), shards, "left_semi").withColumn("_round", F.lit(-1)).select(*built.columns))
    before = Window.partitionBy(*shards).orderBy("_round").rowsBetween(Window.unboundedPreceding, -1)
    united = built.withColumn("_before", F.bitmap_or_agg("bits").over(before)).select(*shards, "_round", "_before")
    joined = firsts.join(united.where("_round >= 0"), [*shards, "_round"], "left")
    marked = joined.withColumn("_seen", F.coalesce(bit_is_set(F.col("_before"), F.col("_bit")), F.lit(False))).drop("_before")
    return arrivals, scratch(marked, "marked"), codes, added


def surplus_arrivals(rows: DataFrame, keys: list[str], order: str, batch: str | None = None) -> DataFrame:
    """One row (kept, copy) for each row that repeats a message; ``kept`` is the smallest ``order`` of it.

    Rows that are equal in ``order`` too are one arrival written twice: all but one of them count as
    copies of themselves, so that the number of rows still adds up.
    """
    arrivals, firsts, _, _ = first_arrivals(rows, keys, order, batch)
    bits = [*_shards(keys), "_bit"]
    repeated = firsts.where("_seen or _n > 1").select(*bits).distinct()
    many = scratch(firsts.join(repeated, bits, "left_semi").groupBy(*bits).agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n")), "many")
    total = many.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    joined = lookup_join(arrivals.drop("_round"), many, bits, "_n", total)
    counted = joined.groupBy("_first", "_order").count()
    times = F.col("count") - F.when(F.col("_order") == F.col("_first"), 1).otherwise(0)
    return counted.withColumn("_t", times).where("_t > 0").select(F.col("_first").alias("kept"), F.col("_order").alias("copy"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_t")))).select("kept", "copy")


def _kept(rows: DataFrame, keys: list[str], order: str, batch: str | None, seen: SeenMessages | None = None, state: dict | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    _, firsts, codes, added = first_arrivals(rows, keys, order, batch, seen, state)
    new = firsts.where("not _seen")
    code = ((F.col("_bucket") - 1) * 32768 + F.col("_bit")).cast("bigint")
    wanted = new.select(*_shards(keys)[:-1], code.alias(f"_{keys[-1]}"), F.col("_first").alias(order))
    for key in keys:  # back from codes to identifiers, for the new messages only
        wanted = wanted.join(codes[key].drop("_n").withColumnRenamed(f"{key}_code", f"_{key}"), f"_{key}").drop(f"_{key}")
    # Joined by arrival number as well, so that the copies of a message spread over the tasks.
    kept = rows.join(wanted, [*keys, order], "left_semi")
    if rows.groupBy(order).count().where("count > 1").limit(1).count():  # the same arrival written twice
        kept = kept.dropDuplicates([*keys])
    nameless = rows.where(" or ".join(f"`{k}` is null" for k in keys))
    return scratch(kept.unionByName(nameless), "kept"), new, added


def keep_one(rows: DataFrame, keys: list[str], order: str, batch: str | None = None) -> DataFrame:
    """One row of each message, the first to arrive, and all rows that have no identity.

    The first is that of the earliest round of batches and in it that with the smallest ``order``, an
    arrival number, not null, that grows over the batches. Rows that are equal in it too are one arrival
    written twice; any one of them is kept. Columns may have any names but those beginning with an underscore.
    """
    return _kept(rows, keys, order, batch)[0]
