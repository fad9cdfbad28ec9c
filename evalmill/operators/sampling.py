"""Samples of exact size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

SEED = 20260910
#: Bins of the seeded hash, by its leading bits.
BIN_BITS = 12


def quotas(strata: DataFrame, size: int, keys: list[str], n: str = "n") -> DataFrame:
    """``strata`` (keys, n rows each) with ``take``: in proportion, at least one, in sum exactly ``size``.

    What rounding leaves over or short goes to or comes from the largest strata, one each in turn.
    """
    held, total = strata.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0))).first()
    if size >= total:
        return strata.withColumn("take", F.col(n))
    if size < held:
        raise ValueError("fewer rows asked for than there are strata")
    drawn = scratch(strata.withColumn("take", F.greatest(F.lit(1), F.rint(F.lit(float(size)) * F.col(n) / total).cast("bigint"))), "quotas")
    off = size - drawn.agg(F.sum("take")).first()[0]
    if not off:
        return drawn
    room, step = (F.col("take") - 1, -1) if off < 0 else (F.col(n) - F.col("take"), 1)
    low, high = 0, abs(off)  # rounds that all strata with room take part in
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if drawn.agg(F.sum(F.least(room, F.lit(middle)))).first()[0] < abs(off) else (low, middle)
    rest = abs(off) - drawn.agg(F.sum(F.least(room, F.lit(low)))).first()[0]
    last = drawn.where(room > low).orderBy(F.desc(n), *keys).limit(rest).select(*keys, F.lit(1).alias("_more"))
    return drawn.join(last, keys, "left").withColumn("take", F.col("take") + step * (F.least(room, F.lit(low)) + F.coalesce("_more", F.lit(0)))).drop("_more")


def sample(questions: DataFrame, spec: str, strata: list[str] = ("category", "difficulty", "type"), id_col: str = "question_id", seed: int = SEED) -> DataFrame:
    """``all``, ``limit:N`` (the first by id) or ``stratified:N``, without few-shot examples.

    Within a stratum rows are taken in the order of a seeded hash, which is the same on every run: whole
    bins of it, and of the bin where the quota is reached the first rows, so that no stratum is
    sorted as a whole.
    """
    pool = questions.where(~F.coalesce("is_fewshot_example", F.lit(False)))
    kind, _, number = spec.partition(":")
    if kind == "all" and not number:
        return pool
    if kind not in ("limit", "stratified") or not number.isdigit():
        raise ValueError(f"unknown sample: {spec}")
    if kind == "limit":
        return pool.orderBy(id_col).limit(int(number))
    names = [f"_s{i}" for i in range(len(strata))]
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(strata, names)]
    marked = pool.select("*", *keys, F.xxhash64(F.lit(seed), F.col(id_col)).alias("_h")).withColumn("_bin", F.shiftrightunsigned("_h", 64 - BIN_BITS))
    bins = scratch(marked.groupBy(*names, "_bin").agg(F.count("*").alias("_n")), "bins")
    take = quotas(bins.groupBy(*names).agg(F.sum("_n").alias("n")), int(number), names).select(*names, "take")
    upto = F.sum("_n").over(Window.partitionBy(*names).orderBy("_bin"))
    wanted = bins.withColumn("_before", upto - F.col("_n")).join(take, names).where("_before < take").select(*names, "_bin", (F.col("take") - F.col("_before")).alias("_left"), (F.col("_before") + F.col("_n") > F.col("take")).alias("_border"))
    chosen = marked.join(wanted, [*names, "_bin"])
    ranked = chosen.where("_border").withColumn("_k", F.row_number().over(Window.partitionBy(*names, "_bin").orderBy("_h", id_col))).where("_k <= _left")
    return chosen.where("not _border").select(*questions.columns).unionByName(ranked.select(*questions.columns))
