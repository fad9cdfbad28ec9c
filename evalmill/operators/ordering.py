"""Places in an order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def ecdf(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, share): for each row its place in its group's order of values, divided by the group's rows. Null values are left out.

    Different values are counted first and sorted by range over all groups; a range's rows are added up
    within it, from what the ranges before it hold. So no group is sorted in one task, and a value
    that holds most rows is one row until the end.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = scratch(counts.repartitionByRange(parts, by, value).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(by, "_part").agg(F.sum("_n").alias("_held"))
    order = Window.partitionBy(by).orderBy("_part")
    before = totals.select(F.col(by).alias("_by"), "_part", (F.sum("_held").over(order) - F.col("_held")).alias("_before"), F.sum("_held").over(Window.partitionBy(by)).alias("_all"))
    joined = ranged.alias("r").join(before.alias("b"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("r._part") == F.col("b._part"))).select("r.*", "_before", "_all")
    within = Window.partitionBy(by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = joined.withColumn("_upto", F.col("_before") + F.sum("_n").over(within))
    places = upto.select(by, value, "_all", F.explode(F.sequence(F.col("_upto") - F.col("_n") + 1, F.col("_upto"))).alias("_place"))
    return places.select(by, value, (F.col("_place").cast("double") / F.col("_all")).alias("share"))
