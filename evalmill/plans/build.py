"""The gold layer as a whole: staging as views, dimensions, fact and marts as one published version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import publish, published
from . import gold
from .quality import checked, gold_tables, mixed_runtimes, outside_interval, unbalanced_grades

#: Layers: what is a view of an application, and what is written.
STAGING = {n: f for n, f in gold.catalog.queries.items() if n.startswith("stg_")}
GOLD = {n: f for n, f in gold.catalog.queries.items() if n not in STAGING}


def stage(spark: SparkSession, base: str, layer: str = "staging") -> list[str]:
    """Staging as temporary views, ``<layer>_<name>``, and their names."""
    names = []
    for name, query in STAGING.items():
        query(spark, base).createOrReplaceTempView(f"{layer}_{name}")
        names.append(f"{layer}_{name}")
    return names


def violations(spark: SparkSession, base: str, tolerated: frozenset[str] = frozenset()) -> DataFrame:
    """(check_name, n_violations) of the checks that don't hold."""
    answers = gold.fact(spark, base, ["run_id", "grade", "ai_correct"])
    found = checked(gold_tables(spark, base)).where("n_violations > 0")
    for name, rows in (("grades don't add up", unbalanced_grades(answers)), ("accuracy outside its interval", outside_interval(gold.mart_run_summary(spark, base))), ("mixed runtimes", mixed_runtimes(gold.dim_run(spark, base)))):
        found = found.unionByName(rows.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check_name"), "n_violations").where("n_violations > 0"))
    return found.where(~F.col("check_name").isin(*tolerated)) if tolerated else found


def build(spark: SparkSession, base: str, root: str, layer: str = "gold", tolerated: frozenset[str] = frozenset(), tables: dict[str, Callable[[SparkSession, str], DataFrame]] | None = None) -> str:
    """Write a version of all tables, named ``<layer>/<table>``, and make it the current one if every check but the ``tolerated`` ones holds."""
    made = {f"{layer}/{n}": q(spark, base) for n, q in (tables or GOLD).items()}
    return publish(made, root, [violations(spark, base, tolerated)])


def read(spark: SparkSession, root: str, name: str, layer: str = "gold") -> DataFrame:
    return published(spark, root, f"{layer}/{name}")
