"""Ratios and Wilson intervals as Column expressions, all in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole as a double; null for an empty whole."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def wilson(successes: str, trials: str, side: int, z: float = 1.96) -> Column:
    """Lower (side -1) or upper (side 1) limit of the Wilson interval; null without trials."""
    n = F.nullif(F.col(trials).cast("double"), F.lit(0.0))
    p = F.col(successes).cast("double") / n
    z2 = F.lit(z * z)
    middle = p + z2 / (2.0 * n)
    reach = F.lit(z) * F.sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n))
    return (middle + side * reach) / (1.0 + z2 / n)
