"""Join helpers that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_BYTES = 64 << 20


def plan_bytes(df: DataFrame) -> int:
    """Size estimate the optimizer holds for a plan."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def small(df: DataFrame, limit: int = DEFAULT_BROADCAST_BYTES) -> bool:
    return plan_bytes(df) <= limit


def maybe_broadcast(df: DataFrame, limit: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when the estimated size is within the limit; the plain shuffle join otherwise."""
    return F.broadcast(df) if small(df, limit) else df


# Rows of a few short columns that certainly fit a broadcast (about 100 bytes each).
NARROW_ROWS = 200_000


def few_rows(df: DataFrame, limit: int = NARROW_ROWS) -> bool:
    """Exact check for narrow tables whose estimate is inflated by the joins below them."""
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def salted_join(
    big: DataFrame,
    side: DataFrame,
    keys: list[str],
    spread: Column,
    how: str = "inner",
    salts: int = 32,
    limit: int = DEFAULT_BROADCAST_BYTES,
    narrow: bool = False,
) -> DataFrame:
    """Equi join of a fact with a smaller side whose keys may be hot.

    Within the size limit the side is broadcast, which has no skew; with ``narrow`` its rows are counted when the
    estimate exceeds the limit. Beyond it every key is split over ``salts``
    tasks: fact rows take a salt from ``spread`` and the side is repeated once per salt.
    """
    if small(side, limit) or (narrow and few_rows(side)):
        return big.join(F.broadcast(side), keys, how)
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    salted_side = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_big.join(salted_side, [*keys, "_salt"], how).drop("_salt")
