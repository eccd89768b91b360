"""Exact row numbers and running totals without sorting a whole group in one task.

A row number over an unbounded group would put the group into a single task. Here the order is cut into coarse
cells (any prefix of the order): cell counts are pre-aggregated, their running total gives each cell its offset,
and only rows of the same cell are ordered together. The result equals ``row_number`` over the full order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_row_number(
    df: DataFrame, group: list[str], cell: list[tuple[str, bool]], order: list[Column], name: str = "rank"
) -> DataFrame:
    """Row number per group by (cell columns, then ``order``).

    ``cell`` lists (column, descending) pairs that form the leading part of the order and are not null.
    """
    cells = [c for c, _ in cell]
    by_cell = [F.col(c).desc() if down else F.col(c).asc() for c, down in cell]
    counts = df.groupBy(*group, *cells).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*group).orderBy(*by_cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, *cells, F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, *cells).orderBy(*order)
    return (
        df.withColumn("_within", F.row_number().over(inside))
        .join(offsets, [*group, *cells])
        .withColumn(name, F.col("_offset") + F.col("_within"))
        .drop("_offset", "_within")
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group. The optimizer turns this into a per-task top-k before the shuffle, so a hot group
    sends at most k rows per map task."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def first_of_equal(df: DataFrame, same: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that agree in the columns ``same`` are asked once: (their columns and the smallest ``key`` of each class, the key
    of every row with that of its class as ``_asked``)."""
    asked = df.groupBy(*same).agg(F.min(key).alias(key))
    named = asked.withColumnRenamed(key, "_asked")
    alike = lambda a, b: [a[c].eqNullSafe(b[c]) for c in same]
    return asked, df.join(named, alike(df, named)).select(df[key], "_asked")
