"""Table maintenance as set operations: the result is the new content of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_profiles(current: DataFrame, new: DataFrame, key: str, time: str) -> DataFrame:
    """One profile per user; the last upload wins, a stored profile loses against any upload.

    The winner is found by a pre-aggregated maximum, so one user with many uploads is no hot task.
    """
    columns = [c for c in current.columns if c != key]
    both = current.withColumn("_new", F.lit(0)).unionByName(new.select(*current.columns).withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct(*columns), F.struct("_new", time))
    return both.groupBy(key).agg(last.alias("_r")).select(key, "_r.*")


def replace_criteria_skills(current: DataFrame, new: DataFrame) -> DataFrame:
    """The skills of every criteria that occurs in ``new`` are replaced."""
    changed = new.select("criteria_id").distinct()
    return current.join(changed, "criteria_id", "left_anti").unionByName(new.select(*current.columns))


def partial_update(current: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Only supplied (non-null) fields change."""
    fields = [c for c in patch.columns if c != key]
    right = patch.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return current.join(right, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).select(*current.columns)


def cascade_delete(ids: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    """Every child table without the rows of the deleted keys."""
    gone = ids.select(key).distinct()
    return [child.join(gone, key, "left_anti") for child in children]


def insert_if_absent(current: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds the rows whose key is new; of several new rows with one key the first by ``order``."""
    rest = [c for c in current.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")
    fresh = first.join(current.select(*keys), keys, "left_anti")
    return current.unionByName(fresh.select(*current.columns))


def results_or_compute(stored: DataFrame, criteria: DataFrame, compute) -> DataFrame:
    """Stored results, plus freshly computed ones for the criteria without any; ``compute`` gets those criteria."""
    missing = criteria.join(stored.select("criteria_id").distinct(), "criteria_id", "left_anti")
    return stored.unionByName(compute(missing).select(*stored.columns))
