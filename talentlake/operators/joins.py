"""Relational joins of the recruitment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import top_per_group
from ..plans.skew import maybe_broadcast, salted_join
from ..session import cut_lineage
from . import patterns, vector_index

MEMBERS = 4096  # owners of equal skills in one row, about
SIDE_BYTES = 16 << 20  # stored size up to which the criteria go to every task


def owners(rows: DataFrame, key: str, item: Column, about: DataFrame | None = None, distinct: bool = False, how: str = "inner") -> DataFrame:
    """One row per owner ``key``: its sorted ``items`` and the columns of ``about``."""
    kept = F.collect_set(item) if distinct else F.collect_list(item)
    own = rows.groupBy(key).agg(F.array_sort(kept).alias("items"))
    return own if about is None else own.join(about, key, how)


def classes(rows: DataFrame, key: str, same: list[str], limit: int = MEMBERS) -> DataFrame:
    """Owners that agree in the columns ``same`` as one row with ``members``, an array of their other columns. Classes above
    the limit are dealt into parts, so no row holds an unbounded class."""
    rows = cut_lineage(rows)
    crowded = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).withColumn("_n", F.ceil(F.col("_n") / limit))
    part = F.pmod(F.xxhash64(key), F.coalesce("_n", F.lit(1).cast("bigint"))).alias("_part")
    member = F.struct(*[c for c in rows.columns if c not in same])
    return rows.join(crowded, same, "left").select(*same, part, member.alias("_m")).groupBy(*same, "_part").agg(
        F.collect_list("_m").alias("members")).drop("_part")


def class_pairs(held: DataFrame, need: DataFrame, same_held: list[str], same_need: list[str], skill=lambda n: n, limit: int = MEMBERS, side: int = SIDE_BYTES) -> DataFrame:
    """Classes of candidates and of criteria that share a skill: ``held`` and ``need`` (their items), the other columns of
    ``same_held`` and ``same_need``, ``people`` and ``jobs`` (their members).

    A pair comes from its first shared skill alone, so pairs are neither shuffled nor aggregated nor kept: what is moved grows
    with the skill rows. The criteria go to every task, or both sides are dealt by skill and salt.
    """
    tasks = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * held.sparkSession.sparkContext.defaultParallelism)
    people = cut_lineage(classes(held, "candidate_id", same_held, limit).withColumnsRenamed({"items": "held", "members": "people"}))
    jobs = cut_lineage(classes(need, "criteria_id", same_need, limit).withColumnsRenamed({"items": "need", "members": "jobs"}))
    left = people.repartition(tasks).withColumn("_skill", F.explode(F.array_distinct("held")))
    names = F.array_compact(F.array_distinct(F.transform("need", skill)))
    right = jobs.select("*", names.alias("_names")).select("*", F.posexplode("_names").alias("_at", "_skill")).withColumn(
        "_before", F.slice("_names", F.lit(1), F.col("_at"))).drop("_names", "_at")
    met = salted_join(left, right, ["_skill"], F.get("people", F.lit(0))["candidate_id"], limit=side)
    return met.filter(~F.arrays_overlap("_before", "held")).drop("_skill", "_before")


def expanded(pairs: DataFrame) -> DataFrame:
    """One row per candidate and criteria of the class pairs, with the columns of both members."""
    rest = [c for c in pairs.columns if c not in ("people", "jobs")]
    return pairs.select(*rest, "jobs", F.inline("people")).select(
        *rest, *[f.name for f in pairs.schema["people"].dataType.elementType], F.inline("jobs"))


def pairs(candidate_skills: DataFrame, criteria_skills: DataFrame, people: DataFrame | None = None, criteria: DataFrame | None = None) -> DataFrame:
    """Candidate and criteria pairs that share at least one skill, with the columns of ``people`` and ``criteria``.

    Cosine and coverage scores of all other pairs are 0. Business, heuristic and component scores are not: see
    ``overlap_topk`` for rankings that hold every candidate.
    """
    found = class_pairs(owners(candidate_skills, "candidate_id", F.col("skill"), people, True),
                        owners(criteria_skills, "criteria_id", F.col("skill"), criteria, True), ["items"], ["items"])
    return expanded(found.select("people", "jobs"))


def shared_weights(candidate_skills: DataFrame, criteria_skills: DataFrame) -> DataFrame:
    """Per pair the number of shared skill rows and their weight; repeated rows count as often as they meet."""
    held = owners(candidate_skills, "candidate_id", F.col("skill")).withColumn("_once", F.size("items") == F.size(F.array_distinct("items")))
    found = class_pairs(held, owners(criteria_skills, "criteria_id", F.struct("skill", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))),
                        ["items", "_once"], ["items"], lambda n: n["skill"])
    hits = F.filter("need", lambda n: F.array_contains("held", n["skill"]))
    times = lambda n: F.when(F.col("_once"), F.lit(1)).otherwise(F.size(F.filter("held", lambda h: h == n["skill"]))).cast("long")
    add = lambda value: F.aggregate("_hits", F.lit(0).cast("long"), lambda a, n: a + value(n))
    shown = found.withColumn("_hits", hits).select("people", "jobs", add(times).alias("n_shared"), add(lambda n: n["weight"] * times(n)).alias("weight"))
    return expanded(shown).select("candidate_id", "criteria_id", "n_shared", "weight")


def criteria_skill_rows(criteria_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """Per criteria the required skills as an array of (name, weight), heaviest first, then by id."""
    named = criteria_skills.select("id", "criteria_id", "skill_id", "weight").join(
        maybe_broadcast(skills.select("skill_id", "name")), "skill_id")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("down"), "id", "name", "weight")))
    return named.groupBy("criteria_id").agg(
        F.transform(ordered, lambda s: F.struct(s["name"].alias("name"), s["weight"].alias("weight"))).alias("required_skills")
    )


def candidate_skill_rows(candidate_skills: DataFrame, skills: DataFrame) -> DataFrame:
    return candidate_skills.select("candidate_id", "skill_id", "proficiency").join(
        maybe_broadcast(skills.select("skill_id", "name", "category")), "skill_id")


def missing_skills(candidate_skills: DataFrame, criteria_skills: DataFrame) -> DataFrame:
    """(candidate_id, criteria_id, skill) for required skills that the candidate of a pair lacks."""
    found = class_pairs(owners(candidate_skills, "candidate_id", F.col("skill"), distinct=True),
                        owners(criteria_skills, "criteria_id", F.col("skill"), distinct=True), ["items"], ["items"])
    lacking = found.select("people", "jobs", F.explode(F.array_except("need", "held")).alias("skill"))
    return expanded(lacking).select("candidate_id", "criteria_id", "skill")


def with_scores(candidates: DataFrame, results: DataFrame, criteria_id) -> DataFrame:
    """Every candidate with the score of one criteria, 0 when there is none."""
    scores = results.filter(F.col("criteria_id") == criteria_id).groupBy("candidate_id").agg(F.max("score_pct").alias("score_pct"))
    return candidates.join(scores, "candidate_id", "left").withColumn("score_pct", F.coalesce("score_pct", F.lit(0.0)))


def results_with_names(results: DataFrame, candidates: DataFrame) -> DataFrame:
    return named_results(results.join(candidates.select("candidate_id", "full_name", "email"), "candidate_id", "left"))


def named_results(results: DataFrame) -> DataFrame:
    """Names and addresses of results that carry those of their candidate, with the defaults of unknown ones."""
    return results.withColumns({
        "candidate_name": F.coalesce("full_name", F.lit("Unknown")),
        "candidate_email": F.coalesce("email", F.lit("")),
    }).drop("full_name", "email")


def link_orphans(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Candidates without a user take the user of the same address; others stay as they are."""
    accounts = users.groupBy("email").agg(F.min("user_id").alias("_user"))
    # Only orphans carry a join key, so linked rows never meet the user table.
    keyed = candidates.withColumn("_key", F.when(F.col("user_id").isNull(), F.col("email")))
    return keyed.join(accounts.withColumnRenamed("email", "_key"), "_key", "left").withColumn(
        "user_id", F.coalesce("user_id", "_user")).drop("_key", "_user")


def join_ci(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Equality ignoring case."""
    return left.withColumn("_key", F.lower(left_name)).join(
        right.withColumn("_key", F.lower(right_name)), "_key").drop("_key")


def contains_join(docs: DataFrame, names: DataFrame, text: str, name: str, shard_chars: int = patterns.SHARD_CHARS) -> DataFrame:
    """Rows of docs with every name that occurs in the text, ignoring case; see ``patterns`` for how many names are met."""
    return docs.withColumn(name, F.explode(patterns.patterns_in(F.col(text), names, name, shard_chars=shard_chars)))


def exists_semi(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_semi")


def missing_parent(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def shortlist(favorites: DataFrame, candidates: DataFrame) -> DataFrame:
    """Favorites with their displayable candidates (see ``quality.displayable`` and ``quality.real_identity``)."""
    from .quality import displayable, real_identity

    shown = real_identity(displayable(candidates)).select(
        "candidate_id", "full_name", "email", "phone", "quality_pct", "extracted_job_titles", "extracted_companies")
    return favorites.select(F.col("id").alias("favorite_id"), "recruiter_id", "candidate_id").join(shown, "candidate_id")


def top_k_similar(
    queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", item_id: str = "item_id", vector: str = "vector",
    query_block: int = vector_index.QUERY_ROWS, corpus_block: int = vector_index.CHUNK_ROWS, n_cells: int | None = None, least: float = 0.0, skip_same: bool = False,
) -> DataFrame:
    """The k corpus items of highest cosine per query, clipped to 0-1, ties by item id. Exact, through a partitioned index;
    ``least`` leaves out lower cosines, ``skip_same`` the item with the query's own id."""
    index = vector_index.build_index(corpus, item_id, vector, n_cells=n_cells, chunk_rows=corpus_block)
    partial = vector_index.nearest(queries, index, k, least, query_id, item_id, vector, skip_same, query_block)
    return top_per_group(partial, [query_id], [F.desc("similarity"), F.asc(item_id)], k)


def nearest_join(queries: DataFrame, corpus: DataFrame, threshold: float, **names) -> DataFrame:
    """The nearest corpus item per query when its cosine reaches the threshold."""
    return top_k_similar(queries, corpus, 1, least=threshold, **names).drop("rank")


def best_per_owner(queries: DataFrame, corpus: DataFrame, owner: str, threshold: float, skip_same: bool = False, n_cells: int | None = None) -> DataFrame:
    """Best similarity of every (query, owner of corpus items) that reaches the threshold: only cells that can reach it are
    visited, and the items of one owner are reduced inside their task."""
    index = vector_index.build_index(corpus, "item_id", "vector", owner, n_cells)
    return vector_index.best_owners(queries, index, threshold, owner=owner, skip_same=skip_same)
