"""Registered queries do the whole job, also where the test tables hold no such case."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentlake.catalog import load, registry
from talentlake.catalog.text_queries import job_rows, profile_rows
from talentlake.operators import features, joins, matching


def test_proficiency_of_names_with_symbols(spark, monkeypatch):
    cvs = spark.createDataFrame([(1, "Expert in C++ and Node.js"), (2, "basic CI/CD"), (3, "strong Python")], "cv_id int, text string")
    monkeypatch.setattr(registry, "table", lambda *_: cvs)
    found = {(r.cv_id, r.skill): r.proficiency for r in load()["k09_skill_proficiency"].run(spark, "").collect()}
    assert {(1, "C++"), (1, "Node.js"), (2, "CI/CD"), (3, "Python")} <= set(found)
    assert found[1, "C++"] == "expert" and found[3, "Python"] == "advanced"


def test_proficiency_reads_a_text_once(spark, monkeypatch):
    cvs = spark.range(3).selectExpr("id AS cv_id", "concat('Expert in Python ', uuid()) AS text")
    monkeypatch.setattr(registry, "table", lambda *_: cvs)
    found = load()["k09_skill_proficiency"].run(spark, "")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert {(r.cv_id, r.proficiency) for r in found.collect() if r.skill == "Python"} == {(0, "expert"), (1, "expert"), (2, "expert")}


def test_training_pairs_of_copies(spark):
    """Copies, and copies that differ in years alone, give what the pairs give; their pairs are not built."""
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    copied = lambda df, key, by: df.unionByName(df.withColumn(key, F.expr(f"{key} + {by}"))).unionByName(df.withColumn(key, F.expr(f"{key} + {10 * by}")))
    people = copied(profile_rows(t).withColumn("cv_years", F.lit(3)), "candidate_id", 1000).withColumn("cv_years", F.expr("if(candidate_id > 10000, 0, 3)"))
    jobs = copied(job_rows(t), "criteria_id", 100)
    held, need = copied(t.candidate_skills, "candidate_id", 1000), copied(t.criteria_skills, "criteria_id", 100)
    rows = lambda df: sorted(map(tuple, df.select("pair_id", F.md5("cv_text"), F.md5("job_text"), "label").collect()))
    found = features.shared_training_pairs(held, need, people, jobs)
    groups = features.training_pairs(joins.pairs(held, need), people, jobs).groupBy("cv_text", "job_text", "label").agg(F.min("pair_id").alias("pair_id"))
    assert rows(found) == rows(groups) and len(rows(found)) > 0


def test_searches_ask_every_query(spark, monkeypatch):
    """Every id divisible by 10 is a query, and rows divisible by 10 can be found."""
    turned = lambda i: [float(np.cos(i // 2)), float(np.sin(i // 2))]  # noqa: E731  20 and 21 are one vector, and so on
    near = [(i, turned(i), i % 3) for i in range(100)] + [(110, turned(30), 1)]
    vectors = spark.createDataFrame(near, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(registry, "table", lambda *_: vectors)
    found = lambda name: load()[name].run(spark, "").collect()
    asked = {*range(0, 100, 10), 110}
    assert {r.query_id for r in found("j12_top_k_similar")} == asked == {r.query_id for r in found("j13_nearest_join")}
    assert {(r.query_id, r.item_id) for r in found("j13_nearest_join")} >= {(110, 30), (20, 21)}
    assert {r.name for r in found("k13_canonicalise_by_embedding")} >= {"canon 21", "canon 30"}
    assert sum(r.total_matches for r in found("m12_semantic_match")) >= len(asked)


@pytest.mark.parametrize("name", ["j07_with_scores", "r03_explore_by_skill", "r13_export_rows", "r14_export_order", "r16_page_results"])
def test_one_criteria_builds_its_own_pairs(spark, monkeypatch, name):
    """Queries on one criteria build the pairs of that criteria alone."""
    asked, whole = [], matching.weighted_cosine

    def seen(held, need, *more):
        asked.append(need.select("criteria_id").distinct().count())
        return whole(held, need, *more)

    monkeypatch.setattr(matching, "weighted_cosine", seen)
    load()[name].run(spark, "/root/testdata/sf0.001")
    assert asked == [1]


def plan_of(spark, name):
    return load()[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_component_pairs_are_not_joined_again(spark):
    """What the score needs of a candidate is there before the pairs, so no pair is shuffled for it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan_of(spark, "m14_component_score")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["d03_business_rules", "d04_decision_text", "d05_explain"])
def test_rules_prepare_each_side_once(spark, name):
    """Lower-case skill sets belong to one side; a pair makes none of its own."""
    assert "lower(" not in plan_of(spark, name)


def test_shared_weights_count_repeated_rows(spark):
    held = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "d")], "candidate_id long, skill string")
    need = spark.createDataFrame([(7, "a", 5), (7, "a", 2), (7, "b", None), (8, "c", 4), (9, "z", 1)], "criteria_id long, skill string, weight int")
    want = held.join(need, "skill").groupBy("candidate_id", "criteria_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w"))
    found = joins.shared_weights(held, need)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "once" in found._jdf.queryExecution().optimizedPlan().toString()  # plain holders are counted without a second pass
