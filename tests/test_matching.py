"""Scores, decisions, rankings, joins and their physical helpers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from talentlake.operators import decisions as dc
from talentlake.operators import evaluation as ev
from talentlake.operators import joins as jn
from talentlake.operators import matching as mt
from talentlake.operators import models as md
from talentlake.operators import quality as ql
from talentlake.operators import vector_index
from talentlake.plans import skew
from talentlake.plans.ranking import exact_row_number

PAIR = ("cv_skills array<string>, job_skills array<string>, cv_years int, job_years int, cv_edu int, job_edu int, similarity double")


def business(spark, *row):
    return mt.business_score(spark.createDataFrame([row], PAIR)).first().score_01


def test_business_score_cases(spark):
    assert business(spark, ["React", "Python", "AWS"], ["React", "Python", "AWS"], 5, 3, 2, 2, 0.0) >= 0.80
    assert business(spark, [], ["React"], 5, 0, 2, 2, 0.0) < 0.5
    assert business(spark, ["a"], [], 0, 4, 1, 2, 0.5) == pytest.approx(0.5 + 0.1 + 0.0 + 0.05)


def test_decisions(spark):
    rows = spark.createDataFrame([(0.85,), (0.65,), (0.40,)], "s double")
    assert [r[0] for r in rows.select(dc.decide(F.col("s"))).collect()] == ["accepted", "to_review", "rejected"]
    rules = dc.business_rules(spark.createDataFrame([(0.75, ["React", "Python"], ["React", "Node"], 5, 3)],
                                                    "score_01 double, cv_skills array<string>, job_skills array<string>, cv_years int, job_years int")).first()
    assert rules.decision == "to_review" and rules.missing_skills == ["node"] and rules.skill_match_ratio == 0.5
    assert spark.range(1).select(dc.decide_pct(F.lit(88.0), 80.0, 50.0)).first()[0] == "accepted"


@pytest.fixture(scope="module")
def skills(spark):
    cand = spark.createDataFrame([(1, "python"), (1, "sql"), (1, "cooking"), (2, "java"), (3, "python")], "candidate_id int, skill string")
    crit = spark.createDataFrame([(9, "Python", 90), (9, "SQL", 80), (9, "Rust", 70), (8, "Java", 0)], "criteria_id int, skill string, weight int")
    universe = spark.createDataFrame([(s,) for s in ("Python", "SQL", "Java", "Cooking")], "skill string")
    return cand, crit, universe


def test_weighted_cosine_outside_universe(skills):
    rows = {(r.criteria_id, r.candidate_id): r for r in mt.weighted_cosine(*skills).collect()}
    # Rust is no part of the universe: ignored by the cosine, counted by the coverage.
    cosine = (0.9 + 0.8) / (math.sqrt(3) * math.sqrt(0.81 + 0.64)) * 100
    assert rows[9, 1].score_pct == pytest.approx(round(cosine, 2)) and rows[9, 1].coverage_pct == pytest.approx(70.83)
    assert (9, 2) not in rows and rows[8, 2].score_pct == 0.0 and rows[8, 2].coverage_pct == 0.0


def test_score_ignores_skill_order_and_coverage_grows(spark, skills):
    cand, crit, universe = skills
    more = cand.unionByName(spark.createDataFrame([(1, "rust")], "candidate_id int, skill string"))
    before = {r.candidate_id: r.coverage_pct for r in mt.weighted_cosine(cand, crit, universe).filter("criteria_id = 9").collect()}
    after = {r.candidate_id: r.coverage_pct for r in mt.weighted_cosine(more.orderBy(F.desc("skill")), crit, universe).filter("criteria_id = 9").collect()}
    assert after[1] == 100.0 > before[1] and after[3] == before[3]


def test_salted_join_equals_join(spark):
    big = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("5", 3)], "k string, v int")
    plain = sorted(map(tuple, big.join(side, "k").collect()))
    assert sorted(map(tuple, skew.salted_join(big, side, ["k"], F.col("id"), limit=0).collect())) == plain


def test_exact_row_number_equals_window(spark):
    rows = spark.range(400).select((F.col("id") % 3).alias("g"), F.round(F.rand(7) * 5, 0).alias("s"), "id")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    got = exact_row_number(rows, ["g"], [("s", True)], [F.asc("id")], "r")
    want = rows.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "id")))
    pick = lambda df: {r.id: r.r for r in df.collect()}
    assert pick(got) == pick(want)


def test_blocked_similarity_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(7, 5)), rng.normal(size=(23, 5))
    frame = lambda m, n: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{n} int, vector array<double>")
    got = jn.top_k_similar(frame(q, "query_id"), frame(c, "item_id"), 4, query_block=3, corpus_block=5)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.clip(np.round(unit(q) @ unit(c).T, 6), 0, 1)
    want = {(i, int(j), k + 1) for i in range(7) for k, j in enumerate(np.argsort(-sims[i], kind="stable")[:4])}
    assert {(r.query_id, r.item_id, r["rank"]) for r in got.collect()} == want


def test_contains_join_over_many_shards(spark):
    docs = spark.createDataFrame([(1, "Knows SQL and go", "x"), (2, "c", "y"), (3, "nothing", None), (4, None, "z"), (5, "", "z")], "id int, text string, form string")
    names = spark.createDataFrame([("sql",), ("SQL",), ("Go",), ("C",), ("hing",), ("sql",), ("",), (None,)], "name string")
    want = {(1, "sql"), (1, "SQL"), (1, "Go"), (2, "C"), (3, "hing")}
    for chars in (1 << 19, 4, 1):
        got = jn.contains_join(docs, names, "text", "name", shard_chars=chars)
        assert got.columns == ["id", "text", "form", "name"]
        rows = [(r.id, r["name"]) for r in got.collect()]
        assert sorted(rows) == sorted(want)


def test_auc_and_thresholds(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.3), (1, 0.3), (0, 0.1)], "label int, score double")
    assert ev.roc_auc(rows).first()[0] == pytest.approx((0.5 + 1 + 1 + 0 + 1 + 1 + 0 + 0.5 + 1) / 9)
    assert ev.roc_auc(rows.filter("label = 1")).first()[0] is None
    best = ev.best_f1_threshold(rows).first()
    assert best.f1 == pytest.approx(0.75) and best.threshold == pytest.approx(0.11)
    m = ev.metrics_at(rows.limit(0), 0.5).first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0, 0.0)


def test_prediction_with_a_fixed_model(spark):
    class Fixed:
        def transform(self, df):
            from pyspark.ml.functions import array_to_vector

            return df.withColumns({"probability": array_to_vector(F.array(F.lit(0.12), F.lit(0.88))), "rawPrediction": F.lit(0), "prediction": F.lit(1)})

    pairs = spark.createDataFrame([(1, 5, ["Python"], ["Python", "SQL"])], "criteria_id int, candidate_id int, matched_skills array<string>, required_skills array<string>")
    row = md.predict_top_k(Fixed(), pairs, 20, 80.0, 50.0).first()
    assert row.score_pct == 88.0 and row.decision == "accepted" and row.coverage_pct == 50.0 and row.missing_skills == ["SQL"]


def test_ideal_profile_rules(spark):
    text = "We need a senior engineer with Python, FastAPI and Docker. 5+ years, Bachelor degree. English and French."
    row = mt.ideal_profiles(spark.createDataFrame([(text,)], "text string")).first()
    names = {s.name.lower() for s in row.ideal_skills}
    assert row.ideal_experience_years >= 5 and {"python", "fastapi"} <= names
    assert row.ideal_education == "Bachelor's degree" and row.ideal_languages == ["English", "French"]


def test_dedupe_is_idempotent(spark):
    rows = spark.createDataFrame(
        [(1, "A@x.io", "12-3", "Jo", ["Python"]), (2, "a@x.io ", "1 23", "jo ", ["Python"]), (3, "b@x.io", None, "Jane", ["React"])],
        "id int, email string, phone string, full_name string, normalized_skills array<string>")
    once = ql.dedupe_candidates(rows, "id", [])
    assert sorted(r.id for r in once.collect()) == [1, 3]
    again = ql.dedupe_candidates(once.drop("fingerprint"), "id", [])
    assert sorted(r.id for r in again.collect()) == [1, 3]
    assert all(len(r.fingerprint) == 32 for r in once.collect())


def test_ranking_is_filled_with_the_newest(spark):
    scored = spark.createDataFrame([(1, 5, 80.0, 40.0), (1, 6, 0.0, 10.0), (2, 7, 20.0, 5.0)], "criteria_id long, candidate_id long, score_pct double, coverage_pct double")
    people = spark.createDataFrame([(i, f"2024-01-{i:02d}", f"p{i}") for i in range(1, 10)], "candidate_id long, day string, full_name string").selectExpr(
        "candidate_id", "cast(day AS timestamp) AS created_at", "full_name")
    criteria = spark.createDataFrame([(1,), (2,), (3,)], "criteria_id long")
    got = mt.rank_top(scored, people, 4, criteria).orderBy("criteria_id", "rank").collect()
    assert [(r.criteria_id, r.rank, r.candidate_id, r.score_pct, r.coverage_pct) for r in got] == [
        (1, 1, 5, 80.0, 40.0), (1, 2, 9, 0.0, 0.0), (1, 3, 8, 0.0, 0.0), (1, 4, 7, 0.0, 0.0),
        (2, 1, 7, 20.0, 5.0), (2, 2, 9, 0.0, 0.0), (2, 3, 8, 0.0, 0.0), (2, 4, 6, 0.0, 0.0),
        (3, 1, 9, 0.0, 0.0), (3, 2, 8, 0.0, 0.0), (3, 3, 7, 0.0, 0.0), (3, 4, 6, 0.0, 0.0)]
    wide = mt.rank_top(scored, people, 8, criteria).filter("criteria_id = 1 AND candidate_id = 6").first()
    assert (wide.rank, wide.coverage_pct) == (5, 10.0)


def test_partial_selection_equals_full_sort():
    r = np.random.default_rng(0)
    sims = np.round(r.random((150, 40)), 1)
    sims[3] = 0.0
    for k in (1, 5, 40, 60):
        rows, cols = vector_index.first_per_row(sims, k)
        want = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        assert (rows == np.repeat(np.arange(150), want.shape[1])).all() and (cols == want.ravel()).all()


def test_pairs_equal_brute_force_and_are_not_shuffled(spark):
    """Equal candidates and criteria meet as one class; every pair comes out once, on both join forms and with dealt classes."""
    r = random.Random(5)
    held = {c: r.sample("abcdefgh", r.randint(1, 4)) for c in range(60)} | {c: ["a", "b"] for c in range(60, 90)}
    need = {j: [(s, r.randint(1, 9)) for s in r.sample("abcdefgh", 3)] for j in range(20)} | {j: [("b", 2), ("z", 3)] for j in range(20, 30)}
    people = spark.createDataFrame([(c, s) for c, skills in held.items() for s in skills], "candidate_id long, skill string")
    wanted = spark.createDataFrame([(j, s, w) for j, items in need.items() for s, w in items], "criteria_id long, skill string, weight int")
    want = sorted((c, j) for c in held for j in need if set(held[c]) & {s for s, _ in need[j]})
    found = jn.pairs(people, wanted).select("candidate_id", "criteria_id")
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan
    own, asked = jn.owners(people, "candidate_id", F.col("skill")), jn.owners(wanted, "criteria_id", F.struct("skill", "weight"))
    dealt = jn.class_pairs(own, asked, ["items"], ["items"], lambda n: n["skill"], limit=7, side=0)
    assert sorted(map(tuple, jn.expanded(dealt.select("people", "jobs")).select("candidate_id", "criteria_id").collect())) == want


def test_balanced_weights_need_no_join(spark):
    rows = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (0.0,), (None,)], "label double")
    got = md.balanced_weights(rows)
    assert sorted((r.label, r.weight) for r in got.collect()) == [(0.0, 2.0), (1.0, 2 / 3), (1.0, 2 / 3), (1.0, 2 / 3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Subquery" not in plan
