"""Bounded top-k against the scores of all pairs."""

import datetime
import random

import numpy as np
import pytest

from talentlake.operators import matching as mt
from talentlake.operators import topk


def sides(seed, n, jobs, n_skills):
    r = random.Random(seed)
    names = [f"s{k}" for k in range(n_skills)]
    people = [(k, datetime.datetime(2020, 1, 1 + r.randrange(5)), sorted(set(r.choices(names, range(n_skills, 0, -1), k=r.randrange(0, 12))))) for k in range(n)]
    need = [(j, {s: r.choice([0, 1, 20, 50, 100]) for s in r.sample(names, r.randrange(1, 6))}) for j in range(jobs)]
    return names, people, need


@pytest.mark.parametrize("seed", range(4))
def test_bounds_give_the_exact_top(seed):
    names, people, need = sides(seed, 3000, 60, 15 if seed % 2 else 60)
    born = np.array([int(b.timestamp()) for _, b, _ in people])
    block = topk.Block(np.arange(len(people)), born, np.array([len(s) for *_, s in people]), [np.array(s, object) for *_, s in people])
    scored = 0
    for _, weights in need:
        square = sum(w * w for w in weights.values())
        if not square:
            continue
        every = [(topk.percent(sum(weights.get(s, 0) for s in skills), len(skills), square), int(born[k]), -k) for k, _, skills in people]
        found, n = block.best(list(weights), list(weights.values()), square, 10)
        scored += n
        want = [x for x in sorted(every, reverse=True)[:10] if x[0] > 0]
        assert [x[:3] for x in found if x[0] > 0] == want
    assert scored < 0.5 * len(need) * len(people)


@pytest.mark.parametrize("blocks", [{}, {"candidate_block": 40, "criteria_block": 7}, {"bits": False}, {"candidate_block": 40, "criteria_block": 7, "bits": False}])
def test_top_scored_equals_all_pairs(spark, blocks):
    names, people, need = sides(9, 150, 25, 20)
    held = spark.createDataFrame([(k, s) for k, _, skills in people for s in skills], "candidate_id long, skill string")
    wanted = spark.createDataFrame([(j, s, w) for j, weights in need for s, w in weights.items()], "criteria_id long, skill string, weight int")
    universe = spark.createDataFrame([(s,) for s in names[::2] + names[1:9]], "skill string")  # some skills count for coverage only
    candidates = spark.createDataFrame([(k, b, f"n{k}") for k, b, _ in people], "candidate_id long, created_at timestamp_ntz, full_name string")
    pairs = mt.score_pairs(held, wanted, universe).collect()
    age = {k: b for k, b, _ in people}
    best = {}
    for r in pairs:
        score = float(mt_round(r.similarity * 100))
        if score > 0:
            best.setdefault(r.criteria_id, []).append((-score, -age[r.candidate_id].timestamp(), r.candidate_id))
    want = {(j, c, -s) for j, rows in best.items() for s, _, c in sorted(rows)[:5]}
    sides_ = topk.matching_sides(held, candidates, wanted, universe)
    got = topk.top_scored(*sides_, 5, **blocks)
    assert {(r.criteria_id, r.candidate_id, r.score_pct) for r in got.collect()} == want
    details = {(r.criteria_id, r.candidate_id): r for r in topk.pair_details(got.drop("score_pct"), *sides_).collect()}
    for r in pairs:
        if (r.criteria_id, r.candidate_id) in details:
            d = details[r.criteria_id, r.candidate_id]
            assert (d.similarity, d.matched_weight, d.total_weight, d.n_matched, d.n_required, d.matched_skills) == (
                r.similarity, r.matched_weight, r.total_weight, r.n_matched, r.n_required, r.matched_skills)


def mt_round(x):
    from decimal import ROUND_HALF_UP, Decimal

    return Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP).quantize(Decimal("0.01"), ROUND_HALF_UP)


def test_complete_ranking_and_empty_sides(spark):
    held = spark.createDataFrame([(1, "python")], "candidate_id long, skill string")
    wanted = spark.createDataFrame([(7, "python", 10), (8, "cobol", 5)], "criteria_id long, skill string, weight int")
    candidates = spark.createDataFrame([(k, datetime.datetime(2020, 1, k), f"n{k}") for k in (1, 2, 3)], "candidate_id long, created_at timestamp_ntz, full_name string")
    universe = spark.createDataFrame([("Python",), ("Cobol",)], "skill string")
    criteria = spark.createDataFrame([(7,), (8,), (9,)], "criteria_id long")
    got = {(r.criteria_id, r.rank): (r.candidate_id, r.score_pct) for r in topk.top_matches(held, candidates, wanted, universe, 2, criteria).collect()}
    assert got == {(7, 1): (1, 100.0), (7, 2): (3, 0.0), (8, 1): (3, 0.0), (8, 2): (2, 0.0), (9, 1): (3, 0.0), (9, 2): (2, 0.0)}
    assert topk.top_matches(held.limit(0), candidates, wanted, universe, 2).count() == 0


def test_equal_sides_reach_the_blocks_once(spark, monkeypatch):
    """Equal criteria get equal answers, and equal candidates beyond the k newest change nothing."""
    import datetime

    day = lambda i: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i % 7)
    held = spark.createDataFrame([(i, day(i), 2, ["y", "x"] if i % 2 else ["x", "y"]) for i in range(100)] + [(500, None, 1, ["x"])],
                                 "candidate_id long, created_at timestamp, size long, skills array<string>")
    need = spark.createDataFrame([(j, ["x", "y"], [3, 4], 25) for j in range(30)], "criteria_id long, skills array<string>, weights array<int>, square long")
    counted = []
    real = topk.top_per_group
    monkeypatch.setattr(topk, "top_per_group", lambda df, group, order, k, *more: (counted.append(df.select(*group).distinct().count()), real(df, group, order, k, *more))[1])
    rows = topk.top_scored(held, need, 4).collect()
    newest = sorted(range(100), key=lambda i: (-(i % 7), i))[:4]
    assert sorted((r.criteria_id, r.candidate_id) for r in rows) == sorted((j, i) for j in range(30) for i in newest)
    assert counted == [2, 1]  # two different skill sets, one question


def test_winners_without_scoring_all_pairs(spark, monkeypatch):
    from talentlake.operators import reports as rp

    skills = spark.createDataFrame([(1, "Alpha"), (2, "Alpha"), (2, "Zeta"), (3, "Zeta")], "candidate_id long, skill string")
    need = spark.createDataFrame([(10, "Alpha", 50), (11, "Zeta", 40)], "criteria_id long, skill string, weight int")
    universe = spark.createDataFrame([("Alpha",)], "skill string")  # Zeta is outside: its pairs score 0
    found = rp.best_by_cosine(skills, need, universe, lambda rest: mt.weighted_cosine(skills, rest, universe)).collect()
    assert sorted((r.criteria_id, r.candidate_id, r.score_pct) for r in found) == [(10, 1, 100.0), (11, 2, 0.0)]

    people = spark.createDataFrame([(i, datetime.datetime(2020, 1, i)) for i in (1, 2, 3)], "candidate_id long, created_at timestamp")
    jobs = need.groupBy(mt.F.col("criteria_id").alias("job_id")).agg(mt.F.collect_list(mt.F.struct(mt.F.col("skill").alias("name"), "weight")).alias("ideal_skills"))
    monkeypatch.setattr(mt, "scored_classes", lambda *_: pytest.fail("all pairs are scored"))
    best = mt.generate_and_match(jobs, people, skills, 1).collect()
    assert sorted((r.criteria_id, r.candidate_id, r.score_pct, r["rank"]) for r in best) == [(10, 1, 100.0, 1), (11, 3, 100.0, 1)]


def test_few_positive_scores_are_filled_with_zero_scores(spark):
    """Criteria with fewer than k positive scores go on with the pairs that score 0, as the ranking of all pairs does."""
    from talentlake.operators import matching as mt
    from talentlake.operators import reports as rp

    held = spark.createDataFrame([(i, s) for i in range(1, 9) for s in (["Go", "Sql"] if i < 7 else ["Sql"])], "candidate_id long, skill string")
    need = spark.createDataFrame([(1, "Go", 50), (1, "Sql", 0), (2, "Sql", 0), (3, "Java", 9), (4, "Go", 5)], "criteria_id long, skill string, weight int")
    universe = spark.createDataFrame([("Go",), ("Sql",), ("Java",)], "skill string")
    asked = []

    def pairs(rest):
        asked.extend(sorted({r.criteria_id for r in rest.collect()}))
        return mt.weighted_cosine(held, rest, universe)

    for k in (1, 3, 8):
        want = rp.compare_candidates(mt.weighted_cosine(held, need, universe).select("criteria_id", "candidate_id", "score_pct"), k)
        found = rp.compare_candidates(rp.best_by_cosine(held, need, universe, pairs, k), k)
        assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert asked == [2, 3, 2, 3, 1, 2, 3, 4]


def test_compared_candidates_are_found_without_all_pairs(spark, monkeypatch):
    from talentlake.catalog import load
    from talentlake.operators import matching as mt

    def no_pairs(*_, **__):
        raise AssertionError("pairs are scored")

    monkeypatch.setattr(mt, "weighted_cosine", no_pairs)
    assert load()["r09_compare_candidates"].run(spark, "/root/testdata/sf0.01").count() == 300


@pytest.mark.parametrize("few", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_bit_blocks_equal_all_pairs(monkeypatch, seed, few):
    """Top and counts of a block of bits, also where the possible scores are too many to be tried one by one."""
    names, people, need = sides(seed, 3000, 60, 15 if seed % 2 else 60)
    if few:
        monkeypatch.setattr(topk, "BIT_SCORES", 60)
    code = {s: i for i, s in enumerate(names)}
    people = [p for p in people if p[2]]
    ids = np.array([k for k, *_ in people])
    born = np.array([int(b.timestamp()) for _, b, _ in people])
    block = topk.BitBlock(ids, born, np.array([len(s) for *_, s in people]), np.array([len(s) for *_, s in people]), np.array([code[x] for *_, s in people for x in s]))
    for _, weights in need:
        square = sum(w * w for w in weights.values())
        if not square:
            continue
        asked = [code[s] for s in weights], list(weights.values()), square
        every = [(topk.percent(sum(weights.get(s, 0) for s in skills), len(skills), square), int(b), -k) for b, (k, _, skills) in zip(born, people)]
        want = [x for x in sorted(every, reverse=True)[:10] if x[0] > 0]
        assert [(v, b, -k) for v, b, k in block.best(*asked, 10) if v > 0] == want
        limits = [0.8, 0.6, want[-1][0] / 100] if want else [0.8, 0.6]
        assert block.counts(*asked, limits) == [sum(v / 100 >= x for v, *_ in every) for x in limits]


@pytest.mark.parametrize("block", [None, 30])
def test_shortlist_counts_without_pairs(spark, monkeypatch, block):
    from talentlake.operators import reports as rp

    names, people, need = sides(5, 150, 25, 8)
    held = spark.createDataFrame([(k, s) for k, _, skills in people for s in skills], "candidate_id long, skill string")
    wanted = spark.createDataFrame([(j, s, w) for j, weights in need for s, w in weights.items()] + [(3, names[0], 9)], "criteria_id long, skill string, weight int")
    universe = spark.createDataFrame([(s.upper(),) for s in names[:6]], "skill string")
    jobs, screened = spark.range(27).withColumnRenamed("id", "criteria_id"), spark.range(150)
    if block:
        monkeypatch.setattr(topk, "BIT_CANDIDATES", block)
        monkeypatch.setattr(topk, "BIT_CRITERIA", 4)

    def no_pairs():
        raise AssertionError("pairs are scored")

    scored = mt.weighted_cosine(held, wanted, universe).withColumn("score_01", mt.F.col("score_pct") / 100)
    want = rp.shortlist_summary(scored, jobs, screened)
    found = rp.shortlist_by_cosine(held, jobs, wanted, universe, screened, no_pairs)
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert want.agg(mt.F.sum("strong"), mt.F.sum("moderate")).first()[0] > 0
    monkeypatch.setattr(topk, "BIT_SKILLS", 2)
    many = rp.shortlist_by_cosine(held, jobs, wanted, universe, screened, lambda: scored)
    assert sorted(map(tuple, many.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
