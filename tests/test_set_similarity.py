"""Similar records and connected groups against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from talentlake.operators import quality, set_similarity
from talentlake.operators.set_similarity import similar_groups
from talentlake.plans.graph import connected_groups


def closure(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_groups(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, 2001 + k) for k in range(300)] + [(5, 5)]
    chain = list(range(3000, 3150))
    r.shuffle(chain)
    links += list(zip(chain, chain[1:]))
    found = {x.node: x.root for x in connected_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closure({n for link in links for n in link if link[0] != link[1]}, links)
    assert found == want
    assert connected_groups(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("threshold, cell", [(0.9, 512), (0.8, 4), (0.5, 16), (1.0, 3)])
def test_groups_equal_all_pairs(spark, threshold, cell):
    r = random.Random(int(threshold * 10))
    rows = []
    for k in range(50):
        base = [f"w{r.randrange(60)}" for _ in range(r.randrange(1, 30))] + ["common", "often"]
        for _ in range(r.randrange(1, 6)):
            copy = [w if r.random() > 0.04 else f"x{r.randrange(30)}" for w in base]
            rows.append((len(rows), copy + (["more"] if r.random() < 0.3 else [])))
    rows += [(len(rows), None), (len(rows) + 1, []), (len(rows) + 2, [None]), (len(rows) + 3, ["a", "a", None]), (len(rows) + 4, ["a"])]
    sets = {k: frozenset(w for w in t or [] if w) for k, t in rows}
    near = lambda a, b: a == b or len(a & b) >= threshold * len(a | b) - 1e-9 and bool(a | b)
    want = closure(sets, [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])])
    docs = spark.createDataFrame(rows, "id long, words array<string>")
    assert {x.id: x.group for x in similar_groups(docs, "id", F.col("words"), threshold, cell).collect()} == want


@pytest.mark.parametrize("threshold, paired", [(0.8, 8), (0.4, 5), (0.9, 12), (0.6, 1)])
def test_groups_across_the_limit_of_pairs(spark, threshold, paired):
    r = random.Random(paired)
    rows = []
    for k in range(60):
        base = [f"w{r.randrange(40)}" for _ in range(r.randrange(1, 2 * paired + 4))]
        rows += [(len(rows) + i, [w for w in base if r.random() > 0.1] + ["more"] * (r.random() < 0.3)) for i in range(r.randrange(1, 5))]
    sets = {k: frozenset(t) for k, t in rows}
    near = lambda a, b: a == b or len(a & b) >= threshold * len(a | b) - 1e-9 and bool(a | b)
    want = closure(sets, [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])])
    docs = spark.createDataFrame(rows, "id long, words array<string>")
    assert {x.id: x.group for x in similar_groups(docs, "id", F.col("words"), threshold, paired=paired).collect()} == want


def test_sets_with_one_rare_token_in_common_do_not_meet(spark):
    rows = [(k, [f"own{k}", "rare", *[f"often{(k * i) % 50}" for i in range(2, 10)]]) for k in range(1, 400)]
    sets = spark.createDataFrame(rows, "node long, _tokens array<string>").withColumn("_tokens", F.array_distinct("_tokens"))
    keys = sets.select("node", F.explode(set_similarity.meeting_keys(sets, 0.9)).alias("key")).groupBy("key").count()
    assert keys.agg(F.max("count")).first()[0] < 50


def test_most_complete_record_stays(spark):
    rows = [(1, "a@x.io", None, "Jonathan Doe Smithson", None), (2, "A@x.io ", None, "Jonathan Doe Smithson", "note"), (3, "a@x.io", None, "Jonathan Doe Smithson.", None), (4, "b@x.io", "1", "Someone Else", None), (5, None, None, None, None)]
    df = spark.createDataFrame([(*x, ["SQL", "python"]) for x in rows], "id long, email string, phone string, full_name string, note string, normalized_skills array<string>")
    got = {x.id: (x.group, x.copies) for x in quality.merge_similar(df, "id", ["email", "phone", "full_name", "note"], 0.9).collect()}
    assert got == {2: (1, 3), 4: (4, 1), 5: (5, 1)}
    assert quality.merge_similar(df.limit(0), "id", ["email"]).count() == 0
