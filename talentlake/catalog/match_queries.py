"""Joins, scores and rankings of candidates against criteria."""

from pyspark.sql import functions as F

from ..functions.contact import experience_years
from ..functions.text import clean_text, normalize_text, round_dp
from ..operators import joins as jn
from ..operators import matching as mt
from ..operators import quality as ql
from ..operators import skills as sk
from ..operators import overlap_topk as ot
from ..operators.topk import top_matches
from .oracle_views import skill_name, sql_list, sql_map
from .registry import query, rnd
from .skills_queries import SKILL_SETS
from .text_queries import JOB_VIEWS, PROFILE_VIEWS, _CLEAN_SQL, job_rows, norm, profile_rows, titled

SCORED = {**SKILL_SETS, "universe": f"SELECT DISTINCT {skill_name('name')} AS skill FROM {{skills}}",
          "need": f"SELECT criteria_id, id, {skill_name('skill')} AS skill, weight FROM {{criteria_skills}}", "scored": f"""
    SELECT h.criteria_id, h.candidate_id, h.matched_weight, t.total_weight, h.n_matched, t.n_required, h.matched,
           h.dot / (sqrt(u.n) * sqrt(t.square)) AS similarity,
           {rnd('h.dot / (sqrt(u.n) * sqrt(t.square)) * 100', 2)} AS score_pct,
           {rnd('h.matched_weight * 100.0 / t.total_weight', 2)} AS coverage_pct
    FROM (SELECT s.candidate_id, n.criteria_id, CAST(sum(n.weight) AS BIGINT) AS matched_weight, count(*) AS n_matched,
                 sum(CASE WHEN u.skill IS NOT NULL THEN n.weight ELSE 0 END)::DOUBLE AS dot,
                 string_agg(s.skill, ', ' ORDER BY s.skill) AS matched
          FROM {{skill_sets}} s JOIN {{need}} n USING (skill) LEFT JOIN {{universe}} u USING (skill) GROUP BY ALL) h
    JOIN (SELECT criteria_id, CAST(sum(weight) AS BIGINT) AS total_weight, count(*) AS n_required, sum(weight * weight)::DOUBLE AS square
          FROM {{need}} GROUP BY criteria_id) t USING (criteria_id)
    JOIN (SELECT candidate_id, count(*) AS n FROM {{skill_sets}} JOIN {{universe}} USING (skill) GROUP BY 1) u USING (candidate_id)""",
          "eligible": """
    SELECT * FROM {candidates} WHERE (is_fully_extracted OR quality_pct >= 80) AND full_name IS NOT NULL
    AND full_name NOT IN ('Unknown', '') AND raw_text IS NOT NULL""", "ranked": """
    SELECT s.*, e.full_name, e.created_at, row_number() OVER (PARTITION BY s.criteria_id ORDER BY s.score_pct DESC,
           e.created_at DESC, s.candidate_id) AS rank FROM {scored} s JOIN {eligible} e USING (candidate_id)"""}


def scored_pairs(t, held=None, people=None, how="inner", need=None):
    """All overlapping pairs of the skill sets ``held`` (default: those of every candidate) with the columns of ``people``."""
    held = sk.candidate_skill_set(t.candidates, t.candidate_skills) if held is None else held
    need = t.criteria_skills if need is None else need
    return mt.weighted_cosine(held, need, sk.skill_universe(t.skills, sk.dictionary(t.spark)), people, how)


def scored_for(t, criteria_id):
    """``scored_pairs`` of one criteria; no other pair is built."""
    return scored_pairs(t, need=t.criteria_skills.filter(F.col("criteria_id") == criteria_id))


def eligible_skills(t):
    """Skill sets of the candidates that take part in matching; filtering here spares all later work on the others."""
    eligible = ql.matchable(t.candidates)
    links = t.candidate_skills.join(eligible.select("candidate_id"), "candidate_id", "left_semi")
    return sk.candidate_skill_set(eligible, links)


def best_matches(t, k, criteria=None):
    """The k best eligible candidates per criteria, found with score bounds."""
    return top_matches(eligible_skills(t), ql.matchable(t.candidates), t.criteria_skills, sk.skill_universe(t.skills, sk.dictionary(t.spark)), k, criteria)


@query("j01_pairs", """
    SELECT DISTINCT candidate_id, criteria_id FROM {candidate_skills} JOIN {criteria_skills} USING (skill)""")
def _(t):
    return jn.pairs(t.candidate_skills, t.criteria_skills)


@query("j02_criteria_skill_rows", """
    SELECT criteria_id, string_agg(s.name || ':' || weight, ', ' ORDER BY weight DESC, id) AS required
    FROM {criteria_skills} c JOIN {skills} s USING (skill_id) GROUP BY criteria_id""")
def _(t):
    rows = jn.criteria_skill_rows(t.criteria_skills, t.skills)
    items = F.transform("required_skills", lambda s: F.concat_ws(":", s["name"], s["weight"].cast("string")))
    return rows.select("criteria_id", F.array_join(items, ", ").alias("required"))


@query("j03_candidate_skill_rows", """
    SELECT candidate_id, skill_id, proficiency, s.name, s.category FROM {candidate_skills} JOIN {skills} s USING (skill_id)""")
def _(t):
    return jn.candidate_skill_rows(t.candidate_skills, t.skills)


@query("j04_skill_overlap", """
    SELECT candidate_id, criteria_id, count(*) AS n_shared, CAST(sum(weight) AS BIGINT) AS weight
    FROM {candidate_skills} JOIN {criteria_skills} USING (skill) GROUP BY ALL""")
def _(t):
    return jn.shared_weights(t.candidate_skills, t.criteria_skills)


@query("j05_missing_skills", """
    SELECT p.candidate_id, p.criteria_id, n.skill
    FROM (SELECT DISTINCT candidate_id, criteria_id FROM {candidate_skills} JOIN {criteria_skills} USING (skill)) p
         JOIN {criteria_skills} n USING (criteria_id)
    WHERE NOT EXISTS (SELECT 1 FROM {candidate_skills} c WHERE c.candidate_id = p.candidate_id AND c.skill = n.skill)""")
def _(t):
    return jn.missing_skills(t.candidate_skills, t.criteria_skills)


_SHOWN = """quality_pct >= 80 AND full_name IS NOT NULL AND full_name NOT IN ('Unknown', '')
    AND regexp_matches(raw_text, '[^\\s\\p{Z}]')"""
_REAL = r"""trim(lower(trim(coalesce(full_name, ''))) || ' ' || lower(trim(coalesce(email, '')))) <> ''
    AND NOT regexp_matches(lower(coalesce(full_name, '') || ' ' || coalesce(email, '')), '\b(unknown|target\s+test|test|demo|sample|mock)\b')"""


@query("j06_shortlist", f"""
    SELECT f.id AS favorite_id, f.recruiter_id, candidate_id, c.full_name, c.email, c.quality_pct
    FROM {{favorites}} f JOIN {{candidates}} c USING (candidate_id) WHERE {_SHOWN} AND {_REAL}""".replace("p{Z}", "p{{Z}}").replace("{{Z}}", "{Z}"))
def _(t):
    return jn.shortlist(t.favorites, t.candidates).select(
        "favorite_id", "recruiter_id", "candidate_id", "full_name", "email", "quality_pct")


@query("j07_with_scores", """
    SELECT c.candidate_id, c.full_name, coalesce(s.score_pct, 0.0) AS score_pct FROM {candidates} c
    LEFT JOIN (SELECT candidate_id, score_pct FROM {scored} WHERE criteria_id = (
        SELECT criteria_id FROM {job_criteria} ORDER BY created_at DESC, criteria_id LIMIT 1)) s USING (candidate_id)""", SCORED)
def _(t):
    from ..operators.reports import latest_criteria

    latest = latest_criteria(t.job_criteria).select("criteria_id").scalar()
    return jn.with_scores(t.candidates, scored_for(t, latest), latest).select("candidate_id", "full_name", "score_pct")


@query("j08_results_with_names", """
    SELECT s.criteria_id, s.candidate_id, s.score_pct, coalesce(c.full_name, 'Unknown') AS candidate_name,
           coalesce(c.email, '') AS candidate_email
    FROM {scored} s LEFT JOIN (SELECT * FROM {candidates} WHERE quality_pct > 0) c USING (candidate_id)""", SCORED)
def _(t):
    names = t.candidates.filter("quality_pct > 0").select("candidate_id", "full_name", "email")
    return jn.named_results(scored_pairs(t, people=names, how="left").select("criteria_id", "candidate_id", "score_pct", "full_name", "email"))


@query("j09_link_orphans", """
    SELECT candidate_id, coalesce(c.user_id, u.user_id) AS user_id FROM {candidates} c
    LEFT JOIN (SELECT lower(replace(c_name, '#', '')) || '@example.com' AS email, c_custkey + 500000 AS user_id FROM customer) u
    ON c.user_id IS NULL AND u.email = c.email""")
def _(t):
    users = t.customer.select(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@example.com")).alias("email"),
                              (F.col("c_custkey") + 500000).alias("user_id"))
    return jn.link_orphans(t.candidates, users).select("candidate_id", "user_id")


@query("j10_join_ci", """
    SELECT p.p_partkey, s.skill_id FROM part p JOIN {skills} s ON lower(s.name) = lower(upper(p.p_name))""")
def _(t):
    left = t.part.select("p_partkey", F.upper("p_name").alias("raw_name"))
    return jn.join_ci(left, t.skills, "raw_name", "name").select("p_partkey", "skill_id")


@query("j11_contains_join", """
    SELECT conv_id, turn, word FROM conversations JOIN (
        SELECT DISTINCT regexp_extract(lower(text), '^[a-z]+') AS word FROM benchmark) ON contains(lower(text), word)
    WHERE word <> '' UNION ALL
    SELECT cv_id, NULL, name FROM {cv_texts} JOIN {skills} ON contains(lower(text), lower(name))""")
def _(t):
    words = t.benchmark.select(F.regexp_extract(F.lower("text"), "^[a-z]+", 0).alias("word")).filter("word <> ''")
    said = jn.contains_join(t.conversations.select("conv_id", "turn", "text"), words, "text", "word")
    held = jn.contains_join(t.cv_texts, t.skills, "text", "name").select(
        F.col("cv_id").alias("conv_id"), F.lit(None).cast("bigint").alias("turn"), F.col("name").alias("word"))
    return said.select("conv_id", "turn", "word").unionByName(held)


_SIMILAR = {"sims": """
    SELECT q.vec_id AS query_id, c.vec_id AS item_id, greatest(0.0, least(1.0, round(list_cosine_similarity(
           CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6))) AS similarity
    FROM embeddings q JOIN embeddings c ON q.vec_id % 10 = 0 AND c.vec_id <> q.vec_id"""}


def queries_and_corpus(t):
    """The query set, ids divisible by 10, and all rows; a query's own row is left out by the search."""
    v = t.embeddings.select("vec_id", F.col("embedding").alias("vector"))
    return v.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "item_id")


@query("j12_top_k_similar", """
    SELECT query_id, item_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY similarity DESC, item_id) AS rank FROM {sims}) WHERE rank <= 5""", _SIMILAR)
def _(t):
    return jn.top_k_similar(*queries_and_corpus(t), 5, skip_same=True)


@query("j13_nearest_join", """
    SELECT query_id, item_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY similarity DESC, item_id) AS rank FROM {sims}) WHERE rank = 1 AND similarity >= 0.30""", _SIMILAR)
def _(t):
    return jn.nearest_join(*queries_and_corpus(t), 0.30, skip_same=True)


@query("j14_exists_semi", """
    SELECT 'child' AS kind, id FROM {favorites} WHERE candidate_id IN (SELECT candidate_id FROM {candidates} WHERE quality_pct >= 80)
    UNION ALL SELECT 'orphan', id FROM {favorites} f WHERE NOT EXISTS (
        SELECT 1 FROM {candidates} c WHERE c.candidate_id = f.candidate_id AND quality_pct >= 80)""")
def _(t):
    good = t.candidates.filter("quality_pct >= 80")
    kept = jn.exists_semi(t.favorites, good, "candidate_id").select(F.lit("child").alias("kind"), "id")
    lost = jn.missing_parent(t.favorites, good, "candidate_id").select(F.lit("orphan").alias("kind"), "id")
    return kept.unionByName(lost)


@query("k13_canonicalise_by_embedding", """
    SELECT owner, name, max(sim) AS similarity FROM (
        SELECT q.label AS owner, CASE WHEN b.similarity >= 0.30 THEN 'canon ' || b.item_id ELSE 'raw ' || q.vec_id END AS name,
               CASE WHEN b.similarity >= 0.30 THEN b.similarity END AS sim
        FROM embeddings q JOIN (SELECT query_id, item_id, similarity FROM (SELECT *, row_number() OVER (
            PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM {sims}) WHERE rank = 1) b ON b.query_id = q.vec_id)
    GROUP BY owner, name""", _SIMILAR)
def _(t):
    queries, corpus = queries_and_corpus(t)
    raw = t.embeddings.filter("vec_id % 10 = 0").select(
        F.col("label").alias("owner"), F.col("vec_id").alias("query_id"), F.concat(F.lit("raw "), "vec_id").alias("name"))
    nearest = jn.nearest_join(queries, corpus, 0.30, skip_same=True).withColumn("canonical", F.concat(F.lit("canon "), "item_id"))
    return sk.canonicalise_by_embedding(raw, nearest, "owner")


@query("m01_clamp_weight", """
    SELECT event_id, greatest(0, least(100, coalesce(TRY_CAST(CASE WHEN regexp_full_match(w, '-?[0-9]+') THEN w END AS INTEGER), 0))) AS weight
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 300 - 50 AS VARCHAR) WHEN 1 THEN event_type
          WHEN 2 THEN CAST(event_id % 90 AS VARCHAR) END AS w FROM events)""")
def _(t):
    raw = F.expr("""CASE event_id % 4 WHEN 0 THEN cast(event_id % 300 - 50 AS string) WHEN 1 THEN event_type
        WHEN 2 THEN cast(event_id % 90 AS string) END""")
    return t.events.select("event_id", mt.clamp_weight(raw).alias("weight"))


@query("m02_weighted_cosine", f"""
    SELECT criteria_id, candidate_id, {rnd('similarity', 4)} AS similarity, score_pct FROM {{scored}}""", SCORED)
def _(t):
    return scored_pairs(t).select("criteria_id", "candidate_id", round_dp(F.col("similarity"), 4).alias("similarity"), "score_pct")


def _plain_scored() -> str:
    return f"""
    SELECT h.criteria_id, h.candidate_id, {rnd('h.dot / (sqrt(u.n) * sqrt(t.square)) * 100', 4)} AS score_pct,
           {rnd('h.n * 100.0 / t.n', 4)} AS matching_pct
    FROM (SELECT candidate_id, criteria_id, sum(weight)::DOUBLE AS dot, count(*) AS n FROM {{candidate_skills}}
          JOIN {{criteria_skills}} USING (skill) GROUP BY ALL) h
    JOIN (SELECT criteria_id, sum(weight * weight)::DOUBLE AS square, count(*) AS n FROM {{criteria_skills}} GROUP BY 1) t USING (criteria_id)
    JOIN (SELECT candidate_id, count(*) AS n FROM {{candidate_skills}} GROUP BY 1) u USING (candidate_id)"""


@query("m03_cosine_scorer", _plain_scored())
def _(t):
    scored = mt.cosine_scorer(t.candidate_skills, t.criteria_skills, t.skills)
    return scored.select("criteria_id", "candidate_id", round_dp(F.col("score_pct"), 4).alias("score_pct"),
                         round_dp(F.col("matching_pct"), 4).alias("matching_pct"))


@query("m04_pair_cosine", _plain_scored())
def _(t):
    scored = mt.pair_cosine(t.candidate_skills, t.criteria_skills)
    return scored.select("criteria_id", "candidate_id", round_dp(F.col("score_pct"), 4).alias("score_pct"),
                         round_dp(F.col("matching_pct"), 4).alias("matching_pct"))


@query("m05_weighted_coverage", "SELECT criteria_id, candidate_id, matched_weight, total_weight, coverage_pct FROM {scored}", SCORED)
def _(t):
    return scored_pairs(t).select("criteria_id", "candidate_id", "matched_weight", "total_weight", "coverage_pct")


@query("m06_count_coverage", f"""
    SELECT criteria_id, candidate_id, {rnd('n_matched * 100.0 / n_required', 1)} AS coverage_1, {rnd('n_matched * 100.0 / n_required', 2)} AS coverage_2
    FROM {{scored}}""", SCORED)
def _(t):
    share = lambda d: mt.count_coverage(F.col("n_matched"), F.col("n_required"), d)
    return scored_pairs(t).select("criteria_id", "candidate_id", share(1).alias("coverage_1"), share(2).alias("coverage_2"))


_BREAK = {**SCORED, "breakdown": f"""
    SELECT s.criteria_id, s.candidate_id, s.score_pct, s.total_weight, n.skill, n.weight, h.skill IS NOT NULL AS present
    FROM {{scored}} s JOIN {{need}} n USING (criteria_id)
         LEFT JOIN {{skill_sets}} h ON h.candidate_id = s.candidate_id AND h.skill = n.skill"""}


def named_need(t):
    from ..functions.skillnames import normalize_skill_name

    return t.criteria_skills.select("criteria_id", normalize_skill_name("skill").alias("skill"), "weight")


@query("m07_skill_breakdown", """
    SELECT criteria_id, candidate_id, string_agg(skill || ':' || weight || ':' || CASE WHEN present THEN 'yes' ELSE 'no' END, ', '
           ORDER BY weight DESC, skill) AS breakdown FROM {breakdown} GROUP BY 1, 2""", _BREAK)
def _(t):
    rows = mt.skill_breakdown(scored_pairs(t), named_need(t))
    items = F.transform("skill_breakdown", lambda r: F.concat_ws(
        ":", r["skill"], r["weight"].cast("string"), F.when(r["present"], "yes").otherwise("no")))
    return rows.select("criteria_id", "candidate_id", F.array_join(items, ", ").alias("breakdown"))


@query("m08_contributions", f"""
    SELECT criteria_id, candidate_id, skill, {rnd('CASE WHEN present THEN weight * score_pct / total_weight ELSE 0 END', 2)} AS contribution
    FROM {{breakdown}}""", _BREAK)
def _(t):
    rows = mt.contributions(scored_pairs(t), named_need(t))
    return rows.select("criteria_id", "candidate_id", F.inline("skill_breakdown")).select(
        "criteria_id", "candidate_id", "skill", "contribution")


# Pairs of a candidate and a criteria that share a skill, with skill arrays, years and education levels.
PAIR_VIEWS = {**PROFILE_VIEWS, **JOB_VIEWS, "pair_rows": """
    SELECT p.candidate_id, p.criteria_id, c.skills AS cv_skills, j.skills AS job_skills,
           coalesce(TRY_CAST(regexp_extract(coalesce(c.raw_text, ''), '(?i)(\\d{1,2})\\+?\\s*(?:years|ans|yrs|year)', 1) AS INTEGER), 0) AS cv_years,
           j.years AS job_years, CAST(p.candidate_id % 5 AS INTEGER) AS cv_edu, CAST(p.criteria_id % 5 AS INTEGER) AS job_edu,
           CAST((p.candidate_id * 7 + p.criteria_id * 3) % 101 AS DOUBLE) / 100 AS similarity,
           c.full_name, c.raw_text, j.title, j.description
    FROM (SELECT DISTINCT candidate_id, criteria_id FROM {candidate_skills} JOIN {criteria_skills} USING (skill)) p
    JOIN {profile_rows} c USING (candidate_id) JOIN {job_rows} j USING (criteria_id)""", "business": """
    SELECT *, len(list_intersect(list_distinct(cv_skills), list_distinct(job_skills))) AS met, len(list_distinct(job_skills)) AS wanted,
           least(1.0, greatest(0.0, CASE WHEN len(job_skills) > 0 THEN 0.5 * met / wanted ELSE 0.5 END + similarity * 0.2
           + CASE WHEN job_years <= 0 OR cv_years >= job_years THEN 0.15 ELSE greatest(0, 0.15 * (1 - (job_years - cv_years) / job_years::DOUBLE)) END
           + CASE WHEN job_edu <= 0 OR cv_edu >= job_edu THEN 0.10 ELSE greatest(0, 0.10 * (1 - (job_edu - cv_edu) / job_edu::DOUBLE)) END
           + CASE WHEN met = wanted AND cv_years >= job_years THEN 0.05 ELSE 0 END)) AS score_01 FROM {pair_rows}"""}


def pair_rows(t, texts=True, more=None):
    """Pairs that share a skill with the columns of both sides, those of ``more`` included. What depends on one side alone is
    made before the pairs; without ``texts`` they carry no text."""
    text, job_text = (["raw_text"], ["title", "description"]) if texts else ([], [])
    distinct = lambda c: F.array_distinct(F.transform(c, F.lower))
    people = profile_rows(t).select("candidate_id", "full_name", *text, F.col("skills").alias("cv_skills"), distinct("skills").alias("cv_set"),
                                    experience_years("raw_text").alias("cv_years"))
    jobs = job_rows(t).select("criteria_id", *job_text, F.col("required_skills").alias("job_skills"), distinct("required_skills").alias("job_set"),
                              F.col("required_years").alias("job_years"))
    people = people if more is None else people.join(more, "candidate_id")
    return jn.pairs(t.candidate_skills, t.criteria_skills, people, jobs).withColumns({
        "shared_set": F.filter("job_set", lambda s: F.array_contains("cv_set", s)),
        "cv_edu": F.expr("cast(candidate_id % 5 as int)"), "job_edu": F.expr("cast(criteria_id % 5 as int)"),
        "similarity": F.expr("cast((candidate_id * 7 + criteria_id * 3) % 101 as double) / 100")})


@query("m09_business_score", f"SELECT candidate_id, criteria_id, {rnd('score_01', 4)} AS score_01 FROM {{business}}", PAIR_VIEWS)
def _(t):
    return mt.business_score(pair_rows(t, texts=False)).select("candidate_id", "criteria_id", round_dp(F.col("score_01"), 4).alias("score_01"))


_HEURISTIC = {**PAIR_VIEWS, "heuristic": """
    SELECT *, least(1.0, CASE WHEN len(job_skills) > 0 THEN 0.5 * met / wanted ELSE 0.5 END
           + 0.2 * met / greatest(1, len(list_distinct(cv_skills || job_skills)))
           + CASE WHEN job_years <= 0 OR cv_years >= job_years THEN 0.15 ELSE greatest(0, 0.15 * (1 - (job_years - cv_years) / job_years::DOUBLE)) END
           + 0.10 + CASE WHEN met = wanted AND cv_years >= job_years THEN 0.05 ELSE 0 END) AS h_score FROM {business}"""}


@query("m10_heuristic_label", f"""
    SELECT candidate_id, criteria_id, {rnd('h_score', 4)} AS heuristic_score, CASE WHEN round(h_score, 9) >= 0.60 THEN 1 ELSE 0 END AS label
    FROM {{heuristic}}""", _HEURISTIC)
def _(t):
    return mt.heuristic_label(pair_rows(t, texts=False)).select(
        "candidate_id", "criteria_id", round_dp(F.col("heuristic_score"), 4).alias("heuristic_score"), "label")


@query("m11_simple_label", """
    SELECT candidate_id, criteria_id, CASE WHEN len(list_filter(cv_skills, lambda s: contains(lower(title || ' ' || coalesce(description, '')), s))) > 0
           THEN 1 ELSE 0 END AS label FROM {pair_rows}""", PAIR_VIEWS)
def _(t):
    pairs = pair_rows(t).withColumn("job_text", F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))))
    return mt.simple_label(pairs).select("candidate_id", "criteria_id", "label")


# Criteria skills are the vectors of the query set, each label is one criteria; the items are grouped into candidates.
_SEMANTIC = {**_SIMILAR, "sem_need": """
    SELECT label AS criteria_id, 's' || vec_id AS skill, vec_id % 50 + 1 AS weight FROM embeddings WHERE vec_id % 10 = 0""",
    "sem_best": """
    SELECT q.label AS criteria_id, i.vec_id % 20 AS candidate_id, 's' || q.vec_id AS skill, max(similarity) AS similarity
    FROM {sims} s JOIN embeddings q ON q.vec_id = s.query_id JOIN embeddings i ON i.vec_id = s.item_id GROUP BY ALL"""}


@query("m12_semantic_match", f"""
    SELECT criteria_id, candidate_id, count(*) AS total_matches, {rnd('sum(n.weight) * 100.0 / max(t.total)', 2)} AS score_pct
    FROM {{sem_best}} b JOIN {{sem_need}} n USING (criteria_id, skill)
         JOIN (SELECT criteria_id, sum(weight) AS total FROM {{sem_need}} GROUP BY 1) t USING (criteria_id)
    WHERE b.similarity >= 0.25 GROUP BY criteria_id, candidate_id""", _SEMANTIC)
def _(t):
    needs = t.embeddings.filter("vec_id % 10 = 0").select(
        F.col("label").alias("criteria_id"), F.concat(F.lit("s"), "vec_id").alias("skill"),
        F.expr("vec_id % 50 + 1").alias("weight"), F.col("vec_id").alias("query_id"))
    queries, corpus = queries_and_corpus(t)
    best = jn.best_per_owner(queries, corpus.withColumn("owner", F.expr("item_id % 20")), "owner", 0.25, skip_same=True)
    nearest = best.join(needs.select("query_id", "criteria_id", "skill"), "query_id").withColumnRenamed("owner", "candidate_id")
    return mt.semantic_match(nearest, needs, 0.25).select(
        "criteria_id", "candidate_id", "total_matches", round_dp(F.col("score_pct"), 2).alias("score_pct"))


# Every eligible candidate with every criteria, skill-sharing or not; only the checking engine builds these pairs.
_EVERY_PAIR = {**PAIR_VIEWS, "eligible": SCORED["eligible"], "pair_rows": PAIR_VIEWS["pair_rows"].replace(
    "(SELECT DISTINCT candidate_id, criteria_id FROM {candidate_skills} JOIN {criteria_skills} USING (skill))",
    "(SELECT candidate_id, criteria_id FROM {eligible} CROSS JOIN {job_criteria})")}
_EVERY_HEURISTIC = {**_HEURISTIC, **_EVERY_PAIR}


def people_and_jobs(t, numbers, job_numbers):
    """Eligible candidates and criteria with their distinct lower-case skills and the given numbers."""
    distinct = lambda c: F.array_distinct(F.transform(c, F.lower)).alias("items")
    eligible = ql.matchable(t.candidates).select("candidate_id", "quality_pct")
    people = profile_rows(t).join(eligible, "candidate_id").withColumn("cv_years", experience_years("raw_text"))
    as_numbers = lambda columns: F.array(*[F.coalesce(F.expr(c).cast("double"), F.lit(0.0)) for c in columns]).alias("numbers")
    return people.select("candidate_id", distinct("skills"), as_numbers(numbers)), job_rows(t).select("criteria_id", distinct("required_skills"), as_numbers(job_numbers))


@query("m09_top_business", f"""
    SELECT criteria_id, candidate_id, score_01, rank FROM (SELECT *, row_number() OVER (PARTITION BY criteria_id ORDER BY score_01 DESC, candidate_id) AS rank
        FROM (SELECT criteria_id, candidate_id, {rnd('score_01', 6)} AS score_01 FROM {{business}})) WHERE rank <= 20""", _EVERY_PAIR)
def _(t):
    sides = people_and_jobs(t, ["cv_years", "candidate_id % 5", "candidate_id % 101"], ["required_years", "criteria_id % 5", "criteria_id % 101"])
    return ot.top_by_overlap(*sides, 20, ot.business_scores).withColumnRenamed("score", "score_01")


@query("m10_top_heuristic", f"""
    SELECT criteria_id, candidate_id, heuristic_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY criteria_id ORDER BY heuristic_score DESC, candidate_id) AS rank
        FROM (SELECT criteria_id, candidate_id, {rnd('h_score', 6)} AS heuristic_score FROM {{heuristic}})) WHERE rank <= 20""", _EVERY_HEURISTIC)
def _(t):
    sides = people_and_jobs(t, ["cv_years", "size(array_distinct(skills))"], ["required_years"])
    return ot.top_by_overlap(*sides, 20, ot.heuristic_scores).withColumnRenamed("score", "heuristic_score")


FALLBACK = {"fallback": f"""
    SELECT criteria_id, candidate_id, score_pct, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY criteria_id ORDER BY score_pct DESC, created_at DESC, candidate_id) AS rank FROM (
            SELECT j.criteria_id, c.candidate_id, c.created_at, {rnd("coalesce((SELECT sum(n.weight) FROM {criteria_skills} n JOIN {candidate_skills} h USING (skill) WHERE n.criteria_id = j.criteria_id AND h.candidate_id = c.candidate_id), 0) * 100.0 / (SELECT sum(weight) FROM {criteria_skills} w WHERE w.criteria_id = j.criteria_id)", 2)} AS score_pct
            FROM {{job_criteria}} j, (SELECT * FROM {{candidates}} ORDER BY created_at DESC, candidate_id LIMIT 20) c)) WHERE rank <= 10"""}


@query("m13_fallback_top", "SELECT * FROM {fallback}", FALLBACK)
def _(t):
    return mt.fallback_top(t.candidates, t.candidate_skills, t.job_criteria, t.criteria_skills).select(
        "criteria_id", "candidate_id", "score_pct", "rank")


@query("m14_component_score", f"""
    SELECT candidate_id, criteria_id, experience_score, company_score, {rnd("least(100.0, (share * 0.5 + experience_score * 0.25 + company_score * 0.15) * (1 + coalesce(quality_pct, 0) / 100 * 0.15))", 4)} AS final_score
    FROM (SELECT p.candidate_id, p.criteria_id, 100.0 * len(list_intersect(p.cv_skills, p.job_skills)) / len(p.job_skills) AS share,
        CASE WHEN regexp_matches(lower(array_to_string(r.titles, ' ')), 'senior|lead|principal|architect') THEN 90.0::DOUBLE ELSE 60.0::DOUBLE END AS experience_score,
        least(100.0::DOUBLE, len(list_filter(r.companies, lambda c: contains(lower(c), 'works') OR contains(lower(c), 'bank'))) / 2.0::DOUBLE * 100 + 50) AS company_score,
        d.quality_pct FROM {{pair_rows}} p JOIN {{profile_rows}} r USING (candidate_id) JOIN {{candidates}} d USING (candidate_id))""", PAIR_VIEWS)
def _(t):
    parts = mt.component_parts(profile_rows(t).select("candidate_id", "companies", "job_titles", F.array(F.lit("Works"), F.lit("Bank")).alias("preferred_companies")))
    more = parts.select("candidate_id", "experience_score", "company_score").join(t.candidates.select("candidate_id", "quality_pct"), "candidate_id")
    rows = pair_rows(t, False, more).withColumn("skill_share_pct", F.size(F.array_intersect("cv_skills", "job_skills")) / F.size("job_skills") * 100)
    return mt.component_score(rows).select("candidate_id", "criteria_id", "experience_score", "company_score",
                                           round_dp(F.col("final_score"), 4).alias("final_score"))


@query("m14_top_components", f"""
    SELECT criteria_id, candidate_id, final_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY criteria_id ORDER BY final_score DESC, candidate_id) AS rank FROM (
        SELECT criteria_id, candidate_id, {rnd("least(100.0, (share * 0.5 + experience_score * 0.25 + company_score * 0.15) * (1 + coalesce(quality_pct, 0) / 100 * 0.15))", 6)} AS final_score
        FROM (SELECT p.candidate_id, p.criteria_id, 100.0 * len(list_intersect(p.cv_skills, p.job_skills)) / len(p.job_skills) AS share,
            CASE WHEN regexp_matches(lower(array_to_string(r.titles, ' ')), 'senior|lead|principal|architect') THEN 90.0::DOUBLE ELSE 60.0::DOUBLE END AS experience_score,
            least(100.0::DOUBLE, len(list_filter(r.companies, lambda c: contains(lower(c), 'works') OR contains(lower(c), 'bank'))) / 2.0::DOUBLE * 100 + 50) AS company_score,
            d.quality_pct FROM {{pair_rows}} p JOIN {{profile_rows}} r USING (candidate_id) JOIN {{candidates}} d USING (candidate_id)))) WHERE rank <= 20""", _EVERY_PAIR)
def _(t):
    scores = mt.component_score(profile_rows(t).select(
        "candidate_id", "companies", "job_titles", F.lit(0.0).alias("skill_share_pct"), F.lit(0.0).alias("quality_pct"),
        F.array(F.lit("Works"), F.lit("Bank")).alias("preferred_companies"))).select("candidate_id", "experience_score", "company_score")
    people, jobs = people_and_jobs(t, ["quality_pct"], ["0"])
    numbers = F.array("experience_score", F.col("company_score").cast("double"), F.get("numbers", F.lit(0)))
    return ot.top_by_overlap(people.join(scores, "candidate_id").withColumn("numbers", numbers), jobs, 20, ot.component_scores).withColumnRenamed("score", "final_score")


@query("m15_blended_score", f"""
    SELECT candidate_id, criteria_id, {rnd('n / greatest(1, m)::DOUBLE', 4)} AS coverage_01,
           {rnd('(0.25 * similarity + 0.75 * n / greatest(1, m)::DOUBLE) * 100', 4)} AS blended_pct FROM (
        SELECT candidate_id, criteria_id, similarity, len(list_intersect(a, b)) AS n, len(b) AS m FROM (
            SELECT candidate_id, criteria_id, similarity, list_distinct(list_filter(string_split(lower({norm('raw_text')}), ' '), lambda s: s <> '')) AS a,
                   list_distinct(list_filter(string_split(lower({norm("title || ' with ' || coalesce(description, '')")}), ' '), lambda s: s <> '')) AS b FROM {{pair_rows}}))""", PAIR_VIEWS)
def _(t):
    rows = pair_rows(t).select("candidate_id", "criteria_id", F.col("similarity").alias("probability"), F.col("raw_text").alias("cv_text"),
                               F.concat("title", F.lit(" with "), F.coalesce("description", F.lit(""))).alias("job_text"))
    return mt.blended_score(rows).select("candidate_id", "criteria_id", round_dp(F.col("coverage_01"), 4).alias("coverage_01"),
                                         round_dp(F.col("blended_pct"), 4).alias("blended_pct"))


@query("m16_rank_all", "SELECT criteria_id, candidate_id, score_pct, coverage_pct, rank FROM {ranked}", SCORED)
def _(t):
    scored = scored_pairs(t, eligible_skills(t)).drop("matched_skills")
    return mt.rank_all(scored, t.candidates).select("criteria_id", "candidate_id", "score_pct", "coverage_pct", "rank")


@query("m16_rank_top_10", """
    SELECT criteria_id, candidate_id, full_name, score_pct, coverage_pct, matched, rank,
           CASE WHEN score_pct >= 80 THEN 'accepted' WHEN score_pct >= 50 THEN 'to_review' ELSE 'rejected' END AS decision
    FROM {ranked_fully} WHERE rank <= 10""", {**SCORED, "ranked_fully": """
    SELECT *, row_number() OVER (PARTITION BY criteria_id ORDER BY score_pct DESC, created_at DESC, candidate_id) AS rank
    FROM (SELECT j.criteria_id, e.candidate_id, e.full_name, e.created_at, coalesce(s.score_pct, 0) AS score_pct,
                 coalesce(s.coverage_pct, 0) AS coverage_pct, coalesce(s.matched, '') AS matched
          FROM (SELECT criteria_id FROM {job_criteria}) j CROSS JOIN {eligible} e
          LEFT JOIN {scored} s ON s.criteria_id = j.criteria_id AND s.candidate_id = e.candidate_id)"""})
def flagship(t):
    from ..operators.decisions import decide

    top = best_matches(t, 10, t.job_criteria)
    return top.select("criteria_id", "candidate_id", "full_name", "score_pct", "coverage_pct",
                      F.array_join("matched_skills", ", ").alias("matched"), "rank", decide(F.col("score_pct") / 100).alias("decision"))


# The 20 best per criteria with the measures of m02 to m08, computed for these pairs only.
@query("m16_top_scores", f"""
    SELECT criteria_id, candidate_id, rank, {rnd('similarity', 4)} AS similarity, score_pct, matched_weight, total_weight, coverage_pct,
           {rnd('n_matched * 100.0 / n_required', 1)} AS matching_pct FROM {{ranked}} WHERE rank <= 20""", SCORED)
def _(t):
    return best_matches(t, 20).select(
        "criteria_id", "candidate_id", "rank", round_dp(F.col("similarity"), 4).alias("similarity"), "score_pct", "matched_weight", "total_weight",
        "coverage_pct", mt.count_coverage(F.col("n_matched"), F.col("n_required"), 1).alias("matching_pct"))


@query("m16_top_contributions", f"""
    SELECT b.criteria_id, b.candidate_id, rank, skill, weight, {rnd('CASE WHEN present THEN weight * b.score_pct / b.total_weight ELSE 0 END', 2)} AS contribution
    FROM {{breakdown}} b JOIN {{ranked}} r ON r.criteria_id = b.criteria_id AND r.candidate_id = b.candidate_id WHERE rank <= 20""", _BREAK)
def _(t):
    rows = mt.contributions(best_matches(t, 20), named_need(t))
    return rows.select("criteria_id", "candidate_id", "rank", F.inline("skill_breakdown")).drop("present")


def _word_hits(words) -> str:
    return f"list_filter({sql_list(words)}, lambda w: regexp_matches(low, '\\b' || w || '\\b'))"


def _ladder(words: dict[str, str], default: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN contains(low, '{w}') THEN {quote(v)}" for w, v in words.items()) + f" ELSE {quote(default)} END"


IDEAL = {**JOB_VIEWS, "job_texts": f"""
    SELECT kind || id AS job_id, lower({_CLEAN_SQL}) AS low FROM (
        SELECT 'c' AS kind, criteria_id AS id, title || '. ' || coalesce(description, '') AS text FROM {{job_criteria}}
        UNION ALL SELECT 'b', item_id, text FROM benchmark)""", "ideal": f"""
    SELECT job_id, CASE WHEN len(tech) + len(soft) > 0 THEN tech || soft ELSE ['communication', 'problem solving', 'teamwork'] END AS names, tech, level, years, education, languages, industries
    FROM (SELECT job_id, {_word_hits(mt.IDEAL_TECH)} AS tech, {_word_hits(mt.IDEAL_SOFT)} AS soft,
        CASE WHEN regexp_matches(low, 'senior|expert|advanced|lead') THEN 'Advanced' WHEN regexp_matches(low, 'junior|entry|beginner') THEN 'Beginner' ELSE 'Intermediate' END AS level,
        coalesce(TRY_CAST(regexp_extract(low, '([0-9]{{1,2}})\\s*\\+?\\s*(?:years|yrs|ans)', 1) AS INTEGER),
            CASE WHEN regexp_matches(low, 'senior|lead') THEN 5 WHEN regexp_matches(low, 'mid-level|mid level') THEN 3 WHEN contains(low, 'junior') THEN 1 ELSE 2 END) AS years,
        {_ladder(mt.IDEAL_EDUCATION, "Bachelor's degree or equivalent")} AS education,
        array_to_string(list_transform({_word_hits(mt.IDEAL_LANGUAGES)}, lambda w: upper(w[1]) || w[2:]), ', ') AS languages,
        array_to_string(list_transform(list_filter({sql_list(mt.IDEAL_INDUSTRIES)}, lambda w: contains(low, w)), lambda w: {sql_map(mt.IDEAL_INDUSTRIES)}[w]), ', ') AS industries
        FROM {{job_texts}})""".replace("{{1,2}}", "{1,2}"), "ideal_rows": f"""
    SELECT job_id, generate_subscripts(names, 1) AS pos, unnest(names) AS raw, tech, level FROM {{ideal}}"""}


def job_texts(t):
    jobs = t.job_criteria.select(F.concat(F.lit("c"), "criteria_id").alias("job_id"),
                                 F.concat("title", F.lit(". "), F.coalesce("description", F.lit(""))).alias("text"))
    return jobs.unionByName(t.benchmark.select(F.concat(F.lit("b"), "item_id").alias("job_id"), "text"))


def skills_as_text(column: str = "ideal_skills", level: bool = True):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(
        ":", s["name"], s["weight"].cast("string"), *([s["level"]] if level else []))), ", ")


@query("m18_ideal_profiles", f"""
    SELECT i.job_id, (SELECT string_agg({titled('raw')} || ':' || CASE WHEN list_contains(r.tech, raw) THEN 90 ELSE 70 END || ':' || r.level, ', ' ORDER BY pos)
        FROM {{ideal_rows}} r WHERE r.job_id = i.job_id) AS skills, years, education, languages, industries FROM {{ideal}} i""", IDEAL)
def _(t):
    return mt.ideal_profiles(job_texts(t)).select(
        "job_id", skills_as_text().alias("skills"), F.col("ideal_experience_years").alias("years"),
        F.col("ideal_education").alias("education"), F.array_join("ideal_languages", ", ").alias("languages"),
        F.array_join("industries", ", ").alias("industries"))


@query("m19_ideal_profiles_weighted", f"""
    SELECT b.criteria_id, (SELECT string_agg(name || ':' || w, ', ' ORDER BY w DESC, name) FROM (
        SELECT name, max(w) AS w FROM (SELECT criteria_id, coalesce({sql_map(mt.WEIGHTED_NAMES)}[lower(s)], s) AS name, 30 AS w
            FROM (SELECT criteria_id, unnest(skills) AS s FROM {{job_rows}})
          UNION ALL SELECT criteria_id, {sql_map(mt.WEIGHTED_NAMES)}[k], w FROM {{low_jobs}}, (VALUES {", ".join(f"('{k}', {w})" for k, w in mt.WEIGHTED_KEYWORDS.items())}) v(k, w)
            WHERE contains(low, k)) x WHERE x.criteria_id = b.criteria_id GROUP BY name)) AS skills,
      coalesce(nullif(regexp_extract(low, '(\\d{{1,2}})\\+?\\s*(?:ans|years?|yrs?)', 1), '') || '+ years', CASE WHEN regexp_matches(low, 'senior|lead|principal') THEN '5+ years' ELSE '3+ years' END) AS experience,
      CASE WHEN regexp_matches(low, 'phd|doctorat') THEN 'PhD or equivalent' WHEN regexp_matches(low, 'master|msc|m\\.sc|ingénieur|engineer') THEN 'Master''s degree' ELSE 'Bachelor''s degree' END AS education,
      coalesce(nullif(array_to_string(list_filter(['English', 'French', 'Spanish', 'German'], lambda l: contains(low, lower(l))), ', '), ''), 'English') AS languages
    FROM {{low_jobs}} b""".replace("{{1,2}}", "{1,2}"), {**JOB_VIEWS, "low_jobs": """
    SELECT criteria_id, lower(title || ' ' || coalesce(description, '') || ' ' || array_to_string(skills, ' ')) AS low FROM {job_rows}"""})
def _(t):
    return mt.ideal_profiles_weighted(job_rows(t)).select(
        "criteria_id", skills_as_text(level=False).alias("skills"), "experience", "education", F.array_join("languages", ", ").alias("languages"))


def ideal_with_fallback(t):
    jobs = job_texts(t)
    profiles = mt.ideal_profiles(jobs).withColumn(
        "ideal_skills", F.when(F.col("has_keywords"), F.col("ideal_skills")).otherwise(F.array().cast(mt._IDEAL)))
    found = sk.extract_skills(jobs, sk.dictionary(t.spark), 85, "job_id")
    return mt.ideal_skills_with_fallback(profiles, found)


@query("m20_ideal_skills_with_fallback")
def _(t):
    return ideal_with_fallback(t).select("job_id", skills_as_text().alias("skills"))


@query("m21_sanitise_profiles", f"""
    SELECT row_id, CASE WHEN trim(coalesce(raw, '')) <> '' THEN trim(raw) || ':' || CASE WHEN row_id % 4 = 0 OR row_id % 4 = 1 THEN 80 ELSE row_id % 4 * 10 END || ':' ||
               CASE WHEN row_id % 3 = 0 THEN 'Expert' ELSE 'Intermediate' END ELSE 'rule:70:Beginner' END AS skills,
           CAST(CASE WHEN row_id % 5 = 0 THEN 2 ELSE row_id % 5 END AS INTEGER) AS years,
           CASE WHEN row_id % 2 = 0 THEN 'Bachelor' ELSE 'Degree ' || row_id % 7 END AS education FROM {{raw_skills}}""")
def _(t):
    given = F.array(F.struct(F.col("raw").alias("name"), F.expr("CASE row_id % 4 WHEN 0 THEN 0 WHEN 1 THEN null ELSE cast(row_id % 4 * 10 as int) END").alias("weight"),
                             F.expr("CASE row_id % 3 WHEN 0 THEN 'Expert' WHEN 1 THEN '' END").alias("level")))
    rows = t.raw_skills.withColumns({
        "given_skills": given, "given_years": F.expr("cast(row_id % 5 as int)"),
        "given_education": F.expr("CASE WHEN row_id % 2 = 0 THEN '' ELSE concat('Degree ', row_id % 7) END"),
        "rule_skills": F.array(F.struct(F.lit("rule").alias("name"), F.lit(70).alias("weight"), F.lit("Beginner").alias("level"))),
        "rule_years": F.lit(2), "rule_education": F.lit("Bachelor")})
    return mt.sanitise_profiles(rows).select("row_id", skills_as_text().alias("skills"), F.col("ideal_experience_years").alias("years"),
                                             F.col("ideal_education").alias("education"))


@query("m22_generate_and_match", f"""
    SELECT criteria_id, candidate_id, score_pct, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY criteria_id ORDER BY score_pct DESC, created_at DESC, candidate_id) AS rank FROM (
            SELECT h.criteria_id, e.candidate_id, e.created_at, {rnd('h.dot / (sqrt(u.n) * sqrt(t.square)) * 100', 6)} AS score_pct
            FROM (SELECT candidate_id, criteria_id, sum(w)::DOUBLE AS dot FROM {{candidate_skills}} s JOIN {{wanted}} k ON lower(k.name) = lower(s.skill) GROUP BY ALL) h
            JOIN (SELECT criteria_id, sum(w * w)::DOUBLE AS square FROM {{wanted}} GROUP BY 1) t USING (criteria_id)
            JOIN (SELECT candidate_id, count(*) AS n FROM {{candidate_skills}} GROUP BY 1) u USING (candidate_id) JOIN {{eligible}} e USING (candidate_id)))
    WHERE rank <= 20""", {**SCORED, **JOB_VIEWS, "wanted": f"""
    SELECT criteria_id, name, w FROM (SELECT *, row_number() OVER (PARTITION BY criteria_id ORDER BY w DESC, name) AS rn FROM (
        SELECT criteria_id, name, max(w) AS w FROM (
            SELECT criteria_id, coalesce({sql_map(mt.WEIGHTED_NAMES)}[lower(s)], s) AS name, 30 AS w FROM (SELECT criteria_id, unnest(skills) AS s FROM {{job_rows}})
            UNION ALL SELECT criteria_id, {sql_map(mt.WEIGHTED_NAMES)}[k], w FROM {{job_rows}}, (VALUES {", ".join(f"('{k}', {w})" for k, w in mt.WEIGHTED_KEYWORDS.items())}) v(k, w)
                WHERE contains(lower(title || ' ' || coalesce(description, '') || ' ' || array_to_string(skills, ' ')), k)) GROUP BY ALL)) WHERE rn <= 10"""})
def _(t):
    jobs = mt.ideal_profiles_weighted(job_rows(t)).withColumn("job_id", F.col("criteria_id"))
    return mt.generate_and_match(jobs, ql.matchable(t.candidates), t.candidate_skills, 20).select(
        "criteria_id", "candidate_id", "score_pct", "rank")


@query("m23_match_summary", """
    SELECT s.criteria_id, s.candidate_id, n_matched || '/' || n_required || ' compétences couvertes' AS summary,
           c.full_name || ' couvre ' || n_matched || '/' || n_required || ' compétences clés (' || CAST(round(n_matched * 100.0 / n_required, 0) AS INTEGER) || '%).' AS sentence
    FROM {scored} s JOIN {candidates} c USING (candidate_id)""", SCORED)
def _(t):
    rows = scored_pairs(t, people=t.candidates.select("candidate_id", "full_name"))
    share = mt.count_coverage(F.col("n_matched"), F.col("n_required"), 1)
    return rows.select("criteria_id", "candidate_id", mt.match_summary(F.col("n_matched"), F.col("n_required")).alias("summary"),
                       mt.prediction_summary(F.col("full_name"), F.col("n_matched"), F.col("n_required"), share).alias("sentence"))


def packed(t):
    rows = mt.skill_breakdown(scored_pairs(t), named_need(t))
    missing = F.transform(F.filter("skill_breakdown", lambda r: ~r["present"]), lambda r: r["skill"])
    return mt.pack_explanation(rows.withColumns({
        "missing_skills": missing, "summary": mt.match_summary(F.col("n_matched"), F.col("n_required"))}))


@query("m24_explanation_round_trip", """
    SELECT s.criteria_id, s.candidate_id, n_matched || '/' || n_required || ' compétences couvertes' AS summary, coverage_pct, matched,
           (SELECT coalesce(string_agg(skill, ', ' ORDER BY weight DESC, skill), '') FROM {breakdown} b WHERE b.criteria_id = s.criteria_id
            AND b.candidate_id = s.candidate_id AND NOT present) AS missing
    FROM {scored} s""", _BREAK)
def _(t):
    stored = packed(t).select("criteria_id", "candidate_id", "explanation")
    return mt.unpack_explanation(stored).select(
        "criteria_id", "candidate_id", "summary", "coverage_pct", F.array_join("matched_skills", ", ").alias("matched"),
        F.array_join("missing_skills", ", ").alias("missing"))


@query("m25_pair_similarity", """
    SELECT a.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS similarity,
           similarity >= 0.25 AS is_match
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(t):
    from ..operators.features import pair_similarity

    right = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return pair_similarity(t.embeddings.join(right, "vec_id"), "embedding", "other", 0.25).select("vec_id", "similarity", "is_match")
