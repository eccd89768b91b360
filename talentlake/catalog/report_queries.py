"""Decisions, shortlists, conversation analytics, exports and table maintenance."""

from pyspark.sql import functions as F

from ..functions.text import round_dp
from ..operators import decisions as dc
from ..operators import joins as jn
from ..operators import maintenance as mn
from ..operators import matching as mt
from ..operators import quality as ql
from ..operators import reports as rp
from ..operators import skills as sk
from .match_queries import _BREAK, FALLBACK, PAIR_VIEWS, SCORED, best_matches, named_need, pair_rows, scored_for, scored_pairs
from .oracle_views import sql_list
from .registry import query, rnd
from .text_queries import json_items


@query("d01_decide", """
    SELECT pair_id, CASE WHEN score >= 0.8 THEN 'accepted' WHEN score >= 0.5 THEN 'to_review' ELSE 'rejected' END AS decision FROM {scored_pairs}""")
def _(t):
    return t.scored_pairs.select("pair_id", dc.decide(F.col("score")).alias("decision"))


@query("d02_decide_pct", """
    SELECT pair_id, CASE WHEN score * 100 >= 94.78 THEN 'accepted' WHEN score * 100 >= 89.78 THEN 'review' ELSE 'rejected' END AS decision,
           CASE WHEN score * 100 >= 60 THEN 'accepted' ELSE 'rejected' END AS swapped FROM {scored_pairs}""")
def _(t):
    pct = F.col("score") * 100
    return t.scored_pairs.select("pair_id", dc.decide_pct(pct).alias("decision"), dc.decide_pct(pct, 60.0, 70.0).alias("swapped"))


RULES = {**PAIR_VIEWS, "rules": """
    SELECT *, CASE WHEN score_01 >= 0.8 THEN 'accepted' WHEN score_01 >= 0.5 THEN 'to_review' ELSE 'rejected' END AS decision,
        met / wanted::DOUBLE AS ratio, greatest(0, job_years - cv_years) AS gap,
        list_sort(list_filter(job_skills, lambda s: NOT list_contains(cv_skills, s))) AS missing,
        list_filter(list_sort(job_skills), lambda s: list_contains(cv_skills, s)) AS matched FROM {business}"""}


def ruled(t):
    return dc.business_rules(mt.business_score(pair_rows(t, texts=False)).withColumn("score_01", F.round("score_01", 9)))


@query("d03_business_rules", f"""
    SELECT candidate_id, criteria_id, CASE WHEN round(score_01, 9) >= 0.8 THEN 'accepted' WHEN round(score_01, 9) >= 0.5 THEN 'to_review' ELSE 'rejected' END AS decision,
           {rnd('ratio', 4)} AS skill_match_ratio, gap AS experience_gap_years, array_to_string(missing, ', ') AS missing FROM {{rules}}""", RULES)
def _(t):
    return ruled(t).select("candidate_id", "criteria_id", "decision", round_dp(F.col("skill_match_ratio"), 4).alias("skill_match_ratio"),
                           "experience_gap_years", F.array_join("missing_skills", ", ").alias("missing"))


_PCT = f"printf('%.1f', {rnd('score_01 * 100', 1)}) || '%)'"


@query("d04_decision_text", f"""
    SELECT candidate_id, criteria_id, CASE WHEN round(score_01, 9) >= 0.8 THEN '✅ Strong match (score: ' || {_PCT} || '. Candidate has the required experience and skills.'
        WHEN round(score_01, 9) >= 0.5 THEN '🟠 Worth reviewing (score: ' || {_PCT} || '. Some experience or skill gaps but overall promising.'
        ELSE '❌ Not a match (score: ' || {_PCT} || '. Significant gaps in skills or experience.' END
        || CASE WHEN len(missing) > 0 THEN chr(10) || '⚠️  Missing skills: ' || array_to_string(missing[:3], ', ') ELSE '' END
        || CASE WHEN gap > 0 THEN chr(10) || '📅 Experience gap: ' || gap || ' years below requirement' ELSE '' END AS explanation FROM {{rules}}""", RULES)
def _(t):
    return dc.decision_text(ruled(t)).select("candidate_id", "criteria_id", "explanation")


def _align(mark, label, sign):
    return f"'{mark} {label} (' || printf('%.1f', cv_years::DOUBLE) || ' years {sign} ' || printf('%.1f', job_years::DOUBLE) || ' required)'"


@query("d05_explain", f"""
    SELECT candidate_id, criteria_id, {rnd('s', 2)} AS overall_score,
        CASE WHEN s >= 0.8 THEN '🟢 Strong Match' WHEN s >= 0.6 THEN '🟡 Moderate Match' ELSE '🔴 Weak Match' END AS interpretation,
        CASE WHEN g >= 2 THEN {_align('✅', 'Highly experienced', '>')} WHEN g >= 0 THEN {_align('✅', 'Meets experience requirement', '≈')}
             WHEN g > -2 THEN {_align('⚠️', 'Slightly under-experienced', '<')} ELSE {_align('❌', 'Under-experienced', '<')} END AS experience_alignment,
        CASE WHEN len(matched) >= 5 AND ratio > 0.85 THEN 'Strong technical skills alignment: ' || array_to_string(matched[:3], ', ') || ' + ' || (len(matched) - 3) || ' more'
             WHEN len(matched) > 0 THEN 'Good skills match: ' || array_to_string(matched[:2], ', ')
             WHEN similarity > 0.75 THEN 'Strong text/profile similarity with job description' ELSE 'Limited overlap between background and job requirements' END AS key_reason,
        array_to_string((CASE WHEN len(advice) > 0 THEN advice ELSE ['Strong candidate — proceed with hiring process'] END)[:2], ' / ') AS recommendations,
        array_to_string(matched, ', ') AS top_matched, array_to_string(missing, ', ') AS top_missing
    FROM (SELECT *, round(score_01, 9) AS s, cv_years - job_years AS g, list_filter([CASE WHEN len(missing) > 0 THEN 'Consider candidates with: ' || array_to_string(missing[:2], ', ') END,
        CASE WHEN cv_years - job_years < -1 THEN 'Candidate needs more industry experience' END, CASE WHEN round(score_01, 9) > 0.6 THEN 'Recommended for interview or technical assessment' END,
        CASE WHEN round(score_01, 9) < 0.5 THEN 'Better candidates may exist; consider re-posting' END], lambda x: x IS NOT NULL) AS advice FROM {{rules}})""", RULES)
def _(t):
    rows = ruled(t).withColumns({
        "matched_skills": F.array_sort(F.array_intersect("job_skills", "cv_skills")), "text_similarity": F.col("similarity"),
        "skills_match": F.col("skill_match_ratio")})
    out = dc.explain(rows)
    return out.select("candidate_id", "criteria_id", "overall_score", "interpretation", "experience_alignment", "key_reason",
                      F.array_join("recommendations", " / ").alias("recommendations"), F.array_join("top_matched", ", ").alias("top_matched"),
                      F.array_join("top_missing", ", ").alias("top_missing"))


ANALYSIS = {**PAIR_VIEWS, "analysed": f"""
    SELECT h.criteria_id, c.candidate_id, h.score, h.n AS n_matched, t.n AS n_required, u.n AS n_skills, h.n * 100.0::DOUBLE / t.n AS share, c.quality_pct,
           c.extracted_job_titles, c.extracted_companies
    FROM (SELECT candidate_id, criteria_id, sum(weight)::DOUBLE AS score, count(*) AS n FROM {{candidate_skills}} JOIN {{criteria_skills}} USING (skill) GROUP BY ALL) h
    JOIN (SELECT criteria_id, count(*) AS n FROM {{criteria_skills}} GROUP BY 1) t USING (criteria_id)
    JOIN (SELECT candidate_id, count(*) AS n FROM {{candidate_skills}} GROUP BY 1) u USING (candidate_id) JOIN {{candidates}} c USING (candidate_id)"""}


def analysed(t):
    sizes = t.candidate_skills.groupBy("candidate_id").agg(F.count("*").alias("n_skills"))
    people = t.candidates.join(sizes, "candidate_id")
    scores = mt.pair_cosine(t.candidate_skills, t.criteria_skills, people).withColumn(
        "level_score", F.expr("cast((candidate_id + criteria_id) % 10 * 10 as double)"))
    return dc.analysis(scores)


_STRONG = "array_to_string(list_filter([CASE WHEN share >= 70 THEN 'Strong skill match' END, CASE WHEN (candidate_id + criteria_id) % 10 >= 8 THEN 'High experience level' END, CASE WHEN quality_pct >= 70 THEN 'Complete data extraction' END, CASE WHEN n_skills >= 15 THEN 'Diverse skill portfolio' END], lambda x: x IS NOT NULL), ', ')"


@query("d06_strengths", f"""
    SELECT criteria_id, candidate_id, CASE WHEN {_STRONG} = '' THEN 'Potential candidate' ELSE {_STRONG} END AS strengths FROM {{analysed}}""", ANALYSIS)
def _(t):
    return analysed(t).select("criteria_id", "candidate_id", F.array_join("strengths", ", ").alias("strengths"))


@query("d07_gaps", """
    SELECT criteria_id, candidate_id, array_to_string(list_filter([CASE WHEN share < 50 THEN 'Key skills missing - consider training' END, CASE WHEN (candidate_id + criteria_id) % 10 < 5 THEN 'Less experience than required' END,
        CASE WHEN coalesce(extracted_job_titles, '') = '' THEN 'Job title extraction unavailable' END,
        CASE WHEN coalesce(extracted_companies, '') = '' THEN 'Company background extraction unavailable' END], lambda x: x IS NOT NULL), ', ') AS gaps FROM {analysed}""", ANALYSIS)
def _(t):
    return analysed(t).select("criteria_id", "candidate_id", F.array_join("gaps", ", ").alias("gaps"))


@query("d08_candidate_analysis", """
    SELECT a.criteria_id, a.candidate_id, n_matched, n_required, CAST(round(coalesce(quality_pct, 0), 0) AS INTEGER) || '%' AS data_completeness,
           s.score_pct >= 75 AS priority_match
    FROM {analysed} a JOIN (SELECT h.criteria_id, h.candidate_id, h.dot / (sqrt(u.n) * sqrt(t.square)) * 100 AS score_pct
        FROM (SELECT candidate_id, criteria_id, sum(weight)::DOUBLE AS dot FROM {candidate_skills} JOIN {criteria_skills} USING (skill) GROUP BY ALL) h
        JOIN (SELECT criteria_id, sum(weight * weight)::DOUBLE AS square FROM {criteria_skills} GROUP BY 1) t USING (criteria_id)
        JOIN (SELECT candidate_id, count(*) AS n FROM {candidate_skills} GROUP BY 1) u USING (candidate_id)) s USING (criteria_id, candidate_id)""", ANALYSIS)
def _(t):
    return analysed(t).select("criteria_id", "candidate_id", "n_matched", "n_required", "data_completeness", "priority_match")


@query("d09_recommendation", """
    SELECT pair_id, CASE WHEN score * 100 >= 85 THEN 'EXCELLENT MATCH - Primary candidate' WHEN score * 100 >= 75 THEN 'STRONG MATCH - Highly recommended'
        WHEN score * 100 >= 65 THEN 'GOOD MATCH - Consider for interview' ELSE 'LIMITED MATCH - Consider as backup' END AS advice FROM {scored_pairs}""")
def _(t):
    return t.scored_pairs.select("pair_id", dc.recommendation(F.col("score") * 100).alias("advice"))


@query("r01_shortlist_summary", """
    SELECT criteria_id, total_screened, strong, moderate, CASE WHEN total_screened = 0 THEN 'No candidates found. Consider widening search criteria.' ELSE
        CASE WHEN strong >= 3 THEN '✅ Excellent pool: ' || strong || ' strong matches. Recommend interviews for all.'
             WHEN strong >= 1 THEN '👍 Good: ' || strong || ' strong match(es) available. Start with top candidates.'
             ELSE '⚠️ Limited strong matches (' || strong || '). Consider adjusting requirements or widening search.' END
        || CASE WHEN moderate > 0 THEN ' | Consider ' || moderate || ' moderate matches for technical screening.' ELSE '' END END AS recommendations
    FROM (SELECT j.criteria_id, (SELECT count(*) FROM {candidates}) AS total_screened, count(*) FILTER (s.score_pct / 100 >= 0.8) AS strong,
          count(*) FILTER (s.score_pct / 100 >= 0.6 AND s.score_pct / 100 < 0.8) AS moderate FROM {job_criteria} j LEFT JOIN {scored} s USING (criteria_id) GROUP BY 1)""", SCORED)
def _(t):
    held = sk.candidate_skill_set(t.candidates, t.candidate_skills)
    universe = sk.skill_universe(t.skills, sk.dictionary(t.spark))
    return rp.shortlist_by_cosine(held, t.job_criteria, t.criteria_skills, universe, t.candidates, lambda: scored_pairs(t, held)).select(
        "criteria_id", "total_screened", "strong", "moderate", F.array_join("recommendations", " | ").alias("recommendations"))


@query("r02_top_skills", """
    SELECT criteria_id, skill, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY criteria_id ORDER BY n DESC, skill) AS rank FROM (
        SELECT criteria_id, skill, count(*) AS n FROM (SELECT criteria_id, unnest(string_split(matched, ', ')) AS skill FROM (
            SELECT *, row_number() OVER (PARTITION BY criteria_id ORDER BY score_pct DESC, candidate_id) AS rn FROM {scored}) WHERE rn <= 5) GROUP BY ALL)) WHERE rank <= 5""", SCORED)
def _(t):
    return rp.top_skills(scored_pairs(t))


@query("r03_explore_by_skill", """
    SELECT candidate_id, full_name, score_pct, 'scored' AS origin, 'Red Rod' AS wanted FROM (SELECT s.*, c.full_name FROM {scored} s JOIN {candidates} c USING (candidate_id)
        WHERE criteria_id = 3 AND contains(lower(concat_ws(' ', full_name, replace(matched, ', ', ' '))), 'red rod')
        AND score_pct >= 5 ORDER BY score_pct DESC, candidate_id LIMIT 10)
    UNION ALL SELECT candidate_id, full_name, NULL, 'stored', 'BUILDING' FROM (SELECT * FROM {candidates} WHERE contains(lower(raw_text), 'building')
        ORDER BY created_at DESC, candidate_id LIMIT 10)""", SCORED)
def _(t):
    top = scored_for(t, 3).join(t.candidates.select("candidate_id", "full_name"), "candidate_id")
    scored = rp.explore_by_skill("Red Rod", top, t.candidates, t.candidate_skills, 5.0).withColumn("wanted", F.lit("Red Rod"))
    stored = rp.explore_by_skill("BUILDING", top, t.candidates, t.candidate_skills).withColumn("wanted", F.lit("BUILDING"))
    return scored.unionByName(stored)


# Recruiter messages: the words of a conversation plus a request that depends on its id.
MESSAGES = {"messages": """
    SELECT conv_id * 1000 + turn AS message_id, conv_id, role, CASE (conv_id + turn) % 6
        WHEN 0 THEN 'Pourquoi ce score pour Customer#000000' || lpad(CAST(conv_id % 900 AS VARCHAR), 3, '0') || ' ? ' || text
        WHEN 1 THEN 'Compare les candidats au-dessus de ' || (conv_id % 130) || ' % ' || text
        WHEN 2 THEN 'augmente le poids de small ring ' || text WHEN 3 THEN 'baisse RED WIDGET à ' || (conv_id % 80) || ' % ' || text
        WHEN 4 THEN 'decrease old anvil please ' || text ELSE text END AS text FROM conversations"""}


def messages(t):
    body = F.expr("""CASE (conv_id + turn) % 6
        WHEN 0 THEN concat('Pourquoi ce score pour Customer#000000', lpad(cast(conv_id % 900 AS string), 3, '0'), ' ? ', text)
        WHEN 1 THEN concat('Compare les candidats au-dessus de ', conv_id % 130, ' % ', text)
        WHEN 2 THEN concat('augmente le poids de small ring ', text) WHEN 3 THEN concat('baisse RED WIDGET à ', conv_id % 80, ' % ', text)
        WHEN 4 THEN concat('decrease old anvil please ', text) ELSE text END""")
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "conv_id", "role", body.alias("text"))


@query("r04_min_score", r"""
    SELECT message_id, greatest(0, least(100, TRY_CAST(nullif(regexp_extract(lower(text), '(?:au[-\s]?dessus de|sup[eé]rieur [aà]|>=?|plus de)\s*(\d{1,3})\s*%?', 1), '') AS INTEGER))) AS minimum
    FROM {messages} WHERE regexp_matches(lower(text), '(?:au[-\s]?dessus de|sup[eé]rieur [aà]|>=?|plus de)\s*(\d{1,3})')""", MESSAGES)
def _(t):
    return messages(t).select("message_id", rp.min_score(F.col("text")).alias("minimum")).filter("minimum IS NOT NULL")


@query("r05_search_candidates", """
    SELECT candidate_id FROM {candidates} WHERE contains(lower(full_name), '12') OR contains(lower(email), '12') OR contains(lower(coalesce(extracted_job_titles, '')), '12')
    UNION ALL SELECT candidate_id + 1000000 FROM {candidates} WHERE contains(lower(extracted_job_titles), 'analyst')""")
def _(t):
    first = rp.search_candidates(t.candidates, "12").select("candidate_id")
    return first.unionByName(rp.search_candidates(t.candidates, "ANALYST").select((F.col("candidate_id") + 1000000).alias("candidate_id")))


@query("r06_suggest_skills", """
    SELECT name, category FROM {skills} WHERE contains(lower(name), 'red') AND lower(name) NOT IN (SELECT lower(skill) FROM {criteria_skills} WHERE criteria_id = 1)
    ORDER BY name LIMIT 8""")
def _(t):
    used = t.criteria_skills.filter("criteria_id = 1").select(F.col("skill").alias("name"))
    return rp.suggest_skills(t.skills, used, " Red ").select("name", "category")


@query("r07_weight_shares", f"""
    SELECT criteria_id, skill, CAST(sum(weight) OVER (PARTITION BY criteria_id) AS BIGINT) AS total_weight,
           {rnd('weight * 100.0 / sum(weight) OVER (PARTITION BY criteria_id)', 4)} AS share_pct FROM {{criteria_skills}}""")
def _(t):
    return rp.weight_shares(t.criteria_skills).select("criteria_id", "skill", "total_weight", round_dp(F.col("share_pct"), 4).alias("share_pct"))


@query("r08_skills_by_category", "SELECT category, count(*) AS n_skills, string_agg(name, ', ' ORDER BY name) AS names FROM {skills} GROUP BY category")
def _(t):
    return rp.skills_by_category(t.skills).withColumn("names", F.array_join("names", ", "))


def best_scored(t, k):
    """The k best of ``scored_pairs`` per criteria, without scoring the pairs."""
    held = sk.candidate_skill_set(t.candidates, t.candidate_skills)
    universe = sk.skill_universe(t.skills, sk.dictionary(t.spark))
    return rp.best_by_cosine(held, t.criteria_skills, universe, lambda need: scored_pairs(t, held, need=need), k)


@query("r09_compare_candidates", f"""
    SELECT criteria_id, candidate_id, score_pct, rank, first_value(candidate_id) OVER w AS winner_id,
           {rnd('first_value(score_pct) OVER w - nth_value(score_pct, 2) OVER w', 2)} AS gap FROM (
        SELECT *, row_number() OVER (PARTITION BY criteria_id ORDER BY score_pct DESC, candidate_id) AS rank FROM {{scored}}) WHERE rank <= 3
    WINDOW w AS (PARTITION BY criteria_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", SCORED)
def _(t):
    return rp.compare_candidates(best_scored(t, 3)).select("criteria_id", "candidate_id", "score_pct", "rank", "winner_id", "gap")


@query("r10_best_candidate", """
    SELECT criteria_id, candidate_id, score_pct FROM (SELECT *, row_number() OVER (PARTITION BY criteria_id ORDER BY score_pct DESC, candidate_id) AS rn FROM {scored}) WHERE rn = 1""", SCORED)
def _(t):
    return best_scored(t, 1).select("criteria_id", "candidate_id", "score_pct")


@query("r11_priority_board", """
    SELECT criteria_id, skill, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY criteria_id ORDER BY weight DESC, skill) AS rank FROM {criteria_skills}) WHERE rank <= 5""")
def _(t):
    return rp.priority_board(t.criteria_skills)


_UP, _DOWN = "augmente|increase|raise|hausse", "diminue|baisse|decrease|lower"


@query("r12_adjust_weights", rf"""
    SELECT request_id, criteria_id, skill, weight, CAST(greatest(0, least(100, CASE WHEN pct IS NOT NULL THEN pct WHEN up THEN weight + 10 ELSE weight - 10 END)) AS INTEGER) AS new_weight FROM (
        SELECT message_id AS request_id, criteria_id, arg_min(skill, id) AS skill, arg_min(weight, id) AS weight,
               TRY_CAST(nullif(regexp_extract(lower(any_value(text)), '(\d{{1,3}})\s*%', 1), '') AS INTEGER) AS pct,
               regexp_matches(lower(any_value(text)), '{_UP}') AS up, regexp_matches(lower(any_value(text)), '{_DOWN}') AS down
        FROM {{messages}} m JOIN {{criteria_skills}} s ON s.criteria_id = m.conv_id % 100 AND contains(lower(m.text), lower(s.skill)) GROUP BY 1, 2)
    WHERE pct IS NOT NULL OR up OR down""", MESSAGES)
def _(t):
    requests = messages(t).select(F.col("message_id").alias("request_id"), F.expr("conv_id % 100").alias("criteria_id"), F.col("text").alias("message"))
    return rp.adjust_weights(t.criteria_skills, requests).select("request_id", "criteria_id", "skill", "weight", "new_weight")


def _list_text(c: str) -> str:
    return (f"CASE WHEN coalesce({c}, '') = '' THEN '' WHEN json_valid({c}) AND json_type({c}) = 'ARRAY' "
            f"THEN array_to_string(from_json({c}, '[\"VARCHAR\"]'), '; ') ELSE {c} END")


EXPORT = {**SCORED, "export": f"""
    SELECT c.candidate_id, c.full_name, c.email, coalesce(c.phone, '') AS phone, c.created_at, coalesce(s.score_pct, 0.0) AS score_pct, coalesce(k.skills, '') AS skills,
           {_list_text('extracted_job_titles')} AS titles, {_list_text('extracted_companies')} AS companies, {_list_text('extracted_education')} AS education
    FROM {{candidates}} c LEFT JOIN (SELECT candidate_id, score_pct FROM {{scored}} WHERE criteria_id = 5) s USING (candidate_id)
    LEFT JOIN (SELECT candidate_id, string_agg(skill, '; ' ORDER BY skill) AS skills FROM {{candidate_skills}} GROUP BY 1) k USING (candidate_id)"""}


def export(t):
    return rp.export_rows(jn.with_scores(t.candidates, scored_for(t, 5), 5), t.candidate_skills)


@query("r13_export_rows", "SELECT * FROM {export}", EXPORT)
def _(t):
    return export(t)


@query("r14_export_order", """
    SELECT candidate_id, full_name, score_pct FROM {export} ORDER BY score_pct DESC, candidate_id""", EXPORT)
def _(t):
    return rp.export_order(export(t), "score").select("candidate_id", "full_name", "score_pct")


@query("r15_latest_criteria", "SELECT criteria_id, title, created_at FROM {job_criteria} ORDER BY created_at DESC, criteria_id LIMIT 1")
def _(t):
    return rp.latest_criteria(t.job_criteria)


@query("r16_page_results", """
    SELECT criteria_id, candidate_id, score_pct FROM {scored} WHERE criteria_id = 7 ORDER BY score_pct DESC, criteria_id, candidate_id LIMIT 25 OFFSET 25""", SCORED)
def _(t):
    rows = scored_for(t, 7).select("criteria_id", "candidate_id", "score_pct")
    return rp.page_results(rows, criteria_id=7, skip=25, limit=25)


_INTENT = "CASE " + " ".join(f"WHEN len(list_filter({sql_list(w)}, lambda k: contains(lower(text), k))) > 0 THEN '{i}'" for i, w in rp.INTENT_WORDS.items()) + " ELSE 'general' END"


@query("r17_tag_intents", f"SELECT message_id, {_INTENT} AS intent FROM {{messages}}", MESSAGES)
def _(t):
    return rp.tag_intents(messages(t)).select("message_id", "intent")


@query("r17_intent_counts", f"SELECT role, {_INTENT} AS intent, count(*) AS n FROM conversations GROUP BY ALL")
def _(t):
    return rp.intent_counts(rp.tag_intents(t.conversations))


@query("r18_suggest_actions", f"""
    SELECT message_id, CASE WHEN intent = 'explanation' AND n_top > 0 THEN 'Comparer avec le candidat suivant | Montrer les compétences manquantes'
        WHEN intent = 'comparison' AND n_top >= 2 THEN 'Expliquer le score du vainqueur | Voir les 3 meilleurs candidats'
        WHEN intent = 'exploration' THEN 'Lister les candidats les mieux scorés | Filtrer par autre compétence'
        WHEN intent = 'adjustment' THEN 'Recalculer ' || title || ' | Suggérer une pondération plus équilibrée'
        WHEN n_top > 0 THEN 'Expliquer le meilleur score | Comparer les deux meilleurs candidats'
        ELSE 'Importer ou calculer un matching | Poser une question sur un candidat précis' END AS actions
    FROM (SELECT message_id, {_INTENT} AS intent, conv_id % 3 AS n_top, coalesce(j.title, 'la matrice active') AS title FROM {{messages}} m
          LEFT JOIN {{job_criteria}} j ON j.criteria_id = m.conv_id % 150)""", MESSAGES)
def _(t):
    titles = t.job_criteria.select(F.col("criteria_id").alias("k"), F.col("title").alias("criteria_title"))
    rows = rp.tag_intents(messages(t)).withColumns({"n_top": F.expr("conv_id % 3"), "k": F.expr("conv_id % 150")}).join(titles, "k", "left")
    return rp.suggest_actions(rows).select("message_id", F.array_join("actions", " | ").alias("actions"))


@query("r19_resolve_candidate", r"""
    SELECT message_id, arg_min(candidate_id, p * 100 + rank) AS candidate_id, CASE min(p) WHEN 0 THEN 'name' WHEN 1 THEN 'words' ELSE 'first' END AS basis FROM (
        SELECT message_id, candidate_id, rank, CASE WHEN contains(lower(text), lower(full_name)) THEN 0
               WHEN len(list_filter(regexp_extract_all(lower(full_name), '[a-zà-ÿ]+'), lambda w: length(w) >= 3 AND contains(lower(text), w))) >= 2 THEN 1 ELSE 2 END AS p
        FROM {messages} m JOIN (SELECT criteria_id, candidate_id, CASE WHEN candidate_id % 2 = 0 THEN 'Small Ring' ELSE full_name END AS full_name, rank FROM {ranked} WHERE rank <= 10) r
             ON r.criteria_id = m.conv_id % 100) GROUP BY message_id""", {**SCORED, **MESSAGES})
def _(t):
    top = best_matches(t, 10).withColumn(
        "full_name", F.expr("CASE WHEN candidate_id % 2 = 0 THEN 'Small Ring' ELSE full_name END"))
    said = messages(t).withColumn("criteria_id", F.expr("conv_id % 100"))
    return rp.resolve_candidate(said, top).select("message_id", "candidate_id", "basis")


@query("r20_to_percent", f"""
    SELECT event_id, {rnd('CASE WHEN coalesce(value, 0) <= 1 THEN coalesce(value, 0) * 100 ELSE value END', 2)} AS pct FROM events""")
def _(t):
    return t.events.select("event_id", rp.to_percent(F.col("value")).alias("pct"))


@query("r21_list_children", """
    SELECT id, recruiter_id, candidate_id, created_at FROM {favorites} WHERE recruiter_id = 4 ORDER BY created_at DESC, id LIMIT 20 OFFSET 10""")
def _(t):
    return rp.list_children(t.favorites, "recruiter_id", 4, [F.desc("created_at"), "id"], 10, 20)


@query("r22_list_criteria", """
    SELECT j.criteria_id, j.title, j.created_at, string_agg(s.name || ':' || weight, ', ' ORDER BY weight DESC, id) AS required
    FROM {job_criteria} j LEFT JOIN {criteria_skills} c USING (criteria_id) LEFT JOIN {skills} s USING (skill_id) GROUP BY ALL""")
def _(t):
    rows = rp.list_criteria(t.job_criteria, jn.criteria_skill_rows(t.criteria_skills, t.skills), None)
    items = F.transform("required_skills", lambda s: F.concat_ws(":", s["name"], s["weight"].cast("string")))
    return rows.select("criteria_id", "title", "created_at", F.array_join(items, ", ").alias("required"))


@query("r23_breakdown_text", f"""
    SELECT criteria_id, candidate_id, string_agg('- ' || skill || CASE WHEN present THEN ': OK, poids ' ELSE ': MANQUANT, poids ' END || weight || '%, contribution ' ||
        printf('%.2f', {rnd('CASE WHEN present THEN weight * score_pct / total_weight ELSE 0 END', 2)}), chr(10) ORDER BY weight DESC, skill) AS breakdown_text
    FROM {{breakdown}} GROUP BY ALL""", _BREAK)
def _(t):
    return rp.breakdown_text(mt.contributions(scored_pairs(t), named_need(t))).select("criteria_id", "candidate_id", "breakdown_text")


@query("r24_top_snapshot", f"""
    SELECT criteria_id, candidate_id, score_pct, rank, 'stored' AS origin FROM (SELECT *, row_number() OVER (PARTITION BY criteria_id ORDER BY score_pct DESC, candidate_id) AS rank FROM (
        SELECT criteria_id, candidate_id, {rnd('CASE WHEN score_pct <= 1 THEN score_pct * 100 ELSE score_pct END', 2)} AS score_pct FROM {{scored}} WHERE criteria_id % 4 <> 0)) WHERE rank <= 10
    UNION ALL SELECT criteria_id, candidate_id, score_pct, rank, 'fallback' FROM {{fallback}} WHERE criteria_id % 4 = 0""", {**SCORED, **FALLBACK})
def _(t):
    stored = scored_pairs(t).filter("criteria_id % 4 <> 0")
    spare = mt.fallback_top(t.candidates, t.candidate_skills, t.job_criteria, t.criteria_skills)
    return rp.top_snapshot(t.job_criteria, stored, spare)


@query("u01_upsert_profiles", """
    SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fresh DESC, ts DESC) AS rn FROM (
        SELECT user_id, event_id, value, ts, 1 AS fresh FROM events UNION ALL SELECT c_custkey, NULL, c_acctbal, NULL, 0 FROM customer)) WHERE rn = 1""")
def _(t):
    current = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit(None).cast("bigint").alias("event_id"),
                                F.col("c_acctbal").alias("value"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    return mn.upsert_profiles(current, t.events.select("user_id", "event_id", "value", "ts"), "user_id", "ts").select("user_id", "event_id", "value")


@query("u02_replace_criteria_skills", """
    SELECT criteria_id, skill, weight FROM {criteria_skills} WHERE criteria_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 3000)
    UNION ALL SELECT s_suppkey, 'small ring', 55 FROM supplier WHERE s_acctbal < 3000""")
def _(t):
    new = t.supplier.filter("s_acctbal < 3000").select(F.col("s_suppkey").alias("criteria_id"), F.lit("small ring").alias("skill"), F.lit(55).cast("bigint").alias("weight"))
    return mn.replace_criteria_skills(t.criteria_skills.select("criteria_id", "skill", "weight"), new)


@query("u03_partial_update", """
    SELECT criteria_id, coalesce(p.title, j.title) AS title, coalesce(p.description, j.description) AS description FROM {job_criteria} j
    LEFT JOIN (SELECT s_suppkey AS criteria_id, CASE WHEN s_suppkey % 2 = 0 THEN 'New ' || s_name END AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'changed' END AS description FROM supplier WHERE s_acctbal > 2000) p USING (criteria_id)""")
def _(t):
    patch = t.supplier.filter("s_acctbal > 2000").select(
        F.col("s_suppkey").alias("criteria_id"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN concat('New ', s_name) END").alias("title"),
        F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'changed' END").alias("description"))
    return mn.partial_update(t.job_criteria.select("criteria_id", "title", "description"), patch, "criteria_id")


_WEAK = "quality_pct IS NULL OR quality_pct < 80 OR lower(full_name) LIKE '%unknown%' OR lower(full_name) LIKE '%test%' OR lower(full_name) LIKE '%demo%' OR lower(email) LIKE 'candidate-%'"


@query("u04_cascade_delete", f"""
    SELECT 'skill' AS child, candidate_id, skill_id AS item FROM {{candidate_skills}} WHERE candidate_id NOT IN (SELECT candidate_id FROM {{candidates}} WHERE {_WEAK})
    UNION ALL SELECT 'favorite', candidate_id, id FROM {{favorites}} WHERE candidate_id NOT IN (SELECT candidate_id FROM {{candidates}} WHERE {_WEAK})""")
def _(t):
    kept_skills, kept_favorites = mn.cascade_delete(ql.cleanup_candidates(t.candidates), "candidate_id", t.candidate_skills, t.favorites)
    return kept_skills.select(F.lit("skill").alias("child"), "candidate_id", F.col("skill_id").alias("item")).unionByName(
        kept_favorites.select(F.lit("favorite").alias("child"), "candidate_id", F.col("id").alias("item")))


@query("u05_insert_if_absent", """
    SELECT recruiter_id, candidate_id, id FROM {favorites} UNION ALL
    SELECT c_nationkey, o_custkey, min(o_orderkey) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority <> '1-URGENT'
        AND (c_nationkey, o_custkey) NOT IN (SELECT (recruiter_id, candidate_id) FROM {favorites}) GROUP BY 1, 2""".replace("(c_nationkey, o_custkey) NOT IN (SELECT (recruiter_id, candidate_id) FROM {favorites})",
        "NOT EXISTS (SELECT 1 FROM {favorites} f WHERE f.recruiter_id = c_nationkey AND f.candidate_id = o_custkey)"))
def _(t):
    new = t.orders.filter("o_orderpriority <> '1-URGENT'").join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").alias("recruiter_id"), F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("id"))
    return mn.insert_if_absent(t.favorites.select("recruiter_id", "candidate_id", "id"), new, ["recruiter_id", "candidate_id"], "id")


@query("u06_results_or_compute", """
    SELECT criteria_id, candidate_id, CASE WHEN criteria_id % 3 = 0 THEN 1.5 ELSE score_pct END AS score_pct FROM {scored}""".replace("1.5", "1.5::DOUBLE"), SCORED)
def _(t):
    rows = scored_pairs(t, need=t.criteria_skills.filter("criteria_id % 3 = 0"))
    stored = rows.select("criteria_id", "candidate_id", F.lit(1.5).alias("score_pct"))
    compute = lambda missing: scored_pairs(t, need=t.criteria_skills.join(missing, "criteria_id", "left_semi"))
    return mn.results_or_compute(stored, t.job_criteria.select("criteria_id"), compute)
