"""Validation, quality scores, curation and deduplication."""

from pyspark.sql import functions as F

from ..operators import quality as ql
from .extract_queries import _KNOWN, any_of, first_items, profiles
from .oracle_views import skill
from .registry import query, rnd
from .text_queries import SP

# Word lists per document: pieces of the text and derived addresses, phones and names.
PIECES = {"pieces": """
    SELECT doc_id, string_split(text, '. ') AS sentences,
           ['Client.' || doc_id || '@Mail.org ', 'client.' || doc_id || '@mail.org', 'broken@', source || '@x.fr', NULL, lang || '.' || doc_id || '@y.de', 'a@b.io', 'c@d.io', 'e@f.io'] AS emails,
           ['+33 6 12 ' || (100000 + doc_id), '33612' || (100000 + doc_id), '12345', '06 11 22 33 ' || (doc_id % 90 + 10), ' 0611-2233-' || (doc_id % 90 + 10), '0123456789', '1234567890123456'] AS phones,
           CASE doc_id % 6 WHEN 0 THEN 'jean paul MARTIN' WHEN 1 THEN 'x@y.z name' WHEN 2 THEN 'solo' WHEN 3 THEN '  anna   lee ' WHEN 4 THEN 'agent 007' END AS name
    FROM documents"""}


def pieces(t):
    return t.documents.select(
        "doc_id", F.split("text", r"\. ").alias("sentences"),
        F.expr("""array(concat('Client.', doc_id, '@Mail.org '), concat('client.', doc_id, '@mail.org'), 'broken@', concat(source, '@x.fr'), null,
            concat(lang, '.', doc_id, '@y.de'), 'a@b.io', 'c@d.io', 'e@f.io')""").alias("emails"),
        F.expr("""array(concat('+33 6 12 ', 100000 + doc_id), concat('33612', 100000 + doc_id), '12345', concat('06 11 22 33 ', doc_id % 90 + 10),
            concat(' 0611-2233-', doc_id % 90 + 10), '0123456789', '1234567890123456')""").alias("phones"),
        F.expr("CASE doc_id % 6 WHEN 0 THEN 'jean paul MARTIN' WHEN 1 THEN 'x@y.z name' WHEN 2 THEN 'solo' WHEN 3 THEN '  anna   lee ' WHEN 4 THEN 'agent 007' END").alias("name"))


def _first(source: str, key: str, value: str, by: str) -> str:
    """Distinct values per document in list order, the earliest spelling of equal keys."""
    return f"""
    SELECT doc_id, string_agg(v, ' | ' ORDER BY pos) AS items FROM (SELECT doc_id, arg_min(v, i) AS v, min(i) AS pos
        FROM (SELECT doc_id, i, {value} AS v FROM (SELECT doc_id, unnest({key}) AS x, generate_subscripts({key}, 1) AS i FROM {{pieces}})) WHERE {source} GROUP BY doc_id, {by}) GROUP BY doc_id"""


@query("q01_clean_emails", _first(r"regexp_full_match(v, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')", "emails", "lower(trim(x))", "v"), PIECES)
def _(t):
    return pieces(t).select("doc_id", F.array_join(ql.clean_emails("emails"), " | ").alias("items"))


@query("q02_clean_phones", _first(r"length(regexp_replace(v, '\D', '', 'g')) BETWEEN 10 AND 15", "phones", "trim(x)", r"regexp_replace(v, '\D', '', 'g')"), PIECES)
def _(t):
    return pieces(t).select("doc_id", F.array_join(ql.clean_phones("phones"), " | ").alias("items"))


@query("q03_clean_name", f"""
    SELECT doc_id, CASE WHEN NOT contains(name, '@') AND NOT regexp_matches(name, '\\d') AND len(w) BETWEEN 2 AND 4
        THEN array_to_string(list_transform(w, lambda s: upper(s[1]) || lower(s[2:])), ' ') END AS name
    FROM (SELECT doc_id, name, list_filter(regexp_split_to_array(name, '{SP}+'), lambda s: s <> '') AS w FROM {{pieces}})""", PIECES)
def _(t):
    return pieces(t).select("doc_id", ql.clean_name("name").alias("name"))


_BANNED = ["the", "der"]


@query("q04_clean_list", _first(
    f"length(v) BETWEEN 5 AND 80 AND NOT contains(v, '@') AND NOT contains(lower(v), 'http') AND NOT regexp_matches(v, '\\b(19|20)\\d{{2}}\\b') AND NOT {any_of('lower(v)', _BANNED)}".replace("{{2}}", "{2}"),
    "sentences", f"trim(regexp_replace(x, '{SP}+', ' ', 'g'))", "lower(v)"), PIECES)
def _(t):
    return pieces(t).select("doc_id", F.array_join(ql.clean_list("sentences", 5, 80, None, _BANNED), " | ").alias("items")).filter("items <> ''")


def cleaned_profiles(t):
    return ql.postprocess_profiles(profiles(t))


@query("q05_postprocess_profiles")
def _(t):
    rows = cleaned_profiles(t)
    return rows.select("cv_id", "full_name", "email", "phone", *[F.array_join(c, " | ").alias(c) for c in ql.FIELD_LIMITS])


_MERGE = {"left_side": """
    SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS full_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'a' || c_custkey END AS email,
           [c_mktsegment, 'Base ', CASE WHEN c_custkey % 2 = 0 THEN 'dup' END] AS tags FROM customer WHERE c_nationkey < 20""", "right_side": """
    SELECT c_custkey AS id, 'Other ' || c_custkey AS full_name, 'b' || c_custkey AS email, ['base', lower(c_mktsegment), 'DUP', '', 'extra'] AS tags FROM customer WHERE c_nationkey > 5""",
    "joined": """
    SELECT coalesce(l.id, r.id) AS id, coalesce(nullif(l.full_name, ''), r.full_name) AS full_name, coalesce(nullif(l.email, ''), r.email) AS email,
           coalesce(l.tags, []) || coalesce(r.tags, []) AS tags FROM {left_side} l FULL JOIN {right_side} r ON l.id = r.id"""}


@query("q06_merge_profiles", """
    SELECT j.id, full_name, email, tags FROM {joined} j JOIN (SELECT id, string_agg(v, ' | ' ORDER BY i) AS tags FROM (
        SELECT id, arg_min(x, i) AS v, min(i) AS i FROM (SELECT id, unnest(tags) AS x, generate_subscripts(tags, 1) AS i FROM {joined}) WHERE trim(x) <> '' GROUP BY id, lower(trim(x))) GROUP BY id) g ON g.id = j.id""".replace(
    "SELECT j.id, full_name, email, tags FROM", "SELECT j.id, full_name, email, g.tags FROM"), _MERGE)
def _(t):
    left = t.customer.filter("c_nationkey < 20").select(
        F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_name END").alias("full_name"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('a', c_custkey) END").alias("email"),
        F.expr("array(c_mktsegment, 'Base ', CASE WHEN c_custkey % 2 = 0 THEN 'dup' END)").alias("tags"))
    right = t.customer.filter("c_nationkey > 5").select(
        F.col("c_custkey").alias("id"), F.expr("concat('Other ', c_custkey)").alias("full_name"), F.expr("concat('b', c_custkey)").alias("email"),
        F.expr("array('base', lower(c_mktsegment), 'DUP', '', 'extra')").alias("tags"))
    return ql.merge_profiles(left, right, "id", ["full_name", "email"], ["tags"]).withColumn("tags", F.array_join("tags", " | "))


# Profiles for the quality scores: which fields are present depends on columns of the candidate.
_PRESENT = {"full_name": "full_name <> ''", "email": "quality_pct > 20", "phone": "phone IS NOT NULL", "job_titles": "linkedin_url IS NOT NULL",
            "companies": "segment IN ('BUILDING', 'MACHINERY')", "education": "nation_id % 2 = 0", "languages": "nation_id % 3 = 0",
            "soft_skills": "nation_id % 5 = 0", "interests": "nation_id % 7 = 0", "profile_summary": "nation_id % 4 = 0"}


def field_rows(t):
    """Candidates with every profile field either filled or empty."""
    texts, arrays = ("full_name", "email", "phone", "profile_summary"), ("job_titles", "companies", "education", "languages", "soft_skills", "interests")
    columns = [F.expr(f"CASE WHEN {_PRESENT[c]} THEN 'x' END").alias(c) for c in texts]
    columns += [F.expr(f"CASE WHEN {_PRESENT[c]} THEN array('x') ELSE array() END").alias(c) for c in arrays]
    return t.candidates.select("candidate_id", *columns).withColumns({
        "emails": F.when(F.col("email").isNotNull(), F.array("email")).otherwise(F.array().cast("array<string>")),
        "locations": F.col("languages"), "skills": F.col("soft_skills"), "total_entities": F.size("interests")})


def _score(points: dict[str, int]) -> str:
    return "CAST(least(100, " + " + ".join(f"CASE WHEN {_PRESENT[c]} THEN {n} ELSE 0 END" for c, n in points.items()) + ") AS DOUBLE)"


_Q = {"a": _score(ql.QUALITY_POINTS),
      "b": _score({**{k: v for k, v in ql.ENTITY_POINTS.items() if k != "locations"}, "languages": 10, "interests": 5}),
      "c": _score({"full_name": 20, "email": 20, "job_titles": 20, "companies": 20, "soft_skills": 20})}


@query("q07a_quality_pct", f"SELECT candidate_id, {_Q['a']} AS quality_pct FROM {{candidates}}")
def _(t):
    return ql.quality_pct(field_rows(t)).select("candidate_id", "quality_pct")


@query("q07b_quality_entities_pct", f"SELECT candidate_id, {_Q['b']} AS quality_entities_pct FROM {{candidates}}")
def _(t):
    return ql.quality_entities_pct(field_rows(t)).select("candidate_id", "quality_entities_pct")


@query("q07c_quality_five_pct", f"SELECT candidate_id, {_Q['c']} AS quality_five_pct FROM {{candidates}}")
def _(t):
    return ql.quality_five_pct(field_rows(t)).select("candidate_id", "quality_five_pct")


@query("q08_extraction_flags", f"""
    SELECT candidate_id, greatest({_Q['a']}, {_Q['b']}, {_Q['c']}) AS quality_pct, greatest({_Q['a']}, {_Q['b']}, {_Q['c']}) >= 80 AS is_fully_extracted FROM {{candidates}}""")
def _(t):
    rows = ql.quality_five_pct(ql.quality_entities_pct(ql.quality_pct(field_rows(t))))
    return ql.extraction_flags(rows, "quality_pct", "quality_entities_pct", "quality_five_pct").select("candidate_id", "quality_pct", "is_fully_extracted")


@query("q09_profiles_to_candidates", r"""
    SELECT candidate_id AS cv_id, CASE WHEN candidate_id % 4 = 0 THEN segment WHEN len(p) >= 2 AND length(n) >= 5 THEN n ELSE 'Unknown' END AS full_name,
           mail AS email, CASE WHEN mail IS NULL THEN '[]' ELSE '["' || mail || '"]' END AS extracted_emails, coalesce(quality_pct, 0) >= 80 AS is_fully_extracted FROM (
        SELECT *, array_to_string(list_transform(p[:3], lambda w: upper(w[1]) || lower(w[2:])), ' ') AS n FROM (
            SELECT *, list_filter(regexp_split_to_array(split_part(mail, '@', 1), '[._\-+]+'), lambda w: w <> '') AS p FROM (
                SELECT *, CASE WHEN candidate_id % 5 <> 0 THEN replace(email, '000', '.') END AS mail FROM {candidates})))""")
def _(t):
    none = F.array().cast("array<string>")
    rows = t.candidates.select(
        F.col("candidate_id").alias("cv_id"), F.expr("CASE WHEN candidate_id % 4 = 0 THEN segment ELSE '' END").alias("full_name"),
        F.expr("CASE WHEN candidate_id % 5 <> 0 THEN replace(email, '000', '.') END").alias("email"), "phone", "linkedin_url",
        none.alias("emails"), none.alias("phones"), none.alias("job_titles"), none.alias("companies"), none.alias("education"),
        F.coalesce("quality_pct", F.lit(0.0)).alias("quality_pct"))
    return ql.profiles_to_candidates(rows).select("cv_id", "full_name", "email", "extracted_emails", "is_fully_extracted")


@query("q10_matchable", """
    SELECT candidate_id FROM {candidates} WHERE (is_fully_extracted OR quality_pct >= 80) AND full_name IS NOT NULL AND full_name NOT IN ('Unknown', '') AND raw_text IS NOT NULL""")
def _(t):
    return ql.matchable(t.candidates).select("candidate_id")


@query("q11_displayable", """
    SELECT candidate_id FROM {candidates} WHERE quality_pct >= 80 AND full_name IS NOT NULL AND full_name NOT IN ('Unknown', '') AND trim(raw_text) <> ''""")
def _(t):
    return ql.displayable(t.candidates).select("candidate_id")


@query("q12_real_identity", """
    SELECT candidate_id FROM {candidates} WHERE NOT regexp_matches(lower(coalesce(full_name, '') || ' ' || coalesce(email, '')), '\\b(unknown|test|demo|sample|mock)\\b')""")
def _(t):
    return ql.real_identity(t.candidates).select("candidate_id")


_INCOMPLETE = "(full_name = 'Unknown' OR " + " OR ".join(f"coalesce({c}, '') = ''" for c in (
    "linkedin_url", "extracted_job_titles", "extracted_companies", "extracted_education", "ner_json")) + " OR " + " OR ".join(
    f"NOT contains(coalesce(ner_json, ''), '\"{k}\"')" for k in ql.PROFILE_KEYS) + ")"


@query("q13_needs_refresh", f"""
    SELECT candidate_id, coalesce({_INCOMPLETE}, FALSE) AS incomplete FROM {{candidates}} WHERE coalesce(raw_text, '') <> '' AND (coalesce(quality_pct, 0) < 80 OR {_INCOMPLETE})""")
def _(t):
    return ql.needs_refresh(t.candidates).select("candidate_id", "incomplete")


@query("q13_keep_better", f"""
    SELECT candidate_id, CAST(nation_id * 4 AS DOUBLE) AS quality_pct FROM {{candidates}} WHERE coalesce(raw_text, '') <> '' AND (coalesce(quality_pct, 0) < 80 OR {_INCOMPLETE})
        AND (nation_id * 4 > coalesce(quality_pct, 0) OR {_INCOMPLETE})""")
def _(t):
    fresh = t.candidates.select("candidate_id", (F.col("nation_id") * 4).cast("double").alias("quality_pct"))
    return ql.keep_better(t.candidates, fresh)


@query("q14_cleanup_candidates", """
    SELECT candidate_id FROM {candidates} WHERE quality_pct IS NULL OR quality_pct < 80 OR regexp_matches(lower(full_name), 'unknown|test|demo') OR starts_with(lower(email), 'candidate-')""")
def _(t):
    return ql.cleanup_candidates(t.candidates).select("candidate_id")


# Copies of candidates: every order is one submission of its customer.
SUBMISSIONS = {"submissions": """
    SELECT o_orderkey AS submission_id, o_orderdate AS sent_at, upper(c.email) || ' ' AS email, c.phone, CASE WHEN o_orderkey % 9 = 0 THEN 'X ' || c.full_name ELSE c.full_name END AS full_name,
           [c.segment, 'sql', 'Python'] AS normalized_skills FROM orders JOIN {candidates} c ON c.candidate_id = o_custkey""", "printed": """
    SELECT *, md5(trim(lower(email)) || '|' || replace(replace(coalesce(phone, ''), ' ', ''), '-', '') || '|' || trim(lower(full_name)) || '|' ||
           array_to_string(list_sort(normalized_skills), '')) AS fingerprint FROM {submissions}"""}


def submissions(t):
    c = t.candidates.select("candidate_id", "email", "phone", "full_name", "segment")
    return t.orders.join(c, F.col("candidate_id") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("submission_id"), F.col("o_orderdate").alias("sent_at"), F.concat(F.upper("email"), F.lit(" ")).alias("email"), "phone",
        F.expr("CASE WHEN o_orderkey % 9 = 0 THEN concat('X ', full_name) ELSE full_name END").alias("full_name"),
        F.array(F.col("segment"), F.lit("sql"), F.lit("Python")).alias("normalized_skills"))


@query("q15_fingerprint", "SELECT submission_id, fingerprint FROM {printed}", SUBMISSIONS)
def _(t):
    return ql.fingerprint(submissions(t)).select("submission_id", "fingerprint")


@query("q16_dedupe_candidates", """
    SELECT submission_id, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY sent_at, submission_id) AS rn FROM {printed}) WHERE rn = 1""", SUBMISSIONS)
def _(t):
    return ql.dedupe_candidates(submissions(t), "submission_id", ["sent_at"]).select("submission_id", "fingerprint")


@query("q17_merge_near_duplicates", """
    SELECT submission_id, completeness, copies FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY completeness DESC, submission_id) AS rn,
        count(*) OVER (PARTITION BY fingerprint) AS copies FROM (SELECT *, CASE WHEN trim(email) <> '' THEN 1 ELSE 0 END + CASE WHEN phone <> '' THEN 1 ELSE 0 END
            + CASE WHEN trim(full_name) <> '' THEN 1 ELSE 0 END + CASE WHEN submission_id % 3 = 0 THEN 1 ELSE 0 END AS completeness FROM {printed})) WHERE rn = 1""", SUBMISSIONS)
def _(t):
    rows = submissions(t).withColumn("note", F.expr("CASE WHEN submission_id % 3 = 0 THEN 'x' END"))
    return ql.merge_near_duplicates(rows, "submission_id", ["email", "phone", "full_name", "note"]).select("submission_id", "completeness", "copies")


# Token sets of the submissions, their similar pairs and what each can reach over them.
_SIMILAR = {**SUBMISSIONS, "token_sets": """
    SELECT submission_id, list_sort(list_distinct(['email:' || e] || CASE WHEN p <> '' THEN ['phone:' || p] ELSE [] END || ['skill:' || lower(s) for s in normalized_skills] ||
           CASE WHEN n <> '' THEN ['name:' || substring(n, i, 3) for i in range(1, greatest(length(n) - 2, 1) + 1)] ELSE [] END)) AS tokens
    FROM (SELECT submission_id, normalized_skills, trim(lower(email)) AS e, replace(replace(coalesce(phone, ''), ' ', ''), '-', '') AS p, trim(lower(full_name)) AS n FROM {submissions})""",
    "distinct_sets": "SELECT min(submission_id) AS node, tokens FROM {token_sets} GROUP BY tokens", "set_items": "SELECT node, len(tokens) AS n, unnest(tokens) AS token FROM {distinct_sets}",
    "set_pairs": """
    SELECT a.node AS a, b.node AS b FROM {set_items} a JOIN {set_items} b ON a.token = b.token AND a.node <> b.node
    GROUP BY a.node, b.node, a.n, b.n HAVING count(*) >= 0.9 * (a.n + b.n - count(*)) - 1e-9""",
    "set_groups": """
    WITH RECURSIVE reach AS (SELECT node, node AS other FROM {distinct_sets} UNION SELECT r.node, p.b FROM reach r JOIN {set_pairs} p ON p.a = r.other)
    SELECT node, min(other) AS root FROM reach GROUP BY node""",
    "grouped": """
    SELECT s.*, g.root, CASE WHEN trim(email) <> '' THEN 1 ELSE 0 END + CASE WHEN phone <> '' THEN 1 ELSE 0 END + CASE WHEN trim(full_name) <> '' THEN 1 ELSE 0 END
           + CASE WHEN s.submission_id % 3 = 0 THEN 1 ELSE 0 END AS completeness
    FROM {submissions} s JOIN {token_sets} USING (submission_id) JOIN {distinct_sets} d USING (tokens) JOIN {set_groups} g USING (node)"""}


@query("q17_merge_similar", """
    SELECT submission_id, root AS group_id, completeness, copies FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY completeness DESC, submission_id) AS rn,
        count(*) OVER (PARTITION BY root) AS copies FROM {grouped}) WHERE rn = 1""", _SIMILAR)
def _(t):
    rows = submissions(t).withColumn("note", F.expr("CASE WHEN submission_id % 3 = 0 THEN 'x' END"))
    return ql.merge_similar(rows, "submission_id", ["email", "phone", "full_name", "note"], 0.9).select(
        "submission_id", F.col("group").alias("group_id"), "completeness", "copies")


@query("q18_dedupe_pairs", """
    SELECT min(pair_id) AS pair_id, label, job_text FROM (SELECT doc_id AS pair_id, text AS cv_text, doc_id % 2 AS label, lang AS job_text FROM documents) GROUP BY cv_text, job_text, label""")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("cv_text"), F.expr("doc_id % 2").alias("label"), F.col("lang").alias("job_text"))
    return ql.dedupe_pairs(rows).select("pair_id", "label", "job_text")


@query("q19_clean_candidates", f"""
    SELECT row_id, (SELECT coalesce(string_agg(s, ', ' ORDER BY i), '') FROM (SELECT {skill('x')} AS s, min(i) AS i FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i) GROUP BY 1) WHERE s <> '') AS skills,
           CAST(CASE WHEN row_id % 3 > 0 THEN row_id % 3 WHEN row_id % 2 = 0 THEN row_id % 20 ELSE 4 END AS INTEGER) AS experience_years, 'Bachelor ' || row_id % 4 AS education
    FROM (SELECT row_id, regexp_split_to_array(coalesce(raw, '') || ', ml;sql / PYTHON,python', '[,;/\\\\]\\s*') AS l FROM {{raw_skills}})""")
def _(t):
    rows = t.raw_skills.select(
        "row_id", F.concat(F.coalesce("raw", F.lit("")), F.lit(", ml;sql / PYTHON,python")).alias("skills"), F.expr("cast(row_id % 3 as int)").alias("experience_years"),
        F.expr("CASE WHEN row_id % 2 = 0 THEN concat(row_id % 20, '+ years of work') ELSE '' END").alias("experience"), F.lit("4 ans").alias("summary"),
        F.expr("concat('  Bachelor ', row_id % 4, ' ')").alias("education"))
    return ql.clean_candidates(rows).select("row_id", F.array_join("normalized_skills", ", ").alias("skills"), "experience_years", "education")


@query("q20_valid_text", "SELECT doc_id, text AS stored_text FROM documents WHERE length(trim(text)) >= 10")
def _(t):
    return ql.valid_text(t.documents).select("doc_id", "stored_text")


COVERAGE = {"found_rows": """
    SELECT p_partkey AS id, p_size % 4 AS identity, p_size % 3 AS experience, p_size % 5 AS education, p_size % 7 AS skills, p_size % 2 AS enrichment,
           p_partkey % 4 AS w_identity, p_partkey % 3 AS w_experience, p_partkey % 2 AS w_education, p_partkey % 9 AS w_skills, p_partkey % 3 AS w_enrichment FROM part""",
    "coverage": "SELECT id, " + rnd(" + ".join(
        f"{w} * CASE WHEN w_{s} = 0 THEN CASE WHEN {s} = 0 THEN 100 ELSE least(100, {s} * 25) END ELSE least(1.0, {s} / w_{s}::DOUBLE) * 100 END" for s, w in ql.SECTION_WEIGHTS.items()), 1)
    + " AS score FROM {found_rows}"}


def coverage(t):
    found = t.part.selectExpr("p_partkey AS id", "p_size % 4 AS identity", "p_size % 3 AS experience", "p_size % 5 AS education", "p_size % 7 AS skills", "p_size % 2 AS enrichment")
    expected = t.part.selectExpr("p_partkey AS id", "p_partkey % 4 AS identity", "p_partkey % 3 AS experience", "p_partkey % 2 AS education", "p_partkey % 9 AS skills", "p_partkey % 3 AS enrichment")
    return ql.coverage_report(found, expected, "id")


@query("q21_coverage_report", "SELECT id, score FROM {coverage}", COVERAGE)
def _(t):
    return coverage(t)


@query("q21_coverage_summary", f"SELECT count(*) AS samples, {rnd('avg(score)', 4)} AS average, avg(score) >= 70 AS passed FROM {{coverage}}", COVERAGE)
def _(t):
    return ql.coverage_summary(coverage(t))


@query("q22_diagnose_missing", r"""
    SELECT cv_id, 'full_name' AS field, CASE WHEN cv_id % 4 = 0 THEN 'rejected_by_filters' END AS reason FROM {cv_texts} WHERE cv_id % 4 = 0
    UNION ALL SELECT cv_id, 'phone', 'rejected_by_normalisation' FROM {cv_texts} WHERE cv_id % 3 = 0
    UNION ALL SELECT cv_id, 'experiences', CASE WHEN regexp_matches(lower(text), 'experience|professionnelle|stage') THEN 'section_without_entry' ELSE 'no_section' END FROM {cv_texts} WHERE cv_id % 2 = 0
    UNION ALL SELECT cv_id, 'education', 'lines_not_recognised' FROM {cv_texts} WHERE cv_id % 5 = 0
    UNION ALL SELECT cv_id, 'skills', CASE WHEN regexp_matches(lower(text), 'python|sql|java|react|docker|airflow|spark') THEN 'terms_missed' ELSE 'soft_skills_only' END FROM {cv_texts} WHERE cv_id % 7 = 0
    UNION ALL SELECT cv_id, 'enrichment', 'no_signal' FROM {cv_texts} WHERE cv_id % 6 <> 0""")
def _(t):
    flag = lambda n, c: F.expr(f"CASE WHEN cv_id % {n} = 0 THEN array() ELSE array('x') END").cast("array<string>").alias(c)
    none = F.array().cast("array<string>")
    rows = t.cv_texts.select(
        "cv_id", "text", F.expr("CASE WHEN cv_id % 4 <> 0 THEN 'x' END").alias("full_name"), F.expr("CASE WHEN cv_id % 3 <> 0 THEN 'x' END").alias("phone"), F.lit("x").alias("email"),
        flag(2, "experiences"), flag(5, "education"), flag(7, "skills"), F.expr("CASE WHEN cv_id % 6 = 0 THEN array('x') ELSE array() END").cast("array<string>").alias("projects"),
        *[none.alias(c) for c in ("linkedin_urls", "github_urls", "portfolio_urls", "certifications")])
    return ql.diagnose_missing(rows)


@query("q23_extraction_metadata", f"""
    SELECT cv_id, length(text) AS raw_text_length, coalesce(c.n, 0) AS entities_found, 'text_input' AS source FROM {{cv_texts}} LEFT JOIN (
        SELECT cv_id, len(string_split(items, ' | ')) AS n FROM ({first_items("TRUE", "v", 5, "{company_items}")})) c USING (cv_id)""".replace("{{", "{").replace("}}", "}"), _KNOWN)
def _(t):
    from ..operators import extract as ex

    rows = ex.annotate_lines(t.cv_texts)
    counted = rows.select("cv_id", "text", ex.companies(F.col("lines"), F.col("text")).alias("skills")).withColumn("total_entities", F.size("skills").cast("bigint"))
    return ql.extraction_metadata(counted).select("cv_id", F.col("raw_text_length").cast("bigint").alias("raw_text_length"), "entities_found", "source")


@query("r25_ingest_report")
def _(t):
    from ..operators.reports import ingest_report

    rows = ql.extraction_flags(ql.quality_pct(cleaned_profiles(t)), "quality_pct")
    return ingest_report(rows).select("cv_id", "full_name", "email", "skills_count", "quality_pct", "is_fully_extracted",
                                      *[F.array_join(c, ", ").alias(c) for c in ("top_skills", "job_titles", "companies")])

