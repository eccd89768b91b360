"""Text projections."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.jsonlist import json_list
from ..operators import texts
from .registry import query

SP = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SP}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def folded(x: str) -> str:
    return (f"lower(trim(regexp_replace(translate(coalesce({x}, ''), '{tx.ACCENTED}', '{tx.UNACCENTED}'), "
            "'[^a-zA-Z0-9]+', ' ', 'g')))")


def titled(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|\\P{{L}}+'), "
            "lambda w: CASE w[1] WHEN 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), '')")


def rich(x: str) -> str:
    x = f"coalesce({x}, '')"
    return (f"(length(regexp_replace({x}, '\\P{{L}}', '', 'g'))"
            f" + 200 * len(regexp_extract_all({x}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'))"
            f" + 120 * len(regexp_extract_all({x}, '\\+?\\d[\\d\\s().-]{{7,}}\\d'))"
            f" + 80 * len(regexp_extract_all(lower({x}), "
            "'\\b(experience|education|skills|profil|formation|competences|projects)\\b'))"
            f" + 3 * len(list_filter(string_split({x}, chr(10)), lambda s: regexp_matches(s, '[^' || '{SP[1:]}'))))")


def json_items(x: str) -> str:
    """List of item names of a JSON text, [] when it is not a JSON list."""
    return (f"CASE WHEN json_valid({x}) AND json_type({x}) = 'ARRAY' THEN list_filter(list_transform("
            f"from_json({x}, '[\"JSON\"]'), lambda j: CASE json_type(j) WHEN 'OBJECT' THEN j->>'$.name' "
            "ELSE j->>'$' END), lambda s: s IS NOT NULL AND trim(s) <> '') ELSE [] END")


@query("t01_normalize_text", f"SELECT doc_id, {norm('text')} AS text_norm FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.normalize_text("text").alias("text_norm"))


@query("t02_compact_join", f"""
    SELECT conv_id, turn, {norm("array_to_string(list_filter(list_transform(string_split(text, '.'), "
    "lambda s: trim(regexp_replace(s, '" + SP + "+', ' ', 'g'))), lambda s: s <> ''), ' ')")} AS joined
    FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", tx.compact_join(F.split("text", r"\.")).alias("joined"))


@query("t03_normalize_company", f"""
    SELECT s_suppkey, trim({norm("' - ' || s_name || ' ,Inc.' || chr(9) || '. '")}, ' ,.-') AS company FROM supplier""")
def _(t):
    raw = F.concat(F.lit(" - "), "s_name", F.lit(" ,Inc.\t. "))
    return t.supplier.select("s_suppkey", tx.normalize_company(raw).alias("company"))


@query("t04_normalize_job_title", f"SELECT doc_id, {norm('text')} AS job_title FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.normalize_job_title("text").alias("job_title"))


@query("t05_normalize_layout", f"""
    SELECT cv_id, {strip("regexp_replace(regexp_replace(replace(replace(text, 'EXPERIENCE', chr(13) || chr(10) || "
    "chr(13) || chr(10) || 'EXPERIENCE'), chr(13), chr(10)), '[ ' || chr(9) || ']+', ' ', 'g'), "
    "chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS layout FROM {{cv_texts}}""")
def _(t):
    noisy = F.replace("text", F.lit("EXPERIENCE"), F.lit("\r\n\r\nEXPERIENCE"))
    return t.cv_texts.select("cv_id", tx.normalize_layout(noisy).alias("layout"))


_CLEAN_SQL = norm("text")
for _pattern in (r"http[^\s\x0B\x1C-\x1F\x85\p{Z}]+|www[^\s\x0B\x1C-\x1F\x85\p{Z}]+",
                 r"[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]+",
                 r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", r"[^a-zA-Z0-9\s\-]"):
    _CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '{_pattern}', '', 'g')"


@query("t06_clean_text", f"""
    SELECT 'd' AS kind, doc_id AS id, {_CLEAN_SQL} AS cleaned FROM documents
    UNION ALL SELECT 'c', cv_id, {_CLEAN_SQL} FROM {{{{cv_texts}}}}""".replace("{{cv_texts}}", "{cv_texts}"))
def _(t):
    docs = t.documents.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text")
    cvs = t.cv_texts.select(F.lit("c").alias("kind"), F.col("cv_id").alias("id"), "text")
    return docs.unionByName(cvs).select("kind", "id", tx.clean_text("text").alias("cleaned"))


@query("t07_fold", f"SELECT doc_id, {folded('text')} AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.fold("text").alias("folded"))


@query("t08_token_set", f"""
    SELECT doc_id, count(DISTINCT tok) AS n_tokens, string_agg(DISTINCT tok, ' ' ORDER BY tok) AS tokens
    FROM (SELECT doc_id, unnest(string_split(lower({norm('text')}), ' ')) AS tok FROM documents)
    WHERE tok <> '' GROUP BY doc_id""")
def _(t):
    tokens = tx.token_set("text")
    return t.documents.select(
        "doc_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.array_join(F.array_sort(tokens), " ").alias("tokens")
    ).filter("n_tokens > 0")


@query("t09_title_case", f"""
    SELECT row_id, {titled('raw')} AS title, NULL::BIGINT AS item_id FROM {{raw_skills}}
    UNION ALL SELECT NULL, {titled('text')}, item_id FROM benchmark""")
def _(t):
    skills = t.raw_skills.select("row_id", tx.title_case("raw").alias("title"), F.lit(None).cast("bigint").alias("item_id"))
    items = t.benchmark.select(F.lit(None).cast("bigint").alias("row_id"), tx.title_case("text").alias("title"), "item_id")
    return skills.unionByName(items)


@query("t10_flatten_text", """
    SELECT doc_id, replace(text, chr(10), ' ') AS flat_text FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.flatten_text("text").alias("flat_text"))


PROFILE_VIEWS = {"profile_rows": f"""
    SELECT c.candidate_id, c.full_name, c.raw_text, coalesce(k.skills, []) AS skills,
           {json_items('c.extracted_companies')} AS companies, {json_items('c.extracted_job_titles')} AS titles,
           {json_items('c.extracted_education')} AS education,
           {json_items("CASE WHEN json_valid(c.ner_json) THEN json_extract_string(c.ner_json, '$.languages') END")} AS languages
    FROM {{candidates}} c LEFT JOIN (SELECT candidate_id, list(skill ORDER BY skill) AS skills FROM {{candidate_skills}}
                                   GROUP BY candidate_id) k USING (candidate_id)"""}
JOB_VIEWS = {"job_rows": r"""
    SELECT j.criteria_id, j.title, j.description, coalesce(k.skills, []) AS skills,
           coalesce(TRY_CAST(regexp_extract(coalesce(description, '') || ' ' || title,
               '(?i)(\d{1,2})\+?\s*(?:years|ans|yrs|year)', 1) AS INTEGER), 0) AS years
    FROM {job_criteria} j LEFT JOIN (SELECT criteria_id, list(skill ORDER BY weight DESC, id) AS skills
                                     FROM {criteria_skills} GROUP BY criteria_id) k USING (criteria_id)"""}


def profile_rows(t):
    """Candidates with their skill, company, title, education and language arrays."""
    skills = t.candidate_skills.groupBy("candidate_id").agg(F.array_sort(F.collect_list("skill")).alias("skills"))
    return t.candidates.join(skills, "candidate_id", "left").select(
        "candidate_id", "full_name", "raw_text", "created_at",
        F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
        json_list("extracted_companies").alias("companies"), json_list("extracted_job_titles").alias("job_titles"),
        json_list("extracted_education").alias("education"),
        json_list(F.get_json_object("ner_json", "$.languages")).alias("languages"),
    )


def job_rows(t):
    """Criteria with the required skills by weight and the years their text asks for."""
    from ..functions.contact import experience_years

    ordered = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "id", "skill")))
    skills = t.criteria_skills.groupBy("criteria_id").agg(F.transform(ordered, lambda s: s["skill"]).alias("required_skills"))
    return t.job_criteria.join(skills, "criteria_id", "left").select(
        "criteria_id", "title", "description", "created_at",
        F.coalesce("required_skills", F.array().cast("array<string>")).alias("required_skills"),
        F.array().cast("array<string>").alias("languages_required"),
        experience_years(F.concat_ws(" ", F.coalesce("description", F.lit("")), "title")).alias("required_years"),
    )


@query("t11_candidate_and_job_text", f"""
    SELECT 'candidate' AS kind, candidate_id AS id, {norm("array_to_string(list_filter([full_name, raw_text] || skills || "
    "companies || titles || education || languages, lambda s: s IS NOT NULL AND s <> ''), ' ' || chr(10) || ' ')")} AS text
    FROM {{profile_rows}}
    UNION ALL
    SELECT 'job', criteria_id, {norm("array_to_string(list_filter([title, description] || skills || [CASE WHEN years <> 0 "
    "THEN CAST(years AS VARCHAR) END], lambda s: s IS NOT NULL AND s <> ''), ' ' || chr(10) || ' ')")} FROM {{job_rows}}
    """, {**PROFILE_VIEWS, **JOB_VIEWS})
def _(t):
    people = texts.candidate_text(profile_rows(t)).select(
        F.lit("candidate").alias("kind"), F.col("candidate_id").alias("id"), F.col("candidate_text").alias("text"))
    jobs = texts.job_text(job_rows(t)).select(
        F.lit("job").alias("kind"), F.col("criteria_id").alias("id"), F.col("job_text").alias("text"))
    return people.unionByName(jobs)


@query("t12_predict_texts", """
    SELECT 'candidate' AS kind, candidate_id AS id, coalesce(full_name, '') || ' ' || chr(10) || ' ' ||
           array_to_string(skills, '; ') || ' ' || chr(10) || ' ' || array_to_string(titles || companies, '; ') AS text
    FROM {profile_rows}
    UNION ALL
    SELECT 'job', criteria_id, coalesce(title, '') || ' ' || chr(10) || ' ' || coalesce(description, '') || ' ' || chr(10)
           || ' Skills: ' || array_to_string(skills, '; ') FROM {job_rows}""", {**PROFILE_VIEWS, **JOB_VIEWS})
def _(t):
    people = texts.predict_candidate_text(profile_rows(t)).select(
        F.lit("candidate").alias("kind"), F.col("candidate_id").alias("id"), F.col("candidate_text").alias("text"))
    jobs = texts.predict_job_text(job_rows(t)).select(
        F.lit("job").alias("kind"), F.col("criteria_id").alias("id"), F.col("job_text").alias("text"))
    return people.unionByName(jobs)


@query("t13_richness", f"""
    SELECT 'd' AS kind, doc_id AS id, CAST({rich('text')} AS BIGINT) AS richness FROM documents
    UNION ALL SELECT 'c', cv_id, CAST({rich('text')} AS BIGINT) FROM {{cv_texts}}""")
def _(t):
    docs = t.documents.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text")
    cvs = t.cv_texts.select(F.lit("c").alias("kind"), F.col("cv_id").alias("id"), "text")
    return docs.unionByName(cvs).select("kind", "id", tx.richness("text").cast("bigint").alias("richness"))


@query("t14_best_variant", f"""
    SELECT cv, text, richness FROM (
        SELECT doc_id // 4 AS cv, text, CAST({rich('text')} AS BIGINT) AS richness,
               row_number() OVER (PARTITION BY doc_id // 4 ORDER BY {rich('text')} DESC, doc_id) AS pos
        FROM documents WHERE regexp_matches(text, '[^' || '{SP[1:]}')) WHERE pos = 1""")
def _(t):
    variants = t.documents.select(F.expr("doc_id div 4").alias("cv"), "text", "doc_id")
    return texts.best_variant(variants, "cv", "text", "doc_id").withColumn("richness", F.col("richness").cast("bigint"))


@query("t15_stitch_pages", f"""
    SELECT conv_id, string_agg(chosen, chr(10) || chr(10) ORDER BY turn) AS text FROM (
        SELECT conv_id, turn, CASE WHEN {rich('own')} < 120 AND {rich('other')} > {rich('own')} THEN other ELSE own END AS chosen
        FROM (SELECT conv_id, turn, {strip("left(text, CAST(turn % 3 AS INTEGER) * 80)")} AS own, {strip('text')} AS other
              FROM conversations)) WHERE chosen <> '' GROUP BY conv_id""")
def _(t):
    pages = t.conversations.select(
        "conv_id", "turn", F.left("text", F.expr("cast(turn % 3 as int) * 80")).alias("native"), F.col("text").alias("other"))
    return texts.stitch_pages(pages, "conv_id", "turn", "native", "other")
