"""Validation, scoring and curation of candidate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contact import EMAIL_SHAPE, experience_years
from ..functions.skillnames import normalize_skill_list, split_skills
from ..functions.text import NON_SPACE, SPACE, as_column, capitalize, contains_any, first_chars, first_items, ordered_distinct, strip_space
from ..session import cut_lineage
from .set_similarity import similar_groups

EMPTY = "array<string>"


def _list(value: Column | str) -> Column:
    return F.coalesce(as_column(value), F.array().cast(EMPTY))


def clean_emails(items: Column | str, limit: int | None = None) -> Column:
    lowered = F.transform(_list(items), lambda e: F.lower(F.trim(e)))
    return first_items(F.array_distinct(F.filter(lowered, lambda e: e.rlike(EMAIL_SHAPE))), limit)


def clean_phones(items: Column | str, limit: int | None = None) -> Column:
    def digits(p: Column) -> Column:
        return F.regexp_replace(p, r"\D", "")

    trimmed = F.transform(_list(items), lambda s: F.trim(s))
    valid = F.filter(trimmed, lambda p: F.length(digits(p)).between(10, 15))
    return first_items(ordered_distinct(valid, digits), limit)


def clean_name(value: Column | str) -> Column:
    """Two to four capitalised words without digits or addresses, else null."""
    c = strip_space(F.coalesce(as_column(value), F.lit("")))
    words = F.filter(F.split(c, SPACE + "+"), lambda w: w != "")
    usable = ~c.contains("@") & ~F.lower(c).contains("http") & ~c.rlike(r"\d") & F.size(words).between(2, 4)
    return F.when(usable, F.array_join(F.transform(words, capitalize), " "))


def clean_list(
    items: Column | str, min_len: int, max_len: int, limit: int | None = None, banned: list[str] | None = None, allow_years: bool = False
) -> Column:
    """Items within the length range, without addresses, banned words or (unless allowed) years; unique ignoring case."""
    normal = F.transform(_list(items), lambda s: F.trim(F.regexp_replace(s, SPACE + "+", " ")))

    def keep(s: Column) -> Column:
        low = F.lower(s)
        ok = F.length(s).between(min_len, max_len) & ~low.contains("@") & ~low.contains("http")
        if not allow_years:
            ok = ok & ~low.rlike(r"\b(19|20)\d{2}\b")
        return ok & ~contains_any(low, banned) if banned else ok

    return first_items(ordered_distinct(F.filter(normal, keep)), limit)


# Limits per profile field as (min length, max length, items, banned words, years allowed).
_HOSTS = ["linkedin", "github", "gmail", "hotmail", "outlook"]
FIELD_LIMITS = {
    "companies": (2, 80, 8, _HOSTS + ["formation", "education", "skills", "competences"], False),
    "job_titles": (3, 80, 8, _HOSTS + ["formation", "education"], False),
    "education": (3, 120, 6, _HOSTS, True),
    "skills": (2, 60, 30, _HOSTS, False),
    "languages": (2, 30, 8, [], False),
    "soft_skills": (2, 60, 20, _HOSTS, False),
    "projects": (4, 180, 15, _HOSTS, True),
    "certifications": (3, 140, 15, _HOSTS, True),
}


def postprocess_profiles(df: DataFrame, cap_lists: bool = False) -> DataFrame:
    """Clean every field of a profile table (with ``cap_lists``, the lists are cut to the items of FIELD_LIMITS); needs full_name, emails, phones and the listed array columns."""
    fields = {name: clean_list(name, lo, hi, cap if cap_lists else None, banned, years)
              for name, (lo, hi, cap, banned, years) in FIELD_LIMITS.items()}
    return df.withColumns({
        "emails": clean_emails("emails"), "phones": clean_phones("phones"), "full_name": clean_name("full_name"), **fields,
    }).withColumns({"email": F.get("emails", F.lit(0)), "phone": F.get("phones", F.lit(0))})


MERGE_SCALARS = ["full_name", "email", "phone", "linkedin_url", "profile_summary"]


def merge_profiles(base: DataFrame, other: DataFrame, key: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """Scalars of the base unless missing; lists concatenated, ordered and distinct ignoring case and outer blanks."""
    right = other.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in scalars + lists])
    joined = base.join(right, key, "full")
    merged_scalars = {c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(f"_{c}")) for c in scalars}
    merged_lists = {
        c: ordered_distinct(
            F.filter(F.concat(_list(c), _list(f"_{c}")), lambda s: F.trim(s) != ""), lambda s: F.lower(F.trim(s)))
        for c in lists
    }
    return joined.withColumns({**merged_scalars, **merged_lists}).select(key, *scalars, *lists)


def _has(name: str, df: DataFrame) -> Column:
    dtype = df.schema[name].dataType.typeName()
    return F.coalesce(F.size(name) > 0 if dtype == "array" else F.col(name) != "", F.lit(False))


def _points(df: DataFrame, weights: dict[str, int]) -> Column:
    total = sum((F.when(_has(c, df), w).otherwise(0) for c, w in weights.items()), F.lit(0))
    return F.least(total, F.lit(100)).cast("double")


# Points per field of the three quality scores.
QUALITY_POINTS = {"full_name": 20, "email": 20, "phone": 10, "job_titles": 20, "companies": 20, "education": 10,
                  "languages": 5, "soft_skills": 5, "interests": 5, "profile_summary": 5}
ENTITY_POINTS = {"full_name": 20, "email": 20, "phone": 10, "companies": 20, "job_titles": 15, "locations": 10}
FIVE_POINTS = {"full_name": 20, "emails": 20, "job_titles": 20, "companies": 20, "skills": 20}


def quality_pct(df: DataFrame) -> DataFrame:
    return df.withColumn("quality_pct", _points(df, QUALITY_POINTS))


def quality_entities_pct(df: DataFrame) -> DataFrame:
    """Needs ``total_entities`` too: any entity gives five points."""
    base = _points(df, ENTITY_POINTS) + F.when(F.col("total_entities") > 0, 5).otherwise(0)
    return df.withColumn("quality_entities_pct", F.least(base, F.lit(100.0)))


def quality_five_pct(df: DataFrame) -> DataFrame:
    return df.withColumn("quality_five_pct", _points(df, FIVE_POINTS))


def extraction_flags(df: DataFrame, *scores: str) -> DataFrame:
    """Final quality is the best variant; 80 and above counts as fully extracted."""
    best = F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])
    return df.withColumn("quality_pct", best).withColumn("is_fully_extracted", F.col("quality_pct") >= 80)


def profiles_to_candidates(df: DataFrame) -> DataFrame:
    """Candidate columns of a profile: name falls back to the address, then to Unknown; lists become JSON text."""
    from ..functions.contact import name_from_email

    emails = F.when(F.size("emails") > 0, F.col("emails")).otherwise(F.array_compact(F.array("email")))
    phones = F.when(F.size("phones") > 0, F.col("phones")).otherwise(F.array_compact(F.array("phone")))
    first = F.get(emails, F.lit(0))
    name = F.coalesce(F.nullif("full_name", F.lit("")), name_from_email(first, 5, 3), F.lit("Unknown"))
    return df.select(
        "cv_id", name.alias("full_name"), first.alias("email"), F.get(phones, F.lit(0)).alias("phone"), "linkedin_url",
        F.col("full_name").alias("extracted_name"),
        *[F.to_json(c).alias(f"extracted_{n}") for n, c in (
            ("emails", emails), ("phones", phones), ("job_titles", _list("job_titles")), ("companies", _list("companies")),
            ("education", _list("education")))],
        "quality_pct", (F.col("quality_pct") >= 80).alias("is_fully_extracted"),
    )


def _real_name() -> Column:
    return F.col("full_name").isNotNull() & ~F.col("full_name").isin("Unknown", "")


def matchable(df: DataFrame) -> DataFrame:
    """Candidates that take part in matching."""
    extracted = F.col("is_fully_extracted") | (F.col("quality_pct") >= 80)
    return df.filter(extracted & _real_name() & F.col("raw_text").isNotNull())


def displayable(df: DataFrame) -> DataFrame:
    return df.filter((F.col("quality_pct") >= 80) & _real_name() & F.col("raw_text").rlike(NON_SPACE))


def real_identity(df: DataFrame) -> DataFrame:
    """Drop placeholder names and addresses."""
    both = F.trim(F.concat_ws(" ", F.lower(F.trim(F.coalesce("full_name", F.lit("")))),
                              F.lower(F.trim(F.coalesce("email", F.lit(""))))))
    return df.filter((both != "") & ~both.rlike(r"\b(unknown|target\s+test|test|demo|sample|mock)\b"))


# Profile keys a stored extraction must hold.
PROFILE_KEYS = ["languages", "experiences", "projects", "certifications", "github_urls", "portfolio_urls"]


def refresh_reasons(df: DataFrame) -> DataFrame:
    """Adds ``needs_refresh``: a stored text whose extraction is weak or incomplete."""
    blank = [F.coalesce(F.col(c) == "", F.lit(True)) for c in (
        "linkedin_url", "extracted_job_titles", "extracted_companies", "extracted_education", "ner_json")]
    keys = [F.coalesce(~F.col("ner_json").contains(f'"{k}"'), F.lit(True)) for k in PROFILE_KEYS]
    weak = F.coalesce("quality_pct", F.lit(0.0)) < 80
    unknown = F.coalesce(F.col("full_name") == "Unknown", F.lit(False))
    incomplete = unknown
    for reason in blank + keys:
        incomplete = incomplete | reason
    stored = F.coalesce(F.col("raw_text") != "", F.lit(False))
    return df.withColumn("incomplete", incomplete).withColumn("needs_refresh", stored & (weak | incomplete))


def needs_refresh(df: DataFrame) -> DataFrame:
    return refresh_reasons(df).filter("needs_refresh")


def keep_better(current: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Ids whose re-extraction replaces the stored one: better quality, or the stored one is incomplete."""
    new = refreshed.select("candidate_id", F.col("quality_pct").alias("_new"))
    return refresh_reasons(current).filter("needs_refresh").join(new, "candidate_id").filter(
        (F.col("_new") > F.coalesce("quality_pct", F.lit(0.0))) | F.col("incomplete")
    ).select("candidate_id", F.col("_new").alias("quality_pct"))


def cleanup_candidates(df: DataFrame) -> DataFrame:
    """Rows a clean-up removes: low quality, placeholder names, generated addresses."""
    name, email = F.lower("full_name"), F.lower("email")
    return df.filter(
        F.col("quality_pct").isNull() | (F.col("quality_pct") < 80) | name.like("%unknown%") | name.like("%test%")
        | name.like("%demo%") | email.like("candidate-%"))


def fingerprint(df: DataFrame, name: str = "fingerprint") -> DataFrame:
    """md5 over address, phone, name and sorted skills; needs email, phone, full_name, normalized_skills."""
    email = F.trim(F.lower(F.coalesce("email", F.lit(""))))
    phone = F.translate(F.coalesce("phone", F.lit("")), " -", "")
    person = F.trim(F.lower(F.coalesce("full_name", F.lit(""))))
    skills = F.array_join(F.array_sort(_list("normalized_skills")), "")
    return df.withColumn(name, F.md5(F.concat_ws("|", email, phone, person, skills)))


def dedupe_candidates(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row (by ``order``, then ``key``) of every fingerprint.

    The winner per fingerprint is found by a pre-aggregated minimum, so a fingerprint with many copies is no hot task;
    the rows are then kept by their unique key.
    """
    marked = fingerprint(df)
    first = marked.groupBy("fingerprint").agg(F.min(F.struct(*order, key)).alias("_first"))
    return marked.join(first.select(F.col(f"_first.{key}").alias(key)), key, "left_semi")


def merge_near_duplicates(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One record per group of equal fingerprints: the one with most filled fields, the smallest key on a tie.

    Records count as duplicates when their fingerprints are equal; ``copies`` tells how many there were. The winner is
    a pre-aggregated maximum over keys, so a fingerprint with many copies is no hot task.
    """
    filled = sum((F.coalesce(F.length(F.trim(F.col(c).cast("string"))) > 0, F.lit(False)).cast("int") for c in fields), F.lit(0))
    marked = fingerprint(df).withColumn("completeness", filled)
    best = marked.groupBy("fingerprint").agg(
        F.min(F.struct((-F.col("completeness")).alias("down"), F.col(key))).alias("_best"), F.count(F.lit(1)).alias("copies"))
    return marked.join(best.select(F.col(f"_best.{key}").alias(key), "copies"), key)


def record_tokens() -> Column:
    """What a candidate record is compared by: address, phone number, each skill, and the runs of three characters of the
    name. Needs email, phone, full_name, normalized_skills."""
    email = F.trim(F.lower(F.coalesce("email", F.lit(""))))
    phone = F.translate(F.coalesce("phone", F.lit("")), " -", "")
    person = F.trim(F.lower(F.coalesce("full_name", F.lit(""))))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(person) - 2, F.lit(1))), lambda i: F.concat(F.lit("name:"), F.substring(person, i, F.lit(3))))
    fields = F.array(F.when(email != "", F.concat(F.lit("email:"), email)), F.when(phone != "", F.concat(F.lit("phone:"), phone)))
    skills = F.transform(_list("normalized_skills"), lambda s: F.concat(F.lit("skill:"), F.lower(s)))
    return F.array_compact(F.concat(fields, F.when(person != "", grams).otherwise(F.array().cast("array<string>")), skills))


def merge_similar(df: DataFrame, key: str, fields: list[str], threshold: float = 0.9) -> DataFrame:
    """One record per group of similar records: the one with most filled fields, the smallest key on a tie.

    Records are similar when the Jaccard similarity of their tokens reaches the threshold, directly or over others;
    ``copies`` tells how many the group holds, ``group`` is its smallest key.
    """
    filled = sum((F.coalesce(F.length(F.trim(F.col(c).cast("string"))) > 0, F.lit(False)).cast("int") for c in fields), F.lit(0))
    groups = cut_lineage(similar_groups(df, key, record_tokens(), threshold))
    marked = df.withColumn("completeness", filled)
    best = groups.join(marked.select(key, "completeness"), key).groupBy("group").agg(
        F.min(F.struct((-F.col("completeness")).alias("down"), F.col(key))).alias("_best"), F.count(F.lit(1)).alias("copies"))
    return marked.join(best.select("group", F.col(f"_best.{key}").alias(key), "copies"), key)


def dedupe_pairs(df: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row per (cv_text, job_text, label), the one of smallest key; texts are compared by digest."""
    digest = F.md5(F.to_json(F.struct("cv_text", "job_text", "label")))
    first = df.groupBy(digest.alias("_digest")).agg(F.min(key).alias(key))
    return df.join(first.select(key), key, "left_semi")


def clean_candidates(df: DataFrame) -> DataFrame:
    """Normalised skills, experience years (given, else parsed) and trimmed education."""
    text = F.coalesce(F.nullif("experience", F.lit("")), "summary")
    given = F.when(F.col("experience_years") > 0, F.col("experience_years"))
    return df.withColumns({
        "normalized_skills": normalize_skill_list(_list(split_skills("skills"))),
        "experience_years": F.coalesce(given, experience_years(text)),
        "education": F.trim("education"),
    })


def valid_text(df: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    """Texts of at least ten characters; ``stored_text`` is what the record keeps (``limit`` characters at most)."""
    return df.filter(F.length(strip_space(text)) >= 10).withColumn("stored_text", first_chars(F.col(text), limit))


# Weights of the coverage report and its pass mark.
SECTION_WEIGHTS = {"identity": 0.25, "experience": 0.30, "education": 0.15, "skills": 0.15, "enrichment": 0.15}
PASS_MARK = 70


def coverage_report(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Weighted share of expected items found per section; needs one count column per section on both sides."""
    want = expected.select(F.col(key), *[F.col(s).alias(f"_{s}") for s in SECTION_WEIGHTS])
    joined = found.join(want, key)

    def share(s: str) -> Column:
        none_expected = F.when(F.col(s) == 0, 100.0).otherwise(F.least(F.col(s) * 25.0, F.lit(100.0)))
        ratio = F.least(F.col(s) / F.when(F.col(f"_{s}") > 0, F.col(f"_{s}")), F.lit(1.0)) * 100
        return F.when(F.col(f"_{s}") <= 0, none_expected).otherwise(ratio)

    score = sum((share(s) * w for s, w in SECTION_WEIGHTS.items()), F.lit(0.0))
    from ..functions.text import round_dp

    return joined.select(key, round_dp(score, 1).alias("score"))


def coverage_summary(report: DataFrame) -> DataFrame:
    from ..functions.text import round_dp

    return report.agg(F.count(F.lit(1)).alias("samples"), round_dp(F.avg("score"), 4).alias("average"),
                      (F.avg("score") >= PASS_MARK).alias("passed"))


def diagnose_missing(df: DataFrame, key: str = "cv_id", text: str = "text", name_lines: int | None = None) -> DataFrame:
    """(key, field, reason) for every missing field of a profile; needs the profile columns and the text. A name line is
    looked for in the first ``name_lines`` lines, if given."""
    low = F.lower(F.col(text))
    lines = first_items(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != ""), name_lines)
    name_line = F.exists(lines, lambda s: F.regexp_count(s, F.lit(r"[A-Za-zÀ-ÿ'\-]+")).between(2, 4) & ~s.rlike(r"[@\d]"))
    has = lambda c: _has(c, df)
    none = F.lit(None).cast("string")
    reasons = [
        ("full_name", F.when(has("full_name"), none).when(name_line, "rejected_by_filters")
         .when(has("email"), "only_email").otherwise("no_name_line")),
        ("phone", F.when(has("phone"), none).when(F.col(text).rlike(r"\+?\d[\d\s().-]{7,}\d"), "rejected_by_normalisation")
         .otherwise("no_pattern")),
        ("experiences", F.when(has("experiences"), none)
         .when(contains_any(low, ["experience", "professionnelle", "stage"]), "section_without_entry").otherwise("no_section")),
        ("education", F.when(has("education"), none)
         .when(contains_any(low, ["formation", "education", "study", "universit", "school"]), "lines_not_recognised")),
        ("skills", F.when(has("skills"), none)
         .when(contains_any(low, ["python", "sql", "java", "react", "docker", "airflow", "spark"]), "terms_missed")
         .when(contains_any(low, ["communication", "organisation", "leadership", "rigueur", "autonomie", "gestion de projet",
                                  "sens du contact"]), "soft_skills_only").otherwise("no_term")),
        ("enrichment", F.when(has("linkedin_urls") | has("github_urls") | has("portfolio_urls") | has("projects")
                              | has("certifications"), none).otherwise("no_signal")),
    ]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), r.alias("reason")) for f, r in reasons])
    return df.select(key, F.inline(F.filter(rows, lambda r: r["reason"].isNotNull())))


def extraction_metadata(df: DataFrame) -> DataFrame:
    """Text length, skill and entity counts and the source of an extraction."""
    return df.select("cv_id", F.length("text").alias("raw_text_length"), F.size("skills").alias("skills_extracted"),
                     F.col("total_entities").alias("entities_found"), F.lit("text_input").alias("source"))
