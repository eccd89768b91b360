"""Skill normalisation, extraction, merging and linking."""

from pyspark.sql import functions as F

from .. import vocab
from ..functions import skillnames as sn
from ..operators import skills as sk
from .oracle_views import DICTIONARY, category, classified, dictionary_hits, skill, skill_name, sql_list
from .registry import query, rnd
from .text_queries import json_items, titled


@query("k01_normalize_skill_name", f"SELECT row_id, raw, {skill_name('raw')} AS skill FROM {{raw_skills}}")
def _(t):
    return t.raw_skills.withColumn("skill", sn.normalize_skill_name("raw")).select("row_id", "raw", "skill")


@query("k02_normalize_skill", f"SELECT row_id, raw, {skill('raw')} AS skill FROM {{raw_skills}}")
def _(t):
    return t.raw_skills.withColumn("skill", sn.normalize_skill("raw")).select("row_id", "raw", "skill")


@query("k03_normalize_skill_list", f"""
    SELECT owner_id, string_agg(skill, ', ' ORDER BY first_row) AS skills FROM (
        SELECT owner_id, {skill('raw')} AS skill, min(row_id) AS first_row FROM {{raw_skills}} GROUP BY 1, 2)
    WHERE skill <> '' GROUP BY owner_id""")
def _(t):
    ordered = F.array_sort(F.collect_list(F.struct("row_id", "raw")))
    lists = t.raw_skills.groupBy("owner_id").agg(F.transform(ordered, lambda s: s["raw"]).alias("raw"))
    return lists.select("owner_id", F.array_join(sn.normalize_skill_list("raw"), ", ").alias("skills")).filter("skills <> ''")


@query("k04_split_skills", r"""
    SELECT p_partkey, array_to_string(regexp_split_to_array(p_name || '; ' || p_brand || ',' || p_type || '/ x\y', '[,;/\\]\s*'), '|')
        AS parts FROM part""")
def _(t):
    raw = F.concat("p_name", F.lit("; "), "p_brand", F.lit(","), "p_type", F.lit("/ x\\y"))
    return t.part.select("p_partkey", F.array_join(sn.split_skills(raw), "|").alias("parts"))


@query("k05_skill_category", f"""
    SELECT row_id, coalesce({category('raw')}, 'unknown') AS category FROM {{raw_skills}} WHERE raw IS NOT NULL""")
def _(t):
    return t.raw_skills.filter("raw IS NOT NULL").select("row_id", sn.skill_category("raw").alias("category"))


_EXACT = {**DICTIONARY, "exact_hits": dictionary_hits("{cv_texts}", "cv_id"),
          "document_hits": dictionary_hits("documents", "doc_id")}


@query("k06_match_skills_exact", """
    SELECT cv_id, skill, category, 'exact' AS method, 100 AS confidence FROM {exact_hits}""", _EXACT)
def _(t):
    return sk.match_skills_exact(t.cv_texts, sk.dictionary(t.spark), "cv_id")


@query("k06_match_skills_exact_documents", """
    SELECT doc_id, skill, category, 'exact' AS method, 100 AS confidence FROM {document_hits}""", _EXACT)
def _(t):
    return sk.match_skills_exact(t.documents, sk.dictionary(t.spark))


# All pairs of a distinct word and a dictionary entry whose lengths allow the ratio; no index.
_WORDS_SQL = r"""
    SELECT DISTINCT cv_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_\-]*[\p{L}\p{N}_]')) AS word FROM {cv_texts}"""


def _tokens_sorted(x: str) -> str:
    return (f"array_to_string(list_sort(list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), "
            "lambda s: s <> '')), ' ')")


def _fuzzy_views(threshold: int) -> dict[str, str]:
    return {**_EXACT, "cv_words": _WORDS_SQL, "word_pairs": f"""
        SELECT word, w, skill, category, pos, e FROM (SELECT word, {_tokens_sorted('word')} AS w FROM (
            SELECT DISTINCT word FROM {{cv_words}}) WHERE length(word) > 2) JOIN (
            SELECT *, {_tokens_sorted('skill')} AS e FROM {{dictionary}}) ON 2 * least(length(w), length(e)) * 100 >= ({threshold} - 0.5) * (length(w) + length(e))
        WHERE w <> ''""", "word_rows": """
        SELECT *, (1::BIGINT << length(e)) - 1 AS bits, list_transform(string_split(w, ''), lambda c: list_sum(list_transform(
            range(1, length(e) + 1), lambda i: CASE WHEN e[i] = c THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT) AS masks FROM {word_pairs}""",
            "word_ratios": """
        SELECT word, skill, category, pos, CAST(round(200.0 * (length(e) - bit_count(list_reduce(list_prepend(bits, masks),
            lambda v, m: ((v + (v & m)) | (v - (v & m))) & bits))) / (length(w) + length(e))) AS INTEGER) AS ratio FROM {word_rows}""",
            "fuzzy_words": f"""
        SELECT word, skill, category, ratio FROM {{word_ratios}} WHERE ratio >= {threshold}
        QUALIFY row_number() OVER (PARTITION BY word ORDER BY ratio DESC, pos) = 1"""}


@query("k07_match_skills_fuzzy", """
    SELECT cv_id, word, skill, category, 'fuzzy' AS method, ratio AS confidence FROM {cv_words} JOIN {fuzzy_words} USING (word)""",
       _fuzzy_views(80))
def _(t):
    return sk.match_skills_fuzzy(t.cv_texts, sk.dictionary(t.spark), 80, "cv_id")


@query("k07_fuzzy_prefilter", r"""
    SELECT word, skill, levenshtein(word, lower(skill)) AS distance
    FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM {cv_texts})
         JOIN {dictionary} ON length(word) = length(skill)
    WHERE length(word) > 2 AND levenshtein(word, lower(skill)) <= 2""", DICTIONARY)
def _(t):
    words = t.cv_texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"))).alias("word"))
    words = words.filter(F.length("word") > 2).distinct().withColumn("n", F.length("word"))
    entries = sk.dictionary(t.spark).select("skill", F.length("skill").alias("n"))
    distance = F.levenshtein("word", F.lower("skill"))
    return words.join(F.broadcast(entries), "n").withColumn("distance", distance).filter("distance <= 2").drop("n")


@query("k08_extract_skills", """
    SELECT cv_id, skill, category, method, confidence FROM (
        SELECT cv_id, skill, category, 'exact' AS method, 100 AS confidence, 1 AS prio FROM {exact_hits} UNION ALL
        SELECT cv_id, skill, category, 'fuzzy', ratio, 0 FROM {cv_words} JOIN {fuzzy_words} USING (word))
    QUALIFY row_number() OVER (PARTITION BY cv_id, skill ORDER BY prio DESC, confidence DESC) = 1""", _fuzzy_views(85))
def _(t):
    return sk.extract_skills(t.cv_texts, sk.dictionary(t.spark), 85, "cv_id")


_LEVEL = " ".join(f"WHEN regexp_matches(ctx, '{'|'.join(words)}') THEN '{level}'"
                  for level, words in vocab.PROFICIENCY_WORDS.items())


_WORD_SKILLS = [s for names in vocab.SKILL_DICTIONARY.values() for s in names if s.replace(" ", "").isalpha()]
_CONTEXTS = {"contexts": " UNION ALL ".join(
    f"SELECT cv_id, '{s}' AS skill, array_to_string(regexp_extract_all(low, '.{{0,100}}\\b{s.lower()}\\b.{{0,100}}'), ' ') AS ctx "
    f"FROM {{lowered_cvs}} WHERE regexp_matches(low, '\\b{s.lower()}\\b')" for s in _WORD_SKILLS),
    "lowered_cvs": "SELECT cv_id, lower(text) AS low FROM {cv_texts}"}


@query("k09_skill_proficiency", f"""
    SELECT cv_id, skill, CASE WHEN ctx = '' THEN 'beginner' {_LEVEL} ELSE 'beginner' END AS proficiency FROM {{contexts}}""",
       _CONTEXTS)
def _(t):
    hits = sk.match_skills_exact(t.cv_texts, sk.dictionary(t.spark), "cv_id", keep=("text",))
    return sk.skill_proficiency(hits).select("cv_id", "skill", "proficiency")


@query("k10_tech_skills", f"""
    SELECT cv_id, array_to_string(list_sort(list_transform(list_filter({sql_list(vocab.TECH_SKILLS)}, lambda s:
        CASE WHEN s LIKE '% %' THEN regexp_matches(lower(text), '\\b' || s || '\\b')
             ELSE list_contains(regexp_extract_all(lower(text), '[a-zA-Z0-9+#.\\-]+'), s) END),
        lambda s: {titled('s').replace('lambda w', 'lambda w')})), ', ') AS skills
    FROM {{cv_texts}}""")
def _(t):
    return t.cv_texts.select("cv_id", F.array_join(sn.tech_skills("text"), ", ").alias("skills"))


# Recogniser output stands in the events table: one row per tagged word.
RECOGNISED = {"recognised": """
    SELECT user_id AS doc_id, event_id AS pos,
           CASE event_type WHEN 'click' THEN 'SKILL' WHEN 'view' THEN 'org' WHEN 'purchase' THEN 'MISC'
                WHEN 'signup' THEN 'PER' ELSE 'LOC' END AS entity_group,
           CASE event_id % 7 WHEN 0 THEN 'pyth##on' WHEN 1 THEN ' React  native ' WHEN 2 THEN 'x' WHEN 3 THEN 'team planning'
                WHEN 4 THEN 'english' WHEN 5 THEN 'Docker' ELSE 'item ' || CAST(event_id % 5 AS VARCHAR) END AS word,
           CAST(event_id % 101 AS DOUBLE) / 100 AS score
    FROM events"""}


def recognised(t):
    word = F.expr("""CASE event_id % 7 WHEN 0 THEN 'pyth##on' WHEN 1 THEN ' React  native ' WHEN 2 THEN 'x'
        WHEN 3 THEN 'team planning' WHEN 4 THEN 'english' WHEN 5 THEN 'Docker'
        ELSE concat('item ', event_id % 5) END""")
    group = F.expr("""CASE event_type WHEN 'click' THEN 'SKILL' WHEN 'view' THEN 'org' WHEN 'purchase' THEN 'MISC'
        WHEN 'signup' THEN 'PER' ELSE 'LOC' END""")
    return t.events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), group.alias("entity_group"),
                           word.alias("word"), (F.expr("event_id % 101").cast("double") / 100).alias("score"))


_KEPT = {**RECOGNISED, "kept": f"""
    SELECT doc_id, pos, {titled('w')} AS name, {classified('w')} AS category, score AS confidence FROM (
        SELECT *, trim(regexp_replace(replace(trim(word), '##', ''), '\\s+', ' ', 'g')) AS w FROM {{recognised}}
        WHERE upper(entity_group) IN ('MISC', 'ORG', 'SKILL') AND score > 0.70)
    WHERE length(w) >= 2""", "dict_rows": """
    SELECT user_id AS doc_id, 'PYTHON' AS name, 'tech' AS category FROM events WHERE event_id % 3 = 0 GROUP BY 1
    UNION ALL SELECT user_id, 'Kafka', 'tech' FROM events WHERE event_id % 4 = 0 GROUP BY 1""", "merged": """
    SELECT doc_id, name, source, category, confidence FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY prio, confidence DESC, name DESC) AS rn FROM (
            SELECT doc_id, name, 'NER' AS source, category, confidence, 1 AS prio FROM {kept}
            UNION ALL SELECT doc_id, name, 'DICT-FUZZY', category, 0.80, 2 FROM {dict_rows})) WHERE rn = 1"""}


def kept_rows(t):
    kept = sk.filter_recognised(recognised(t))
    return kept.select("doc_id", "name", "category", F.lit("NER").alias("method"), F.col("score").alias("confidence"))


def merged_rows(t):
    def found(name, step):
        return t.events.filter(f"event_id % {step} = 0").select(F.col("user_id").alias("doc_id")).distinct().select(
            "doc_id", F.lit(name).alias("name"), F.lit("tech").alias("category"), F.lit("exact").alias("method"))

    return sk.merge_skills(kept_rows(t), found("PYTHON", 3).unionByName(found("Kafka", 4)))


@query("k12_merge_skills", "SELECT * FROM {merged}", _KEPT)
def _(t):
    return merged_rows(t).select("doc_id", "name", "source", "category", "confidence")


@query("k14_classify_skill", f"""
    SELECT row_id, {classified('raw')} AS category FROM {{raw_skills}} WHERE raw IS NOT NULL""")
def _(t):
    return t.raw_skills.filter("raw IS NOT NULL").select("row_id", sn.classify_skill("raw").alias("category"))


@query("k15_skill_stats", f"""
    SELECT doc_id, total, by_source, avg_confidence, top_3 FROM (
        SELECT doc_id, count(*) AS total, {rnd('avg(confidence)', 3)} AS avg_confidence FROM {{merged}} GROUP BY doc_id)
    JOIN (SELECT doc_id, string_agg(source || '=' || n, ',' ORDER BY source) AS by_source FROM (
        SELECT doc_id, source, count(*) AS n FROM {{merged}} GROUP BY ALL) GROUP BY doc_id) USING (doc_id)
    JOIN (SELECT doc_id, string_agg(name, ',' ORDER BY pos) AS top_3 FROM (
        SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, name) AS pos FROM {{merged}})
        WHERE pos <= 3 GROUP BY doc_id) USING (doc_id)""", _KEPT)
def _(t):
    stats = sk.skill_stats(merged_rows(t))
    pairs = F.transform(F.map_entries("by_source"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return stats.select("doc_id", "total", F.array_join(pairs, ",").alias("by_source"), "avg_confidence",
                        F.array_join("top_3", ",").alias("top_3"))


@query("k16_filter_recognised", "SELECT doc_id, pos, name, category, confidence FROM {kept}", _KEPT)
def _(t):
    return sk.filter_recognised(recognised(t)).select("doc_id", "pos", "name", "category", F.col("score").alias("confidence"))


SKILL_SETS = {"skill_sets": f"""
    SELECT DISTINCT candidate_id, skill FROM (
        SELECT candidate_id, {skill_name('skill')} AS skill FROM {{candidate_skills}}
        UNION ALL SELECT candidate_id, {skill_name('raw')} FROM (
            SELECT candidate_id, unnest({json_items("json_extract(CASE WHEN json_valid(ner_json) THEN ner_json END, '$.skills')")}) AS raw
            FROM {{candidates}}))
    WHERE skill <> ''"""}


@query("k17_candidate_skill_set", "SELECT candidate_id, skill FROM {skill_sets}", SKILL_SETS)
def _(t):
    return sk.candidate_skill_set(t.candidates, t.candidate_skills)


@query("k18_skill_universe", f"SELECT DISTINCT {skill_name('name')} AS skill FROM {{skills}}")
def _(t):
    return sk.skill_universe(t.skills, sk.dictionary(t.spark))


@query("k19_upsert_skills", f"""
    SELECT name, category, skill_id >= 0 AS has_id FROM {{skills}}
    UNION ALL SELECT min(name), 'tech', TRUE FROM (SELECT {skill_name('raw')} AS name FROM {{raw_skills}})
    WHERE name <> '' AND lower(name) NOT IN (SELECT lower(name) FROM {{skills}}) GROUP BY lower(name)""")
def _(t):
    merged = sk.upsert_skills(t.raw_skills.select(F.col("raw").alias("name")), t.skills)
    return merged.select("name", "category", (F.col("skill_id") >= 0).alias("has_id"))


@query("k20_link_candidate_skills", f"""
    SELECT DISTINCT r.owner_id AS candidate_id, s.skill_id, 'intermediate' AS proficiency, 'extracted' AS source
    FROM {{raw_skills}} r JOIN {{skills}} s ON lower(s.name) = lower({skill_name('r.raw')})""")
def _(t):
    found = t.raw_skills.select(F.col("owner_id").alias("candidate_id"), sn.normalize_skill_name("raw").alias("name"),
                                F.lit(None).cast("string").alias("source"))
    return sk.link_candidate_skills(found, t.skills)
