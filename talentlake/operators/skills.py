"""Skill extraction, merging and linking over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.jsonlist import json_list
from ..functions.skillnames import classify_skill, normalize_skill_name
from ..functions.text import contains_any, let, round_dp, title_case
from ..plans.skew import salted_join
from .patterns import patterns_in

LONG_BITS = 62  # characters whose row of the subsequence program fits a long


def dictionary(spark: SparkSession, skills: dict[str, list[str]] | None = None) -> DataFrame:
    """The skill dictionary as (category, skill, pos)."""
    entries = [(c, s) for c, names in (skills or vocab.SKILL_DICTIONARY).items() for s in names]
    return spark.createDataFrame([(c, s, i) for i, (c, s) in enumerate(entries)], "category string, skill string, pos int")


def _escape(name: Column) -> Column:
    return F.regexp_replace(name, r"([.+*?^$()\[\]{}|\\])", r"\\$1")


def match_skills_exact(docs: DataFrame, skills: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Dictionary skills that occur in a text between non-word characters, found in one walk of each text (``patterns``).

    Only the names found, and the columns ``keep``, leave the walk; they meet the dictionary again for their category.
    """
    entries = skills.select("skill", "category")
    found = docs.select(key, *keep, F.explode(patterns_in(F.col(text), skills, "skill", whole_words=True)).alias("skill"))
    return salted_join(found, entries, ["skill"], F.col(key)).select(
        key, "skill", "category", F.lit("exact").alias("method"), F.lit(100).alias("confidence"), *keep
    )


def _sorted_tokens(name: Column) -> Column:
    cleaned = F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}_]+", " "))
    return F.array_join(F.array_sort(F.filter(F.split(cleaned, " "), lambda t: t != "")), " ")


def _common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one dynamic-programming row per character of ``a``."""
    left, right = F.split(a, ""), F.split(b, "")
    start = F.array_repeat(F.lit(0), F.length(b) + 1)

    def next_row(row: Column, ch: Column) -> Column:
        cells = F.sequence(F.lit(1), F.size(row) - 1)
        seed = F.array(F.lit(0))
        return F.aggregate(
            cells, seed,
            lambda acc, j: F.concat(acc, F.array(
                F.when(F.element_at(right, j) == ch, F.element_at(row, j) + 1)
                .otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(acc, -1))))),
        )

    return F.element_at(F.aggregate(left, start, next_row), -1)


def _letter_masks(entry: Column) -> Column:
    """Map from each character of an entry to a long whose set bits are its positions."""
    letters = F.split(entry, "")
    places = F.sequence(F.lit(0), F.size(letters) - 1)
    mask = lambda c: F.aggregate(
        places, F.lit(0).cast("bigint"), lambda m, i: F.when(F.get(letters, i) == c, m + F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(m))
    return F.map_from_entries(F.transform(F.array_distinct(letters), lambda c: F.struct(c, mask(c))))


def _common_length_bits(word: Column, entry: Column, masks: Column) -> Column:
    """Length of the longest common subsequence with an entry of at most ``LONG_BITS`` characters: a long holds one row of the
    dynamic program, and each character of the word updates all of it by one addition. Two bits stay free, so nothing overflows."""
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(entry)) - 1

    def step(row: Column, ch: Column) -> Column:
        return let(row.bitwiseAND(F.coalesce(F.try_element_at(masks, ch), F.lit(0).cast("bigint"))),
                   lambda met: (row + met).bitwiseOR(row - met).bitwiseAND(full))

    return F.length(entry) - F.bit_count(F.aggregate(F.split(word, ""), full, step))


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("int")


def _range(first: Column, last: Column) -> Column:
    """first..last as an array, empty when last is smaller."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _edits(entry: Column, word: Column, t: float) -> Column:
    """Most insertions and deletions between an entry and a word of these lengths that a ratio of ``t`` allows. Their number
    has the parity of the difference; below the difference no pair qualifies."""
    most = F.floor((entry + word) * (1 - t / 100) + 1e-9).cast("int")
    return most - F.pmod(most - entry - word, F.lit(2))


def _segment_keys(entry: Column, word: Column, t: float, of_entry: Column | None = None, of_word: Column | None = None) -> Column:
    """Keys under which an entry and a word (of these lengths) meet when at most ``_edits`` separate them.

    The entry is cut into one segment more than there are edits, so a segment survives whole, with at most as many edits to
    its left as segments and the rest to its right; that bounds where the word can hold it. With fewer characters than
    segments, each character is a segment and may lie wherever the edits can move it.
    """
    def per_edits(most: Column) -> Column:
        parts = F.least(most + 1, entry)
        gap = word - entry
        dropped, added = _floor_div(most - gap, F.lit(2)), _floor_div(most + gap, F.lit(2))

        def of_part(i: Column) -> Column:
            start, end = _floor_div(i * entry, parts), _floor_div((i + 1) * entry, parts)
            key = lambda source, at: F.xxhash64(entry, word, i, F.substring(source, at + 1, end - start))
            if of_entry is not None:
                return F.array(key(of_entry, start))
            cut = most < entry
            low = F.greatest(-dropped, F.when(cut, F.greatest(-i, gap - most + i)).otherwise(-dropped), -start)
            high = F.least(added, F.when(cut, F.least(i, gap + most - i)).otherwise(added), word - start - (end - start))
            return F.transform(_range(low, high), lambda move: key(of_word, start + move))

        keys = F.flatten(F.transform(_range(F.lit(0), parts - 1), of_part))
        return F.when(most >= F.abs(gap), keys).otherwise(F.array().cast("array<bigint>"))

    return let(_edits(entry, word, t), per_edits)


def match_words_fuzzy(words: DataFrame, skills: DataFrame, threshold: int = 80) -> DataFrame:
    """Best dictionary entry per distinct ``word`` (token-sort ratio at least ``threshold``; ties: the first entry).

    Words and entries meet by equality of segment keys (``_segment_keys``), exact for any length; ``levenshtein`` with a limit
    discards most of the rest before the ratio is computed. A ratio above 0 is needed, so ``threshold`` must be 1 or more.
    """
    t = threshold - 0.5  # the ratio is rounded before it is compared
    entries = skills.select("skill", "category", "pos", _sorted_tokens(F.col("skill")).alias("_entry")).filter(F.length("_entry") > 0)
    lengths = sorted(r[0] for r in entries.select(F.length("_entry")).distinct().collect())  # lengths, not entries
    of_length = F.length("_entry")
    reach = F.sequence(F.ceil(of_length * t / (200 - t)).cast("int"), F.floor(of_length * (200 - t) / t).cast("int"))
    short = of_length <= LONG_BITS
    held = entries.withColumn("_masks", F.when(short, _letter_masks(F.col("_entry")))).withColumn(
        "_key", F.explode(F.flatten(F.transform(reach, lambda n: _segment_keys(of_length, n, t, of_entry=F.col("_entry"))))))
    size = F.length("_word")
    near = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"),
                    lambda n: (n >= F.ceil(size * t / (200 - t))) & (n <= F.floor(size * (200 - t) / t)))
    # A word takes far more work than bytes: a counted exchange, which adaptive execution does not merge, keeps it spread.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = words.select("word").repartition(tasks, "word").withColumn("_word", _sorted_tokens(F.col("word"))).filter(size > 0).withColumn(
        "_key", F.explode(F.array_distinct(F.flatten(F.transform(near, lambda n: _segment_keys(n, size, t, of_word=F.col("_word")))))))
    total = F.length("_word") + F.length("_entry")
    close = salted_join(keyed, held, ["_key"], F.col("word")).filter(
        F.levenshtein("_word", "_entry") <= F.floor(total * (1 - t / 100) + 1e-9))
    common = F.when(short, _common_length_bits(F.col("_word"), F.col("_entry"), F.col("_masks"))).otherwise(
        _common_length(F.col("_word"), F.col("_entry")))
    ratio = F.round(200 * common / total, 0).cast("int")
    best = F.max_by(F.struct("skill", "category", "_ratio"), F.struct("_ratio", -F.col("pos")))
    return (
        close.withColumn("_ratio", ratio).filter(F.col("_ratio") >= threshold).groupBy("word").agg(best.alias("_b"))
        .select("word", "_b.skill", "_b.category", F.lit("fuzzy").alias("method"), F.col("_b._ratio").alias("confidence"))
    )


def match_skills_fuzzy(
    docs: DataFrame, skills: DataFrame, threshold: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Best dictionary entry for each distinct word of three or more characters.

    The ratio is computed once per distinct word of the corpus; hot words meet the small matched vocabulary in a
    join that adaptive execution broadcasts or splits.
    """
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}_][\p{L}\p{N}_\-]*[\p{L}\p{N}_])"))
    pairs = docs.select(key, F.explode(F.array_distinct(tokens)).alias("word")).filter(F.length("word") > 2)
    matched = match_words_fuzzy(pairs.select("word").distinct(), skills, threshold)
    return pairs.join(matched, "word")


def extract_skills(
    docs: DataFrame, skills: DataFrame, threshold: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Exact matches first, then fuzzy ones for skills not yet found; one row per document and skill."""
    exact = match_skills_exact(docs, skills, key, text)
    fuzzy = match_skills_fuzzy(docs, skills, threshold, key, text).drop("word")
    both = exact.withColumn("_rank", F.lit(1)).unionByName(fuzzy.withColumn("_rank", F.lit(0)))
    best = F.max_by(F.struct("category", "method", "confidence"), F.struct("_rank", "confidence"))
    return both.groupBy(key, "skill").agg(best.alias("_b")).select(key, "skill", "_b.*")


def skill_proficiency(mentions: DataFrame, text: str = "text", skill: str = "skill") -> DataFrame:
    """Level cue found within 100 characters of a mention (same line); adds ``proficiency``."""
    name = F.lower(F.col(skill))
    left = F.when(name.rlike(r"^\w"), F.lit(r"\b")).otherwise(F.lit(""))
    right = F.when(name.rlike(r"\w$"), F.lit(r"\b")).otherwise(F.lit(""))
    pattern = F.concat(F.lit("(.{0,100}"), left, _escape(name), right, F.lit(".{0,100})"))
    context = F.array_join(F.regexp_extract_all(F.lower(F.col(text)), pattern), " ")

    def level_of(near: Column) -> Column:
        level = F.when(near == "", "beginner")
        for label, words in vocab.PROFICIENCY_WORDS.items():
            level = level.when(contains_any(near, words), label)
        return level.otherwise("beginner")

    return mentions.withColumn("proficiency", let(context, level_of))


def merge_skills(recognised: DataFrame, from_dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """Recogniser rows win over dictionary rows of the same name; dictionary rows get confidence 0.80.

    Both need (key, name, category, method, confidence).
    """
    first = recognised.withColumn("source", F.lit("NER")).withColumn("_rank", F.lit(1))
    second = (from_dictionary.withColumn("confidence", F.lit(0.80)).withColumn("source", F.lit("DICT-FUZZY"))
              .withColumn("_rank", F.lit(0)))
    both = first.unionByName(second).withColumn("_name", F.lower("name"))
    best = F.max_by(F.struct("name", "source", "category", "method", "confidence"),
                    F.struct("_rank", "confidence", "name"))
    return both.groupBy(key, "_name").agg(best.alias("_b")).select(key, "_b.*")


def filter_recognised(df: DataFrame) -> DataFrame:
    """Usable recogniser rows: group, score and length limits; word-piece marks removed. Adds name and category."""
    word = F.trim(F.regexp_replace(F.replace(F.trim("word"), F.lit("##"), F.lit("")), r"\s+", " "))
    kept = df.filter(F.upper("entity_group").isin("MISC", "ORG", "SKILL") & (F.col("score") > 0.70)).withColumn(
        "_word", word).filter(F.length("_word") >= 2)
    return kept.withColumn("name", title_case("_word")).withColumn("category", classify_skill("_word")).drop("_word")


def skill_stats(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: count, counts by source, mean confidence, the three most confident names."""
    by_source = df.groupBy(key, "source").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"))
    totals = by_source.groupBy(key).agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"),
        round_dp(F.sum("c") / F.sum("n"), 3).alias("avg_confidence"),
    )
    top = Window.partitionBy(key).orderBy(F.desc("confidence"), F.asc("name"))
    best = (df.withColumn("_pos", F.row_number().over(top)).filter(F.col("_pos") <= 3).groupBy(key)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "name"))), lambda s: s["name"]).alias("top_3")))
    return totals.join(best, key)


def candidate_skill_set(candidates: DataFrame, candidate_skills: DataFrame) -> DataFrame:
    """(candidate_id, skill): linked skills and the skills of the stored profile, normalised and distinct."""
    linked = candidate_skills.select("candidate_id", normalize_skill_name("skill").alias("skill"))
    stored = candidates.filter(F.col("ner_json").isNotNull()).select(
        "candidate_id", F.explode(json_list(F.get_json_object("ner_json", "$.skills"))).alias("raw")
    ).select("candidate_id", normalize_skill_name("raw").alias("skill"))
    return linked.unionByName(stored).filter(F.col("skill") != "").distinct()


def skill_universe(skills: DataFrame, fallback: DataFrame) -> DataFrame:
    """Distinct normalised names of the skill table, or of the dictionary when the table is empty."""
    source = skills.select("name")
    if source.isEmpty():
        source = fallback.select(F.col("skill").alias("name"))
    return source.select(normalize_skill_name("name").alias("skill")).filter(F.col("skill") != "").distinct()


def upsert_skills(names: DataFrame, skills: DataFrame) -> DataFrame:
    """The skill table plus the names it lacks (ignoring case) in category tech.

    New ids are a hash of the name, so that no global numbering is needed; they lie above every sequential id.
    """
    wanted = names.select(normalize_skill_name("name").alias("name")).filter(F.col("name") != "")
    wanted = wanted.groupBy(F.lower("name").alias("_key")).agg(F.min("name").alias("name"))
    known = skills.select(F.lower("name").alias("_key"))
    new = wanted.join(known, "_key", "left_anti").select(
        skill_surrogate("name").alias("skill_id"), "name", F.lit("tech").alias("category")
    )
    return skills.select("skill_id", "name", "category").unionByName(new)


def skill_surrogate(name: str) -> Column:
    """Stable id of a new skill, from the md5 of its lower-case name."""
    return F.conv(F.left(F.md5(F.lower(F.col(name))), F.lit(12)), 16, 10).cast("bigint") + F.lit(1 << 50)


def link_candidate_skills(found: DataFrame, skills: DataFrame) -> DataFrame:
    """(candidate_id, skill_id, proficiency, source) for extracted skills; proficiency starts at intermediate."""
    known = skills.select("skill_id", F.lower("name").alias("_key"))
    return found.withColumn("_key", F.lower("name")).join(known, "_key").select(
        "candidate_id", "skill_id", F.lit("intermediate").alias("proficiency"),
        F.coalesce("source", F.lit("extracted")).alias("source"),
    ).distinct()




def canonicalise_by_embedding(found: DataFrame, nearest: DataFrame, key: str) -> DataFrame:
    """Skill variants renamed to their canonical skill where one is near enough, then one row per (key, name).

    ``nearest`` holds (query_id, canonical, similarity) from ``joins.nearest_join``.
    """
    mapped = found.join(nearest.select("query_id", "canonical", "similarity"), "query_id", "left").withColumn(
        "name", F.coalesce("canonical", "name"))
    return mapped.groupBy(key, "name").agg(F.max("similarity").alias("similarity"))
