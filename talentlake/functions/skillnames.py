"""Canonical skill names as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import as_column, contains_any, first_items, normalize_text, title_case

_SPELLING = {s.lower(): s for skills in reversed(vocab.SKILL_DICTIONARY.values()) for s in skills}
_CATEGORY = {s.lower(): category for category, skills in vocab.SKILL_DICTIONARY.items() for s in skills}


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    """Value of a small fixed map, null when absent."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    return F.try_element_at(literal, key)


def normalize_skill_name(value: Column | str) -> Column:
    """Alias, else title case; slashes count as blanks."""
    text = F.trim(F.regexp_replace(F.replace(normalize_text(value), F.lit("/"), F.lit(" ")), " +", " "))
    return F.coalesce(_lookup(vocab.SKILL_ALIASES, F.lower(text)), title_case(text), F.lit(""))


def normalize_skill(value: Column | str) -> Column:
    """Mapping, else dictionary spelling, else upper case for up to three letters, else title case."""
    bare = F.regexp_replace(F.trim(F.coalesce(as_column(value), F.lit(""))), r"[\n()\[\]\\/]", " ")
    text = normalize_text(F.regexp_replace(bare, r"[.,;:]$", ""))
    key = F.lower(text)
    fallback = F.when(F.length(key) <= 3, F.upper(text)).otherwise(title_case(text))
    return F.coalesce(_lookup(vocab.SKILL_MAPPINGS, key), _lookup(_SPELLING, key), fallback, F.lit(""))


def normalize_skill_list(items: Column | str) -> Column:
    """Normalised names, blanks dropped, first occurrence kept."""
    names = F.transform(as_column(items), normalize_skill)
    return F.array_distinct(F.filter(names, lambda s: s != ""))


def split_skills(value: Column | str) -> Column:
    return F.split(as_column(value), r"[,;/\\]\s*")


def skill_category(value: Column | str) -> Column:
    return F.coalesce(_lookup(_CATEGORY, F.lower(as_column(value))), F.lit("unknown"))


def classify_skill(value: Column | str) -> Column:
    """Dictionary category, else the first category with a cue word, else tech."""
    lowered = F.lower(as_column(value))
    out = F.when(_lookup(_CATEGORY, lowered).isNotNull(), _lookup(_CATEGORY, lowered))
    for category, words in vocab.CATEGORY_WORDS.items():
        out = out.when(contains_any(lowered, words), category)
    return out.otherwise("tech")


def tech_skills(value: Column | str, vocabulary: list[str] | None = None, limit: int | None = None) -> Column:
    """Technical terms of a text, in title case and alphabetical order."""
    words = vocabulary or vocab.TECH_SKILLS
    lowered = F.lower(F.coalesce(as_column(value), F.lit("")))
    tokens = F.regexp_extract_all(lowered, F.lit(r"([a-zA-Z0-9+#.\-]+)"))
    single = F.array_intersect(F.array(*[F.lit(w) for w in words if " " not in w]), tokens)
    phrases = F.array(*[F.when(lowered.rlike(rf"\b{p}\b"), F.lit(p)) for p in words if " " in p])
    found = F.concat(single, F.filter(phrases, lambda p: p.isNotNull()))
    return first_items(F.array_sort(F.transform(found, title_case)), limit)
