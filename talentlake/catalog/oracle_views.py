"""Views and SQL fragments that only the checking engine uses."""

from __future__ import annotations

from .. import vocab
from .text_queries import norm, titled


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


_ENTRIES = [(c, s) for c, names in vocab.SKILL_DICTIONARY.items() for s in names]
_SPELLING = {s.lower(): s for _, s in reversed(_ENTRIES)}
_CATEGORY = {s.lower(): c for c, s in _ENTRIES}

DICTIONARY = {
    "dictionary": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{s}', {i})" for i, (c, s) in enumerate(_ENTRIES))
                  + ") AS d(category, skill, pos)"
}


def skill_name(x: str) -> str:
    text = f"trim(regexp_replace(replace({norm(x)}, '/', ' '), ' +', ' ', 'g'))"
    return f"coalesce({sql_map(vocab.SKILL_ALIASES)}[lower({text})], {titled(text)}, '')"


def skill(x: str) -> str:
    bare = f"regexp_replace(trim(coalesce({x}, '')), '[\\n()\\[\\]\\\\/]', ' ', 'g')"
    text = norm(f"regexp_replace({bare}, '[.,;:]$', '')")
    return (f"coalesce({sql_map(vocab.SKILL_MAPPINGS)}[lower({text})], {sql_map(_SPELLING)}[lower({text})], "
            f"CASE WHEN length({text}) <= 3 THEN upper({text}) ELSE {titled(text)} END)")


def category(x: str) -> str:
    return f"{sql_map(_CATEGORY)}[lower({x})]"


def classified(x: str) -> str:
    rules = " ".join(f"WHEN regexp_matches(lower({x}), '{'|'.join(words)}') THEN '{c}'"
                     for c, words in vocab.CATEGORY_WORDS.items())
    return f"coalesce({category(x)}, CASE {rules} ELSE 'tech' END)"


def marked(x: str) -> str:
    """Lower case with every word fenced by chr(1), so that a substring test respects word limits."""
    return f"regexp_replace(lower({x}), '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(1), 'g')"


def dictionary_hits(table: str, key: str) -> str:
    """(key, skill, category) of dictionary names that stand between non-word characters; a name that ends in a symbol
    must not run into a word."""
    return f"""
        SELECT {key}, skill, category
        FROM (SELECT {key}, {marked('text')} AS m FROM {table}) c
             JOIN (SELECT skill, category, {marked('skill')} AS n FROM {{dictionary}}) d ON contains(m, n)
        WHERE regexp_matches(skill, '[\\p{{L}}\\p{{N}}_]$') OR contains(replace(m, n || chr(1), ''), n)"""
