"""Text normalisation columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every Unicode white space character, spelled so that Java and RE2 agree on it.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
NON_SPACE = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"

# Latin letters with diacritics and the base letter each folds to.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to a value that is computed once; an expression used inside a lambda would otherwise be
    computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_items(items: Column, limit: int | None) -> Column:
    """The first ``limit`` items, all of them without a limit."""
    return items if limit is None else F.slice(items, 1, limit)


def first_chars(text: Column, limit: int | None) -> Column:
    """The first ``limit`` characters, all of them without a limit."""
    return text if limit is None else F.left(text, F.lit(limit))


def normalize_text(value: Column | str) -> Column:
    """Collapse all white space to single spaces, trim; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(as_column(value), F.lit("")), SPACE + "+", " "))


def compact_join(items: Column | str) -> Column:
    """Normalise every item, drop blanks, join with one space."""
    cleaned = F.filter(F.transform(as_column(items), normalize_text), lambda s: s != "")
    return F.coalesce(F.array_join(cleaned, " "), F.lit(""))


def normalize_company(value: Column | str) -> Column:
    return F.btrim(normalize_text(value), F.lit(" ,.-"))


def normalize_job_title(value: Column | str, limit: int | None = None) -> Column:
    return first_chars(normalize_text(value), limit)


def normalize_layout(value: Column | str) -> Column:
    """Keep line structure: CR to LF, runs of blanks to one, three or more line feeds to two, trim."""
    unified = F.regexp_replace(as_column(value), "\r", "\n")
    single = F.regexp_replace(unified, "[ \t]+", " ")
    paragraphs = F.regexp_replace(single, "\n{3,}", "\n\n")
    return strip_space(paragraphs)


def strip_space(value: Column | str) -> Column:
    """Strip white space (line feeds included) at both ends."""
    return F.regexp_replace(as_column(value), f"^{SPACE}+|{SPACE}+$", "")


def clean_text(value: Column | str) -> Column:
    """Collapse space, then drop links, addresses, ten-digit phones and special characters, in this order."""
    def drop(c: Column, pattern: str, probe: Column | None = None) -> Column:
        """The probe is a cheap test that spares most texts the pattern."""
        cleaned = F.regexp_replace(c, pattern, "")
        return cleaned if probe is None else F.when(probe, cleaned).otherwise(c)

    raw = as_column(value)
    out = drop(normalize_text(value), rf"http{NON_SPACE}+|www{NON_SPACE}+", raw.contains("http") | raw.contains("www"))
    # A local part starts where its run of characters starts (or where the last match ended), and is never given back:
    # long runs without an address then cost linear time.
    out = drop(out, r"(?:\G|(?<![\p{L}\p{N}_.\-]))[\p{L}\p{N}_.\-]++@[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]+", raw.contains("@"))
    out = drop(out, r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", raw.rlike("[0-9]{3}"))
    return drop(out, r"[^a-zA-Z0-9\s\-]")


def fold(value: Column | str) -> Column:
    """Accent-free, lower case, alphanumerics separated by single spaces."""
    plain = F.translate(F.coalesce(as_column(value), F.lit("")), ACCENTED, UNACCENTED)
    return F.lower(F.trim(F.regexp_replace(plain, "[^a-zA-Z0-9]+", " ")))


def token_set(value: Column | str) -> Column:
    """Distinct lower-case tokens, first occurrence first."""
    tokens = F.split(F.lower(normalize_text(value)), " ")
    return F.array_distinct(F.filter(tokens, lambda t: t != ""))


def capitalize(value: Column | str) -> Column:
    """First character upper, the rest lower."""
    c = as_column(value)
    first = F.left(c, F.lit(1))
    head = F.when(first == "ß", F.lit("Ss")).otherwise(F.upper(first))
    return F.concat(head, F.lower(F.substring(c, F.lit(2), F.length(c))))


def title_case(value: Column | str) -> Column:
    """Upper case after every non-letter, which differs from ``initcap`` ("node.js" gives "Node.Js")."""
    runs = F.regexp_extract_all(as_column(value), F.lit(r"(\p{L}+|\P{L}+)"))
    return F.array_join(F.transform(runs, capitalize), "")


def flatten_text(value: Column | str, limit: int | None = None) -> Column:
    return first_chars(F.replace(F.coalesce(as_column(value), F.lit("")), F.lit("\n"), F.lit(" ")), limit)


def richness(value: Column | str) -> Column:
    """How much usable content a text holds: letters, contact data, section words and non-blank lines."""
    c = F.coalesce(as_column(value), F.lit(""))
    letters = F.length(F.regexp_replace(c, r"\P{L}", ""))
    emails = F.when(c.contains("@"), F.regexp_count(c, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"))).otherwise(0)
    phones = F.regexp_count(c, F.lit(r"\+?\d[\d\s().-]{7,}\d"))
    headings = F.regexp_count(
        F.lower(c), F.lit(r"\b(experience|education|skills|profil|formation|competences|projects)\b")
    )
    lines = F.size(F.filter(F.split(c, "\n"), lambda line: line.rlike(NON_SPACE)))
    return letters + emails * 200 + phones * 120 + headings * 80 + lines * 3


def contains_any(value: Column, words: Iterable[str]) -> Column:
    """True when any of the plain words occurs in the value."""
    pattern = "|".join(rx_escape(word) for word in words)
    return value.rlike(pattern)


def rx_escape(text: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?{}[]\|()" else ch for ch in text)


def ordered_distinct(items: Column, key=F.lower) -> Column:
    """Drop later items whose key equals an earlier one; keeps order and the first spelling."""
    return let(items, lambda a: let(F.transform(a, key), lambda keys: F.filter(
        a, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def round_dp(value: Column, digits: int) -> Column:
    """Half-up rounding that is immune to the last bits of floating point noise."""
    return F.round(F.round(value, 9), digits)
