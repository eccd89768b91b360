"""Predicates on one line of a CV. ``line`` is the line without bullets, ``norm`` its folded form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .contact import PERIOD
from .text import SPACE, contains_any, fold, let

# Patterns of the line rules.
YEAR = r"\b(19|20)\d{2}\b"
COMPANY_SHAPE = r"\b\d{4}\b|\||\s[-–]\s"
LETTER = r"[A-Za-zÀ-ÿ]"
UPPER_NAME = r"^[A-ZÀ-Ÿ][A-ZÀ-Ÿ'’\-]+(\s+[A-ZÀ-Ÿ][A-ZÀ-Ÿ'’\-]+){1,%d}$"
TITLE_NAME = r"^[A-ZÀ-Ÿ][A-Za-zÀ-ÿ'’\-]+(\s+[A-ZÀ-Ÿ][A-Za-zÀ-ÿ'’\-]+){1,%d}$"
SEGMENT = r"\||\s+-\s+|\s+–\s+|\s+—\s+"
TRAILING_PLACE = r"\s*[-–]\s*[A-ZÀ-Ÿ][A-Za-zÀ-ÿ\s&'’.\-]{1,40}$"


def without_bullets(raw: Column) -> Column:
    """Outer white space and bullet marks removed."""
    return F.regexp_replace(raw, rf"^(?:{SPACE}|[•*\-])+|(?:{SPACE}|[•*\-])+$", "")


def is_section_header(norm: Column) -> Column:
    return norm.isin(vocab.EXPERIENCE_HEADERS + vocab.EDUCATION_HEADERS + vocab.STOP_HEADERS)


def matches_header(norm: Column, headers: list[str]) -> Column:
    """Equal to a header, or starting with one of several words."""
    hit = norm.isin(headers)
    for header in headers:
        if " " in header:
            hit = hit | norm.startswith(header + " ")
    return hit


def is_company_line(line: Column, norm: Column) -> Column:
    return ~contains_any(norm, vocab.NOT_COMPANY_WORDS) & line.rlike(COMPANY_SHAPE)


def is_title_line(line: Column, norm: Column, header: Column | None = None, company: Column | None = None) -> Column:
    """``header`` and ``company``: what ``is_section_header`` and ``is_company_line`` gave, where that is known."""
    header = is_section_header(norm) if header is None else header
    company = is_company_line(line, norm) if company is None else company
    words = F.filter(F.split(line, SPACE + "+"), lambda w: w != "")

    def judge(w: Column) -> Column:
        shape = (contains_any(norm, vocab.JOB_WORDS)
                 | F.when(F.size(w) == 1, line.rlike(r"^\p{L}{7,}$")).otherwise(F.forall(w, lambda x: x.rlike(LETTER))))
        refused = (header | company | norm.isin(vocab.LANGUAGE_NAMES) | line.rlike(r"[.:]$")
                   | contains_any(norm, vocab.NOT_TITLE_WORDS + vocab.EDUCATION_WORDS + vocab.LEISURE_WORDS + ["loisirs", "interets"]))
        return F.size(w).between(1, 6) & ~refused & shape

    return let(words, judge)


def has_education_word(norm: Column) -> Column:
    return contains_any(norm, vocab.EDUCATION_WORDS)


def is_education_line(line: Column, norm: Column, header: Column | None = None, company: Column | None = None) -> Column:
    """``header`` and ``company`` as in ``is_title_line``."""
    header = is_section_header(norm) if header is None else header
    company = is_company_line(line, norm) if company is None else company
    refused = header | contains_any(norm, ["linkedin", "github", "http", "www"] + vocab.LEISURE_WORDS)
    return ~refused & (has_education_word(norm) | (line.rlike(YEAR) & ~company))


def company_from_line(line: Column) -> Column:
    """The company part of a line, '' when there is none or it is a school."""
    head = F.trim(F.substring_index(line, "|", 1))
    head = F.trim(F.regexp_replace(head, r"\s*\(\s*\d{4}.*$", ""))
    head = F.trim(F.regexp_replace(head, TRAILING_PLACE, ""))
    name = F.regexp_replace(F.trim(F.substring_index(head, ",", 1)), r"^[•*\-\s]+|[•*\-\s]+$", "")
    refused = ["linkedin", "github"] + vocab.NOT_COMPANY_WORDS + vocab.SCHOOL_WORDS
    return let(name, lambda n: F.when((F.length(n) < 2) | contains_any(fold(n), refused), "").otherwise(n))


def is_anchor(line: Column, norm: Column) -> Column:
    """A line that likely starts a work experience."""
    refused = is_section_header(norm) | contains_any(norm, ["education", "formation", "universite", "university", "ecole", "school"])
    separated = line.rlike(r"\|| - | – | — ") & (is_title_line(line, norm) | is_company_line(line, norm))
    return (F.length(line) >= 3) & ~refused & (line.rlike(PERIOD) | separated)
