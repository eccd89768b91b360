"""Entities and sections of CV texts.

Every text is turned into one array of annotated lines inside its own row, and all rules read that array, so the
extraction of a corpus is a single map-only stage: no line is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import contact, lines as ln
from ..functions.skillnames import tech_skills
from ..functions.text import (first_items, 
    SPACE, capitalize, contains_any, fold, let, strip_space, title_case,
)

# Header vocabulary that opens each kind of section.
SECTIONS = {
    "experience": vocab.EXPERIENCE_HEADERS, "education": vocab.EDUCATION_HEADERS, "skills": vocab.SKILL_HEADERS,
    "interests": vocab.INTEREST_HEADERS, "projects": vocab.PROJECT_HEADERS, "certifications": vocab.CERTIFICATION_HEADERS,
    "profile": vocab.PROFILE_HEADERS, "languages": vocab.LANGUAGE_HEADERS,
}
_NO_STRINGS = "array<string>"


def _opens(norm: Column, kind: str) -> Column:
    if kind in ("experience", "education"):
        return norm.isin(SECTIONS[kind])
    return ln.matches_header(norm, SECTIONS[kind])


def _closes(x: Column, kind: str) -> Column:
    """Education sections end at a stop header only, all others at any header."""
    return x["norm"].isin(vocab.STOP_HEADERS) if kind == "education" else x["header"]


def cleaned_lines(text: Column | str = "text") -> Column:
    """The lines of a text with position, raw, cleaned and folded text."""
    def clean(raw: Column, i: Column) -> Column:
        return let(ln.without_bullets(raw), lambda line: F.struct(
            i.alias("pos"), strip_space(raw).alias("raw"), line.alias("line"), fold(line).alias("norm")))

    return F.transform(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n"), clean)


def annotate_lines(docs: DataFrame, text: str = "text", name: str = "lines") -> DataFrame:
    """Adds the array of annotated lines: position, raw and cleaned text, predicates and the sections a line lies in."""
    own = ("pos", "raw", "line", "norm")

    def judge(x: Column) -> Column:
        line, norm = x["line"], x["norm"]

        def rest(known: Column) -> Column:
            header, company = known["header"], known["company"]
            return F.struct(
                *[x[c].alias(c) for c in own], header.alias("header"), company.alias("company"),
                ln.is_title_line(line, norm, header, company).alias("title"), ln.is_education_line(line, norm, header, company).alias("education"),
                (ln.matches_header(norm, vocab.EXPERIENCE_HEADERS)).alias("opens_experience"))

        return let(F.struct(ln.is_section_header(norm).alias("header"), ln.is_company_line(line, norm).alias("company")), rest)

    headers = sorted({h for words in SECTIONS.values() for h in words})

    def with_sections(array: Column) -> Column:
        def spans(heads: Column, kind: str) -> Column:
            """(from, to) of the lines between a header that opens a section and the next one that opens or closes it."""
            marks = F.filter(F.transform(heads, lambda x: F.struct(
                x["pos"].alias("pos"), F.when(_opens(x["norm"], kind), True).when(_closes(x, kind), False).alias("open"))), lambda m: m["open"].isNotNull())
            return let(marks, lambda b: F.filter(
                F.transform(b, lambda m, i: F.struct(m["pos"].alias("from"), F.get(b, i + 1)["pos"].alias("to"), m["open"].alias("open"))),
                lambda m: m["open"])).alias(kind)

        def place(b: Column) -> Column:
            def inside(x: Column, kind: str) -> Column:
                return F.exists(b[kind], lambda m: (m["from"] < x["pos"]) & (m["to"].isNull() | (x["pos"] < m["to"]))).alias(f"in_{kind}")

            return F.transform(array, lambda x: F.struct(
                *[x[c].alias(c) for c in (*own, "header", "company", "title", "education", "opens_experience")],
                *[inside(x, kind) for kind in SECTIONS]))

        heads = F.filter(array, lambda x: x["header"] | ln.matches_header(x["norm"], headers))  # only these open or close anything
        return let(let(heads, lambda h: F.struct(*[spans(h, kind) for kind in SECTIONS])), place)

    return docs.withColumn(name, let(F.transform(cleaned_lines(text), judge), with_sections))


def _pick(array: Column, keep, value=lambda x: x["line"], limit: int | None = None) -> Column:
    """Distinct values of the lines that pass a rule, in line order."""
    found = F.array_distinct(F.filter(F.transform(F.filter(array, keep), value), lambda v: v != ""))
    return first_items(found, limit)


def job_titles(array: Column, limit: int | None = None) -> Column:
    """Title lines next to a company line: up to three lines below one in the experience section, or right above one."""
    def stops(x: Column) -> Column:
        return F.coalesce((x["line"] != "") & (x["header"] | x["company"]), F.lit(False))

    def keep(a: Column):
        def rule(x: Column) -> Column:
            at = lambda d: F.get(a, x["pos"] + d)
            opens = lambda d: F.coalesce(at(d)["company"] & at(d)["in_experience"], F.lit(False))
            above = opens(-1) | (opens(-2) & ~stops(at(-1))) | (opens(-3) & ~stops(at(-1)) & ~stops(at(-2)))
            below = F.coalesce(at(1)["company"] & (at(1)["line"] != ""), F.lit(False))
            return (x["line"] != "") & x["title"] & (above | below)
        return rule

    return let(array, lambda a: _pick(a, keep(a), limit=limit))


def companies(array: Column, text: Column, limit: int | None = None) -> Column:
    """Companies of company-like lines in line order, then well-known names found anywhere in the text."""
    from_lines = _pick(array, lambda x: x["company"], lambda x: ln.company_from_line(x["raw"]))
    known = F.array_compact(F.array(*[F.when(F.lower(text).contains(c), F.lit(c.title())) for c in vocab.KNOWN_COMPANIES]))
    return first_items(F.array_distinct(F.concat(from_lines, known)), limit)


def education(array: Column, limit: int | None = None) -> Column:
    def keep(x: Column) -> Column:
        in_section = x["in_education"] & F.length(x["line"]).between(5, 200)
        return x["education"] & (in_section | ln.has_education_word(x["norm"]))

    return _pick(array, keep, limit=limit)


def languages(text: Column, limit: int | None = None) -> Column:
    names = F.array(*[F.lit(w) for w in vocab.LANGUAGE_NAMES])
    found = F.array_intersect(F.split(fold(text), " "), names)
    return first_items(F.transform(found, capitalize), limit)


def soft_skills(array: Column, limit: int | None = None) -> Column:
    """Short items of the skills section that are no sentence; without any, vocabulary lines anywhere."""
    def keep(x: Column) -> Column:
        refused = x["norm"].isin(vocab.LANGUAGE_NAMES) | x["line"].contains("@") | x["norm"].contains("http") | x["line"].endswith(".")
        return x["in_skills"] & F.length(x["line"]).between(2, 60) & ~refused

    def choose(a: Column) -> Column:
        return let(_pick(a, keep), lambda found: F.when(F.size(found) > 0, found).otherwise(
            _pick(a, lambda x: x["norm"].isin(vocab.SOFT_SKILL_WORDS))))

    return first_items(let(array, choose), limit)


def interests(array: Column, limit: int | None = None) -> Column:
    def keep(x: Column) -> Column:
        refused = (x["line"].contains("@") | F.lower(x["line"]).contains("http") | x["line"].rlike(ln.YEAR)
                   | ln.has_education_word(x["norm"]) | x["company"])
        return x["in_interests"] & F.length(x["line"]).between(2, 80) & ~refused

    return _pick(array, keep, limit=limit)


def certifications(array: Column, limit: int | None = None) -> Column:
    """Items of the certification section and lines that name a certificate."""
    def keep(x: Column) -> Column:
        inline = contains_any(x["norm"], vocab.CERTIFICATION_WORDS) & ~_opens(x["norm"], "certifications")
        return F.length(x["line"]).between(3, 140) & (x["in_certifications"] | inline)

    return _pick(array, keep, limit=limit)


def projects(array: Column, limit: int | None = None) -> Column:
    """Items of the project section and lines that report something built."""
    def keep(x: Column) -> Column:
        inline = contains_any(x["norm"], vocab.PROJECT_WORDS) & ~x["company"] & ~_opens(x["norm"], "projects")
        refused = x["line"].contains("@") | x["norm"].contains("http")
        return F.length(x["line"]).between(4, 160) & ~refused & (x["in_projects"] | inline)

    return _pick(array, keep, limit=limit)


def locations(text: Column, limit: int | None = None, lines: int | None = None) -> Column:
    """City, Country mentions (in the first ``lines`` lines, if given)."""
    head = F.transform(first_items(F.split(text, "\n"), lines), strip_space)
    usable = F.filter(head, lambda s: ~s.contains("@") & ~F.lower(s).contains("linkedin.com") & ~s.rlike(r"\d{2}\s?\d{2}"))
    pattern = r"([A-ZÀ-Ÿ][A-Za-zÀ-ÿ\-]+\s*,\s*[A-ZÀ-Ÿ][A-Za-zÀ-ÿ\-]+)"
    found = F.flatten(F.transform(usable, lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(1))))
    return first_items(F.array_distinct(found), limit)


def _name_score(line: Column, most: int, upper: int, title: int, other: int) -> Column:
    return (F.when(line.rlike(ln.UPPER_NAME % (most - 1)), upper).when(line.rlike(ln.TITLE_NAME % (most - 1)), title).otherwise(other))


def _name_like(line: Column, norm: Column, most: int) -> Column:
    refused = (line.contains("@") | norm.contains("http") | ln.is_section_header(norm) | line.rlike(r"\p{Nd}")
               | contains_any(norm, ["linkedin", "github", "contact", "profil", "profile"]))
    words = F.filter(F.split(line, SPACE + "+"), lambda w: w != "")
    return (line != "") & ~refused & F.size(words).between(2, most) & F.forall(words, lambda w: w.rlike(ln.LETTER))


def person_name(array: Column, text: Column, first_lines: int | None = None) -> Column:
    """Best-scored name-like line or fragment (of the ``first_lines``, if given), else the name in the first address."""
    def option(score: Column, pos: Column, part: Column, name: Column) -> Column:
        return F.struct((-score).alias("down"), F.length(name).alias("size"), pos.alias("pos"), part.alias("part"), title_case(name).alias("name"))

    def of_line(x: Column) -> Column:
        score = F.when(x["pos"] < 15, 3).otherwise(0) + _name_score(x["line"], 3, 5, 4, 2) - F.when(
            contains_any(x["norm"], ["experience", "formation", "education", "profil", "contact"]), 4).otherwise(0)
        whole = F.array(option(score, x["pos"], F.lit(0), x["line"]))
        pieces = F.transform(F.split(x["line"], r"\s*[|/·•]\s*|\s+-\s+|\s+–\s+|\s+—\s+"), strip_space)
        usable = F.filter(pieces, lambda p: (p != x["line"]) & _name_like(p, fold(p), 4))
        parts = F.transform(usable, lambda p, i: option(
            F.when(x["pos"] < 10, 4).otherwise(2) + _name_score(p, 4, 4, 3, 0), x["pos"], i + 1, p))
        return F.concat(whole, parts)

    lines = F.filter(first_items(array, first_lines), lambda x: _name_like(x["line"], x["norm"], 3))
    best = F.array_min(F.flatten(F.transform(lines, of_line)))["name"]
    fallback = contact.name_from_email(F.get(contact.emails(text), F.lit(0)))
    return F.when(F.length(best) >= 3, best).otherwise(F.coalesce(fallback, best))


def _reported(line: Column, norm: Column) -> Column:
    return ~(line.contains("@") | norm.contains("linkedin"))


# Cues of the summary fallbacks.
_SUMMARY_CUES = ["diplome", "experience", "passion", "relationnel"]
_SUMMARY_STOPS = ["contact", "linkedin", "langues", "competences", "experiences", "formation"]


def profile_summary(array: Column, text: Column, stop_after: int | None = None, following_lines: int | None = None) -> Column:
    """Lines of the first profile section (until ``stop_after`` characters are passed); without any, the first line that
    reads like a summary with the lines that follow it (``following_lines`` at most)."""
    def section(a: Column) -> Column:
        opened = F.array_min(F.transform(F.filter(a, lambda x: _opens(x["norm"], "profile")), lambda x: x["pos"]))
        closed = F.array_min(F.transform(F.filter(a, lambda x: (x["pos"] > opened) & x["header"] & ~x["norm"].isin(vocab.PROFILE_HEADERS)), lambda x: x["pos"]))
        body = F.filter(a, lambda x: (x["pos"] > opened) & F.coalesce(x["pos"] < closed, F.lit(True)) & ~_opens(x["norm"], "profile")
                        & (F.length(x["line"]) >= 10) & ~x["line"].contains("@") & ~F.lower(x["line"]).contains("linkedin.com"))
        lines = F.transform(body, lambda x: x["line"])
        if stop_after is None:
            return lines
        # Lines that are still collected: the text before them has not passed the bound.
        return F.filter(lines, lambda x, i: F.length(F.array_join(F.slice(lines, F.lit(1), i), " ")) <= stop_after)

    def joined(parts: Column) -> Column:
        return F.array_join(parts, " ")

    def without_phones(parts: Column) -> Column:
        kept = F.filter(parts, lambda p: ~p.rlike(contact.LOCAL_PHONE) & (F.length(p) >= 20))
        return F.when(joined(parts).rlike(contact.LOCAL_PHONE), joined(kept)).otherwise(joined(parts))

    def chunks(a: Column) -> Column:
        """Every seed line with the lines that follow it up to the next stop."""
        def chunk(x: Column) -> Column:
            following = F.filter(F.slice(a, x["pos"] + 2, F.size(a) if following_lines is None else F.lit(following_lines)), lambda f: F.length(f["line"]) >= 8)
            def stop(f: Column) -> Column:
                return f["header"] | contains_any(f["norm"], _SUMMARY_STOPS) | f["line"].contains("@") | f["line"].rlike(contact.LOCAL_PHONE)
            first_stop = F.array_min(F.transform(F.filter(following, stop), lambda f: f["pos"]))
            kept = F.filter(following, lambda f: F.coalesce(f["pos"] < first_stop, F.lit(True)))
            return F.array_join(F.concat(F.array(x["line"]), F.transform(kept, lambda f: f["line"])), " ")
        seeds = F.filter(a, lambda x: (F.length(x["line"]) >= 20) & ~contains_any(x["norm"], _SUMMARY_STOPS) & contains_any(x["norm"], _SUMMARY_CUES))
        return F.get(F.filter(F.transform(seeds, chunk), lambda c: F.length(c) >= 40), F.lit(0))

    def paragraph(a: Column) -> Column:
        return F.get(F.transform(F.filter(a, lambda x: (F.length(x["line"]) >= 40) & _reported(x["line"], x["norm"]) & ~contains_any(
            x["norm"], ["experience", "formation", "langues", "competences", "centres"]) & contains_any(x["norm"], _SUMMARY_CUES)), lambda x: x["line"]), F.lit(0))

    sentences = F.transform(F.split(text, r"[\n.]+"), ln.without_bullets)
    sentence = F.get(F.filter(sentences, lambda s: (F.length(s) >= 40) & ~s.contains("@") & ~s.rlike(contact.LOCAL_PHONE) & contains_any(
        fold(s), ["je suis", "experience", "diplome", "relationnel"])), F.lit(0))

    def choose(a: Column) -> Column:
        return let(section(a), lambda parts: F.when(F.size(parts) > 0, F.coalesce(
            F.nullif(without_phones(parts), F.lit("")), chunks(a))).otherwise(F.coalesce(chunks(a), paragraph(a), sentence)))

    return let(array, choose)


_EXPERIENCE = "struct<title:string,company:string,period:string,responsibilities:array<string>>"


def _parse_anchor(line: Column, norm: Column, before: Column, after: Column) -> Column:
    """Title, company and period of an anchor line and its neighbours; null when neither title nor company is found."""
    def result(f: Column) -> Column:
        usable = ((f["title"] != "") | (f["company"] != "")) & ~ln.has_education_word(fold(f["company"]))
        return F.when(usable, F.struct(f["title"].alias("title"), f["company"].alias("company"), F.nullif(contact.period(line), F.lit("")).alias("period"),
                                       F.array().cast(_NO_STRINGS).alias("responsibilities")).cast(_EXPERIENCE))

    def choose(judged: Column) -> Column:
        title = F.get(F.filter(judged, lambda s: s["title"]), F.lit(0))["text"]
        part = F.get(F.filter(judged, lambda s: s["company"] & ~s["title"]), F.lit(0))["text"]
        own = F.coalesce(F.nullif(ln.company_from_line(part), F.lit("")), part, ln.company_from_line(line))
        full_title = F.coalesce(title, F.when(before["title"] & (before["line"] != ""), before["line"]),
                                F.when(after["title"] & (after["line"] != ""), after["line"]), F.lit(""))
        company = F.coalesce(F.nullif(own, F.lit("")), F.when(after["company"], ln.company_from_line(after["line"])), F.lit(""))
        return let(F.struct(full_title.alias("title"), company.alias("company")), result)

    core = F.coalesce(F.nullif(contact.strip_period(line), F.lit("")), line)
    segments = F.transform(F.filter(F.split(core, ln.SEGMENT), lambda s: F.trim(s) != ""), lambda s: F.btrim(s, F.lit(" |-–—,;")))
    judged = F.transform(segments, lambda s: F.struct(
        s.alias("text"), ln.is_title_line(s, fold(s)).alias("title"), ln.is_company_line(s, fold(s)).alias("company")))
    return let(judged, choose)


def experiences(array: Column, limit: int | None = None, duties_limit: int | None = None) -> Column:
    """Work experiences: a running state over the lines after the experience header.

    Anchor lines open an entry; the lines that follow fill its gaps and its responsibilities.
    """
    state_type = f"struct<done:array<{_EXPERIENCE}>,cur:{_EXPERIENCE},stop:boolean>"
    start = F.struct(F.array().alias("done"), F.lit(None).alias("cur"), F.lit(False).alias("stop")).cast(state_type)

    def state(done: Column, cur: Column, stop: Column) -> Column:
        return F.struct(done.alias("done"), cur.alias("cur"), stop.alias("stop")).cast(state_type)

    def entry(title: Column, company: Column, period: Column, duties: Column) -> Column:
        return F.struct(title.alias("title"), company.alias("company"), period.alias("period"), duties.alias("responsibilities")).cast(_EXPERIENCE)

    def flushed(s: Column) -> Column:
        cur = s["cur"]
        ready = entry(cur["title"], cur["company"], cur["period"], first_items(F.array_distinct(cur["responsibilities"]), duties_limit))
        return F.when(cur.isNotNull(), F.concat(s["done"], F.array(ready))).otherwise(s["done"])

    def prepare(a: Column) -> Column:
        first = F.coalesce(F.array_min(F.transform(F.filter(a, lambda x: x["opens_experience"]), lambda x: x["pos"])), F.lit(-1))
        wanted = F.filter(a, lambda x: (x["pos"] > first) & (x["line"] != ""))

        def facts(x: Column) -> Column:
            before, after = F.get(a, x["pos"] - 1), F.get(a, x["pos"] + 1)
            next_company = F.when(after["company"], ln.company_from_line(after["line"])).otherwise("")
            anchor = ln.is_anchor(x["line"], x["norm"])
            return F.struct(
                x["raw"].alias("raw"), x["line"].alias("line"), x["norm"].alias("norm"), x["title"].alias("title"), x["company"].alias("company"),
                x["education"].alias("education"), (x["header"] & ~x["opens_experience"]).alias("closes"), anchor.alias("anchor"),
                F.when(anchor, _parse_anchor(x["line"], x["norm"], before, after)).alias("parsed"), next_company.alias("next_company"),
                contact.period(x["line"]).alias("period"), ln.company_from_line(x["line"]).alias("company_name"))

        return F.transform(wanted, facts)

    def step(s: Column, x: Column) -> Column:
        cur, done = s["cur"], s["done"]
        ends = (F.size(done) > 0) & contains_any(x["norm"], ["education", "formation", "skills", "competences", "langues", "languages"])
        bullet = x["raw"].rlike(r"^[•\-*]")
        duties, period = cur["responsibilities"], F.coalesce(cur["period"], F.nullif(x["period"], F.lit("")))
        last = F.element_at(duties, -1)
        described = (bullet | (F.length(x["line"]) > 30)) & ~x["anchor"]
        merged = F.when((F.size(duties) > 0) & ~bullet & ~last.endswith("."), F.concat(
            F.slice(duties, F.lit(1), F.size(duties) - 1), F.array(F.concat_ws(" ", last, x["line"])))).otherwise(F.concat(duties, F.array(x["line"])))
        filled = (
            F.when(x["norm"].isin(vocab.LANGUAGE_NAMES) | x["line"].contains("@") | x["education"], cur)
            .when((cur["title"] == "") & x["title"], entry(x["line"], cur["company"], cur["period"], duties))
            .when((cur["company"] == "") & x["company"], entry(cur["title"], x["company_name"], cur["period"], duties))
            .otherwise(entry(cur["title"], cur["company"], period, F.when(described, merged).otherwise(duties))))
        opened = entry(x["line"], x["next_company"], F.lit(None).cast("string"), F.array().cast(_NO_STRINGS))
        return (
            F.when(s["stop"], s).when(x["closes"], state(done, cur, ends)).when(x["parsed"].isNotNull(), state(flushed(s), x["parsed"], F.lit(False)))
            .when(cur.isNull() & x["title"] & (x["next_company"] != ""), state(done, opened, F.lit(False)))
            .when(cur.isNull(), s).otherwise(state(done, filled, F.lit(False))))

    def key(e: Column) -> Column:
        return F.concat_ws("|", fold(e["title"]), fold(e["company"]), F.lower(F.coalesce(e["period"], F.lit(""))))

    def unique(items: Column) -> Column:
        return let(F.transform(items, key), lambda keys: F.filter(items, lambda e, i: F.array_position(keys, F.get(keys, i)) == i + 1))

    found = let(array, lambda a: F.aggregate(prepare(a), start, step, flushed))
    return first_items(let(found, unique), limit)


def section_skills(array: Column, text: Column, limit: int | None = None) -> Column:
    """Items of the skills section split on separators; without any, soft-skill phrases anywhere. Title case."""
    def items(a: Column) -> Column:
        lines = F.filter(a, lambda x: x["in_skills"] & (x["line"] != ""))
        parts = F.flatten(F.transform(lines, lambda x: F.transform(F.split(F.lower(x["line"]), "[,;/•|]"), strip_space)))
        def keep(p: Column) -> Column:
            n = fold(p)
            return F.length(p).between(2, 60) & ~(n.isin(vocab.LANGUAGE_NAMES) | p.contains("@") | n.contains("http") | p.rlike(ln.YEAR)
                                                  | ln.is_company_line(p, n))
        return F.filter(parts, keep)

    phrases = F.filter(F.transform(F.split(F.lower(text), r"[\n,;/•|]+"), strip_space), lambda p: fold(p).isin(vocab.SECTION_SKILL_WORDS))
    chosen = let(let(array, items), lambda found: F.when(F.size(found) > 0, found).otherwise(phrases))
    return first_items(F.array_sort(F.array_distinct(F.transform(chosen, title_case))), limit)


def skills(array: Column, text: Column) -> Column:
    """Technical terms, else the items of the skills section."""
    return let(tech_skills(text), lambda tech: F.when(F.size(tech) > 0, tech).otherwise(section_skills(array, text)))


def label_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line, section): the section of every non-header line, null before the first header."""
    kind = None
    norm = fold("line")
    for name in SECTIONS:
        kind = (F if kind is None else kind).when(_opens(norm, name), name)
    kind = kind.when(ln.is_section_header(norm), "other")
    split = docs.select(key, F.posexplode(F.transform(F.split(text, "\n"), ln.without_bullets)).alias("pos", "line"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = split.withColumn("_kind", kind)
    return marked.withColumn("section", F.last("_kind", ignorenulls=True).over(before)).filter(
        F.col("_kind").isNull()).select(key, "pos", "line", "section")


# Header patterns of the coarse sections, in the order in which they are tried.
COARSE = {"experience": r"(?:professional\s+)?experience|work\s+history|employment history",
          "education": "education|academic background|qualifications", "skills": "skills?|competencies|technical skills",
          "summary": "summary|objective|professional summary|about me"}


def coarse_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", last_wins: bool = False) -> DataFrame:
    """Text per (key, section) of four sections; lines before the first header belong to the summary.

    A repeated section is concatenated, or replaced by its last occurrence with ``last_wins``.
    """
    low = F.lower("line")
    kind = None
    for name, pattern in COARSE.items():
        kind = (F if kind is None else kind).when(low.rlike(pattern), name)
    split = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("_kind", kind)
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = split.withColumn("section", F.coalesce(F.last("_kind", ignorenulls=True).over(upto), F.lit("summary"))).withColumn(
        "_block", F.count("_kind").over(upto))
    if last_wins:
        whole = Window.partitionBy(key, "section")
        marked = marked.withColumn("_last", F.max("_block").over(whole)).filter(F.col("_block") == F.col("_last"))
    lines = F.array_sort(F.collect_list(F.struct("pos", "line")))
    body = marked.filter(F.col("_kind").isNull()).groupBy(key, "section").agg(lines.alias("_l"))
    return body.select(key, "section", F.concat_ws("", F.transform("_l", lambda s: F.concat(F.lit(" "), s["line"]))).alias("text"))


def merge_bio(tokens: DataFrame, key: str = "doc_id", floor: float = 0.75) -> DataFrame:
    """Entities from tagged tokens (key, pos, word, tag, score): B- opens, I- of the same type continues, the lowest score
    counts; weak tokens are ignored. An I- of another type opens a new entity; an I- after nothing is dropped."""
    order = Window.partitionBy(key).orderBy("pos")
    kept = tokens.filter(F.col("score") >= floor).withColumns({
        "_type": F.when(F.col("tag").rlike("^[BI]-"), F.substring("tag", 3, 100)), "_begin": F.col("tag").startswith("B-")})
    previous = F.lag("_type").over(order)
    # A chain of I- tokens without an opening one yields nothing: a run is open only if a B- started it or the run before
    # it (no gap between) was open.
    segment = F.sum(F.when(F.col("_type").isNull(), 1).otherwise(0)).over(order)
    opens = F.col("_begin") | (F.col("_type").isNotNull() & ~F.col("_begin") & (previous != F.col("_type")))
    marked = kept.withColumns({"_segment": segment, "_opens": F.coalesce(opens, F.lit(False))})
    within = Window.partitionBy(key, "_segment").orderBy("pos")
    live = F.max(F.col("_begin").cast("int")).over(within)
    numbered = marked.withColumns({"_live": live, "_entity": F.sum(F.col("_opens").cast("int")).over(within)}).filter(
        F.col("_type").isNotNull() & (F.col("_live") == 1))
    pieces = F.array_sort(F.collect_list(F.struct("pos", "word", "_opens")))
    text = lambda p: F.when(p["_opens"], p["word"]).when(p["word"].startswith("##"), F.replace(p["word"], F.lit("##"), F.lit(""))).otherwise(
        F.concat(F.lit(" "), p["word"]))
    return numbered.groupBy(key, "_segment", "_entity", F.col("_type").alias("entity_type")).agg(
        pieces.alias("_p"), F.min("score").alias("confidence"), F.min("pos").alias("pos")).select(
        key, "pos", "entity_type", F.concat_ws("", F.transform("_p", text)).alias("text"), "confidence")


def best_entities(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Most confident entity per (key, entity_type), the earliest on equal confidence."""
    best = F.max_by(F.struct("text", "confidence"), F.struct("confidence", -F.col("pos")))
    return entities.groupBy(key, "entity_type").agg(best.alias("_b")).select(key, "entity_type", "_b.*")


def entities_to_profile(entities: DataFrame, key: str = "doc_id", floor: float = 0.60, limit: int | None = None) -> DataFrame:
    """Per document the first distinct words of the groups PER, ORG, LOC and MISC (every other group counts as MISC).

    Needs (key, pos, entity_group, word, score).
    """
    group = F.when(F.col("entity_group").isin("PER", "ORG", "LOC"), F.col("entity_group")).otherwise("MISC")
    rows = entities.withColumns({"word": F.trim("word"), "_g": group}).filter((F.col("score") >= floor) & (F.col("word") != ""))
    first = rows.groupBy(key, "_g", "word").agg(F.min("pos").alias("pos"))
    lists = {n: first_items(F.transform(F.array_sort(F.collect_list(F.when(F.col("_g") == g, F.struct("pos", "word")))), lambda s: s["word"]), limit)
             for n, g in (("persons", "PER"), ("companies", "ORG"), ("locations", "LOC"), ("job_titles", "MISC"))}
    return first.groupBy(key).agg(*[c.alias(n) for n, c in lists.items()], F.count(F.lit(1)).alias("total_entities")).withColumn(
        "full_name", F.get("persons", F.lit(0)))


def build_profiles(docs: DataFrame, key: str = "cv_id", text: str = "text") -> DataFrame:
    """One structured profile per document; texts under twenty characters give empty lists. Map-only."""
    c = F.when(F.length(strip_space(text)) >= 20, F.col(text)).otherwise("")
    rows = annotate_lines(docs.select(key, c.alias("text")))
    a, whole = F.col("lines"), F.col("text")
    fields = {
        "full_name": person_name(a, whole), "emails": contact.emails(whole), "phones": contact.phones(whole),
        "linkedin_urls": contact.linkedin_urls(whole), "github_urls": contact.github_urls(whole), "portfolio_urls": contact.portfolio_urls(whole),
        "locations": locations(whole), "job_titles": job_titles(a), "companies": companies(a, whole), "education": education(a),
        "languages": languages(whole), "soft_skills": soft_skills(a), "interests": interests(a), "certifications": certifications(a),
        "projects": projects(a), "profile_summary": profile_summary(a, whole), "skills": skills(a, whole), "experiences": experiences(a),
    }
    lists = [n for n in fields if n not in ("full_name", "profile_summary", "experiences")]
    counted = sum((F.size(n) for n in lists), F.lit(0)) + sum((F.col(n).isNotNull().cast("int") for n in ("full_name", "profile_summary")), F.lit(0))
    return rows.select(key, "text", *[e.alias(n) for n, e in fields.items()]).withColumns({
        "email": F.get("emails", F.lit(0)), "phone": F.get("phones", F.lit(0)), "linkedin_url": F.get("linkedin_urls", F.lit(0)),
        "total_entities": counted})
