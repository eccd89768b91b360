"""Normalisation, skill names and skill extraction on hand-written rows."""

import random
import re

from pyspark.sql import functions as F

from talentlake.functions import contact, skillnames as sn, text as tx
from talentlake.functions.jsonlist import json_list, json_list_text
from talentlake.operators import skills as sk


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build("v").alias("r")).first()[0]


def test_text_normalisation(spark):
    assert one(spark, "  a\t\nb  c ", tx.normalize_text) == "a b c"
    assert one(spark, None, tx.normalize_text) == ""
    assert one(spark, "- Acme, Inc. -", tx.normalize_company) == "Acme, Inc"
    assert one(spark, "Élève  n°1, Été!", tx.fold) == "eleve n 1 ete"
    assert one(spark, "node.js they're", tx.title_case) == "Node.Js They'Re"
    assert one(spark, "a\r\rb\r\r\r\rc  d", tx.normalize_layout) == "a\n\nb\n\nc d"
    assert one(spark, ["b ", " ", None, "c"], tx.compact_join, "array<string>") == "b c"
    assert one(spark, "see http://x.io/a mail me@x.io or 555-123-4567 now!", tx.clean_text) == "see  mail  or  now"


def test_skill_names(spark):
    name = lambda v: one(spark, v, sn.normalize_skill)
    assert [name(v) for v in ("Python", "python", "ml", "ML", "js", "nodejs", "React.js", "AWS")] == [
        "Python", "Python", "Machine Learning", "Machine Learning", "JavaScript", "Node.js", "React", "AWS"]
    assert one(spark, "node/js", sn.normalize_skill_name) == "Node.js"
    assert one(spark, "small ring", sn.normalize_skill_name) == "Small Ring"
    assert one(spark, ["React", "ml", "ML", "", "AWS"], sn.normalize_skill_list, "array<string>") == ["React", "Machine Learning", "AWS"]


def test_years_and_contacts(spark):
    years = lambda v: one(spark, v, contact.experience_years)
    assert [years(v) for v in ("5+ years", "5+ years of experience", "10 ans", "", None)] == [5, 5, 10, 0, 0]
    assert one(spark, "call 06 12 34 56 78 or +33 6 12 34 56 78, 2010 - 2014", contact.phones) == ["+33 6 12 34 56 78", "06 12 34 56 78"]
    assert one(spark, "anna.lee+cv@x.io", contact.name_from_email) == "Anna Lee Cv"
    assert one(spark, "solo@x.io", contact.name_from_email) is None
    assert one(spark, "www.linkedin.com/in/a). linkedin.com/in/a", contact.linkedin_urls) == [
        "https://www.linkedin.com/in/a", "https://linkedin.com/in/a"]
    assert one(spark, "Dev 2019 – present at X", contact.period) == "2019 – present"
    assert one(spark, "Dev 2019 – present | X", contact.strip_period) == "Dev  | X"


def test_json_lists(spark):
    assert one(spark, '["a", {"name": "b"}, {"x": 1}, ""]', json_list) == ["a", "b"]
    assert one(spark, "broken", json_list) == [] and one(spark, None, json_list) == []
    assert one(spark, "broken", json_list_text) == "broken" and one(spark, '["a","b"]', json_list_text) == "a; b"


def ratio(a, b):
    a, b = ["".join(sorted("".join(c if c.isalnum() else " " for c in x.lower()).split(), key=str)) if False else
            " ".join(sorted("".join(c if c.isalnum() or c == "_" else " " for c in x.lower()).split())) for x in (a, b)]
    row = [0] * (len(b) + 1)
    for ch in a:
        new = [0]
        for j, other in enumerate(b):
            new.append(row[j] + 1 if ch == other else max(row[j + 1], new[j]))
        row = new
    return int(200 * row[-1] / (len(a) + len(b)) + 0.5) if a or b else 0


def test_fuzzy_equals_brute_force(spark):
    words = ["pyton", "javascrpt", "kubernets", "docker-compose", "comunication", "leadrship", "zzz", "postgres", "github", "react-native", "sqll", "go"]
    threshold = 80
    dictionary = [r[:] for r in sk.dictionary(spark).select("skill", "pos").collect()]
    expected = {}
    for w in words:
        best = max(dictionary, key=lambda d: (ratio(w, d[0]), -d[1]))
        if ratio(w, best[0]) >= threshold:
            expected[w] = (best[0], ratio(w, best[0]))
    found = sk.match_words_fuzzy(spark.createDataFrame([(w,) for w in words], "word string"), sk.dictionary(spark), threshold)
    assert {r.word: (r.skill, r.confidence) for r in found.collect()} == expected
    assert {"pyton", "kubernets", "comunication"} <= set(expected)


def test_fuzzy_of_other_dictionaries_equals_brute_force(spark):
    rng = random.Random(5)
    name = lambda longest: "".join(rng.choice("abc") for _ in range(rng.randint(1, longest)))
    entries = [name(9) for _ in range(60)] + [name(30) for _ in range(12)] + ["ab" * 33, "b a", "a_b c"]
    entries = list(dict.fromkeys(entries))
    changed = ["".join(c for c in e if rng.random() > 0.12) + rng.choice(["", "a", "c"]) for e in entries]
    words = sorted({name(9) for _ in range(80)} | {w for w in changed if w.strip()} | {"x" * 3000, "ab" * 34, "c-ba"})
    skills = spark.createDataFrame([(e, "c", i) for i, e in enumerate(entries)], "skill string, category string, pos int")
    table = spark.createDataFrame([(w,) for w in words], "word string")
    for threshold in (60, 80):
        found = {r.word: (r.skill, r.confidence) for r in sk.match_words_fuzzy(table, skills, threshold).collect()}
        best = {w: max(((ratio(w, e), -i, e) for i, e in enumerate(entries)), default=None) for w in words if len(w) < 1000}
        assert found == {w: (b[2], b[0]) for w, b in best.items() if b[0] >= threshold}


def test_exact_matches_equal_patterns_one_by_one(spark):
    rng = random.Random(3)
    names = ["C++", "c", ".net", "a b", "b  c", "É", "_x", "x_", "a", "A", "aa", "+", "1.2"]
    texts = ["".join(rng.choice(["a", "b", "c", " ", "+", ".", "é", "_", "x", "1", "2", "net", "  "]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, ""), (-3, "c++ " * 20000)], "doc_id int, text string")
    skills = spark.createDataFrame([(n, "c") for n in [*names, "", None]], "skill string, category string")
    edge = r"[^\W]"
    want = {(i, n) for i, t in enumerate(texts) for n in names if re.search(f"(?<!{edge}){re.escape(n.lower())}(?!{edge})", t.lower())}
    want |= {(-3, "C++"), (-3, "c"), (-3, "+")}
    got = [(r.doc_id, r.skill) for r in sk.match_skills_exact(docs, skills).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sk.match_skills_exact(docs, skills.limit(0)).count() == 0 == sk.match_skills_exact(docs.limit(0), skills).count()


def test_exact_matches_respect_word_limits(spark):
    docs = spark.createDataFrame([(1, "C++ and Node.js, not gopher; React Native; sqlite")], "doc_id int, text string")
    found = {r.skill for r in sk.match_skills_exact(docs, sk.dictionary(spark)).collect()}
    assert found == {"C++", "Node.js", "React", "React Native"}


def test_exact_wins_over_fuzzy(spark):
    docs = spark.createDataFrame([(1, "python pythons kubernets")], "doc_id int, text string")
    rows = {r.skill: r.method for r in sk.extract_skills(docs, sk.dictionary(spark), 80).collect()}
    assert rows["Python"] == "exact" and rows["Kubernetes"] == "fuzzy"


def test_proficiency_ladder(spark):
    rows = spark.createDataFrame([("Senior Python developer", "Python"), ("strong sql", "SQL"), ("used git", "Git"), ("java", "Java"),
                                  ("nothing", "Go")], "text string, skill string")
    assert [r.proficiency for r in sk.skill_proficiency(rows).collect()] == ["expert", "advanced", "intermediate", "beginner", "beginner"]


def test_universe_falls_back_to_dictionary(spark):
    empty = spark.createDataFrame([], "skill_id bigint, name string")
    assert sk.skill_universe(empty, sk.dictionary(spark)).filter(F.col("skill") == "Python").count() == 1
