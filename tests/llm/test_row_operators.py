"""Operators that treat every row alone, on edge cases and against the libraries or brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as tokens
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talentlake.llm import fingerprints, html_extract, language_id, packing, quality_rules, sentencepiece_chunks, warc
from talentlake.llm.queries import packed_pieces

ODD = ["", " ", "\t\n", "a", "one two", "a  b   c ", "▁x ▁▁", "naïve café — “quote” 😀", "don't we'll I'd 'tis", "x\x1cy\x85z　w\xa0v", "²³½ ９ ٣", "<|endoftext|> a", "日本語" * 50, "\n\n\n a\n\n", "é\r\n\x0b\x0c end  "]


def frame(spark, texts, extra="h int, i string, s int, bucket int, _row int, windows string"):
    rows = [(k, t, 1, "x", 2, 3, 4, "w") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


def test_quality_statistics(spark):
    r = random.Random(4)
    texts = [None, *ODD, "w " * 9, "w " * 10, " ".join("abcde"[k % 5] for k in range(400)), "l1\nl2\n\nl1\n l1\nl2", "# * $ % & | < > !"]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(40)] + ["a b c d e f g h i j k " * 2]
    got = {x.doc_id: x for x in quality_rules.judge(frame(spark, texts), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        s = got[k].quality_stats
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == want, t[:50]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        assert (got[k].quality_base_failed, got[k].quality_kept, got[k].h) == (failed, not failed, 1)


def test_quality_learning(spark):
    r = random.Random(1)
    text = lambda bad: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) + ("%%%" if bad and r.random() < 0.6 else "") for _ in range(40))
    docs = spark.createDataFrame([(k, text(k % 4 == 0)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(0, 400)] + [(4, 1), (None, 0), (5, None), (9999, 0)], "doc_id long, quality int")
    rules = quality_rules.learn_rules(docs, labels)
    assert rules and rules[0][0].feature == "symbol_rate" and rules[0][0].above
    kept = {x.doc_id for x in quality_rules.judge(docs, labels, rules).filter("quality_kept").collect()}
    assert kept == {k for k in range(400) if k % 4}
    assert quality_rules.learn_rules(docs, labels.filter("quality = 1")) == [] and quality_rules.learn_rules(docs.limit(0), labels) == []


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = language_id.held_out(docs["doc_id"])
    model = language_id.train(docs.filter(~held), per_language=200, epochs=6)
    rows = language_id.identify(docs.filter(held), model).collect()
    assert sum(x.lang_pred == x.lang for x in rows) / len(rows) > 0.9
    odd = language_id.identify(frame(spark, [None, "", "123 %%", "the " * 20000, "é"]), model).collect()
    assert [(x.lang_pred == "und", x.lang_score == 0) for x in odd[:3]] == [(True, True)] * 3
    assert odd[3].lang_pred in model.languages and 0 < odd[3].lang_score <= 1 and odd[4].lang_pred != "und"
    assert language_id.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {x.lang_pred for x in language_id.identify(docs.limit(3), None).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_language_scores_equal_plain_convolution():
    r = np.random.default_rng(2)
    windows, classes = r.integers(0, 256, (40, language_id.WINDOW), dtype=np.uint8), r.integers(0, 3, 40)
    model = language_id.fit(windows, classes, ["a", "b", "c"], epochs=1)
    pooled = [np.maximum.reduce([sum(f[j][windows[:, i + j]] for j in range(w)) for i in range(language_id.WINDOW - w + 1)]) for f, w in zip(model.filters, language_id.WIDTHS)]
    logits = np.maximum(np.concatenate(pooled, 1) + model.bias, 0) @ model.dense + model.dense_bias
    want = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(language_id.Scorer(model).probabilities(windows), want, atol=1e-5)


MODEL = tokens.path("piece_bpe_32k.model")
PIECES = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_sentencepiece_table(spark):
    texts = [None, *ODD, *ODD, "word " * 5000]
    for limit in (0, 1000):
        got = sentencepiece_chunks.encode(frame(spark, texts), MODEL, table_limit=limit).collect()
        for row, text in zip(sorted(got, key=lambda x: x.doc_id), texts):
            ids = PIECES.encode(text or "", add_eos=True)
            assert row.ids == ids and row.decoded == PIECES.decode(ids)
    assert sentencepiece_chunks.splittable(PIECES) and sentencepiece_chunks.encode(frame(spark, []), MODEL).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), st.text("ab ▁é\n", max_size=12)), max_size=5))
def test_sentencepiece_equals_library(texts):
    table = sentencepiece_chunks.ChunkTable(PIECES, 1000)
    assert [x.tolist() for x in sentencepiece_chunks.encode_texts(texts, PIECES, table)] == [PIECES.encode(t, add_eos=True) for t in texts]


BPE = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
FAST = packing.ByteBpe(tokens.path("byte_bpe_50k.json"), tokens.path("byte_bpe_50k.tiktoken"), tokens.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), st.text("abé 'slvTd.,!\n\t  0²", max_size=80)))
def test_token_ids_equal_library(text):
    assert np.frombuffer(FAST.encode(text), "<u4").tolist() == BPE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("windows", [1, 4, 64])
def test_packing(spark, windows):
    r = random.Random(windows)
    texts = [None, *ODD, "long " * 9000] + [" ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(0, 1500))) for _ in range(120)]
    docs = frame(spark, texts).repartition(3)
    rows = packing.pack(docs, tokens.path("byte_bpe_50k.json"), tokens.path("byte_bpe_50k.tiktoken"), tokens.PATTERN, windows=windows, fan_in=2).collect()
    ids = [[*BPE.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    found, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for row in rows:
        own = ids[row.doc_id]
        assert np.frombuffer(row.ids, "<u4").tolist() == own[row.start : row.start + row.length] and row.doc_tokens == len(own)
        found[row.doc_id].append((row.start, row.length))
        sequences[row.sequence_id].append((row.offset, row.length))
    for pieces, total in [(found[k], len(x)) for k, x in enumerate(ids)] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at <= 1024
    fill = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(1024 - f for f in fill if f & (f - 1)) <= 0.02 * sum(fill)
    assert packed_pieces(frame(spark, [])).count() == 0


def test_fingerprints_of_edits(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 300))) for _ in range(60)] + [None, "", "é" * 7, "x y"] + ["same text here now and then again"] * 2
    docs = frame(spark, texts).repartition(5)
    got = {x.doc_id: x for x in fingerprints.fingerprint_edits(docs, buckets=7).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(len(w) - 4, min(len(w), 1)))}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t, n = t or "", texts[(k + 1) % len(texts)] or ""
        edit = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        for near, other in ((got[k].near_edited, edit), (got[k].near_next, n)):
            a, b = shingles(t), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < 1e-9 if len(a | b) <= fingerprints.K else abs(near - true) < 0.2
    assert got[64].fingerprint == got[65].fingerprint and got[64].near_next == 1.0
    ids = spark.createDataFrame([(None, "b"), (2, "c"), (2, "a"), (None, None)], "doc_id long, text string")
    assert sorted(x.near_next for x in fingerprints.fingerprint_edits(ids).collect()) == [0.0] * 4
    lone = fingerprints.fingerprint_edits(docs.filter("doc_id = 3")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0 and fingerprints.fingerprint_edits(docs.limit(0)).count() == 0


def test_sketches_merge(spark):
    words = [f"w{i}" for i in range(4000)]
    parts = [" ".join(words[k : k + 1004]) for k in range(0, 3000, 1000)]
    whole = fingerprints.sketches([" ".join(words[:3004])])[0]
    a, b, c = fingerprints.sketches(parts)
    assert np.array_equal(fingerprints.merged(fingerprints.merged(a, b), c), whole)
    assert abs(fingerprints.distinct(whole) / 3000 - 1) < 0.25 and abs(fingerprints.containment(a, whole) - 1) < 0.25
    assert np.array_equal(fingerprints.from_text(fingerprints.as_text(whole)), whole)
    prints = fingerprints.fingerprint(spark.createDataFrame(list(enumerate(parts)), "doc_id long, text string")).selectExpr("fingerprint", "1 AS part")
    row = fingerprints.merge_by(prints, "part").first()
    assert [int(x) for x in row.sketch] == [int(x) for x in whole]


HTML = fr"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><p>Site name</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy this now, please.</div>
<article><h1>A title</h1><p>First &amp; second&nbsp;line <b>bold
text</b>.<p>Short.<ul><li>One<li>Two</ul><blockquote>Said.</blockquote><!-- a > comment --><p>Last &lt;x&gt; block.</p></article>
<aside><p>Also read this other page.</p></aside><section id="comments"><div class="comment"><p>I like it, really.</p></div></section><form><label>Mail</label><button>Go</button></form>
<div class="cookie-notice"><p>We use cookies.</p></div><footer>&copy; Somebody</footer></body></html>"""


@pytest.fixture(scope="module")
def model():
    return html_extract.train(html_extract.labelled_pages(300), rounds=120)


def test_html(spark, model):
    pages = [(1, "u", HTML), (2, None, None), (3, "u", ""), (4, "u", "<<<>>> <p <"), (5, "u", "<!-- never ends <p>x</p>"), (6, "u", "<article><p>x</p><script>while"), (7, "u", "<article>" + "<p>Text here, yes.</p>" * 5000 + "</article>"), (1, "u", HTML)]
    docs = spark.createDataFrame([(*p, "y") for p in pages], "page_id long, url string, html string, text string")
    got = html_extract.extract(docs, model).collect()
    want = "A title\nFirst & second line bold text.\nShort.\nOne\nTwo\nSaid.\nLast <x> block."
    assert [x.text for x in got if x.page_id == 1] == [want] * 2 and all(x.n_chars == len(x.text) for x in got)
    by = {x.page_id: x for x in got}
    assert (by[2].text, by[2].url, by[3].text, by[5].text, by[6].text) == ("", None, "", "", "x") and by[7].text.count("\n") == 4999
    assert html_extract.extract(docs.limit(0), model).count() == 0


def test_html_held_out(model):
    pages = html_extract.labelled_pages(150, seed=5)
    exact = 0
    for page, text in zip(pages, html_extract.extract_texts(pages, model)):
        tree = html_extract.Tree(page)
        exact += text == "\n".join(t for t, k in zip(tree.texts, tree.kept) if t is not None and k)
    assert exact >= 0.88 * len(pages)


def test_warc(spark, tmp_path):
    big = "".join(random.Random(1).choices("abcdef<>\n", k=300_000))
    rows = [(3, "u", big), (1, "a\nb", big), (2, None, None), (4, "", ""), (5, "a", "y" * 99), (6, "a", "y" * 99), (7, "a", "é" * 50), (7, "a", "é" * 50), (8, "b", "é" * 50), (None, "b", "é" * 50), (None, None, "z" * 100)]
    pages = spark.createDataFrame([(*x, 0, "q") for x in rows], "page_id long, url string, html string, chunk_no int, digest string").repartition(2)
    manifest = warc.write(pages, str(tmp_path / "w"), chunk=1000, rotate=50_000)
    chunks = warc.read(manifest, chunk=4096).collect()
    records = collections.defaultdict(list)
    for c in chunks:
        if c.record_type == "response":
            records[c.page_id, c.digest if c.is_last else None].append(c)
    found = sorted((str(c.page_id), c.payload_bytes, c.digest, c.record_type, c.refers_to) for c in chunks if c.is_last)
    want = []
    for page, _, text in rows:
        raw = (text or "").encode()
        ids = [p for p, _, t in rows if (t or "") == (text or "") and p is not None]
        revisit = len(raw) >= 100 and bool(ids) and page != min(ids)
        want.append((str(page), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", min(ids) if revisit else None))
    assert found == sorted(want, key=lambda x: x[:4]) or sorted(map(str, found)) == sorted(map(str, want))
    whole = sorted((c for c in chunks if c.page_id == 1), key=lambda c: c.chunk_no)
    assert b"".join(bytes(c.chunk) for c in whole) == big.encode() and max(len(c.chunk) for c in whole) <= 4096
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(rows)
    assert warc.read(warc.write(pages.limit(0), str(tmp_path / "none"))).count() == 0


def test_warc_detects_damage(tmp_path):
    head = {"payload_bytes": 3, "is_revisit": False, "page_id": 1, "url": "u", "refers_to": None, "digest": hashlib.sha256(b"abc").hexdigest()}
    for body, cut in ((b"abd", 0), (b"abc", 9)):
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        raw = packer.compress(warc.head_of(head) + body + b"\r\n\r\n") + packer.flush()
        path = tmp_path / f"{cut}.warc.gz"
        path.write_bytes(raw[: len(raw) - cut])
        with pytest.raises(ValueError), open(path, "rb") as source:
            list(warc.read_stream(source))


def test_formulas_drawings_and_listings_stay():
    page = "<html><body><nav><a href=x>Home</a> <a href=y>News</a></nav><article><h1>On energy</h1><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here, as everyone in physics knows by now.</p>"
    page += "<p>See <object data=x>the fallback words</object> and <svg><text>drawn words</text></svg> in this long paragraph of the article.</p><xmp>if a < b: print('<b>literal</b>') # a listing of the article</xmp></article></body></html>"
    tree = html_extract.Tree(page)
    texts = [t for t in tree.texts if t]
    assert "Energy is E=m here, as everyone in physics knows by now." in texts
    assert "See the fallback words and drawn words in this long paragraph of the article." in texts
    assert "if a < b: print('<b>literal</b>') # a listing of the article" in texts


def test_fingerprints_of_other_id_types(spark):
    rows = [(3, "a b c d e f"), (1, "x"), (2, None)]
    want = {r.doc_id: tuple(r) for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in ("smallint", "int", "tinyint"):
        got = {r.doc_id: tuple(r) for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()}
        assert got == want


def test_archives_are_read_by_several_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"u{k}", "<p>" + "x" * 200 + str(k)) for k in range(40)], "page_id long, url string, html string").repartition(5)
    manifest = warc.write(pages, str(tmp_path / "warc"))
    assert warc.read(manifest).rdd.getNumPartitions() == manifest.select("archive").distinct().count() > 1
