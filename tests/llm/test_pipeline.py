"""The pipeline stage by stage on the smallest tables."""

import re

import public_tokenizers as tokens
import pytest
from test_near_copies import kept_of
from test_substrings import brute
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from talentlake.llm import near_copies, substring_dedup
from talentlake.llm.common import stored
from talentlake.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), "stage"))
    return [x.collect() for x in out], [x.columns for x in out]


def test_columns(steps):
    rows, columns = steps
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "substring dedup", "packing"]
    assert all(c == columns[0] for c in columns[1:-1]) and columns[-1][:4] == ["doc_id", "start", "length", "ids_crc32"]
    assert len(rows[0]) > len(rows[1]) >= len(rows[2]) > len(rows[3]) > 0


def test_filters_keep_clean_documents(spark, steps):
    rows, _ = steps
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows[2]}
    clean = [r.doc_id for r in rows[0] if labels.get(r.doc_id) == 1 and len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 10]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_quality_rules_reject_bad_documents(spark):
    folder = "/root/testdata/sf0.01"  # the smallest tables hold too few bad labels to learn from
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = corpus_pipeline.good_quality(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).select("doc_id").join(labels, "doc_id")
    counts = {r.quality: (r.n, r.all) for r in labels.groupBy("quality").count().withColumnRenamed("count", "all").join(
        kept.groupBy("quality").count().withColumnRenamed("count", "n"), "quality", "left").fillna(0).collect()}
    assert counts[0][0] <= 0.1 * counts[0][1] and counts[1][0] >= 0.9 * counts[1][1]


def test_one_of_each_group_stays(steps):
    rows, _ = steps
    assert sorted(r.doc_id for r in rows[3]) == kept_of([(r.doc_id, r.text) for r in rows[2]])


def test_odd_documents(spark):
    """Clashing columns keep their values; null ids and texts, empty texts, repeated rows and an empty table work."""
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(1, words(1), "one"), (1, words(1), "one"), (2, words(1) + " end", "two"), (3, words(3), "three"), (None, words(4), "none"), (5, None, "null"), (6, "", "empty"), (7, "p " + words(3) + " q", "more"), (8, words(8) * 3000, "long")]
    docs = spark.createDataFrame([(i, t, 77, 99, 5, s) for i, t, s in rows], "doc_id long, text string, _chunk int, _a int, _text_hash int, source string").withColumn("n_chars", F.length("text").cast("long"))
    for docs in (docs, docs.limit(0)):
        kept = stored(corpus_pipeline.one_of_near_duplicates(spark, docs, FOLDER), "stage")
        cut = corpus_pipeline.without_repeated_passages(spark, kept, FOLDER)
        assert cut.columns == kept.columns == docs.columns
        out = cut.collect()
        assert all((r._chunk, r._a, r._text_hash) == (77, 99, 5) for r in out)
    assert kept.count() == 0  # the last table is empty


def test_odd_documents_give_their_rows(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(1, words(1), 7), (1, words(1), 7), (2, words(1) + " end", 8), (3, words(3), 9), (None, words(4), 10), (5, None, 11), (6, "", 12), (9, "p " + words(3) + " q r s t u v w x y z a b c d e f g h", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _chunk int")
    kept = near_copies.representatives(docs)
    assert sorted(r._chunk for r in kept.collect()) == [7, 9, 10, 11, 13]
    cut = {r._chunk: r.text for r in substring_dedup.clean(docs).collect()}
    assert cut == {7: words(1), 8: "end", 9: words(3), 10: words(4), 11: None, 12: "", 13: "p q r s t u v w x y z a b c d e f g h"}


def test_passages_are_cut(steps):
    rows, _ = steps
    before = [(r.doc_id, r.text) for r in rows[3]]
    want = brute(before, lambda t: tuple(w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t)), b" ".join)
    after = {r.doc_id: r for r in rows[4]}
    for (doc_id, text), (n, gone, _, _) in zip(before, want):
        if gone < n or not n:
            assert len(after[doc_id].text.split()) == n - gone and after[doc_id].n_chars == len(after[doc_id].text)
            assert gone or after[doc_id].text == text
        else:
            assert doc_id not in after


def test_pieces_cover_the_rest(steps):
    rows, _ = steps
    bpe = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    sizes = {r.doc_id: len(bpe.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows[4]}
    held = dict.fromkeys(sizes, 0)
    for piece in rows[5]:
        held[piece.doc_id] += piece.length
    assert held == sizes


def test_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, name):
    from compare import compare, duck, fetch

    assert compare(QUERIES[name](spark, FOLDER).toArrow(), fetch(duck(FOLDER), SQL[name])) is None
