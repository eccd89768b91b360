"""One registered query per operator, run over the whole intended table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, conversations, fingerprints, html_extract, language_id, line_dedup, packing, quality_rules, sentencepiece_chunks, simhash, substring_dedup, suffix_dedup, warc
from ..session import scratch_dir
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return keep


@register("op9_quality_rules")
def op9(spark, folder):
    judged = quality_rules.judge(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))
    s = F.col("quality_stats")
    return judged.select(
        "doc_id", s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"),
        s["n_dup_lines"].alias("n_dup_lines"), s["n_repeat_words"].alias("n_repeat_words"),
        F.col("quality_base_failed").alias("base_failed"), F.col("quality_kept").alias("kept"), F.col("quality_rule").alias("rejecting_rule"))


@register("op4_language_id")
def op4(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@register("op6_sentencepiece")
def op6(spark, folder):
    encoded = sentencepiece_chunks.encode(read_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def packed_pieces(docs):
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op2_packing")
def op2(spark, folder):
    return packed_pieces(read_table(spark, folder, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("op5_fingerprints")
def op5(spark, folder):
    return fingerprints.fingerprint_edits(read_table(spark, folder, "documents"))


@register("op7_simhash")
def op7(spark, folder):
    grouped = simhash.near_duplicates(read_table(spark, folder, "documents"))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op10_warc", """
    WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
         f AS (SELECT payload_digest, min(page_id) AS target FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN target <> page_id THEN target END AS refers_to
    FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100""")
def op10(spark, folder):
    manifest = warc.write(read_table(spark, folder, "pages"), scratch_dir(spark, "warc"))
    return warc.read(manifest, payload=False).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


@register("op1_suffix_dedup", r"""
    WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
         k AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS i FROM w WHERE len(h) >= 100)),
         f AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win HAVING min(doc_id) < max(doc_id)),
         c AS (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS before FROM k JOIN f USING (win) WHERE first < doc_id),
         r AS (SELECT doc_id, i, sum(CASE WHEN i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
         g AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
         e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS last FROM g),
         t AS (SELECT e.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
                      string_agg(substring(h, 2 * from_ + 1, 2 * (a - from_)) || CASE WHEN last = 1 THEN substring(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
               FROM e JOIN w ON w.doc_id = e.doc_id GROUP BY e.doc_id)
    SELECT w.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM w LEFT JOIN t ON t.doc_id = w.doc_id""")
def op1(spark, folder):
    return suffix_dedup.remove_repeats(read_table(spark, folder, "documents"), text=False)


@register("op8_substring_dedup", r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
         s AS (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50),
         k AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 50], ' ') AS win FROM s),
         f AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win HAVING min(doc_id) < max(doc_id)),
         c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(50)) AS j FROM k JOIN f USING (win) WHERE first < doc_id)),
         p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM w),
         t AS (SELECT p.doc_id, CAST(count(c.p) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (c.p IS NULL) AS kept
               FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)""")
def op8(spark, folder):
    return substring_dedup.remove_repeats(read_table(spark, folder, "documents"), text=False)


@register("op3_html_extract")
def op3(spark, folder):
    return html_extract.extract(read_table(spark, folder, "pages"))


def _centroid_sql() -> str:
    """The rounds as chained tables; the embeddings' components are numbered from 1."""
    near = """{a} AS (SELECT vec_id, e, k, d FROM (SELECT vec_id, v.e, k, CAST(list_sum([(v.e[i] - c.e[i]) * (v.e[i] - c.e[i]) for i in range(1, 65)]) AS BIGINT) AS d,
             row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS place FROM v CROSS JOIN {c} c) WHERE place = 1)"""
    move = """m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM (
                SELECT k, i, CAST(sum(e[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i) GROUP BY k),
         c{s} AS (SELECT k, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} USING (k))"""
    steps = ["""WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
              WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
             """c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS k, e FROM (SELECT e, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT 16))"""]
    for r in range(3):
        steps += [near.format(a=f"a{r}", c=f"c{r}"), move.format(r=r, s=r + 1)]
    return ",\n         ".join([*steps, near.format(a="a", c="c3")]) + """
    SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.e, ',')) AS centroid_sha256 FROM a JOIN c3 ON a.k = c3.k"""


@register("op11_centroids", _centroid_sql())
def op11(spark, folder):
    return centroids.cluster(read_table(spark, folder, "embeddings")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroids.digest(F.col("centroid")).alias("centroid_sha256"))


@register("op12_line_dedup", r"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
         l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
         k AS (SELECT doc_id, line, i, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
         f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
         m AS (SELECT doc_id, line, i, coalesce(first < doc_id, false) AS gone FROM k LEFT JOIN f USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id""")
def op12(spark, folder):
    kept = line_dedup.remove_repeats(read_table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def damaged(conversations_table: DataFrame) -> DataFrame:
    """The rows after the damage that their keys name."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mode = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    return conversations_table.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), mode.alias("mode")).filter("mode <> 0").select(
        "conv_id", "turn", F.when(F.col("mode") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("mode") == 1, "").when(F.col("mode") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("mode") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


@register("op13_conversation_repair")
def op13(spark, folder):
    rows = read_table(spark, folder, "conversations")
    repaired = conversations.repair(damaged(rows), everyone=rows)
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return repaired.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))
