"""Sources and sinks, trained models and streams."""

from pyspark.sql import functions as F

from ..functions.jsonlist import json_list
from ..functions.text import round_dp
from ..operators import features as ft
from ..operators import matching as mt
from ..operators import models as md
from ..operators import quality as ql
from ..operators import skills as sk
from ..operators import texts
from ..operators import training as tr
from ..session import cut_lineage, scratch_dir
from ..sources import readers, writers
from ..streaming import jobs
from .match_queries import SCORED, pair_rows, scored_pairs
from .registry import query, rnd
from .text_queries import job_rows, json_items, norm, profile_rows


# Rows per text file.
ROWS_PER_FILE = 2000


@query("s01_read_cv_text", "SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY source")
def _(t):
    folder = scratch_dir(t.spark, "cv-files")
    t.documents.select("source", "text").repartition("source").write.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("source").text(folder)
    files = readers.read_cv_text(t.spark, folder).withColumn("source", F.regexp_extract("path", "source=([^/]+)", 1))
    return files.groupBy("source").agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@query("s02_read_tables", "SELECT p_name, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_name")
def _(t):
    tables = readers.read_tables(t.spark, t.sf_dir, {"part": ["p_partkey", "p_name"], "lineitem": ["l_partkey", "l_linenumber"]})
    return tables["part"].join(tables["lineitem"], F.col("p_partkey") == F.col("l_partkey")).groupBy("p_name").agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("s03_read_pairs", f"""
    SELECT doc_id AS pair_id, {norm('text')} AS cv_text, lang || ' job' AS job_text, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE 1 END AS label
    FROM documents WHERE {norm('text')} <> '' AND doc_id % 7 <> 0""")
def _(t):
    folder = scratch_dir(t.spark, "pairs")
    rows = t.documents.select(
        "source", F.col("doc_id").cast("string").alias("cv_id"), F.lit("1").alias("job_id"), F.lit('a "quoted" name').alias("candidate_name"),
        F.lit("title").alias("job_title"), F.col("text").alias("cv_text"), F.expr("CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE concat(lang, '  job ') END").alias("job_text"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'Yes' WHEN 3 THEN 'other' ELSE 'true' END").alias("label"), F.lit(0.5).alias("heuristic_score"))
    writers.write_export_csv(rows, folder)
    return readers.read_pairs(t.spark, folder).select(F.col("cv_id").cast("bigint").alias("pair_id"), "cv_text", "job_text", "label")


@query("s04_read_skill_dictionary", "SELECT category, name AS skill FROM {skills}")
def _(t):
    folder = scratch_dir(t.spark, "dictionary")
    writers.write_skill_dictionary(t.skills, folder)
    return readers.read_skill_dictionary(t.spark, folder, lines=True)


@query("s05_read_alias_map", "SELECT lower(p_brand || ' ' || p_type) AS alias, min(p_name) AS canonical FROM part GROUP BY 1")
def _(t):
    folder = scratch_dir(t.spark, "aliases")
    writers.write_alias_map(t.part.groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("alias")).agg(F.min("p_name").alias("canonical")), folder)
    return readers.read_alias_map(t.spark, folder, lines=True)


@query("s06_json_list", f"""
    SELECT candidate_id, array_to_string({json_items('extracted_job_titles')}, '|') AS titles,
           array_to_string({json_items("json_extract(CASE WHEN json_valid(ner_json) THEN ner_json END, '$.skills')")}, '|') AS skills FROM {{candidates}}""")
def _(t):
    return t.candidates.select("candidate_id", F.array_join(json_list("extracted_job_titles"), "|").alias("titles"),
                               F.array_join(json_list(F.get_json_object("ner_json", "$.skills")), "|").alias("skills"))


_PEOPLE = "SELECT candidate_id, full_name || ' \"x\", y' AS full_name, email, coalesce(quality_pct, 0) AS quality_pct FROM {candidates}"


def people(t):
    return t.candidates.select("candidate_id", F.concat("full_name", F.lit(' "x", y')).alias("full_name"), "email", F.coalesce("quality_pct", F.lit(0.0)).alias("quality_pct"))


def _csv_back(t, folder):
    return t.spark.read.schema("candidate_id bigint, full_name string, email string, quality_pct double").option("header", True).option("escape", '"').csv(folder)


@query("s07_write_export_csv", _PEOPLE)
def _(t):
    folder = scratch_dir(t.spark, "export")
    writers.write_export_csv(people(t), folder)
    return _csv_back(t, folder)


@query("s08_write_shortlist_csv", _PEOPLE)
def _(t):
    folder = scratch_dir(t.spark, "shortlist")
    writers.write_shortlist_csv(people(t), folder)
    return _csv_back(t, folder)


@query("s09_write_text", "SELECT doc_id AS cv_id, text FROM documents")
def _(t):
    folder = scratch_dir(t.spark, "texts")
    writers.write_text(t.documents.withColumnRenamed("doc_id", "cv_id"), folder)
    return t.spark.read.text(folder).select(F.from_json("value", "cv_id bigint, text string").alias("r")).select("r.*")


@query("s10_write_report", "SELECT role, count(*) AS n FROM conversations GROUP BY role")
def _(t):
    folder = scratch_dir(t.spark, "report")
    writers.write_report(t.conversations.groupBy("role").agg(F.count("*").alias("n")), folder)
    return t.spark.read.schema("role string, n bigint").json(folder)


@query("s11_write_match_results", "SELECT criteria_id, candidate_id, CASE WHEN criteria_id < 20 THEN 1.5::DOUBLE ELSE score_pct END AS score_pct FROM {scored}", SCORED)
def _(t):
    folder = scratch_dir(t.spark, "results")
    rows = scored_pairs(t).select("criteria_id", "candidate_id", "score_pct")
    writers.write_match_results(rows, folder)
    writers.write_match_results(rows.filter("criteria_id < 20").withColumn("score_pct", F.lit(1.5)), folder)
    return t.spark.read.parquet(folder).withColumn("criteria_id", F.col("criteria_id").cast("bigint"))


@query("s12_backup_rows", "SELECT candidate_id, full_name FROM {candidates} WHERE quality_pct < 80 OR quality_pct IS NULL OR regexp_matches(lower(full_name), 'unknown|test|demo') OR starts_with(lower(email), 'candidate-')")
def _(t):
    folder = scratch_dir(t.spark, "backup")
    writers.backup_rows(ql.cleanup_candidates(t.candidates).select("candidate_id", "full_name"), folder)
    return t.spark.read.schema("candidate_id bigint, full_name string").json(folder)


def reduced_pairs(t, k=200, terms=md.MAX_FEATURES):
    """Document and item pairs with reduced vectors, overlap features and the quality label."""
    docs = t.documents.select("doc_id", "text")
    vocabulary = cut_lineage(ft.tfidf_fit(docs, terms))
    reducer = md.svd_fit(docs, vocabulary, k)
    cv = md.svd_transform(ft.tfidf_vectors(docs, vocabulary), reducer, "doc_id").withColumnRenamed("reduced", "cv_reduced")
    job = md.svd_transform(ft.tfidf_vectors(t.benchmark, vocabulary, "item_id"), reducer, "item_id").withColumnRenamed("reduced", "job_reduced")
    pairs = t.labels.join(docs, "doc_id").withColumn("item_id", F.expr("doc_id % 40")).join(
        t.benchmark.select("item_id", F.col("text").alias("job_text")), "item_id").withColumnRenamed("text", "cv_text")
    return ft.pair_overlap_features(pairs).join(cv, "doc_id").join(job, "item_id").withColumn("label", F.col("quality"))


@query("f04_svd")
def _(t):
    docs = t.documents.select("doc_id", "text")
    vocabulary = cut_lineage(ft.tfidf_fit(docs, md.MAX_FEATURES))
    reducer = md.svd_fit(docs, vocabulary, 200)
    return md.svd_transform(ft.tfidf_vectors(docs, vocabulary), reducer, "doc_id").select("doc_id", F.size("reduced").alias("n_components"))


@query("f05_pair_vector")
def _(t):
    from pyspark.ml.functions import vector_to_array

    return md.pair_vector(reduced_pairs(t)).select("doc_id", "item_id", F.size(vector_to_array("features")).alias("n_features"))


def _scored(t, train):
    pairs = cut_lineage(md.pair_vector(reduced_pairs(t)).select("doc_id", "features", "label"))
    return md.score_pairs(train(pairs), pairs).select("doc_id", "label", round_dp(F.col("probability_1"), 6).alias("probability"))


@query("f16_train_logistic")
def _(t):
    return _scored(t, md.train_logistic)


@query("f17_train_gbt")
def _(t):
    return _scored(t, md.train_gbt)


@query("f18_train_forest")
def _(t):
    return _scored(t, md.train_forest)


def labelled_pairs(t):
    """Documents against items with the quality label, as labelled text pairs."""
    items = t.benchmark.select("item_id", F.col("text").alias("job_text"))
    return t.labels.join(t.documents.select("doc_id", "source", F.col("text").alias("cv_text")), "doc_id").withColumn(
        "item_id", F.expr("doc_id % 40")).join(items, "item_id").select(
        F.col("doc_id").alias("pair_id"), "source", "cv_text", "job_text", F.col("quality").alias("label"))


@query("f14_training_run")
def _(t):
    found = tr.training_run(labelled_pairs(t), scratch_dir(t.spark, "run"))
    ratios = ("accuracy", "precision", "recall", "f1", "threshold", "roc_auc", "cross_validated_auc")
    return found.select("scorer", "part", "selected", "tp", "fp", "fn", "tn", *[round_dp(F.col(c), 4).alias(c) for c in ratios], "accept_pct", "review_pct")


def model_pairs(t):
    """Skill-sharing pairs with prediction texts, overlap features and the heuristic label."""
    pairs = pair_rows(t)
    people_texts = texts.predict_candidate_text(profile_rows(t)).select("candidate_id", F.col("candidate_text").alias("cv_text"))
    rows = mt.heuristic_label(pairs).join(people_texts, "candidate_id").withColumn("required_skills", F.col("job_skills"))
    rows = texts.predict_job_text(rows).withColumn("matched_skills", F.array_intersect("job_skills", "cv_skills"))
    return cut_lineage(md.overlap_vector(ft.pair_overlap_features(rows)).select(
        "criteria_id", "candidate_id", "features", "label", "matched_skills", "required_skills"))


@query("f19_score_pairs")
def _(t):
    rows = model_pairs(t)
    return md.score_pairs(md.train_logistic(rows), rows).select("criteria_id", "candidate_id", round_dp(F.col("probability_1"), 6).alias("probability"))


def predicted_top(t, model, k=20):
    """The k best of all eligible candidates per criteria by a logistic model over the overlap features."""
    eligible = ql.matchable(t.candidates).select("candidate_id", "email")
    people = cut_lineage(texts.predict_candidate_text(profile_rows(t).join(eligible, "candidate_id")).select(
        "candidate_id", "full_name", "email", F.col("skills").alias("cv_skills"), F.col("candidate_text").alias("cv_text")))
    work = cut_lineage(texts.predict_job_text(job_rows(t)).select("criteria_id", "required_skills", "job_text"))
    top = md.predict_candidates(model, people, work, k)
    rows = top.join(people, "candidate_id").join(work, "criteria_id")
    rows = ft.pair_overlap_features(rows).withColumn("matched_skills", F.array_intersect("required_skills", "cv_skills"))
    return md.predict_top_k(model, md.overlap_vector(rows), k)


@query("m17_predict_top_k")
def _(t):
    top = predicted_top(t, md.train_logistic(model_pairs(t)))
    return top.select("criteria_id", "candidate_id", "full_name", "email", "rank", round_dp(F.col("score_pct"), 4).alias("score_pct"), "decision", "coverage_pct",
                      F.array_join("matched_skills", ", ").alias("matched"), F.array_join("missing_skills", ", ").alias("missing"))


def _stream(t, name):
    """One table of the folder as a file stream."""
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)


@query("x01_stream_ingest", "SELECT CAST(sum(len(regexp_extract_all(text, '@mail'))) AS BIGINT) AS n_mails, count(*) AS n_cvs FROM {cv_texts}")
def _(t):
    folder, sink, state = [scratch_dir(t.spark, n) for n in ("inbox", "ingested", "ingest-state")]
    t.cv_texts.select("text").write.option("maxRecordsPerFile", ROWS_PER_FILE).text(folder)
    stream = jobs.stream_ingest(t.spark, folder).select(
        "path", F.size("emails").alias("n_mails"), F.regexp_count("text", F.lit("Master of Science")).alias("n_cvs"))
    jobs.write_batches(stream, sink, state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(sink).agg(F.sum("n_mails").alias("n_mails"), F.sum("n_cvs").alias("n_cvs"))


@query("x02_stream_latest", """
    SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1""")
def _(t):
    sink, state = scratch_dir(t.spark, "latest"), scratch_dir(t.spark, "latest-state")
    latest = jobs.stream_latest(_stream(t, "events").select("user_id", "event_id", "value", "ts"), "user_id", "ts")
    jobs.write_batches(latest, sink, state, "update").trigger(availableNow=True).start().awaitTermination()
    return jobs.read_latest(t.spark, sink, "user_id").select("user_id", "event_id", "value")


@query("x03_stream_dedupe", "SELECT DISTINCT 'user' || user_id || '@x.io' AS email, event_type AS full_name FROM events")
def _(t):
    sink, state = scratch_dir(t.spark, "deduped"), scratch_dir(t.spark, "dedupe-state")
    arrivals = _stream(t, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("user"), "user_id", F.lit("@x.io")).alias("email"),
        F.lit(None).cast("string").alias("phone"), F.col("event_type").alias("full_name"), F.array().cast("array<string>").alias("normalized_skills"))
    unique = jobs.stream_dedupe(arrivals, "ts", "60 days").select("email", "full_name")
    jobs.write_batches(unique, sink, state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(sink).select("email", "full_name")


@query("x04_stream_match", f"""
    SELECT criteria_id, candidate_id, {rnd('h.dot / (sqrt(n) * sqrt(square)) * 100', 2)} AS score_pct FROM (
        SELECT candidate_id, criteria_id, sum(weight)::DOUBLE AS dot FROM {{candidate_skills}} JOIN {{criteria_skills}} USING (skill) GROUP BY ALL) h
    JOIN (SELECT criteria_id, sum(weight * weight)::DOUBLE AS square FROM {{criteria_skills}} GROUP BY 1) USING (criteria_id)
    JOIN (SELECT candidate_id, count(*) AS n FROM {{candidate_skills}} GROUP BY 1) USING (candidate_id)""")
def _(t):
    sink, state = scratch_dir(t.spark, "matched"), scratch_dir(t.spark, "match-state")
    profiles = t.candidate_skills.groupBy("candidate_id").agg(F.collect_set("skill").alias("skills"))
    arrivals = _stream(t, "customer").select(F.col("c_custkey").alias("candidate_id")).join(profiles, "candidate_id")
    universe = sk.skill_universe(t.skills, sk.dictionary(t.spark))
    jobs.stream_match(arrivals, t.criteria_skills, universe, sink, state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(sink).select("criteria_id", "candidate_id", "score_pct")


