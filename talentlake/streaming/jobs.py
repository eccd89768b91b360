"""Streams of CV files, profiles and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.contact import emails, experience_years, phones
from ..functions.skillnames import tech_skills
from ..functions.text import normalize_layout
from ..operators.matching import weighted_cosine
from ..operators.quality import fingerprint


def stream_ingest(spark: SparkSession, path: str, max_bytes: int | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """New text files of a folder with their extraction columns."""
    schema = spark.read.format("binaryFile").load(path).schema
    files = (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.txt")
             .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path))
    texts = (files if max_bytes is None else files.filter(F.col("length") <= max_bytes)).select(
        "path", F.col("modificationTime").alias("arrived_at"), normalize_layout(F.decode("content", "UTF-8")).alias("text"))
    return texts.withColumns({"emails": emails("text"), "phones": phones("text"), "skills": tech_skills("text"),
                              "experience_years": experience_years("text")})


def stream_latest(df: DataFrame, key: str, time: str) -> DataFrame:
    """Latest row per key; the state is one row per key."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(time)).alias("_r")).select(key, "_r.*")


def write_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "append", transform=None) -> DataStreamWriter:
    """Sink that writes each micro-batch to its own folder, so a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform is not None else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)


def read_latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Newest version of every key of an update-mode sink."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("batch")).alias("_r")).select(key, "_r.*").drop("batch")


def stream_dedupe(df: DataFrame, time: str, delay: str) -> DataFrame:
    """First arrival per fingerprint; the state is kept for ``delay`` of event time."""
    return fingerprint(df).withWatermark(time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def stream_match(arrivals: DataFrame, criteria_skills: DataFrame, universe: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Scores arriving (candidate_id, skills) rows against all criteria, batch by batch."""
    def score(batch: DataFrame) -> DataFrame:
        held = batch.select("candidate_id", F.explode("skills").alias("skill"))
        scored = weighted_cosine(held, criteria_skills, universe)
        return scored.select("criteria_id", "candidate_id", "score_pct", "coverage_pct")

    return write_batches(arrivals, path, checkpoint, transform=score)
