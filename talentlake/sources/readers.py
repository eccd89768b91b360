"""Readers of the inputs: CV files, tables, labelled pairs, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text

PAIR_SCHEMA = ("source string, cv_id string, job_id string, candidate_name string, job_title string, cv_text string, "
               "job_text string, label string, heuristic_score double")


def _text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)


def refused_files(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """(path, n_bytes) of the text files that ``read_cv_text`` leaves out under this bound; none of them is read."""
    return _text_files(spark, path).filter(F.col("length") > max_bytes).select("path", F.col("length").alias("n_bytes"))


def read_cv_text(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(path, n_bytes, text) of the text files of a folder; with ``max_bytes``, files above it are left to ``refused_files``."""
    files = _text_files(spark, path)
    return (files if max_bytes is None else files.filter(F.col("length") <= max_bytes)).select(
        "path", F.col("length").alias("n_bytes"), F.decode("content", "UTF-8").alias("text"))


def read_tables(spark: SparkSession, path: str, columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The named parquet tables with only the columns asked for."""
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet").select(*wanted) for name, wanted in columns.items()}


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 32, columns: list[str] | None = None, **options: str
) -> DataFrame:
    """A database table. With a numeric ``key`` its range is read in ``partitions`` parallel queries; the bounds come from one
    query for the smallest and largest key, and rows outside them or without a key are read all the same."""
    base = spark.read.format("jdbc").option("url", url).options(**options)
    if key is not None:
        bounds = spark.read.format("jdbc").option("url", url).options(**options).option("query", f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}").load().first()
        if bounds[0] is not None and bounds[0] < bounds[1]:
            base = base.option("partitionColumn", key).option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1])).option("numPartitions", str(partitions))
    rows = base.option("dbtable", table).load()
    return rows.select(*columns) if columns else rows


def label_of(value: Column) -> Column:
    """1 or 0 from numbers, booleans and words."""
    word = F.lower(F.trim(value))
    return F.coalesce(value.try_cast("int"), F.when(word.isin("1", "true", "yes", "compatible", "match"), 1).otherwise(0))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs from CSV with normalised texts; rows with a blank text are dropped."""
    raw = spark.read.schema(PAIR_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.withColumns({
        "cv_text": normalize_text("cv_text"), "job_text": normalize_text("job_text"), "label": label_of(F.col("label")),
    }).filter((F.length("cv_text") > 0) & (F.length("job_text") > 0))


def _json_document(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """JSON maps of the files: one a file, or (``lines``) one a line, which splits over tasks at any size."""
    return spark.read.text(path, wholetext=not lines).select(F.from_json("value", schema).alias("m"))


def read_skill_dictionary(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(category, skill) of JSON maps of lists."""
    lists = _json_document(spark, path, "map<string,array<string>>", lines).select(F.explode("m").alias("category", "skills"))
    return lists.select("category", F.explode("skills").alias("skill")).filter(F.trim("skill") != "")


def read_alias_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(alias, canonical) of JSON maps; aliases in lower case."""
    return _json_document(spark, path, "map<string,string>", lines).select(F.explode("m").alias("alias", "canonical")).withColumn(
        "alias", F.lower("alias"))
