"""Which of many patterns occur in a text: one automaton, walked once per text.

The patterns are stored in the shared folder, dealt by hash into shards of a bounded number of characters. A task reads a
shard, builds its automaton and walks every text of a batch through it; it holds one shard at a time. Texts are neither
copied nor shuffled, patterns never pass through the driver, and a dictionary of any size takes the same path: a larger one
has more shards, each read once per batch of texts (a single shard once per task).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir

SHARD_CHARS = 1 << 19  # characters of the patterns of a shard; its automaton takes about 100 bytes for each


def stored_patterns(patterns: DataFrame, name: str, shard_chars: int = SHARD_CHARS) -> tuple[str, int]:
    """Writes the distinct names and their lower-case form by shard; returns the qualified folder and the number of shards.
    Null and empty names are no patterns."""
    spark = patterns.sparkSession
    rows = patterns.select(F.col(name).cast("string").alias("name")).filter("name <> ''").distinct().withColumn("form", F.lower("name"))
    chars = rows.agg(F.sum(F.length("form"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    folder = scratch_dir(spark, "patterns")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("form"), F.lit(shards)).cast("int"))
    dealt.repartition(min(shards, 1000), "shard").write.partitionBy("shard").parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(path).toString(), shards


def automaton(folder: str, shard: int) -> ahocorasick.Automaton | None:
    """The automaton of a shard, None when it has no pattern. A form's value is the list of names that share it."""
    store, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))
    part = f"{path}/shard={shard}"
    if store.get_file_info(part).type == fs.FileType.NotFound:
        return None
    names: dict[str, list[str]] = {}
    table = ds.dataset(part, filesystem=store, format="parquet").to_table(columns=["name", "form"])
    for name, form in zip(table["name"].to_pylist(), table["form"].to_pylist()):
        names.setdefault(form, []).append(name)
    found = ahocorasick.Automaton()
    for form, same in names.items():
        found.add_word(form, (len(form), same))
    found.make_automaton()
    return found


def in_word(ch: str) -> bool:
    return ch == "_" or unicodedata.category(ch)[0] in "LN"


def apart(text: str, start: int, end: int) -> bool:
    """Neither side of text[start:end] touches a letter, digit or underscore."""
    return not (start > 0 and in_word(text[start - 1])) and not (end < len(text) and in_word(text[end]))


def patterns_in(text: Column, patterns: DataFrame, name: str, whole_words: bool = False, shard_chars: int = SHARD_CHARS) -> Column:
    """The names that occur in a text, ignoring case, as a sorted array; a null text has none.

    ``whole_words`` asks for a letter, digit or underscore on neither side. The patterns are stored when this is called.
    """
    folder, shards = stored_patterns(patterns, name, shard_chars)

    @F.pandas_udf("array<string>")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only = automaton(folder, 0) if shards == 1 else None
        for texts in batches:
            hits: list[set[str]] = [set() for _ in texts]
            for shard in range(shards):
                tree = only if shards == 1 else automaton(folder, shard)
                if tree is None:
                    continue
                for held, line in zip(hits, texts):
                    if line:
                        for last, (size, names) in tree.iter(line):
                            if not whole_words or apart(line, last + 1 - size, last + 1):
                                held.update(names)
            yield pd.Series([sorted(h) for h in hits], dtype=object)

    return walk(F.lower(text))
