"""Helpers shared by the corpus operators: stored intermediate tables, global ranks, words and shingles in tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.session import scratch_path

#: A word is a run of characters that are not ASCII white space. ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: later plans start from the files, on any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with a column ``name``: the 0-based place of each row in the order, which must be total.

    Rows are dealt out by ranges and ranked inside each range; only one count per range meets in one place.
    """
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    dealt = df.withColumns(keys).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    rows = stored(dealt, "ranked")
    ahead = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(ahead, F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    # One row per range: as many as there are shuffle partitions.
    ranked = rows.withColumn(name, inside).join(F.broadcast(starts.drop("_n")), "_range")
    return ranked.withColumn(name, (F.col(name) - 1 + F.col("_ahead")).cast("long")).drop("_range", "_ahead", *keys)


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that every bit of the result depends on every bit of the value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of every run of ``width`` consecutive word hashes; empty when there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(factor) + hashes[k : k + n]
    return mix64(out)


def shingle_set(words: Sequence[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles. Fewer words give one shingle, no words give none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = word_hashes(words)
    return np.unique(window_hashes(hashes, min(width, len(words))) ^ np.uint64(min(width, len(words)) % width))
