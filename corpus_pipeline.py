"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, source mix, shards.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of ``documents`` in all stages but
the last. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again for the next.

Rows are told apart by id and a hash of the text, so stages decide right where ids are null or repeat. Empty tables pass
every stage. Columns beyond those of ``documents`` are carried along up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import stored, table
from shelfspark.llm.decontamination import benchmark_items, find_leaks
from shelfspark.llm.mixing import mix_sources
from shelfspark.llm.ngram_join import NULL_ID, link_components
from shelfspark.llm.sharding import shard_by_curve
from shelfspark.llm.toxicity import fold, score_toxicity

TOXIC_SCORE = 0.3


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of ``docs`` but those named in ``bad`` (doc_id, mark)."""
    named = stored(bad.select(F.col("doc_id").alias("_bad_id"), F.col("mark").alias("_bad_mark")).distinct(), "rejected")
    small = named.count() <= 1_000_000  # sixteen bytes a row
    named = F.broadcast(named) if small else named.hint("shuffle_hash")
    same = docs["doc_id"].eqNullSafe(F.col("_bad_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("_bad_mark"))
    return docs.join(named, same, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score marks them as toxic."""
    scores = score_toxicity(docs, table(spark, sf_dir, "labels"), fold() != 2)
    return without(docs, scores.where(F.col("score") >= TOXIC_SCORE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: the one with the smallest id. Texts without words are in none and stay."""
    linked = stored(link_components(docs), "components")
    place = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("rank"), "mark")
    first = linked.where("n_shingles > 0").groupBy("component").agg(F.min(place).alias("first"))
    others = linked.join(first, "component").where(place != F.col("first"))
    kept = without(docs, others)
    # The row that stays may itself stand in the table several times.
    again = linked.where("n_shingles > 0").groupBy("doc_id", "mark").count().where("count > 1")
    again = stored(again.join(first, (F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("first.rank")) & (F.col("mark") == F.col("first.mark"))).select("doc_id", again["mark"]), "repeats")
    if again.isEmpty():
        return kept
    named = again.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    same = kept["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(kept["text"]) == F.col("_mark"))
    copies = kept.join(named, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(named, same, "left_anti").unionByName(copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain an item of the benchmark."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("key"), "text")
    leaks = find_leaks(keyed, benchmark_items(table(spark, sf_dir, "benchmark")), id_column="key")
    return without(docs, leaks.select("key.doc_id", "key.mark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the documents of each source as often as the mix asks for: not at all, once, or twice."""
    return mix_sources(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every row in one of eight shards along the curve."""
    return shard_by_curve(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("shards", shards),
]

#: Trained models and random draws have no SQL form; tests compare the stages with plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = stored(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
