"""Registered queries of the corpus operators; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import table
from shelfspark.llm.decontamination import benchmark_items, find_leaks
from shelfspark.llm.licenses import scan_licenses
from shelfspark.llm.mixing import as_units, mix_plan
from shelfspark.llm.ngram_join import link_components
from shelfspark.llm.periodic_runs import find_periodic_runs, longest_exponent, with_planted_period
from shelfspark.llm.quality import quality_rules
from shelfspark.llm.sharding import shard_by_curve
from shelfspark.llm.simhash import simhash_components
from shelfspark.llm.skip_list import fill_in_middle, restored
from shelfspark.llm.substrings import remove_repeated_substrings
from shelfspark.llm.token_counts import count_tokens
from shelfspark.llm.toxicity import fold, score_toxicity
from shelfspark.llm.warc import read_archives, write_archives
from shelfspark.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(as_units(table(spark, sf_dir, "documents")))
    rows = plan.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return rows.select(
        F.col("id").cast("long").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies",
    )


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages")))
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast("long")
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"), "digest_ok",
    )


@query
def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), benchmark_items(table(spark, sf_dir, "benchmark")))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold() != 2)
    return scores.select(
        "doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_by_curve(table(spark, sf_dir, "documents"))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve_place",
    )


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(
        table(spark, sf_dir, "documents"), scratch_path(spark, "token-cache"), public_tokenizers.path("word_bpe_49k.json")
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_period(F.col("text"), number).alias("text"))
    found = find_periodic_runs(docs).withColumn("best", longest_exponent(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLES["op12_fill_in_middle"] = """
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
    FROM documents
), drawn AS (
    SELECT *, CAST(len(u) AS BIGINT) AS n,
        CAST('0x' || digest[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || digest[9:16] AS BIGINT) % (len(u) + 1) AS c2,
        CAST('0x' || digest[17:24] AS BIGINT) % 100 AS d3, CAST('0x' || digest[25:32] AS BIGINT) % 100 AS d4
    FROM units
), cut AS (
    SELECT doc_id, text, n,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d3 >= 90 THEN 'plain'
            WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(u[1:least(c1, c2)], '') AS prefix,
        array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
        array_to_string(u[greatest(c1, c2) + 1:], '') AS suffix
    FROM drawn
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM cut
"""


@query
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", digits.alias("fingerprint"), "component_id")


def load() -> tuple[dict, dict]:
    return dict(QUERIES), dict(ORACLES)
