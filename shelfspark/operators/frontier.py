"""Task tables: which source, keyword and page to visit, in which order and batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.urls import search_url

# Parts of the priority by expected yield.
BASE_PRIORITY = 100
PAGE_PENALTY = 10
SOURCE_BONUS = {"ebay": 20, "walmart": 10, "amazon": 0}
OTHER_SOURCE_BONUS = 5
COMMON_KEYWORDS = ("laptop", "phone", "computer", "tablet")
COMMON_KEYWORD_PENALTY = 15
# First pages go first; high-ranked keywords go deeper.
FIRST_PAGES = 2
HIGH_RANKS = 10
HIGH_DEPTH, LOW_DEPTH = 4, 3
BATCH_SIZE = 12


def keyword_table(spark: SparkSession, keywords: Sequence[str]) -> DataFrame:
    """A configured keyword list as (keyword_no, keyword), numbered from 0."""
    return spark.createDataFrame(list(enumerate(keywords)), "keyword_no long, keyword string")


def _with_sources(keywords: DataFrame, sources: Sequence[str]) -> DataFrame:
    return keywords.select(
        "*", F.posexplode(F.array(*[F.lit(s) for s in sources])).alias("source_no", "source")
    )


def frontier(keywords: DataFrame, sources: Sequence[str], max_pages: int, scraper_type: str = "static") -> DataFrame:
    """Every source, keyword and page; keywords stay distributed, sources and pages are expanded in place."""
    return _with_sources(keywords, sources).select(
        "source_no",
        "source",
        "keyword_no",
        "keyword",
        F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page"),
        F.lit(scraper_type).alias("scraper_type"),
    )


def with_priority(tasks: DataFrame, mode: str = "page") -> DataFrame:
    """'page': 1 for the first pages, else 2 (small first). 'yield': expected yield (large first)."""
    if mode == "page":
        return tasks.withColumn("priority", F.when(F.col("page") <= FIRST_PAGES, 1).otherwise(2))
    bonus = F.lit(OTHER_SOURCE_BONUS)
    for source, value in SOURCE_BONUS.items():
        bonus = F.when(F.col("source") == source, value).otherwise(bonus)
    common = F.when(F.lower("keyword").isin(*COMMON_KEYWORDS), COMMON_KEYWORD_PENALTY).otherwise(0)
    value = F.lit(BASE_PRIORITY) + bonus - (F.col("page") - 1) * PAGE_PENALTY - common
    return tasks.withColumn("priority", F.greatest(F.lit(1), value))


def by_priority(tasks: DataFrame) -> DataFrame:
    """Highest priority first, generation order within."""
    return tasks.orderBy(F.desc("priority"), "page", "keyword_no", "source_no")


def batches(keywords: DataFrame, sources: Sequence[str], size: int = BATCH_SIZE) -> DataFrame:
    """Tasks without pages in batches of ``size`` in generation order, with depth by keyword rank.

    The number of a task follows from its keyword and source numbers, so no global numbering is needed.
    """
    rank = F.col("keyword_no") + 1
    number = F.col("keyword_no") * len(sources) + F.col("source_no")
    return _with_sources(keywords, sources).select(
        (F.floor(number / size) + 1).alias("batch"),
        "source",
        "keyword",
        rank.alias("priority"),
        F.when(rank <= HIGH_RANKS, HIGH_DEPTH).otherwise(LOW_DEPTH).alias("max_pages"),
    )


def in_batch_order(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy("batch", "source", "priority")


def with_search_url(tasks: DataFrame, blank: str = " ") -> DataFrame:
    return tasks.withColumn("url", search_url(F.col("source"), F.col("keyword"), F.col("page"), blank))
