"""Views of the supplied tables in the shape of the listing domain.

Pure projections, so filters and column pruning still reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_columns() -> list[Column]:
    rating = F.when(F.col("l_linenumber") % 4 != 0, 1 + (F.col("l_partkey") % 40) / 10.0)
    return [
        F.col("l_returnflag").alias("source"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_linestatus").alias("scraper_type"),
        (F.col("l_extendedprice") / 50.0).alias("price"),
        rating.alias("rating"),
        F.col("l_shipdate").alias("scraped_at"),
        F.concat(
            F.lit("https://"), F.lower("l_returnflag"), F.lit(".example.com/dp/"), F.col("l_partkey")
        ).alias("url"),
        F.col("l_orderkey").alias("order_no"),
        F.col("l_linenumber").alias("line_no"),
    ]


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing sightings without catalogue columns (no join)."""
    return table(spark, sf_dir, "lineitem").select(*_line_columns())


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing sightings with title, keyword and brand from the catalogue."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        *_line_columns(),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("search_keyword"),
        F.col("p_brand").alias("brand"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price ticks per (source, product_id); prices move in steps of 20."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"),
        F.col("user_id").cast("string").alias("product_id"),
        (F.floor(F.col("value") / 20.0) * 20.0).alias("price"),
        F.col("ts").alias("recorded_at"),
        F.col("event_id").alias("id"),
    )


# The same views for the comparison engine; %s placeholders are not needed, tables are registered there.
SQL_VIEWS = {
    "sightings": """SELECT l_returnflag AS source, CAST(l_partkey AS VARCHAR) AS product_id,
        l_linestatus AS scraper_type, l_extendedprice / 50.0 AS price,
        CASE WHEN l_linenumber % 4 <> 0 THEN 1 + (l_partkey % 40) / 10.0 END AS rating,
        l_shipdate AS scraped_at,
        'https://' || lower(l_returnflag) || '.example.com/dp/' || l_partkey AS url,
        l_orderkey AS order_no, l_linenumber AS line_no FROM lineitem""",
    "listings": """SELECT l_returnflag AS source, CAST(l_partkey AS VARCHAR) AS product_id,
        l_linestatus AS scraper_type, l_extendedprice / 50.0 AS price,
        CASE WHEN l_linenumber % 4 <> 0 THEN 1 + (l_partkey % 40) / 10.0 END AS rating,
        l_shipdate AS scraped_at,
        'https://' || lower(l_returnflag) || '.example.com/dp/' || l_partkey AS url,
        l_orderkey AS order_no, l_linenumber AS line_no,
        p_name AS title, p_type AS search_keyword, p_brand AS brand
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "ticks": """SELECT event_type AS source, CAST(user_id AS VARCHAR) AS product_id,
        floor(value / 20.0) * 20.0 AS price, ts AS recorded_at, event_id AS id FROM events""",
}
