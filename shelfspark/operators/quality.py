"""Validation, deduplication and data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.hashing import listing_hash
from shelfspark.functions.numbers import extract_price, extract_rating, float_text, to_number
from shelfspark.functions.text import clean_text
from shelfspark.functions.times import to_time
from shelfspark.functions.urls import BASE_URLS, by_source, is_valid_url, normalize_url
from shelfspark.operators.skew import first_per_key, join_group_table
from shelfspark.operators.stats import named, share_present

# Required fields and the price bounds of a valid row.
REQUIRED_FIELDS = ("title", "url", "source")
MIN_PRICE = 0.01
MAX_PRICE = 100_000
# Text and address fields that cleaning touches.
TEXT_FIELDS = ("title", "description", "brand", "condition", "availability")
URL_FIELDS = ("url", "image_url")


def clean_listings(df: DataFrame, base_urls: dict[str, str] = BASE_URLS, resolved: Sequence[str] = ()) -> DataFrame:
    """Text fields cleaned, price and rating taken out of text, addresses made absolute unless they are ``resolved`` already."""
    types = dict(df.dtypes)
    changed = {}
    for field in TEXT_FIELDS:
        if field in types:
            changed[field] = F.when(F.length(field) > 0, clean_text(F.col(field))).otherwise(F.col(field))
    for field, reader in (("price", extract_price), ("rating", extract_rating)):
        if types.get(field) == "string":
            changed[field] = reader(F.col(field))
    base = F.coalesce(by_source(F.col("source"), base_urls), F.lit(""))
    for field in URL_FIELDS:
        if field in types and field not in resolved:
            changed[field] = F.when(F.length(field) > 0, normalize_url(F.col(field), base)).otherwise(F.col(field))
    return df.withColumns(changed)


def validate(df: DataFrame, min_price: float = MIN_PRICE, max_price: float = MAX_PRICE) -> DataFrame:
    """Fills is_valid and validation_errors; no row is dropped."""
    price = F.col("price")
    number = to_number(price)
    checks = [
        F.when(F.coalesce(F.col(f) == "", F.lit(True)), F.lit(f"Missing required field: {f}"))
        for f in REQUIRED_FIELDS
    ]
    checks.append(
        F.when(
            price.isNotNull() & price.try_cast("double").isNull(),
            F.concat(F.lit("Invalid price format: "), price.cast("string")),
        ).when((number < min_price) | (number > max_price), F.concat(F.lit("Price out of range: "), float_text(number)))
    )
    checks.append(
        F.when(
            ~is_valid_url(F.col("url")),
            F.concat(F.lit("Invalid URL format: "), F.coalesce("url", F.lit("None"))),
        )
    )
    errors = F.array_compact(F.array(*checks))
    return df.withColumns({"validation_errors": errors, "is_valid": F.size(errors) == 0})


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned and validated rows, parted into good and bad ones."""
    checked = validate(clean_listings(df))
    return checked.where("is_valid"), checked.where(~F.col("is_valid"))


def coerce(df: DataFrame) -> DataFrame:
    """Prices and ratings as numbers, times as timestamps; what cannot be read becomes null."""
    types = dict(df.dtypes)
    changed = {c: to_number(F.col(c)) for c in ("price", "rating") if c in types}
    # Only text needs parsing; real timestamps stay as they are.
    changed |= {c: to_time(F.col(c)) for c in ("created_at", "scraped_at", "timestamp") if types.get(c) == "string"}
    return df.withColumns(changed)


def clean_frame(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Coerced rows with a positive price, one per (title, source): the first in the stated order.

    Null titles or sources count as equal to each other.
    """
    return first_per_key(coerce(df).where(F.col("price") > 0), ["title", "source"], order)


def with_listing_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("data_hash", listing_hash(F.col("source"), F.col("product_id"), F.col("title")))


def dedup_by_hash(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per hash: the first in the stated order."""
    return first_per_key(df, ["data_hash"], order)


def mark_duplicates(df: DataFrame, order: str, keys: Sequence[str] = ("title", "source")) -> DataFrame:
    """Every row with the size of its group and whether it repeats an earlier row.

    ``order`` must be unique. Only groups with more than one row take part in the join.
    """
    keys = list(keys)
    named = {k: f"_k_{k}" for k in keys}
    keyed = df.withColumns({v: F.md5(F.coalesce(F.col(k).cast("string"), F.lit("\u0000"))) for k, v in named.items()})
    groups = (
        keyed.groupBy(*named.values())
        .agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("_first"))
        .where("copies > 1")
    )
    joined = join_group_table(keyed, groups, list(named.values()), "copies", "left")
    return joined.select(
        *df.columns,
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce(F.col(order) != F.col("_first"), F.lit(False)).alias("is_repeat"),
    )


def completeness(df: DataFrame, columns: Sequence[str] = ("price", "rating", "url")) -> DataFrame:
    """Share of non-null values in percent, one column per field that exists."""
    return df.agg(*[(share_present(c) * 100).alias(f"has_{c}") for c in columns if c in df.columns])


def source_quality(df: DataFrame) -> DataFrame:
    """Mean of the completeness shares of price, rating and url per source."""
    columns = [c for c in ("price", "rating", "url") if c in df.columns]
    score = sum((share_present(c) for c in columns), F.lit(0.0)) / len(columns)
    return df.where(F.col("source").isNotNull()).groupBy("source").agg(score.alias("data_quality_score"))


def quality_columns(df: DataFrame) -> dict[str, Column]:
    """Completeness score, duplicate rate and invalid rate as aggregates."""
    columns = [c for c in ("price", "title", "source", "url") if c in df.columns]
    rows = F.count(F.lit(1))
    invalid = F.count_if(F.col("price") <= 0) + F.count_if(F.col("title").isNull())
    return {
        "completeness_score": sum((share_present(c) for c in columns), F.lit(0.0)) / len(columns),
        "duplicate_rate": F.try_divide((rows - F.count_distinct("title")) * 100.0, rows),
        "invalid_data_rate": F.try_divide(invalid * 100.0, rows),
    }


def data_quality(df: DataFrame) -> DataFrame:
    return df.agg(*named(quality_columns(df)))


def completeness_by_source(df: DataFrame, columns: Sequence[str] = ("price", "title")) -> DataFrame:
    return (
        df.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(*[(share_present(c) * 100).alias(f"{c}_complete") for c in columns])
    )


def price_quality(df: DataFrame) -> DataFrame:
    """Price completeness in whole percent (truncated)."""
    return df.agg((share_present("price") * 100).cast("int").alias("data_quality_score"))
