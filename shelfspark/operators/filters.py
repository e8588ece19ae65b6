"""Projections and predicates on listings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import PROMOTIONAL_TITLES, contains_any
from shelfspark.functions.times import days_before
from shelfspark.schemas import INTERNAL_COLUMNS, LISTING, LISTING_DEFAULTS


def conform(df: DataFrame, schema: T.StructType = LISTING, defaults: dict = LISTING_DEFAULTS) -> DataFrame:
    """Exactly the declared columns: unknown ones go, missing ones come as default or typed null."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(defaults.get(f.name)))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def to_output(df: DataFrame) -> DataFrame:
    """Serialised form: timestamps as ISO text, internal columns left out."""
    columns = []
    for field in df.schema.fields:
        if field.name in INTERNAL_COLUMNS:
            continue
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            micros = F.date_format(field.name, "SSSSSS")
            text = F.date_format(field.name, "yyyy-MM-dd'T'HH:mm:ss")
            columns.append(
                F.when(micros == "000000", text).otherwise(F.concat_ws(".", text, micros)).alias(field.name)
            )
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def positive_price(df: DataFrame) -> DataFrame:
    return df.where(F.col("price") > 0)


def priced(df: DataFrame) -> DataFrame:
    return df.where(F.col("price").isNotNull())


def by_source(df: DataFrame, source: str) -> DataFrame:
    return df.where(F.col("source") == source)


def by_keyword(df: DataFrame, keyword: str) -> DataFrame:
    """Rows whose keyword contains the text, ASCII case ignored; % and _ act as wildcards."""
    return df.where(F.col("search_keyword").ilike(f"%{keyword}%"))


def recent(df: DataFrame, ts: str, days: int, as_of: datetime | str) -> DataFrame:
    return df.where(F.col(ts) >= days_before(as_of, days))


def enabled_only(df: DataFrame, sources: Sequence[str]) -> DataFrame:
    return df.where(F.col("source").isin(*sources))


def not_promotional(df: DataFrame, phrases: tuple[str, ...] = PROMOTIONAL_TITLES) -> DataFrame:
    """Promotional titles dropped; rows without a title stay."""
    return df.where(~F.coalesce(contains_any(F.col("title"), phrases), F.lit(False)))


def with_created_at(df: DataFrame) -> DataFrame:
    """created_at as alias of scraped_at, whichever of the two is present."""
    if "created_at" not in df.columns:
        return df.withColumn("created_at", F.col("scraped_at"))
    if "scraped_at" not in df.columns:
        return df
    return df.withColumn("created_at", F.coalesce("created_at", "scraped_at"))


def flatten_success(results: DataFrame) -> DataFrame:
    """Listing rows of the successful tasks that returned any."""
    return results.where("success").select(F.explode("data").alias("_row")).select("_row.*")
