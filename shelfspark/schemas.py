"""Declared schemas of the listing domain."""

from __future__ import annotations

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())
_STRING_MAP = T.MapType(T.StringType(), T.StringType())


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


LISTING = _schema(
    ("title", T.StringType()),
    ("url", T.StringType()),
    ("product_id", T.StringType()),
    ("source", T.StringType()),
    ("price", T.DoubleType()),
    ("original_price", T.DoubleType()),
    ("currency", T.StringType()),
    ("discount_percent", T.DoubleType()),
    ("description", T.StringType()),
    ("category", T.StringType()),
    ("brand", T.StringType()),
    ("condition", T.StringType()),
    ("availability", T.StringType()),
    ("rating", T.DoubleType()),
    ("review_count", T.IntegerType()),
    ("image_url", T.StringType()),
    ("additional_images", _STRINGS),
    ("shipping_cost", T.DoubleType()),
    ("seller_name", T.StringType()),
    ("seller_rating", T.DoubleType()),
    ("specifications", _STRING_MAP),
    ("scraped_at", T.TimestampNTZType()),
    ("last_updated", T.TimestampNTZType()),
    ("search_keyword", T.StringType()),
    ("page_number", T.IntegerType()),
    ("position_on_page", T.IntegerType()),
    ("scraper_type", T.StringType()),
    ("data_hash", T.StringType()),
    ("is_valid", T.BooleanType()),
    ("validation_errors", _STRINGS),
)

# Values a listing takes when the column is missing altogether.
LISTING_DEFAULTS = {"currency": "USD", "scraper_type": "static", "is_valid": True}

# Columns left out of the serialised form of a listing.
INTERNAL_COLUMNS = ("additional_images", "specifications", "data_hash", "validation_errors")

# Columns the analyses read, in the order of the scan.
ANALYSIS_COLUMNS = (
    "source", "title", "price", "rating", "search_keyword", "scraper_type", "scraped_at", "url",
    "image_url", "product_id", "brand", "condition", "availability", "review_count", "shipping_cost",
)

PRICE_HISTORY = _schema(
    ("product_key", T.LongType()),
    ("source_product_id", T.StringType()),
    ("source", T.StringType()),
    ("price", T.DoubleType()),
    ("currency", T.StringType()),
    ("original_price", T.DoubleType()),
    ("discount_percent", T.DoubleType()),
    ("recorded_at", T.TimestampNTZType()),
    ("availability", T.StringType()),
    ("condition", T.StringType()),
)

RUN_LOG = _schema(
    ("session_id", T.StringType()),
    ("source", T.StringType()),
    ("search_keywords", _STRINGS),
    ("max_pages", T.IntegerType()),
    ("target_urls", _STRINGS),
    ("started_at", T.TimestampNTZType()),
    ("completed_at", T.TimestampNTZType()),
    ("duration_seconds", T.IntegerType()),
    ("total_products_found", T.IntegerType()),
    ("total_products_saved", T.IntegerType()),
    ("total_pages_scraped", T.IntegerType()),
    ("total_errors", T.IntegerType()),
    ("success_rate", T.DoubleType()),
    ("avg_response_time", T.DoubleType()),
    ("scraper_config", _STRING_MAP),
    ("status", T.StringType()),
    ("error_message", T.StringType()),
    ("user_agent", T.StringType()),
)

RUN_LOG_DEFAULTS = {
    "status": "running",
    "total_products_found": 0,
    "total_products_saved": 0,
    "total_pages_scraped": 0,
    "total_errors": 0,
}

TASK = _schema(
    ("source", T.StringType()),
    ("keyword", T.StringType()),
    ("page", T.IntegerType()),
    ("scraper_type", T.StringType()),
    ("priority", T.IntegerType()),
    ("retry_count", T.IntegerType()),
    ("max_retries", T.IntegerType()),
)

TASK_RESULT = _schema(
    ("task", TASK),
    ("success", T.BooleanType()),
    ("data", T.ArrayType(LISTING)),
    ("execution_time", T.DoubleType()),
    ("error", T.StringType()),
    ("worker", T.StringType()),
)

PAGE = _schema(("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()))
