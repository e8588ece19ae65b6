"""Deduplication keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.numbers import float_text


def listing_hash(source: Column, product_id: Column, title: Column) -> Column:
    """MD5 of source-id-title; a missing part is written as the word None."""
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in (source, product_id, title)]
    return F.md5(F.concat_ws("-", *parts))


def content_hash(title: Column, url: Column, price: Column, source: Column) -> Column:
    """MD5 over the identifying content; a missing part counts as empty."""
    parts = [title, url, float_text(price.cast("double")), source]
    return F.md5(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))


def product_key(source: Column, product_id: Column) -> Column:
    """Stable surrogate key of a product."""
    return F.xxhash64(source, product_id)
