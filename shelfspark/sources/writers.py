"""Writing listings and results. Partitioned writes need no shuffle: every task writes its own rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators.filters import recent


def write_listings(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by source and day, so that filters on either skip whole folders."""
    dated = df.withColumn("scraped_date", F.to_date("scraped_at"))
    dated.write.mode(mode).partitionBy("source", "scraped_date").parquet(path)


def write_json(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """JSON lines, one folder per value of the partition columns."""
    df.write.mode(mode).partitionBy(*partition_by).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header; nested values are written as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields
    ]
    df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def export(
    df: DataFrame, fmt: str, path: str, days: int | None = None, as_of: datetime | str | None = None
) -> None:
    """Listings of the last days as csv, json or sheets (one folder per sheet)."""
    rows = df if days is None else recent(df, "scraped_at", days, as_of)
    if fmt == "csv":
        write_csv(rows, path)
    elif fmt == "json":
        write_json(rows, path)
    elif fmt == "excel":
        from shelfspark.plans.reports import report_sheets

        for name, sheet in report_sheets(rows).items():
            write_csv(sheet, f"{path}/{name}")
    else:
        raise ValueError(f"unknown export format: {fmt}")


def source_manifest(df: DataFrame, scraper_type: str, method: str) -> DataFrame:
    """Header of the per-source output and of the combined one: source, kind, products, method."""
    counts = df.groupBy("source").agg(F.count(F.lit(1)).alias("total_products"))
    total = counts.agg(F.lit("combined").alias("source"), F.sum("total_products").alias("total_products"))
    return counts.unionByName(total).select(
        "source", F.lit(scraper_type).alias("scraper_type"), "total_products", F.lit(method).alias("extraction_method")
    )


def observed_count(df: DataFrame, name: str = "saved") -> tuple[DataFrame, Observation]:
    """The rows, and an observation that holds their number once they have been written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def observe_metrics(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Rows, valid rows and priced rows counted while the data passes."""
    seen = Observation(name)
    valid = F.count_if("is_valid") if "is_valid" in df.columns else F.count(F.lit(1))
    metrics = (F.count(F.lit(1)).alias("rows"), valid.alias("valid"), F.count("price").alias("priced"))
    return df.observe(seen, *metrics), seen
