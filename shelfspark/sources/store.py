"""The product table, its price history, and retention, on plain Parquet.

A stored table is a folder of complete versions. A new version is written beside the old one and is visible once
its success marker exists, so a failed or repeated write never harms the readers.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.hashing import listing_hash, product_key
from shelfspark.functions.times import days_before
from shelfspark.operators.filters import conform
from shelfspark.operators.history import price_changes, split_null_keys
from shelfspark.operators.skew import first_per_key
from shelfspark.schemas import PRICE_HISTORY

KEYS = ("source", "product_id")


def last_sightings(batch: DataFrame, order: Sequence[str] = ("scraped_at", "data_hash")) -> tuple[DataFrame, DataFrame]:
    """Newest row per product with its hash, and the rows without a complete key."""
    good, rejects = split_null_keys(batch, KEYS)
    if "data_hash" not in good.columns or "title" in good.columns:
        title = F.col("title") if "title" in good.columns else F.lit(None)
        good = good.withColumn("data_hash", listing_hash(F.col("source"), F.col("product_id"), title))
    return first_per_key(good, list(KEYS), list(order), last=True), rejects


def upsert(
    current: DataFrame, batch: DataFrame, order: Sequence[str] = ("scraped_at", "data_hash")
) -> tuple[DataFrame, DataFrame]:
    """Product table after a batch, and the rejected rows.

    Per product the newer of the stored row and the batch's last row wins, by the order's columns as far as both sides
    have them; on a tie the batch does. So the table does not depend on how rows are cut into batches. Columns the winning
    batch row carries overwrite, also with null; other columns keep their value. Both sides have one row per key, so the join
    cannot be skewed.
    """
    newest, rejects = last_sightings(batch, order)
    new_columns = set(newest.columns)
    columns = list(dict.fromkeys([*current.columns, *newest.columns]))
    # A computed product hash belongs to the table only when the table keeps it.
    if "data_hash" not in current.columns and "data_hash" not in batch.columns:
        columns.remove("data_hash")
    old = current.withColumn("_old", F.lit(True)).alias("old")
    new = newest.withColumn("_new", F.lit(True)).alias("new")
    joined = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in KEYS], "full_outer")

    compared = [c for c in order if c in current.columns and c in new_columns]
    ranks = [F.struct(*[F.col(f"{side}.{c}") for c in compared]) for side in ("old", "new")] if compared else None
    takes_over = F.col("new._new") & F.col("old._old").isNull()
    takes_over = takes_over | (F.col("new._new") & (ranks[1] >= ranks[0] if ranks else F.lit(True)))

    def value(name: str):
        if name in KEYS:
            return F.coalesce(f"new.{name}", f"old.{name}")
        if name not in new_columns:
            return F.col(f"old.{name}")
        if name not in current.columns:
            return F.when(takes_over, F.col(f"new.{name}"))
        return F.when(takes_over, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))

    return joined.select(*[value(c).alias(c) for c in columns]), rejects


def split_existing(current: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batch rows that update a known product, and those that insert a new one."""
    known = current.select(*KEYS).distinct()
    return batch.join(known, list(KEYS), "left_semi"), batch.join(known, list(KEYS), "left_anti")


def last_prices(history: DataFrame, at: str = "recorded_at") -> DataFrame:
    """Last known price per product of the stored history, for :func:`new_history`."""
    product = F.col("source_product_id") if "source_product_id" in history.columns else F.col("product_id")
    known = history.where(F.col("price").isNotNull()).select("source", product.alias("product_id"), "price", at)
    return known.groupBy(*KEYS).agg(F.max_by("price", F.struct(at, "price")).alias("price"))


def new_history(current: DataFrame, batch: DataFrame, ts: str = "scraped_at", tiebreak: str = "id") -> DataFrame:
    """History rows a batch adds: first sightings, and prices that differ from the one before.

    ``current`` holds one row per product with its last price; its prices take part as the earliest sighting. Where null
    prices may overwrite those of the product table, pass :func:`last_prices` of the stored history instead.
    """
    carried = [c for c in batch.columns if c not in (*KEYS, "price", ts, tiebreak)]
    known = current.where(F.col("price").isNotNull()).select(*KEYS, "price")
    seeds = known.join(batch.select(*KEYS).distinct(), list(KEYS), "left_semi").withColumns(
        {ts: F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"), tiebreak: F.lit(None), "_seed": F.lit(True)}
    )
    rows = batch.select(*KEYS, "price", ts, tiebreak, *carried).withColumn("_seed", F.lit(False))
    changes = price_changes(rows.unionByName(seeds, allowMissingColumns=True), KEYS, ts, tiebreak)
    return changes.where(~F.col("_seed")).drop("_seed")


def history_rows(changes: DataFrame, ts: str = "scraped_at") -> DataFrame:
    """Changes in the declared shape of the history table."""
    keyed = changes.withColumns(
        {"product_key": product_key(*[F.col(k) for k in KEYS]), "source_product_id": F.col("product_id")}
    )
    if ts != "recorded_at":
        keyed = keyed.withColumn("recorded_at", F.col(ts))
    return conform(keyed, PRICE_HISTORY, {"currency": "USD"})


def append_history(changes: DataFrame, path: str, batch_id: int) -> None:
    """History rows of one batch added to the stored history; repeating a batch replaces its own rows."""
    changes.write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")


def retain(df: DataFrame, ts: str, days: int, as_of: datetime | str) -> tuple[DataFrame, DataFrame]:
    """Rows not older than ``days``, and the number of older ones; rows without a time stay."""
    old = F.coalesce(F.col(ts) < days_before(as_of, days), F.lit(False))
    return df.where(~old), df.agg(F.count_if(old).alias("removed"))


# --- stored versions --------------------------------------------------------------------------------


def _file_system(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions below a folder, oldest first."""
    fs, path = _file_system(spark, root)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[2:]))
    return sorted(found)


def publish(df: DataFrame, root: str, version: int) -> None:
    """Write one version; repeating a version replaces it."""
    df.write.mode("overwrite").parquet(f"{root}/v={version:09d}")


def read_version(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """Newest complete version (older than ``before``), or None."""
    found = [v for v in versions(spark, root) if before is None or v < before]
    return spark.read.parquet(f"{root}/v={found[-1]:09d}") if found else None


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders directly below a folder; none when it does not exist."""
    fs, path = _file_system(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, found = _file_system(spark, path)
    fs.delete(found, True)


@contextmanager
def reading(spark: SparkSession, root: str, version: int | None = None) -> Iterator[DataFrame]:
    """The newest version, or a stated one, kept from :func:`vacuum` as long as the block runs.

    A lease is an empty file ``_leases/v=N-<id>`` that every process sees; its time tells how old it is.
    """
    fs, path = _file_system(spark, root)
    number = version if version is not None else versions(spark, root)[-1]
    lease = spark._jvm.org.apache.hadoop.fs.Path(path, f"_leases/v={number:09d}-{uuid.uuid4().hex}")
    fs.create(lease, True).close()
    try:
        yield spark.read.parquet(f"{root}/v={number:09d}")
    finally:
        fs.delete(lease, False)


def vacuum(spark: SparkSession, root: str, keep: int = 2, lease_hours: float = 24.0) -> list[int]:
    """Remove all but the newest ``keep`` versions, and what failed writes left before them; returns the versions removed.

    Versions that somebody reads (see :func:`reading`) stay. A lease older than ``lease_hours`` was left by a reader that
    died, and holds nothing any more.
    """
    fs, path = _file_system(spark, root)
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    kept = set(versions(spark, root)[-max(keep, 1) :])
    if not kept:
        return []
    leases, oldest = new_path(path, "_leases"), time.time() * 1000 - lease_hours * 3_600_000
    for status in fs.listStatus(leases) if fs.exists(leases) else ():
        if status.getModificationTime() >= oldest:
            kept.add(int(status.getPath().getName()[2:].split("-")[0]))
        else:
            fs.delete(status.getPath(), False)
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    old = sorted(int(n[2:]) for n in names if n.startswith("v="))
    removed = [v for v in old if v < max(kept) and v not in kept]
    for number in removed:
        fs.delete(new_path(path, f"v={number:09d}"), True)
    return removed
