"""Keyed state on plain Parquet that costs what changes: runs of rows sorted by bucket of their key, and a manifest per version.

A version adds one run, the rows of the keys it touches. A run that is not clearly smaller than the one before it is merged
with it, so there are few runs and a row is rewritten only as often as the state doubles. Files are sorted by bucket, so reading
some buckets skips the rest of every run. The manifest of a version names its runs; it is written last, so a failed or
repeated version harms nobody.

Below ``root``: ``runs/v=N``, ``merged/v=N`` and ``manifest/v=N``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators.skew import first_per_key
from shelfspark.sources.store import folders, publish, read_version, remove, vacuum, versions

BUCKETS = 1024
MANIFEST = "path string, rows long"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class KeyedState:
    """The newest row of every key, by ``order``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.root, self.schema = spark, root, schema
        self.keys, self.order, self.buckets = list(keys), tuple(order), buckets
        self.stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])

    def manifest(self, before: int | None = None) -> list[tuple[str, int]]:
        """Runs (path, rows), oldest first; every one at least twice the next."""
        found = read_version(self.spark, f"{self.root}/manifest", before)
        return [] if found is None else sorted(((r.path, r.rows) for r in found.collect()), key=lambda r: -r[1])

    def _read(self, paths: Sequence[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*[f"{self.root}/{p}" for p in paths])

    def read(self, before: int | None = None, touched: Iterable[int] | None = None) -> DataFrame:
        """One row a key, of the touched buckets or of all."""
        rows = self._read([path for path, _ in self.manifest(before)])
        if touched is not None:
            rows = rows.where(F.col("bucket").isin(*touched))
        return first_per_key(rows.drop("bucket"), self.keys, self.order, last=True)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys of ``rows``, at most ``buckets`` numbers."""
        found = rows.select(bucket_of(self.keys, self.buckets).alias("bucket")).distinct().collect()
        return sorted(r.bucket for r in found)

    def add(self, rows: DataFrame, version: int) -> None:
        """A version with ``rows``, one a key, added; repeating a version replaces it."""
        path = f"runs/v={version:09d}"
        runs, n = self.manifest(version), self._write(rows, path)
        new = [path]
        while runs and runs[-1][1] <= 2 * n:
            earlier, size = runs.pop()
            new.append(earlier)
            n += size
        if len(new) > 1:
            together, path = self._read(new).drop("bucket"), f"merged/v={version:09d}"
            n = self._write(first_per_key(together, self.keys, self.order, last=True), path)
        publish(self.spark.createDataFrame([*runs, (path, n)], MANIFEST).coalesce(1), f"{self.root}/manifest", version)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove the runs that the newest ``keep`` versions do not name, and older manifests; returns the runs removed."""
        kept = versions(self.spark, f"{self.root}/manifest")[-keep:]
        named = {path for v in kept for path, _ in self.manifest(v + 1)}
        found = [f"{kind}/{name}" for kind in ("runs", "merged") for name in folders(self.spark, f"{self.root}/{kind}")]
        removed = [path for path in found if path not in named and int(path.split("=")[1]) <= max(kept, default=-1)]
        for path in removed:
            remove(self.spark, f"{self.root}/{path}")
        vacuum(self.spark, f"{self.root}/manifest", keep)
        return removed

    def _write(self, rows: DataFrame, path: str) -> int:
        """Rows written, counted on the way."""
        placed, counted = rows.select(*self.schema.names, bucket_of(self.keys, self.buckets).alias("bucket")), Observation()
        sorted_out = placed.repartition("bucket").sortWithinPartitions("bucket").observe(counted, F.count(F.lit(1)).alias("n"))
        sorted_out.write.mode("overwrite").parquet(f"{self.root}/{path}")
        return counted.get["n"]
