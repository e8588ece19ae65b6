"""Streams that are ended amid their micro-batches and started again, and the removal of old versions."""

import os
import time
from datetime import datetime, timedelta

import pytest

from shelfspark.operators.history import price_changes
from shelfspark.sources import store
from shelfspark.streaming import streams

START = datetime(2024, 1, 1)
TICK = "source string, product_id string, price double, recorded_at timestamp_ntz, id long"


def files(spark, folder, count=6):
    for k in range(count):
        rows = [("s", f"p{i % 5}", float((i * 7 + k) % 3), START + timedelta(hours=20 * k + i), 100 * k + i) for i in range(20)]
        spark.createDataFrame(rows, TICK).coalesce(1).write.parquet(f"{folder}/part{k}")
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def dying(run, at, before):
    """``run``, but it fails in batch ``at``: before its work or after it."""

    def wrapped(batch, batch_id):
        if batch_id == at and before:
            raise RuntimeError("killed")
        run(batch, batch_id)
        if batch_id == at:
            raise RuntimeError("killed")

    return wrapped


def test_price_changes_go_on_after_a_kill(spark, tmp_path):
    stream, root = files(spark, tmp_path / "in", 4), str(tmp_path / "out")
    for at, before in ((1, True), (2, False)):
        with pytest.raises(Exception, match="killed"):
            streams._run_batches(stream, root, dying(streams.price_change_batches(root), at, before))
    streams._run_batches(stream, root, streams.price_change_batches(root))
    got = spark.read.parquet(f"{root}/changes").collect()
    batch = price_changes(spark.read.schema(TICK).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))).collect()
    assert sorted((r.id, r.previous_price is None, r.previous_price or 0.0) for r in got) == sorted(
        (r.id, r.previous_price is None, r.previous_price or 0.0) for r in batch
    )


def test_windows_go_on_after_a_stop(spark, tmp_path):
    """Stopped after some micro-batches of a file sink, the same counts come out as without a stop."""
    stream = files(spark, tmp_path / "in")
    counts = streams.stream_daily_counts(stream, "1 day", "recorded_at")
    root = str(tmp_path / "out")

    def start(trigger):
        writer = counts.writeStream.option("checkpointLocation", f"{root}/checkpoint").format("parquet").option("path", f"{root}/rows")
        return writer.outputMode("append").trigger(**trigger).start()

    query = start({"processingTime": "0 seconds"})
    deadline = time.time() + 60
    while len(query.recentProgress) < 2 and time.time() < deadline:
        time.sleep(0.05)
    query.stop()
    done = len([f for f in os.listdir(f"{root}/checkpoint/commits") if not f.startswith(".")])
    assert 1 <= done
    start({"availableNow": True}).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{root}/rows").collect())
    whole = sorted(tuple(r) for r in streams.run_available(counts, "whole").collect())
    assert got == whole and len(got) >= 3


def listing(spark, n):
    rows = [("T", f"https://a.com/{k}", "s", str(k), 5.0 + n, START + timedelta(hours=n)) for k in range(4)]
    return spark.createDataFrame(rows, "title string, url string, source string, product_id string, price double, scraped_at timestamp_ntz")


def test_versions_stay_bounded(spark, tmp_path):
    root = str(tmp_path / "shop")
    run = streams.ingest(root, compact_every=1, keep=2)
    run(listing(spark, 0), 0)
    with store.reading(spark, f"{root}/products") as held:
        for n in range(1, 4):
            run(listing(spark, n), n)
        assert store.versions(spark, f"{root}/products") == [0, 2, 3]
        assert {r.price for r in held.collect()} == {5.0}
    run(listing(spark, 4), 4)
    assert store.versions(spark, f"{root}/products") == [3, 4]
    assert {r.price for r in store.read_version(spark, f"{root}/products").collect()} == {9.0}


def test_vacuum(spark, tmp_path):
    root = str(tmp_path / "t")
    assert store.vacuum(spark, root) == []
    for n in range(4):
        store.publish(spark.range(n + 1), root, n)
    os.remove(f"{root}/v=000000001/_SUCCESS")  # a write that failed
    with store.reading(spark, root, 0) as oldest:
        assert store.vacuum(spark, root, keep=1) == [1, 2]
        assert oldest.count() == 1
        for file in os.scandir(f"{root}/_leases"):
            os.utime(file.path, (0, 0))  # a reader that died long ago
        assert store.vacuum(spark, root, keep=1) == [0]
    assert store.versions(spark, root) == [3] and os.listdir(f"{root}/_leases") == []
