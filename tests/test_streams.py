import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfspark.operators.history import price_changes
from shelfspark.operators.trends import weekly_mean
from shelfspark.sources import store
from shelfspark.sources.buckets import KeyedState
from shelfspark.streaming import streams

START = datetime(2024, 1, 1)
TICK = "source string, product_id string, price double, recorded_at timestamp_ntz, id long"


def land(spark, folder, *files):
    """Each argument becomes one file, in this order."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, TICK).coalesce(1).write.parquet(f"{folder}/part{i}")
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def tick(hour, price, i, product="p", source="s"):
    return (source, product, price, START + timedelta(hours=hour), i)


def keyed(stream):
    streams.use_rocksdb(stream.sparkSession)
    return streams.run_available(streams.keyed_price_changes(stream), "keyed")


def batched(stream):
    return streams.run_price_changes(stream, "batched")


@pytest.mark.parametrize("run", [keyed, batched])
def test_price_changes_over_micro_batches(spark, tmp_path, run):
    files = [
        [tick(0, 10.0, 0), tick(1, 10.0, 1), tick(2, 12.0, 2), tick(0, 1.0, 3, "q"), tick(0, 1.0, 9, None)],
        [tick(3, 12.0, 4), tick(4, 10.0, 5), tick(1, 2.0, 6, "q"), tick(1, None, 10, "q"), tick(0, 5.0, 11, "r")],
    ]
    got = run(land(spark, tmp_path, *files)).collect()
    batch = spark.createDataFrame([r for f in files for r in f], TICK)
    assert {(r.id, r.previous_price) for r in got} == {(r.id, r.previous_price) for r in price_changes(batch).collect()}


@pytest.mark.parametrize("run", [keyed, batched])
def test_late_ticks_are_marked(spark, tmp_path, run):
    stream = land(spark, tmp_path, [tick(5, 10.0, 5)], [tick(1, 99.0, 1), tick(6, 11.0, 6), tick(5, 12.0, 5)])
    got = {(r.id, r.price, r.previous_price, r.late) for r in run(stream).collect()}
    assert got == {(5, 10.0, None, False), (6, 11.0, 10.0, False), (1, 99.0, None, True), (5, 12.0, None, True)}


def test_repeated_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "r")
    run = streams.price_change_batches(root)
    run(spark.createDataFrame([tick(0, 1.0, 0)], TICK), 0)
    for _ in range(2):
        run(spark.createDataFrame([tick(1, 2.0, 1)], TICK), 1)
    rows = spark.read.parquet(f"{root}/changes").collect()
    assert sorted((r.id, r.previous_price) for r in rows) == [(0, None), (1, 1.0)]


def ordered(stream, delay):
    streams.use_rocksdb(stream.sparkSession)
    return streams.run_available(streams.stream_price_changes(stream, delay), "ordered")


def ordered_batches(stream, delay):
    return streams.run_price_changes(stream, "ordered-batches", delay)


FAR = START + timedelta(days=2000)


def shuffled_files(seed, n=400, disorder=40, files=4):
    """Ticks that arrive up to ``disorder`` hours late, cut into files, and a tick far later that closes all."""
    rng = random.Random(seed)
    ticks = [tick(rng.randint(0, 300), float(rng.randint(1, 4)), i, f"p{rng.randint(0, 6)}") for i in range(n)]
    ticks += [("s", "p0", None, START, n), ("s", None, 1.0, START, n + 1)]
    arrived = sorted(ticks, key=lambda t: t[3] + timedelta(hours=rng.uniform(0, disorder)))
    cuts = sorted(rng.sample(range(1, len(ticks)), files - 1))
    files = [arrived[a:b] for a, b in zip([0, *cuts], [*cuts, None])]
    for file in files:
        rng.shuffle(file)
    return files, [("s", "end", 1.0, FAR, -1)]


@pytest.mark.parametrize("run,seed", [(ordered, 1), (ordered_batches, 2)])
def test_any_order_within_the_delay_equals_batch(spark, tmp_path, run, seed):
    files, end = shuffled_files(seed)
    got = run(land(spark, tmp_path, *files, end), "60 hours").where("product_id <> 'end'").collect()
    batch = price_changes(spark.createDataFrame([t for f in files for t in f], TICK)).collect()
    assert sorted((r.id, r.previous_price or 0.0, r.late) for r in got) == sorted((r.id, r.previous_price or 0.0, False) for r in batch)


@pytest.mark.parametrize("run", [ordered, ordered_batches])
def test_the_earlier_tick_may_come_second(spark, tmp_path, run):
    files = [tick(2, 20.0, 2)], [tick(1, 10.0, 1)], [tick(9, 20.0, 9)], [("s", "end", 1.0, FAR, -1)]
    got = run(land(spark, tmp_path, *files), "5 hours").where("product_id = 'p'").collect()
    assert sorted((r.id, r.price, r.previous_price, r.late) for r in got) == [(1, 10.0, None, False), (2, 20.0, 10.0, False)]


@pytest.mark.parametrize("run", [ordered, ordered_batches])
def test_beyond_the_delay_is_late(spark, tmp_path, run):
    files = [tick(0, 1.0, 0), tick(50, 2.0, 1)], [tick(1, 9.0, 2), tick(49, 3.0, 3)], [("s", "p", 5.0, None, 4), tick(100, 2.0, 5)], [("s", "end", 1.0, FAR, -1)]
    got = run(land(spark, tmp_path, *files), "8 hours").where("product_id = 'p'").collect()
    assert {(r.id, r.previous_price, r.late) for r in got} == {(0, None, False), (2, None, True), (3, 1.0, False), (1, 3.0, False), (4, None, True)}


def test_forgotten_products(spark, tmp_path):
    streams.use_rocksdb(spark)
    files = [tick(0, 1.0, 0)], [tick(10, 1.0, 1, "q")], [tick(200, 1.0, 2, "q")], [tick(210, 1.0, 3)], [("s", "end", 1.0, FAR, -1)]
    for keep, expected in ((None, [0, 1]), ("100 hours", [0, 1, 2, 3])):
        folder = tmp_path / str(keep)
        got = streams.run_available(streams.stream_price_changes(land(spark, folder, *files), "2 hours", keep), "kept")
        assert sorted(r.id for r in got.where("product_id <> 'end'").collect()) == expected


class Held:
    """State of one key in memory that counts the calls."""

    def __init__(self):
        self.value, self.rows, self.calls, self.timers = None, [], 0, []

    def getListState(self, name, schema):  # noqa: N802
        return self

    def getValueState(self, name, schema):  # noqa: N802
        return Last(self)

    def registerTimer(self, moment):  # noqa: N802
        self.calls += 1
        self.timers.append(moment)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.passed

    def appendList(self, rows):  # noqa: N802
        self.calls += 1
        self.rows = self.rows + rows

    def put(self, rows):
        self.calls += 1
        self.rows = rows

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def clear(self):
        self.put([])


class Last:
    def __init__(self, held):
        self.held = held

    def get(self):
        self.held.calls += 1
        return self.held.value

    def update(self, value):
        self.held.calls += 1
        self.held.value = value

    def clear(self):
        self.update(None)


def test_calls_to_the_state_do_not_grow_with_the_products():
    held, step, products = Held(), 3_600_000, 500
    processor = streams.OrderedPriceChanges(step, None)
    processor.init(held)
    passed = lambda hour: int((START + timedelta(hours=hour) - datetime(1970, 1, 1)).total_seconds() * 1000)
    found = []
    for number, hours in enumerate(((1, 0), (3, 2), (5, 4))):
        rows = [(3, "s", f"p{k}", h * 1000 + k, float((h + k) % 5 // 2), START + timedelta(hours=h)) for h in hours for k in range(products)]
        frame = pd.DataFrame(rows, columns=["bucket", "source", "product_id", "id", "price", "recorded_at"])
        held.passed = passed(2 * number)
        found += [f for f in processor.handleInputRows((3,), iter([frame[:700], frame[700:]]), held)]
        held.passed = passed(2 * number + 1)
        found += [f for f in processor.handleExpiredTimer((3,), held, None)]
    held.passed = passed(9)
    found += [f for f in processor.handleExpiredTimer((3,), held, None)]
    got = {r.id: r.previous_price for f in found for r in f.itertuples()}
    expected = {}
    for k in range(products):
        before = None
        for h in range(6):
            price = float((h + k) % 5 // 2)
            if price != before:
                expected[h * 1000 + k] = before
            before = price
    assert {i: None if p != p else p for i, p in got.items()} == expected
    assert held.calls < 40


def folder_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    """Bytes follow the batch, not the table."""
    root = tmp_path / "r"
    run = streams.price_change_batches(str(root), buckets=16)
    run(spark.createDataFrame([tick(0, 1.0, i, f"p{i}") for i in range(20_000)], TICK), 0)
    table = folder_bytes(root / "last")
    sizes, seen = [], table
    for n in range(1, 4):
        run(spark.createDataFrame([tick(n, 2.0 + n, 20_000 + n, f"p{n}")], TICK), n)
        sizes.append(folder_bytes(root / "last") - seen)
        seen += sizes[-1]
    assert max(sizes) < table / 20
    state = KeyedState(spark, f"{root}/last", streams.LAST, store.KEYS, ("recorded_at", "id"), 16)
    assert state.read().count() == 20_000
    assert {r.product_id: r.price for r in state.read().where("price > 1").collect()} == {f"p{n}": 2.0 + n for n in range(1, 4)}


def test_runs_of_a_bucket_stay_few(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "s"), streams.LAST, store.KEYS, ("recorded_at", "id"), 2)
    for n in range(6):
        rows = [("s", f"p{(n * 7 + k) % 30}", n, float(n), START + timedelta(hours=n)) for k in range(6)]
        for _ in range(2 if n % 5 == 0 else 1):  # repeated versions change nothing
            state.add(spark.createDataFrame(rows, streams.LAST), n)
    expected = {}
    for n in range(6):
        expected |= {f"p{(n * 7 + k) % 30}": float(n) for k in range(6)}
    assert {r.product_id: r.price for r in state.read().collect()} == expected
    sizes = [rows for _, rows in state.manifest()]
    assert len(sizes) <= 4 and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert {r.price for r in state.read(before=1).collect()} == {0.0}
    before, removed = {tuple(r) for r in state.read().collect()}, state.vacuum()
    assert len(removed) >= 2 and {tuple(r) for r in state.read().collect()} == before
    some = state.touched(spark.createDataFrame([("s", "p1", 0, 0.0, START)], streams.LAST))
    assert len(some) == 1 and state.read(touched=some).where("product_id = 'p1'").count() == 1


def test_a_repeated_batch_with_delay_changes_nothing(spark, tmp_path):
    files, end = shuffled_files(3, 120, files=2)
    results = []
    for repeats in (1, 2):
        root = str(tmp_path / str(repeats))
        run = streams.price_change_batches(root, "60 hours", buckets=4, tidy_every=repeats)
        for number, rows in enumerate([*files, end]):
            for _ in range(repeats):
                run(spark.createDataFrame(rows, TICK), number)
        found = spark.read.parquet(f"{root}/changes").where("product_id <> 'end'").collect()
        results.append(sorted((r.id, r.previous_price or 0.0, r.late) for r in found))
    assert results[0] == results[1] and len(results[0]) > 30


def test_windows_equal_batch(spark, tmp_path):
    files = [[tick(h, float(h), h) for h in range(0, 300, 7)], [tick(h, float(h), h) for h in range(300, 700, 7)]]
    stream = land(spark, tmp_path, *files)
    batch = spark.createDataFrame([r for f in files for r in f], TICK)
    weekly = streams.run_available(streams.stream_weekly_mean(stream, "1 day", "recorded_at"), "w", "complete")
    assert sorted(map(tuple, weekly.collect())) == sorted(map(tuple, weekly_mean(batch, "recorded_at").collect()))
    daily = streams.run_available(streams.stream_daily_counts(stream, "1 day", "recorded_at"), "d", "complete")
    expected = batch.groupBy(F.to_date("recorded_at")).count().collect()
    assert sorted(map(tuple, daily.collect())) == sorted(map(tuple, expected))


def test_dedup(spark, tmp_path):
    stream = land(spark, tmp_path, [tick(0, 1.0, 0), tick(1, 1.0, 1)], [tick(2, 1.0, 2), tick(3, 2.0, 3)])
    hashed = stream.withColumn("data_hash", F.md5(F.col("price").cast("string")))
    got = streams.run_available(streams.stream_dedup(hashed, "2 days", "recorded_at"), "u")
    assert sorted(r.price for r in got.collect()) == [1.0, 2.0]


def listing(spark, *rows):
    return spark.createDataFrame(
        [("T", f"https://a.com/{p}", "s", p, price, START + timedelta(hours=h)) for p, price, h in rows],
        "title string, url string, source string, product_id string, price double, scraped_at timestamp_ntz",
    )


def test_ingest_compacts_and_survives_a_repeated_batch(spark, tmp_path):
    root = str(tmp_path / "shop")
    run = streams.ingest(root, compact_every=2)
    run(listing(spark, ("1", 5.0, 0), ("2", 6.0, 0), (None, 1.0, 0)), 0)
    assert store.read_version(spark, f"{root}/products") is None
    second = listing(spark, ("1", 7.0, 1), ("3", 0.0, 1), ("1", 6.0, 2))
    run(second, 1)
    run(second, 1)
    table = {r.product_id: r.price for r in store.read_version(spark, f"{root}/products").collect()}
    assert table == {"1": 6.0, "2": 6.0}
    assert streams.checked_rows(spark, root, "accepted").count() == 4
    reasons = {r.reason for r in streams.checked_rows(spark, root, "rejected").collect()}
    assert reasons == {"null key", "Price out of range: 0.0"}
    run(listing(spark, ("2", 9.0, 3)), 2)
    run(listing(spark, ("4", 1.0, 3)), 3)
    table = {r.product_id: r.price for r in store.read_version(spark, f"{root}/products").collect()}
    assert table == {"1": 6.0, "2": 9.0, "4": 1.0}


def test_run_ingest_folds_the_rest(spark, tmp_path):
    for i, price in enumerate((5.0, 6.0, 7.0)):
        listing(spark, ("1", price, i)).coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
    schema = listing(spark, ("1", 1.0, 0)).schema
    stream = streams.stream_listings(
        spark, str(tmp_path), "parquet", schema, recursiveFileLookup="true", maxFilesPerTrigger="1"
    )
    root = streams.run_ingest(stream, "shop", compact_every=2)
    assert store.versions(spark, f"{root}/products") == [1, 2]
    assert [r.price for r in store.read_version(spark, f"{root}/products").collect()] == [7.0]


def test_folding_does_not_depend_on_the_batches(spark, tmp_path):
    """Sightings that arrive in any order and are folded at any time give the same table."""
    batches = [[("1", 20.0, 10), ("2", 1.0, 1)], [("1", 10.0, 1), ("3", 3.0, 5)], [("2", 2.0, 4), ("3", 9.0, 2)], [("1", 15.0, 9)]]
    tables = set()
    for every, order in ((1, (0, 1, 2, 3)), (1, (3, 2, 1, 0)), (2, (1, 3, 0, 2)), (4, (2, 0, 3, 1))):
        root = str(tmp_path / f"{every}-{order[0]}")
        run = streams.ingest(root, compact_every=every)
        for number, k in enumerate(order):
            run(listing(spark, *batches[k]), number)
        table = store.read_version(spark, f"{root}/products").collect()
        tables.add(frozenset((r.product_id, r.price) for r in table))
    assert tables == {frozenset({("1", 20.0), ("2", 2.0), ("3", 3.0)})}
