import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfspark.operators.history import price_changes, rank_slices, split_null_keys
from shelfspark.sources.store import append_history, history_rows, new_history

SCHEMA = "source string, product_id string, price double, recorded_at timestamp_ntz, id long"
START = datetime(2024, 1, 1)


def ticks(spark, prices, key="p"):
    rows = [("s", key, p, START + timedelta(hours=i), i) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    "prices,expected",
    [([10.0, 10.0, 12.0, 12.0, 10.0], [10.0, 12.0, 10.0]), ([10.0, None, 10.0], [10.0]), ([None], [])],
)
def test_changes(spark, prices, expected):
    got = price_changes(ticks(spark, prices)).orderBy("recorded_at", "id").collect()
    assert [r.price for r in got] == expected


def test_ties_follow_the_id(spark):
    rows = [("s", "p", 2.0, START, 2), ("s", "p", 1.0, START, 1), ("s", "p", 1.0, START, 3)]
    got = price_changes(spark.createDataFrame(rows, SCHEMA)).orderBy("id").collect()
    assert [(r.id, r.previous_price) for r in got] == [(1, None), (2, 1.0), (3, 2.0)]


def test_null_keys(spark):
    rows = [("s", None, 1.0, START, 1), (None, "p", 1.0, START, 2), ("s", "p", 1.0, START, 3)]
    good, rejects = split_null_keys(spark.createDataFrame(rows, SCHEMA), ["source", "product_id"])
    assert good.count() == 1 and {r.reason for r in rejects.collect()} == {"null key"}
    assert price_changes(spark.createDataFrame(rows, SCHEMA)).count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_hot_products_in_slices_equal_plain_order(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(3000):
        product = "hot" if rng.random() < 0.4 else f"p{rng.randint(0, 300)}"
        moment = START + timedelta(minutes=rng.randint(0, 400) if seed else 0)
        rows.append(("s", product, float(rng.randint(1, 3)), moment, i))
    expected = set()
    last = {}
    for s, p, price, moment, i in sorted(rows, key=lambda r: (r[3], r[4])):
        if last.get(p) != price:
            expected.add((i, last.get(p)))
        last[p] = price
    df = spark.createDataFrame(rows, SCHEMA)
    sliced = price_changes(df, hot_share=50, hot_floor=100, slice_rows=200)
    assert "_slice" in sliced._jdf.queryExecution().toString()
    assert {(r.id, r.previous_price) for r in sliced.collect()} == expected
    assert {(r.id, r.previous_price) for r in price_changes(df).collect()} == expected


def test_slices_need_no_second_shuffle_of_the_rows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([("s", "hot", float(i % 3), START + timedelta(hours=i), i) for i in range(500)], SCHEMA)
        text = price_changes(df, hot_floor=10, slice_rows=10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Cold rows by product, and hot rows by slice; slice ends by product and slice, and by product.
    assert text.count("Exchange hashpartitioning") == 3 and text.count("Exchange rangepartitioning(_slice") == 1


@pytest.mark.parametrize("instants", [1, 7])
def test_a_burst_is_spread_over_tasks(spark, instants):
    """20,000 ticks of one product at one instant: no task holds more than slice_rows."""
    rng = random.Random(instants)
    rows = [("s", "hot", float(rng.randint(1, 3)), START + timedelta(hours=i % instants), i) for i in range(20_000)]
    rows += [("s", f"p{i % 50}", float(rng.randint(1, 3)), START, 20_000 + i) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    expected, last = set(), {}
    for _, p, price, moment, i in sorted(rows, key=lambda r: (r[3], r[4])):
        if last.get(p) != price:
            expected.add((i, last.get(p)))
        last[p] = price
    got = price_changes(df, hot_share=50, hot_floor=1000, slice_rows=2000)
    assert {(r.id, r.previous_price) for r in got.collect()} == expected
    hot = df.where("product_id = 'hot'")
    sizes = rank_slices(hot, 20, ["source", "product_id", "recorded_at", "id"]).groupBy("_slice").count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) <= 2000
    tasks = got.withColumn("_task", F.spark_partition_id()).where("product_id = 'hot'").groupBy("_task").count().collect()
    assert len(tasks) > 10 and max(r["count"] for r in tasks) <= 4000


def test_history_of_a_batch(spark, tmp_path):
    current = spark.createDataFrame([("s", "a", 5.0), ("s", "b", 7.0), ("s", "c", None)], "source string, product_id string, price double")
    batch = spark.createDataFrame(
        [("s", "a", 5.0, START, 1), ("s", "a", 6.0, START + timedelta(1), 2), ("s", "b", 8.0, START, 3),
         ("s", "c", 1.0, START, 4), ("s", "new", 2.0, START, 5), ("s", "new", None, START, 6)], SCHEMA)
    added = new_history(current, batch, "recorded_at")
    assert {(r.id, r.previous_price) for r in added.collect()} == {(2, 5.0), (3, 7.0), (4, None), (5, None)}
    shaped = history_rows(added, "recorded_at")
    assert shaped.columns[:3] == ["product_key", "source_product_id", "source"]
    assert {r.currency for r in shaped.collect()} == {"USD"}
    assert shaped.where(F.col("product_key").isNull()).count() == 0
    for _ in range(2):
        append_history(shaped, str(tmp_path / "h"), 7)
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4
