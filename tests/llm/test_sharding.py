import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from shelfspark.llm.sharding import curve_place, shard_by_curve, write_shards

from odd_rows import ODD_ROWS


def test_curve_visits_every_cell_step_by_step(spark):
    for dims, bits in ((2, 3), (3, 2), (3, 4), (1, 3)):
        cells = spark.range(2 ** (dims * bits))
        steps = [F.floor(F.col("id") / 2 ** (bits * d)) % 2**bits for d in range(dims)]
        rows = cells.select(*[s.cast("int").alias(f"s{d}") for d, s in enumerate(steps)])
        placed = rows.withColumn("at", curve_place([F.col(f"s{d}") for d in range(dims)], bits)).collect()
        by_place = {r.at: tuple(r)[:-1] for r in placed}
        assert sorted(by_place) == list(range(2 ** (dims * bits)))
        for at in range(len(by_place) - 1):
            assert sum(abs(a - b) for a, b in zip(by_place[at], by_place[at + 1])) == 1


def check(rows, docs, shards=8, **options):
    out = shard_by_curve(docs, shards=shards, **options).toPandas()
    sizes = sorted(len((t or "").encode()) + 1 for _, t, *_ in rows)
    assert sorted(out["size"]) == sizes
    assert sorted(out["text_crc32"]) == sorted(zlib.crc32((t or "").encode()) for _, t, *_ in rows)
    total, largest = sum(sizes), max(sizes, default=0)
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
        assert abs(part["size"].sum() - total / shards) <= 2 * largest
    return out


def test_shards(spark, make):
    rng = random.Random(1)
    rows = [(i, "x" * rng.choice([0, 5, 90, 2000]), rng.choice(["hot"] * 5 + ["a", "b", None])) for i in range(3000)]
    out = check(rows, make(rows))
    again = shard_by_curve(make(rows[::-1]).repartition(7)).toPandas()
    assert dict(zip(out["doc_id"], zip(out["shard"], out["slot"]))) == dict(zip(again["doc_id"], zip(again["shard"], again["slot"])))
    # The same cut into small runs gives every row a place as well.
    check(rows, make(rows), run_rows=100)
    # A source lies in few shards: that is what lets files be skipped.
    source, held = dict((r[0], r[2]) for r in rows), defaultdict(set)
    for doc, shard in zip(out["doc_id"], out["shard"]):
        held[source[doc]].add(shard)
    assert len(held["a"]) < 8 and len(held["b"]) < 8


def test_one_cell_and_odd_rows(spark, make):
    same = [(i, "same text", "s") for i in range(500)]
    check(same, make(same), run_rows=40)
    check(ODD_ROWS, make(ODD_ROWS), shards=1)
    assert len(check(ODD_ROWS, make(ODD_ROWS))) == len(ODD_ROWS)
    assert shard_by_curve(make(ODD_ROWS).limit(0)).count() == 0


def test_written_shards(spark, make, tmp_path):
    rows = [(i, "x" * (i % 50), f"s{i % 5}") for i in range(200)]
    docs = make(rows)
    write_shards(docs, shard_by_curve(docs), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 8


def test_no_python_in_the_plan(spark, make):
    plan = shard_by_curve(make(ODD_ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
