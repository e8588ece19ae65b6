import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import frontier, tasks
from shelfspark.schemas import RUN_LOG
from shelfspark.sources import readers, runs, store, writers

TS = datetime(2024, 1, 5)
LISTING = "source string, product_id string, title string, price double, scraped_at timestamp_ntz"


def batch(spark, *rows):
    return spark.createDataFrame([(*r, TS) if len(r) == 4 else r for r in rows], LISTING)


def test_listing_files_of_all_shapes(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"source": "s"}, "products": [
        {"title": "A", "price": "12.5", "scraped_at": "2024-01-01T00:00:00"}, {"title": "B", "price": 3}]}, indent=1))
    (tmp_path / "deep" / "b.json").write_text(json.dumps([{"title": "C", "price": "n/a", "extra": 1}]))
    (tmp_path / "broken.json").write_text('{"products": [{"title": ')
    (tmp_path / "other.json").write_text(json.dumps({"total": 5}))
    got = {r.title: (r.price, r.scraped_at) for r in readers.read_listings(spark, str(tmp_path), "json").collect()}
    assert got == {"A": (12.5, datetime(2024, 1, 1)), "B": (3.0, None), "C": (None, None)}
    assert sorted(r.title for r in readers.load_listings(spark, str(tmp_path), "json").collect()) == ["A", "B"]


def test_odd_fields_cost_only_themselves(spark, tmp_path):
    odd = {
        "review_count": "1,234", "original_price": "12.00", "seller_rating": "99.1%", "position_on_page": "3",
        "shipping_cost": "Free", "additional_images": '["a", "b"]', "specifications": "none", "is_valid": "maybe", "page_number": 2.0,
    }
    for i, (name, value) in enumerate(odd.items()):
        products = [{"title": f"{name}-{k}", "price": k + 1, **({name: value} if k == 1 else {})} for k in range(3)]
        (tmp_path / f"{i}.json").write_text(json.dumps({"products": products}, indent=2))
    (tmp_path / "array.json").write_text(json.dumps([{"source": "s"}, {"title": "T", "specifications": {"a": "b"}}], indent=2))
    (tmp_path / "broken.json").write_text("{[")
    got = {r.title: r for r in readers.read_listing_files(spark, str(tmp_path)).collect()}
    assert len(got) == 29 and got["T"].specifications == {"a": "b"} and got[None].source == "s"
    assert got["original_price-1"].original_price == 12.0 and got["position_on_page-1"].position_on_page == 3
    assert got["additional_images-1"].additional_images == ["a", "b"] and got["page_number-1"].page_number == 2
    assert got["review_count-1"].review_count is None and got["shipping_cost-1"].shipping_cost is None
    broken = readers.broken_documents(spark, str(tmp_path)).collect()
    assert len(broken) == 1 and broken[0].file.endswith("broken.json")


def test_stored_listings_are_pruned(spark, golden, tmp_path):
    path = str(tmp_path / "t")
    writers.write_listings(golden, path)
    rows = readers.load_listings(spark, path).where("source = 'ebay'")
    assert [r.product_id for r in rows.collect()] == ["prod2"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "GreaterThan(price,0.0)" in plan


def test_find_listings(spark, golden):
    assert [r.product_id for r in readers.find_listings(golden, limit=2, offset=1).collect()] == ["prod2", "prod1"]
    assert readers.find_listings(golden, source="ebay", keyword="pho").count() == 1
    assert readers.find_listings(golden, order_by="nonsense").count() == 3
    assert [r.product_id for r in readers.find_listings(golden, order_by="price", desc=False).collect()][0] == "prod3"


def test_upsert(spark):
    current = batch(spark, ("s", "1", "old", 1.0), ("s", "2", "keep", 2.0)).withColumn("brand", F.lit("b"))
    new = batch(spark, ("s", "1", "new", None), ("s", "3", "x", 3.0), ("s", "3", "y", 4.0, datetime(2024, 1, 6)), ("s", None, "z", 1.0))
    merged, rejects = store.upsert(current, new, ("scraped_at",))
    got = {r.product_id: (r.title, r.price, r.brand) for r in merged.collect()}
    # A null in the batch overwrites; a column the batch lacks keeps its value.
    assert got == {"1": ("new", None, "b"), "2": ("keep", 2.0, "b"), "3": ("y", 4.0, None)}
    assert [r.reason for r in rejects.collect()] == ["null key"]
    updates, inserts = store.split_existing(current, new.where("product_id is not null"))
    assert updates.count() == 1 and inserts.count() == 2


def test_upsert_keeps_the_newer_row(spark):
    new, old = datetime(2024, 1, 10), datetime(2024, 1, 1)
    stored = batch(spark, ("s", "p", "T", 20.0, new))
    late, _ = store.upsert(stored, batch(spark, ("s", "p", "T", 10.0, old), ("s", "q", "Q", 1.0, old)))
    assert {r.product_id: r.price for r in late.collect()} == {"p": 20.0, "q": 1.0}
    newer, _ = store.upsert(batch(spark, ("s", "p", "T", 10.0, old)), stored)
    assert [r.price for r in newer.collect()] == [20.0]


def test_versions_are_replaced_and_incomplete_ones_ignored(spark, tmp_path):
    root = str(tmp_path / "t")
    assert store.read_version(spark, root) is None
    store.publish(spark.range(3), root, 0)
    store.publish(spark.range(5), root, 1)
    store.publish(spark.range(7), root, 1)
    (tmp_path / "t" / "v=000000002").mkdir()
    assert store.versions(spark, root) == [0, 1]
    assert store.read_version(spark, root).count() == 7 and store.read_version(spark, root, before=1).count() == 3


def test_retention_keeps_rows_without_time(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 9),), (None,)], "ts timestamp_ntz")
    kept, removed = store.retain(df, "ts", 5, "2024-01-10 00:00:00")
    assert kept.count() == 2 and removed.first().removed == 1


def test_run_log(spark):
    run = runs.start_run(spark, "ebay", ["a", "b"], {"max_pages": 3, "deep": True}, "2024-01-01 00:00:00")
    row = run.first()
    assert run.first().session_id == row.session_id
    assert run.schema.fieldNames() == RUN_LOG.fieldNames()
    assert (row.status, row.max_pages, row.search_keywords, row.scraper_config["deep"], row.total_errors) == ("running", 3, ["a", "b"], "True", 0)
    log = spark.createDataFrame([("x", datetime(2024, 1, 1), None, None, "running"), ("y", None, None, None, "running")],
                                "session_id string, started_at timestamp_ntz, completed_at timestamp_ntz, duration_seconds int, status string")
    updates = spark.createDataFrame([("x", datetime(2024, 1, 1, 0, 1, 30, 900000), "completed", 1), ("y", TS, "failed", 2), ("z", TS, "failed", 2)],
                                    "session_id string, completed_at timestamp_ntz, status string, products_found int")
    got = {r.session_id: (r.status, r.duration_seconds) for r in runs.finish_run(log, updates).collect()}
    assert got == {"x": ("completed", 90), "y": ("failed", None)}


def test_writers(spark, golden, tmp_path):
    path = str(tmp_path)
    writers.write_json(golden, f"{path}/j", ["source"])
    assert sorted(p.name for p in (tmp_path / "j").glob("source=*")) == ["source=amazon", "source=ebay", "source=walmart"]
    nested = golden.withColumn("tags", F.array(F.lit('a"b'), F.lit("c,d")))
    writers.write_csv(nested, f"{path}/c")
    read = spark.read.option("header", True).option("escape", '"').csv(f"{path}/c")
    assert json.loads(read.first().tags) == ['a"b', "c,d"]
    writers.export(golden, "excel", f"{path}/x")
    assert {p.name for p in (tmp_path / "x").iterdir()} == {"Products", "Source_Summary", "Price_Analysis", "Summary"}
    writers.export(golden, "json", f"{path}/e", 1, "2025-07-01 11:30:00")
    assert spark.read.json(f"{path}/e").count() == 1
    with pytest.raises(ValueError):
        writers.export(golden, "pdf", f"{path}/p")
    rows, seen = writers.observed_count(golden)
    rows.write.parquet(f"{path}/o")
    assert seen.get == {"rows": 3}
    manifest = {r.source: r.total_products for r in writers.source_manifest(golden, "static", "cards").collect()}
    assert manifest == {"amazon": 1, "ebay": 1, "walmart": 1, "combined": 3}


def test_frontier(spark):
    keywords = frontier.keyword_table(spark, ["laptop", "gaming mouse"])
    planned = frontier.frontier(keywords, ["amazon", "ebay", "other"], 13)
    assert planned.count() == 2 * 3 * 13
    priorities = {(r.source, r.keyword, r.page): r.priority for r in frontier.with_priority(planned, "yield").collect()}
    assert priorities["ebay", "gaming mouse", 1] == 120 and priorities["amazon", "laptop", 1] == 85
    assert priorities["other", "gaming mouse", 2] == 95 and priorities["amazon", "laptop", 13] == 1
    first = frontier.by_priority(frontier.with_priority(planned, "yield")).first()
    assert (first.source, first.keyword, first.page) == ("ebay", "gaming mouse", 1)
    many = frontier.keyword_table(spark, [f"k{i}" for i in range(20)])
    rows = frontier.in_batch_order(frontier.batches(many, ["amazon", "ebay", "walmart"], 12)).collect()
    assert [r.batch for r in rows] == [i // 12 + 1 for i in range(60)]
    assert [(r.source, r.priority) for r in rows[:5]] == [("amazon", 1), ("amazon", 2), ("amazon", 3), ("amazon", 4), ("ebay", 1)]
    assert {r.priority: r.max_pages for r in rows}[10] == 4 and {r.priority: r.max_pages for r in rows}[11] == 3


def test_apply_per_task_reports_errors(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1,), (0,)], "n int")
    done = tasks.apply_per_task(df, lambda t: [{"v": 1 / t["n"]}], T.StructType([T.StructField("v", T.DoubleType())]))
    got = {r.n: (r.success, [d.v for d in r.data], r.error) for r in done.collect()}
    assert got == {1: (True, [1.0], None), 0: (False, [], "ZeroDivisionError: division by zero")}
