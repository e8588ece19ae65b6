import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.operators import outliers, quality, stats, trends
from shelfspark.operators.quantiles import approximate_quantiles, exact_quantiles
from shelfspark.plans import reports

PROBS = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.9, "q10": 1.0}
LISTING = "title string, source string, price double, rating double, scraped_at timestamp_ntz, search_keyword string, url string, scraper_type string"


def frame(spark, prices):
    return spark.createDataFrame([(p,) for p in prices], "price double")


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_against_numpy(spark, seed):
    rng = random.Random(seed)
    kinds = [
        lambda: rng.uniform(-50, 50), lambda: round(rng.expovariate(0.01), 2), lambda: float(rng.randint(0, 3)),
        lambda: rng.choice([1e-9, 1e9, -1e6, 0.0]),
    ]
    groups = {f"g{i}": [kinds[(seed + i) % 4]() for _ in range(rng.choice([1, 2, 7, 400]))] for i in range(5)}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("g0", None), (None, 3.0), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, price double")
    got = {r.g: r for r in exact_quantiles(df, "price", PROBS, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(float(np.quantile(vs, p)), rel=1e-12, abs=1e-12), (g, name)
    everything = [v for g, v in rows if v is not None]
    one = exact_quantiles(df, "price", PROBS).first()
    for name, p in PROBS.items():
        assert one[name] == pytest.approx(float(np.quantile(everything, p)), rel=1e-12, abs=1e-12)


def test_quantile_plan_has_no_percentile_buffer(spark):
    plan = exact_quantiles(frame(spark, [1.0, 2.0]), "price", {"m": 0.5})._jdf.queryExecution().toString()
    assert "percentile(" not in plan


def test_approximate_quantiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1001)], "g string, price double")
    assert approximate_quantiles(df, "price", {"m": 0.5}, ["g"]).first()["m"] == pytest.approx(500, abs=1)


def test_golden_rows(spark, golden):
    s = stats.price_summary(golden).first()
    assert s["mean"] == pytest.approx((599.99 + 299.99 + 199.99) / 3)
    assert (s["min"], s["max"], s["median"]) == (199.99, 599.99, 299.99)
    assert (s["q1"], s["q3"]) == (pytest.approx(249.99), pytest.approx(449.99))
    assert s["std"] == pytest.approx(208.1666, abs=1e-4)
    assert stats.cumulative_price_counts(golden).first().asDict() == {
        "under_100": 0, "under_500": 2, "under_1000": 3, "over_1000": 0}
    o = stats.overview(golden).first()
    assert (o.total_products, o.unique_sources) == (3, 3)
    assert {r.source: r.total_products for r in stats.source_comparison(golden).collect()} == {
        "amazon": 1, "ebay": 1, "walmart": 1}
    assert outliers.iqr_outliers(golden).count() == 0 and outliers.z_outliers(golden).count() == 0


def test_outlier_edges(spark):
    ten = frame(spark, [float(p) for p in range(10, 19)] + [200.0])
    found = outliers.iqr_outliers(ten).collect()
    assert [(r.price, r.lower_bound, r.upper_bound) for r in found] == [(200.0, 5.5, 23.5)]
    assert outliers.z_outliers(ten).count() == 0
    spike = frame(spark, [10.0] * 20 + [200.0])
    assert outliers.z_outliers(spike).first().z_score == pytest.approx(4.3644, abs=1e-4)
    assert outliers.iqr_outliers(spike).count() == 1
    flat = frame(spark, [5.0] * 4)
    assert outliers.z_outliers(flat).count() == 0 and outliers.iqr_outliers(flat).count() == 0
    single = frame(spark, [5.0])
    assert outliers.z_outliers(single).count() == 0 and stats.price_summary(single).first()["std"] is None


def test_outlier_summary(spark):
    df = spark.createDataFrame([(i, 10.0) for i in range(40)] + [(100 + i, 900.0 + i) for i in range(12)], "id int, price double")
    found = outliers.iqr_outliers(df)
    s = outliers.outlier_summary(df, found, "price", ["id"]).first()
    assert s["count"] == 12 and s["percentage"] == pytest.approx(12 / 52 * 100)
    assert s["values"] == [900.0 + i for i in range(10)]
    grouped = df.withColumn("g", F.lit("a")).unionByName(df.where("id < 40").withColumn("g", F.lit("b")))
    by = outliers.outlier_summary_by(grouped, outliers.iqr_outliers(grouped, by=["g"]), "price", "g", ["id"])
    assert {r.g: (r["count"], r["values"] and len(r["values"])) for r in by.collect()} == {"a": (12, 10), "b": (0, None)}


def test_empty_and_null_inputs(spark):
    empty = spark.createDataFrame([], LISTING)
    assert stats.price_summary(empty).first()["n"] == 0
    assert stats.overview(empty).first()["total_products"] == 0
    assert stats.store_stats(empty).first()["avg_price"] == 0.0
    assert stats.source_comparison(empty).collect() == []
    assert [r.n for r in stats.price_ranges(empty).collect()] == [0, 0, 0, 0]
    assert stats.report_metadata(empty).first().collection_period == "No data"
    assert outliers.iqr_outliers(empty).collect() == []
    assert quality.data_quality(empty).first().duplicate_rate is None
    assert trends.weekly_trend(empty).first().trend_direction == "stable"
    assert trends.daily_fit(empty).collect() == []
    assert reports.recommendations(empty).collect() == []
    assert sum(r.n for r in stats.histogram(empty).collect()) == 0
    nulls = spark.createDataFrame([("t", None, None, None, None, None, None, None)] * 2, LISTING)
    assert stats.source_comparison(nulls).collect() == [] and stats.keyword_performance(nulls).collect() == []
    assert stats.products_by_source(nulls).first()["n"] == 2


def test_histogram(spark):
    rows = stats.histogram(frame(spark, [0.0, 1.0, 29.9, 30.0])).orderBy("bin").collect()
    assert len(rows) == 30 and rows[-1].n == 2 and rows[0].n == 1 and rows[1].n == 1
    flat = {r.bin: r.n for r in stats.histogram(frame(spark, [7.0] * 3)).collect()}
    assert flat[16] == 3 and sum(flat.values()) == 3


def test_box_stats(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", 5.0), (None, 1.0)], "source string, price double")
    got = {r.source: r for r in stats.box_stats(df).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].whisker_low, got["a"].whisker_high, got["a"].outside) == (1.0, 4.0, 1)


def test_price_ranges(spark):
    got = [(r["range"], r.n) for r in stats.price_ranges(frame(spark, [99.99, 100.0, 500.0, 1000.0, None])).orderBy("position").collect()]
    assert got == [("Under $100", 1), ("$100-$500", 1), ("$500-$1000", 1), ("Over $1000", 1)]


def weekly(spark, rows):
    return spark.createDataFrame(rows, "d string, price double").withColumn("scraped_at", F.col("d").cast("timestamp_ntz"))


def test_weekly_trend_with_gap(spark):
    df = weekly(spark, [("2024-01-01", 10.0), ("2024-01-07", 20.0), ("2024-01-08", 30.0), ("2024-01-22", 50.0)])
    assert {str(r.week): r.mean_price for r in trends.weekly_mean(df).collect()} == {
        "2024-01-07": 15.0, "2024-01-14": 30.0, "2024-01-28": 50.0}
    t = trends.weekly_trend(df).first()
    assert t.trend_slope == pytest.approx(11.428571, abs=1e-6) and t.trend_direction == "increasing"
    assert trends.weekly_trend(weekly(spark, [("2024-01-01", 10.0)])).first().trend_direction == "stable"
    flat = weekly(spark, [("2024-01-01", 10.0), ("2024-01-08", 10.0)])
    assert trends.weekly_trend(flat).first().trend_direction == "decreasing"


def test_daily_fit_and_velocity(spark):
    df = weekly(spark, [("2024-01-01", 1.0)] * 1 + [("2024-01-03", 1.0)] * 2 + [("2024-01-09", 1.0)] * 3)
    rows = trends.daily_fit(df).orderBy("day").collect()
    assert [r.fitted for r in rows] == pytest.approx([1, 2, 3]) and rows[0].slope == pytest.approx(1)
    v = trends.velocity(df).first()
    assert (v.avg_products_per_day, v.max_products_per_day, v.total_collection_days) == (2.0, 3, 3)


def test_moving_average(spark):
    df = weekly(spark, [("2024-01-01", 10.0), ("2024-01-05", 20.0), ("2024-01-09", 60.0)]).withColumn("source", F.lit("a"))
    got = {r.day: r.mean_7d for r in trends.moving_average(trends.daily_prices(df), [7]).collect()}
    assert got == {date(2024, 1, 1): 10.0, date(2024, 1, 5): 15.0, date(2024, 1, 9): 40.0}


def test_batch_progress_over_chunks(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 26)], "batch long, batch_records long")
    got = [(r.batch, r.total_records) for r in stats.batch_progress(df, 100, chunk=4).orderBy("batch").collect()]
    assert got == [(i, i * (i + 1) // 2) for i in range(1, 26)]


def test_rollups_with_nothing_done(spark):
    schema = "task struct<source string, keyword string>, success boolean, data array<struct<title string>>, execution_time double"
    empty = spark.createDataFrame([], schema)
    r = stats.run_rollup(empty, 1).first()
    assert (r.tasks_completed, r.total_products, r.success_rate, r.target_achieved) == (0, 0, 0.0, False)
    failed = spark.createDataFrame([(("a", "k"), False, None, 0.0), (("a", "k"), True, None, 0.0)], schema)
    assert stats.run_rollup(failed, 1).first().total_products == 0
    k = stats.keyword_outcomes(failed).first()
    assert (k.successful_keywords, k.failed_keywords, k.success_rate) == (1, 0, "1/1")


def test_findings_and_recommendations(spark, golden):
    lines = [r.finding for r in reports.key_findings(golden).orderBy("position").collect()]
    assert lines == ["Average product price across all sources: $366.66", "Amazon provided the most products (1)",
                     "Overall data quality score: 100.0%"]
    advice = [r.recommendation for r in reports.recommendations(golden).orderBy("position").collect()]
    assert advice[0] == "Collection velocity is 3.0 products/day. Consider parallel processing to increase throughput."
    assert len(advice) == 5
    cheap = golden.withColumn("price", F.lit(5.0))
    assert "Majority of products (3) are priced under $100" in [r.finding for r in reports.key_findings(cheap).collect()]


def test_report_tables_and_sheets(spark, golden):
    assert all(t.count() >= 1 for t in reports.report_tables(golden).values())
    sheets = reports.report_sheets(golden)
    assert set(sheets) == {"Products", "Source_Summary", "Price_Analysis", "Summary"}
    values = {r.metric: r.value for r in sheets["Summary"].collect()}
    assert values["Average Price"] == "$366.66" and values["Total Products"] == "3"
    doc = {(r.section, r.entry, r.metric): r.value for r in reports.statistics_document(golden).collect()}
    assert doc["overview", "all", "total_products"] == 3 and not math.isnan(doc["price_summary", "all", "std"])


def test_price_comparison(spark):
    df = spark.createDataFrame([("k", "a", 5.0), ("k", "b", 3.0), ("z", "a", 1.0)], "search_keyword string, source string, price double")
    got = {r.search_keyword: (r.a, r.b, r.cheapest) for r in reports.price_comparison(df, ["a", "b"]).collect()}
    assert got == {"k": (5.0, 3.0, "b"), "z": (1.0, None, "a")}


def test_trend_report(spark, golden):
    tables = reports.trend_report(golden, 2, "2025-07-01 00:00:00", tiebreak="product_id")
    assert {name: t.count() for name, t in tables.items()} == {
        "daily": 1, "weekly": 1, "price_trend": 1, "velocity": 1, "daily_fit": 1, "moving_average": 3, "price_changes": 3}
