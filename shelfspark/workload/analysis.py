"""Aggregates, quality, outliers and trends over the listing sightings."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.adapters import listings, sightings, table, ticks
from shelfspark.operators import outliers, quality, stats, trends
from shelfspark.operators.history import price_changes
from shelfspark.workload.registry import query, rounded

L, S, T = ("listings",), ("sightings",), ("ticks",)


# --- A1-A16 -----------------------------------------------------------------------------------------


@query(
    """SELECT count(*) AS total_products, count(DISTINCT source) AS unique_sources,
    min(scraped_at) AS earliest, max(scraped_at) AS latest,
    round(avg(CASE WHEN price IS NULL THEN 0.0 ELSE 1.0 END) * 100, 4) AS has_price,
    round(avg(CASE WHEN rating IS NULL THEN 0.0 ELSE 1.0 END) * 100, 4) AS has_rating,
    round(avg(CASE WHEN url IS NULL THEN 0.0 ELSE 1.0 END) * 100, 4) AS has_url FROM sightings""",
    S,
)
def a1_overview(spark, sf):
    return rounded(stats.overview(sightings(spark, sf)))


@query(
    """SELECT count(price) AS n, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std,
    round(min(price), 6) AS min, round(max(price), 6) AS max, round(quantile_cont(price, 0.25), 6) AS q1,
    round(quantile_cont(price, 0.5), 6) AS median, round(quantile_cont(price, 0.75), 6) AS q3 FROM sightings""",
    S,
)
def a2_price_summary(spark, sf):
    return rounded(stats.price_summary(sightings(spark, sf)), 6)


@query(
    """SELECT source, count(price) AS n, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std,
    round(min(price), 6) AS min, round(max(price), 6) AS max, round(quantile_cont(price, 0.25), 6) AS q1,
    round(quantile_cont(price, 0.5), 6) AS median, round(quantile_cont(price, 0.75), 6) AS q3
    FROM sightings GROUP BY source""",
    S,
)
def d8_price_analysis_by_source(spark, sf):
    return rounded(stats.price_summary(sightings(spark, sf), ["source"]), 6)


@query(
    """SELECT source, count(rating) AS n, round(avg(rating), 6) AS mean, round(stddev_samp(rating), 6) AS std,
    round(min(rating), 6) AS min, round(max(rating), 6) AS max, round(quantile_cont(rating, 0.25), 6) AS q1,
    round(quantile_cont(rating, 0.5), 6) AS median, round(quantile_cont(rating, 0.75), 6) AS q3
    FROM sightings WHERE rating IS NOT NULL GROUP BY source""",
    S,
)
def d8_rating_analysis(spark, sf):
    return rounded(stats.price_summary(sightings(spark, sf), ["source"], "rating"), 6)


@query(
    """SELECT count(*) FILTER (price < 100) AS under_100, count(*) FILTER (price < 500) AS under_500,
    count(*) FILTER (price < 1000) AS under_1000, count(*) FILTER (price >= 1000) AS over_1000 FROM sightings""",
    S,
)
def a3_cumulative_price_counts(spark, sf):
    return stats.cumulative_price_counts(sightings(spark, sf))


@query(
    """SELECT CAST(p AS INTEGER) AS position, r AS "range",
    (SELECT count(*) FROM sightings WHERE price >= lo AND price < hi) AS n
    FROM (VALUES (1, 'Under $100', -1e300, 100.0), (2, '$100-$500', 100.0, 500.0),
    (3, '$500-$1000', 500.0, 1000.0), (4, 'Over $1000', 1000.0, 1e300)) v(p, r, lo, hi)""",
    S,
)
def a4_price_ranges(spark, sf):
    return stats.price_ranges(sightings(spark, sf))


@query(
    """WITH s AS (SELECT min(price) AS a, max(price) AS b FROM sightings),
    b AS (SELECT least(CAST(floor((price - a) / (b - a) * 30) AS BIGINT) + 1, 30) AS bin, count(*) AS n
    FROM sightings, s GROUP BY 1)
    SELECT g.bin, round(a + (g.bin - 1) * ((b - a) / 30), 4) AS low, round(a + g.bin * ((b - a) / 30), 4) AS high,
    coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 31)) AS bin) g CROSS JOIN s LEFT JOIN b ON g.bin = b.bin""",
    S,
)
def a5_histogram(spark, sf):
    return rounded(stats.histogram(sightings(spark, sf)))


@query(
    """WITH q AS (SELECT source, count(*) AS n, avg(price) AS mean, quantile_cont(price, 0.25) AS q1,
    quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q3 FROM sightings GROUP BY source)
    SELECT source, n, round(mean, 4) AS mean, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
    round(min(price) FILTER (ok), 6) AS whisker_low, round(max(price) FILTER (ok), 6) AS whisker_high,
    count(*) FILTER (NOT ok) AS outside FROM
    (SELECT q.*, price, price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok
    FROM sightings JOIN q USING (source)) GROUP BY ALL""",
    S,
)
def a6_box_stats(spark, sf):
    boxes = stats.box_stats(sightings(spark, sf))
    return rounded(boxes.withColumn("mean", F.round("mean", 4)), 6)


@query(
    """SELECT source, count(*) AS total_products, round(avg(price), 4) AS avg_price, round(avg(rating), 4) AS avg_rating,
    round(min(price), 4) AS min_price, round(max(price), 4) AS max_price,
    round((avg(CASE WHEN price IS NULL THEN 0.0 ELSE 1 END) + avg(CASE WHEN rating IS NULL THEN 0.0 ELSE 1 END)
    + avg(CASE WHEN url IS NULL THEN 0.0 ELSE 1 END)) / 3, 4) AS data_quality_score FROM sightings GROUP BY source""",
    S,
)
def a7_source_comparison(spark, sf):
    return rounded(stats.source_comparison(sightings(spark, sf)))


@query(
    """SELECT source, count(price) AS count, round(avg(price), 4) AS mean, round(quantile_cont(price, 0.5), 4) AS median,
    round(stddev_samp(price), 4) AS std FROM sightings GROUP BY source""",
    S,
)
def a8_source_summary(spark, sf):
    return rounded(stats.source_summary(sightings(spark, sf), digits=None))


@query(
    """SELECT source, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share
    FROM sightings GROUP BY source""",
    S,
)
def a9_source_shares(spark, sf):
    return rounded(stats.source_shares(sightings(spark, sf)))


@query("SELECT source, round(avg(price), 4) AS avg_price FROM sightings GROUP BY source", S)
def a10_average_price_by_source(spark, sf):
    return rounded(stats.average_price_by_source(sightings(spark, sf)))


@query(
    """SELECT search_keyword, count(price) AS price_count, round(avg(price), 4) AS price_mean,
    round(stddev_samp(price), 4) AS price_std, round(avg(rating), 4) AS rating_mean,
    count(DISTINCT source) AS sources FROM listings WHERE search_keyword IS NOT NULL GROUP BY search_keyword""",
    L,
)
def a11_keyword_performance(spark, sf):
    return rounded(stats.keyword_performance(listings(spark, sf), digits=None))


@query(
    """SELECT search_keyword, count(price) AS price_count, round(avg(price), 4) AS price_mean,
    round(stddev_samp(price), 4) AS price_std, round(avg(rating), 4) AS rating_mean,
    count(DISTINCT source) AS sources FROM listings
    WHERE search_keyword IN ('PROMO', 'ECONOMY') GROUP BY search_keyword""",
    L,
)
def d8_keyword_analysis(spark, sf):
    return rounded(stats.keyword_performance(listings(spark, sf), ["PROMO", "ECONOMY"], digits=None))


@query(
    """SELECT scraper_type, count(price) AS price_count, count(DISTINCT source) AS sources
    FROM sightings WHERE scraper_type IS NOT NULL GROUP BY scraper_type""",
    S,
)
def a12_scraper_performance(spark, sf):
    return stats.scraper_performance(sightings(spark, sf))


@query(
    """SELECT count(*) AS total_products, round(coalesce(avg(price), 0.0), 4) AS avg_price,
    max(scraped_at) AS latest_scrape, (SELECT count(*) FROM orders) AS total_sessions FROM sightings""",
    S,
)
def a13_store_stats(spark, sf):
    return rounded(stats.store_stats(sightings(spark, sf), table(spark, sf, "orders")))


@query("SELECT source, count(*) AS n FROM sightings GROUP BY source", S)
def a13_products_by_source(spark, sf):
    return stats.products_by_source(sightings(spark, sf))


@query(
    """SELECT CAST(scraped_at AS DATE) AS day, count(*) AS products_collected, count(DISTINCT source) AS sources_active
    FROM sightings WHERE scraped_at >= TIMESTAMP '2001-10-25 00:00:00' GROUP BY 1 ORDER BY 1 DESC LIMIT 10""",
    S,
)
def a14_daily_collection(spark, sf):
    return stats.daily_collection(sightings(spark, sf), "2001-11-04 00:00:00", days=10)


@query(
    """SELECT count(*) AS total_products, round(min(price), 4) AS price_min, round(max(price), 4) AS price_max,
    round(avg(price), 4) AS price_avg, round(min(rating), 4) AS rating_min, round(max(rating), 4) AS rating_max,
    round(avg(rating), 4) AS rating_avg FROM sightings""",
    S,
)
def a15_dataset_stats(spark, sf):
    return rounded(stats.dataset_stats(sightings(spark, sf)))


@query(
    """SELECT 'source' AS kind, source AS value, count(*) AS n FROM listings GROUP BY source
    UNION ALL SELECT 'search_keyword', search_keyword, count(*) FROM listings GROUP BY search_keyword""",
    L,
)
def a15_dataset_counts(spark, sf):
    rows = listings(spark, sf)
    return stats.counts_by(rows, "source").unionByName(stats.counts_by(rows, "search_keyword"))


@query(
    """SELECT count(*) AS total_products, count(DISTINCT source) AS total_sources,
    strftime(min(scraped_at), '%m/%d/%Y') || ' - ' || strftime(max(scraped_at), '%m/%d/%Y') AS collection_period,
    CAST(100 AS INTEGER) AS data_quality_score, printf('$%.2f', avg(price)) AS average_price FROM sightings""",
    S,
)
def a16_report_metadata(spark, sf):
    return stats.report_metadata(sightings(spark, sf))


# --- V2, V4-V11, D3 ---------------------------------------------------------------------------------


@query(
    """SELECT title, source, round(price, 4) AS price, scraped_at, order_no, line_no, product_id FROM (
    SELECT *, row_number() OVER (PARTITION BY title, source
    ORDER BY scraped_at, order_no, line_no, product_id, price) AS rn FROM listings WHERE price > 0) WHERE rn = 1""",
    L,
)
def v2_clean_frame(spark, sf):
    rows = listings(spark, sf)
    order = ["scraped_at", "order_no", "line_no", "product_id", "price"]
    kept = quality.clean_frame(rows, order)
    return rounded(kept.select("title", "source", "price", "scraped_at", "order_no", "line_no", "product_id"))


@query(
    """SELECT md5(text) AS data_hash, min(doc_id) AS doc_id, count(*) > 1 AS had_copies FROM documents GROUP BY text"""
)
def v3_dedup_by_hash(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5("text").alias("data_hash"), "doc_id")
    copies = docs.groupBy("data_hash").agg((F.count(F.lit(1)) > 1).alias("had_copies"))
    return quality.dedup_by_hash(docs, ["doc_id"]).join(copies, "data_hash")


@query(
    """SELECT round(avg(CASE WHEN price IS NULL THEN 0.0 ELSE 1 END) * 100, 4) AS has_price,
    round(avg(CASE WHEN rating IS NULL THEN 0.0 ELSE 1 END) * 100, 4) AS has_rating,
    round(avg(CASE WHEN url IS NULL THEN 0.0 ELSE 1 END) * 100, 4) AS has_url FROM sightings""",
    S,
)
def v4_completeness(spark, sf):
    return rounded(quality.completeness(sightings(spark, sf)))


@query(
    """SELECT source, round((avg(CASE WHEN price IS NULL THEN 0.0 ELSE 1 END)
    + avg(CASE WHEN rating IS NULL THEN 0.0 ELSE 1 END)
    + avg(CASE WHEN url IS NULL THEN 0.0 ELSE 1 END)) / 3, 4) AS data_quality_score FROM sightings GROUP BY source""",
    S,
)
def v5_source_quality(spark, sf):
    return rounded(quality.source_quality(sightings(spark, sf)))


@query(
    """SELECT round(1.0::DOUBLE, 4) AS completeness_score,
    round((count(*) - count(DISTINCT title)) * 100.0 / count(*), 4) AS duplicate_rate,
    round((count(*) FILTER (price <= 0) + count(*) FILTER (title IS NULL)) * 100.0 / count(*), 4) AS invalid_data_rate
    FROM listings""",
    L,
)
def v6_v7_v8_data_quality(spark, sf):
    return rounded(quality.data_quality(listings(spark, sf)))


@query(
    """SELECT source, round(avg(CASE WHEN price IS NULL THEN 0.0 ELSE 1 END) * 100, 4) AS price_complete,
    round(avg(CASE WHEN rating IS NULL THEN 0.0 ELSE 1 END) * 100, 4) AS rating_complete
    FROM sightings GROUP BY source""",
    S,
)
def v9_completeness_by_source(spark, sf):
    return rounded(quality.completeness_by_source(sightings(spark, sf), ("price", "rating")))


@query(
    """SELECT CAST(trunc(avg(CASE WHEN rating IS NULL THEN 0.0 ELSE 1 END) * 100) AS INTEGER) AS data_quality_score
    FROM sightings""",
    S,
)
def v10_price_quality(spark, sf):
    return quality.price_quality(sightings(spark, sf).select(F.col("rating").alias("price")))


@query(
    """SELECT scraper_type, count(*) AS total,
    round(avg(CASE WHEN rating > 2.5 THEN 1.0 ELSE 0.0 END) * 100, 4) AS success_rate
    FROM sightings GROUP BY scraper_type""",
    S,
)
def v11_scraper_success(spark, sf):
    rows = sightings(spark, sf).withColumn("price", F.col("rating") - 2.5)
    return rounded(stats.scraper_success(rows))


@query(
    """SELECT doc_id, copies, doc_id <> first_id AS is_repeat FROM (
    SELECT doc_id, count(*) OVER w AS copies, min(doc_id) OVER w AS first_id FROM documents
    WINDOW w AS (PARTITION BY text, source))"""
)
def d3_mark_duplicates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("title"), "source")
    return quality.mark_duplicates(docs, "doc_id").select("doc_id", "copies", "is_repeat")


# --- T1-T7, D2, D6, D7, H1 --------------------------------------------------------------------------


@query(
    """WITH b AS (SELECT source AS s, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3
    FROM ticks GROUP BY source)
    SELECT id, source, price, round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound
    FROM ticks JOIN b ON source = s WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)""",
    T,
)
def t1_iqr_outliers_by_source(spark, sf):
    found = outliers.iqr_outliers(ticks(spark, sf), "price", by=["source"])
    return rounded(found.select("id", "source", "price", "lower_bound", "upper_bound"))


@query(
    """WITH b AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM ticks),
    o AS (SELECT id, price FROM ticks, b WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1))
    SELECT count(*) AS count, round(count(*) * 100.0 / (SELECT count(price) FROM ticks), 4) AS percentage,
    (SELECT string_agg(CAST(CAST(price AS BIGINT) AS VARCHAR), ',' ORDER BY id)
    FROM (SELECT * FROM o ORDER BY id LIMIT 10)) AS values FROM o""",
    T,
)
def t1_iqr_outlier_summary(spark, sf):
    rows = ticks(spark, sf)
    found = outliers.iqr_outliers(rows, "price")
    summary = outliers.outlier_summary(rows, found, "price", ["id"])
    values = F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), ",")
    return rounded(summary.withColumn("values", values))


@query(
    """WITH b AS (SELECT avg(price) AS m, stddev_samp(price) AS s FROM ticks)
    SELECT id, source, price, round((price - m) / s, 4) AS z_score FROM ticks, b WHERE abs((price - m) / s) > 3""",
    T,
)
def t2_z_outliers(spark, sf):
    return rounded(outliers.z_outliers(ticks(spark, sf), "price").select("id", "source", "price", "z_score"))


@query(
    """WITH b AS (SELECT source AS k, avg(price) AS m, stddev_samp(price) AS s FROM ticks GROUP BY source),
    c AS (SELECT source, count(*) AS count FROM ticks JOIN b ON source = k WHERE abs((price - m) / s) > 3 GROUP BY source)
    SELECT k AS source, coalesce(count, 0) AS count,
    round(coalesce(count, 0) * 100.0 / (SELECT count(price) FROM ticks t WHERE t.source = k), 4) AS percentage
    FROM b LEFT JOIN c ON k = c.source""",
    T,
)
def t2_z_outlier_summary_by_source(spark, sf):
    rows = ticks(spark, sf)
    found = outliers.z_outliers(rows, "price", by=["source"])
    return rounded(outliers.outlier_summary_by(rows, found, "price", "source", ["id"]).drop("values"))


@query(
    """SELECT CAST(scraped_at AS DATE) AS day, count(price) AS price_count, round(avg(price) + 1e-6, 4) AS price_mean,
    round(quantile_cont(price, 0.5), 6) AS price_median, count(DISTINCT source) AS sources FROM sightings GROUP BY 1""",
    S,
)
def t3_daily_trend(spark, sf):
    # The small offset moves means that lie exactly between two rounded values.
    daily = trends.daily_trend(sightings(spark, sf), digits=None)
    return rounded(daily.withColumn("price_mean", F.round(F.col("price_mean") + 1e-6, 4)), 6)


@query(
    """SELECT CAST(recorded_at AS DATE) AS day, count(price) AS price_count, round(avg(price), 4) AS price_mean,
    round(quantile_cont(price, 0.5), 4) AS price_median, count(DISTINCT source) AS sources
    FROM ticks WHERE recorded_at >= TIMESTAMP '2024-01-17 00:00:00' GROUP BY 1""",
    T,
)
def d2_price_by_day(spark, sf):
    from shelfspark.plans.reports import price_by_day

    return rounded(price_by_day(ticks(spark, sf), 14, "2024-01-31 00:00:00", ts="recorded_at", digits=None))


@query(
    """SELECT CAST(date_trunc('week', recorded_at) AS DATE) + 6 AS week, round(avg(price), 4) AS mean_price
    FROM ticks GROUP BY 1""",
    T,
)
def t4_weekly_mean(spark, sf):
    return rounded(trends.weekly_mean(ticks(spark, sf), "recorded_at"))


@query(
    """WITH w AS (SELECT CAST(date_trunc('week', scraped_at) AS DATE) AS week, avg(price) AS m FROM sightings GROUP BY 1),
    x AS (SELECT m, date_diff('day', (SELECT min(week) FROM w), week) / 7.0 AS x FROM w)
    SELECT count(*) AS weeks, round(regr_slope(m, x), 4) AS trend_slope,
    CASE WHEN count(*) < 2 THEN 'stable' WHEN regr_slope(m, x) > 0 THEN 'increasing' ELSE 'decreasing' END
    AS trend_direction FROM x""",
    S,
)
def t5_weekly_trend(spark, sf):
    return rounded(trends.weekly_trend(sightings(spark, sf)))


@query(
    """SELECT round(avg(n), 4) AS avg_products_per_day, max(n) AS max_products_per_day, count(*) AS total_collection_days
    FROM (SELECT count(*) AS n FROM sightings GROUP BY CAST(scraped_at AS DATE))""",
    S,
)
def t6_velocity(spark, sf):
    return rounded(trends.velocity(sightings(spark, sf)))


@query(
    """WITH d AS (SELECT CAST(scraped_at AS DATE) AS day, count(*) AS n FROM sightings GROUP BY 1),
    x AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS x FROM d),
    f AS (SELECT regr_slope(n, x) AS s, regr_intercept(n, x) AS i FROM x)
    SELECT day, n, round(s, 4) AS slope, round(i + s * x, 4) AS fitted FROM x, f""",
    S,
)
def t7_daily_fit(spark, sf):
    return rounded(trends.daily_fit(sightings(spark, sf)))


@query(
    """WITH d AS (SELECT source, CAST(recorded_at AS DATE) AS day, avg(price) AS mean_price, count(*) AS n
    FROM ticks GROUP BY 1, 2)
    SELECT source, day, round(mean_price, 4) AS mean_price, n,
    round(avg(mean_price) OVER (PARTITION BY source ORDER BY day RANGE INTERVAL 6 DAYS PRECEDING), 4) AS mean_7d,
    round(avg(mean_price) OVER (PARTITION BY source ORDER BY day RANGE INTERVAL 13 DAYS PRECEDING), 4) AS mean_14d,
    round(avg(mean_price) OVER (PARTITION BY source ORDER BY day RANGE INTERVAL 29 DAYS PRECEDING), 4) AS mean_30d,
    round(avg(mean_price) OVER (PARTITION BY source ORDER BY day RANGE INTERVAL 89 DAYS PRECEDING), 4) AS mean_90d
    FROM d""",
    T,
)
def d6_moving_average(spark, sf):
    daily = trends.daily_prices(ticks(spark, sf), "recorded_at")
    return rounded(trends.moving_average(daily))


@query(
    """SELECT id, source, product_id, price, previous_price, recorded_at FROM (
    SELECT *, lag(price) OVER (PARTITION BY source, product_id ORDER BY recorded_at, id) AS previous_price
    FROM ticks WHERE price IS NOT NULL) WHERE previous_price IS NULL OR price <> previous_price""",
    T,
)
def h1_price_changes(spark, sf):
    return price_changes(ticks(spark, sf)).select(
        "id", "source", "product_id", "price", "previous_price", "recorded_at"
    )


@query(
    """WITH days AS (SELECT id, source, price, CAST(recorded_at AS DATE) AS day FROM ticks)
    SELECT id, source, price, day, previous_price FROM (
    SELECT *, lag(price) OVER (PARTITION BY source ORDER BY day, id) AS previous_price FROM days)
    WHERE previous_price IS NULL OR price <> previous_price""",
    ("ticks",),
)
def h1_bursts_of_hot_products(spark, sf):
    """A source taken as one product, and all ticks of a day as one instant: slices cut through instants."""
    days = ticks(spark, sf).select("id", "source", "price", F.to_date("recorded_at").alias("day"))
    return price_changes(days, ("source",), "day", hot_share=1000, hot_floor=500, slice_rows=20_000)
