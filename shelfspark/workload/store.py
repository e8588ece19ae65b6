"""Reading, writing, the product table, run logs, task tables, reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.adapters import listings, sightings, table, ticks
from shelfspark.operators import frontier as tasks
from shelfspark.operators import stats
from shelfspark.operators.filters import flatten_success, priced
from shelfspark.operators.skew import first_n_per
from shelfspark.operators.tasks import apply_per_task
from shelfspark.plans import reports
from shelfspark.session import scratch_path
from shelfspark.sources import readers, runs, store, writers
from shelfspark.streaming import streams
from shelfspark.workload.registry import query, rounded

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
SPLIT = "2024-01-16 00:00:00"

# --- R2-R8, W6-W14: files ----------------------------------------------------------------------------


@query(
    """SELECT source, product_id, title, round(price, 4) AS price, scraped_at FROM listings""",
    ("listings",),
)
def r2_r4_listing_files(spark, sf):
    """Listings written as documents of both shapes, one per line, beside a broken one, and read back."""
    rows = listings(spark, sf).select("source", "product_id", "title", "price", "scraped_at", "line_no")
    listing = F.struct("source", "product_id", "title", "price", F.col("scraped_at").cast("string").alias("scraped_at"))
    document = F.to_json(F.struct(F.struct("source").alias("metadata"), F.array(listing).alias("products")))
    array = F.to_json(F.array(listing))
    path = scratch_path(spark, "listing-files")
    rows.select(F.when(F.col("line_no") % 2 == 0, document).otherwise(array)).write.text(f"{path}/good")
    rows.where("line_no = 1").select(F.concat(F.lit('{"products": [{"title": '), "product_id")).write.text(f"{path}/broken")
    read = readers.read_listing_files(spark, path, multiline=False)
    return rounded(read.select("source", "product_id", "title", "price", "scraped_at"))


@query(
    """SELECT order_no, line_no, product_id, source, search_keyword, round(price, 4) AS price FROM listings
    WHERE source = 'A' AND search_keyword ILIKE '%prom%'
    ORDER BY listings.price DESC, order_no, line_no, product_id OFFSET 50 LIMIT 100""",
    ("listings",),
)
def r5_find_listings(spark, sf):
    found = readers.find_listings(
        listings(spark, sf), "A", "prom", 100, 50, "price", tiebreak=("order_no", "line_no", "product_id")
    )
    return rounded(found.select("order_no", "line_no", "product_id", "source", "search_keyword", "price"))


@query(
    "SELECT c_custkey, c_name, round(c_acctbal, 4) AS c_acctbal FROM customer"
)
def r6_json_round_trip(spark, sf):
    path = scratch_path(spark, "customers")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    writers.write_json(rows, path)
    return rounded(readers.read_json(spark, path, rows.schema, multiline=False))


@query(
    """SELECT order_no, line_no, product_id, round(price, 4) AS price FROM sightings
    ORDER BY scraped_at DESC, order_no, line_no, product_id, sightings.price LIMIT 100""",
    ("sightings",),
)
def r7_first_listings(spark, sf):
    rows = readers.find_listings(
        sightings(spark, sf), limit=100, tiebreak=("order_no", "line_no", "product_id", "price")
    )
    return rounded(rows.select("order_no", "line_no", "product_id", "price"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}" for t in TABLES))
def r8_table_counts(spark, sf):
    return readers.table_counts({t: table(spark, sf, t) for t in TABLES})


@query(
    """SELECT source, count(*) AS n, round(sum(price), 4) AS total, count(rating) AS rated FROM sightings GROUP BY source""",
    ("sightings",),
)
def w6_w14_json_by_source(spark, sf):
    path = scratch_path(spark, "by-source")
    rows = sightings(spark, sf)
    writers.write_json(rows, path, ["source"])
    read = readers.read_json(spark, path, rows.schema, multiline=False)
    return rounded(read.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"),
                                              F.count("rating").alias("rated")))


@query(
    """SELECT source, 'static' AS scraper_type, count(*) AS total_products, 'cards' AS extraction_method FROM sightings
    GROUP BY source UNION ALL SELECT 'combined', 'static', count(*), 'cards' FROM sightings""",
    ("sightings",),
)
def w8_source_manifest(spark, sf):
    return writers.source_manifest(sightings(spark, sf), "static", "cards")


@query(
    """SELECT source, product_id, title, round(price, 4) AS price, scraped_at FROM listings
    WHERE scraped_at >= TIMESTAMP '2001-10-28 00:00:00'""",
    ("listings",),
)
def w9_d4_csv_export(spark, sf):
    path = scratch_path(spark, "csv")
    rows = listings(spark, sf).select("source", "product_id", "title", "price", "scraped_at")
    writers.export(rows, "csv", path, 7, "2001-11-04 00:00:00")
    return rounded(spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path))


@query(
    """SELECT source, count(price) AS count, round(avg(price), 4) AS mean, round(quantile_cont(price, 0.5), 4) AS median,
    round(stddev_samp(price), 4) AS std FROM ticks GROUP BY source""",
    ("ticks",),
)
def w11_report_sheets(spark, sf):
    rows = ticks(spark, sf).withColumnRenamed("recorded_at", "scraped_at")
    return rounded(reports.report_sheets(rows, digits=None)["Source_Summary"])


@query(
    """SELECT r AS "range", (SELECT count(*) FROM listings WHERE price >= lo AND price < hi) AS "count"
    FROM (VALUES ('Under $100', -1e300, 100.0), ('$100-$500', 100.0, 500.0),
    ('$500-$1000', 500.0, 1000.0), ('Over $1000', 1000.0, 1e300)) v(r, lo, hi)""",
    ("listings",),
)
def w11_price_sheet(spark, sf):
    """The price sheet of the workbook written as CSV and read back."""
    path = scratch_path(spark, "sheets")
    writers.export(listings(spark, sf), "excel", path)
    return spark.read.schema("range string, count long").option("header", True).csv(f"{path}/Price_Analysis")


@query(
    """SELECT source, product_id, title, round(price, 4) AS price, scraped_at FROM listings
    WHERE scraped_at >= TIMESTAMP '2001-10-28 00:00:00'""",
    ("listings",),
)
def d4_json_export(spark, sf):
    path = scratch_path(spark, "json")
    rows = listings(spark, sf).select("source", "product_id", "title", "price", "scraped_at")
    writers.export(rows, "json", path, 7, "2001-11-04 00:00:00")
    return rounded(readers.read_json(spark, path, rows.schema, multiline=False))


@query("SELECT id, source, product_id, round(price, 4) AS price FROM ticks WHERE id % 7 <> 0", ("ticks",))
def p9_priced(spark, sf):
    """Rows with a price, where every seventh has lost it."""
    rows = ticks(spark, sf).withColumn("price", F.when(F.col("id") % 7 != 0, F.col("price")))
    return rounded(priced(rows).select("id", "source", "product_id", "price"))


@query(
    """SELECT 1 AS position, 'Total Products' AS metric, CAST(count(*) AS VARCHAR) AS value FROM sightings UNION ALL
    SELECT 2, 'Unique Sources', CAST(count(DISTINCT source) AS VARCHAR) FROM sightings UNION ALL
    SELECT 3, 'Average Price', printf('$%.2f', avg(price)) FROM sightings UNION ALL
    SELECT 4, 'Date Range', strftime(min(scraped_at), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S')
    FROM sightings""",
    ("sightings",),
)
def w11_summary_sheet(spark, sf):
    return reports.summary_sheet(sightings(spark, sf))


def _long_sql(section: str, entry: str, metrics: dict[str, str], rest: str) -> str:
    names = ", ".join(f"'{m}'" for m in metrics)
    values = ", ".join(f"CAST({v} AS DOUBLE)" for v in metrics.values())
    return (
        f"SELECT '{section}' AS section, entry, unnest([{names}]) AS metric, unnest(v) AS value FROM "
        f"(SELECT {entry} AS entry, [{values}] AS v FROM {rest})"
    )


def _quantile(p: float) -> str:
    return f"quantile_cont(price, {p})"


_WEEKS = """(SELECT CAST(date_trunc('week', scraped_at) AS DATE) + 6 AS week, avg(price) AS m FROM listings GROUP BY 1)"""
_DOCUMENT = " UNION ALL ".join(
    [
        _long_sql("overview", "'all'", {
            "total_products": "count(*)", "unique_sources": "count(DISTINCT source)",
            "has_price": "count(price) * 100.0 / count(*)", "has_rating": "count(rating) * 100.0 / count(*)",
            "has_url": "count(url) * 100.0 / count(*)"}, "listings"),
        _long_sql("price_distribution", "'all'", {
            "under_100": "count(*) FILTER (price < 100)", "under_500": "count(*) FILTER (price < 500)",
            "under_1000": "count(*) FILTER (price < 1000)", "over_1000": "count(*) FILTER (price >= 1000)"}, "listings"),
        _long_sql("data_quality", "'all'", {
            "completeness_score": "(count(price) + count(title) + count(source) + count(url)) / 4.0 / count(*)",
            "duplicate_rate": "(count(*) - count(DISTINCT title)) * 100.0 / count(*)",
            "invalid_data_rate": "(count(*) FILTER (price <= 0) + count(*) FILTER (title IS NULL)) * 100.0 / count(*)"},
            "listings"),
        _long_sql("price_summary", "'all'", {
            "n": "count(price)", "mean": "avg(price)", "std": "stddev_samp(price)", "min": "min(price)", "max": "max(price)",
            "q1": _quantile(0.25), "median": _quantile(0.5), "q3": _quantile(0.75)}, "listings"),
        _long_sql("source_comparison", "source", {
            "total_products": "count(*)", "avg_price": "avg(price)", "avg_rating": "avg(rating)", "min_price": "min(price)",
            "max_price": "max(price)", "data_quality_score": "(count(price) + count(rating) + count(url)) / 3.0 / count(*)"},
            "listings GROUP BY source"),
        _long_sql("daily_trend", "strftime(scraped_at, '%Y-%m-%d')", {
            "price_count": "count(price)", "price_mean": "avg(price)", "price_median": _quantile(0.5),
            "sources": "count(DISTINCT source)"}, "listings GROUP BY 1"),
        _long_sql("weekly_averages", "strftime(week, '%Y-%m-%d')", {"mean_price": "m"}, _WEEKS),
        _long_sql("price_trend", "'all'", {
            "weeks": "count(*)", "trend_slope": "regr_slope(m, date_diff('day', DATE '1995-01-01', week) / 7.0)"}, _WEEKS),
        _long_sql("velocity", "'all'", {
            "avg_products_per_day": "avg(n)", "max_products_per_day": "max(n)", "total_collection_days": "count(*)"},
            "(SELECT count(*) AS n FROM listings GROUP BY CAST(scraped_at AS DATE))"),
        _long_sql("keyword_performance", "search_keyword", {
            "price_count": "count(price)", "price_mean": "avg(price)", "price_std": "stddev_samp(price)",
            "rating_mean": "avg(rating)", "sources": "count(DISTINCT source)"}, "listings GROUP BY search_keyword"),
        _long_sql("scraper_performance", "scraper_type", {
            "price_count": "count(price)", "sources": "count(DISTINCT source)"}, "listings GROUP BY scraper_type"),
    ]
)


_BOUNDS = """(SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (SELECT quantile_cont(price, 0.25) AS q1,
    quantile_cont(price, 0.75) AS q3, avg(price) AS m, stddev_samp(price) AS s FROM listings))"""
_OUTLIERS = f"""SELECT 'outliers_iqr' AS section, 'all' AS entry, unnest(['count', 'percentage', 'lower_bound', 'upper_bound']) AS metric,
    unnest([n, n * 100.0 / p, low, high]) AS value FROM (SELECT count(*) FILTER (price < low OR price > high) AS n,
    count(price) AS p, min(low) AS low, min(high) AS high FROM listings, {_BOUNDS})
    UNION ALL SELECT 'outliers_z_score', 'all', unnest(['count', 'percentage']), unnest([n, n * 100.0 / p]) FROM (
    SELECT count(*) FILTER (abs((price - m) / s) > 3) AS n, count(price) AS p FROM listings, {_BOUNDS})"""
_HEADER = f"""SELECT 'header' AS section, 'all' AS entry, 'total_records' AS metric, count(*)::DOUBLE AS value, NULL AS text FROM listings
    UNION ALL SELECT 'header', 'all', 'generated_at', NULL, '2024-02-01'
    UNION ALL SELECT 'date_range', 'all', 'earliest', NULL, strftime(min(scraped_at), '%Y-%m-%d %H:%M:%S') FROM listings
    UNION ALL SELECT 'date_range', 'all', 'latest', NULL, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') FROM listings"""


@query(
    f"""SELECT section, entry, metric, round(value + 1e-6, 4) AS value, text FROM (
    SELECT *, NULL AS text FROM ({_DOCUMENT} UNION ALL {_OUTLIERS}) UNION ALL {_HEADER})""",
    ("listings",),
)
def w12_statistics_document(spark, sf):
    """The document, written as JSON and read back; the list of columns is that of the view and is left out."""
    path = scratch_path(spark, "statistics")
    rows = reports.statistics_document(listings(spark, sf), digits=None, generated_at="2024-02-01")
    writers.write_json(rows.where("metric <> 'columns'"), path)
    shape = "section string, entry string, metric string, value double, text string"
    document = readers.read_json(spark, path, shape, multiline=False)
    # The small offset moves values that lie exactly between two rounded ones.
    return document.withColumn("value", F.round(F.col("value") + 1e-6, 4))


@query(
    """SELECT count(*) AS rows, count(*) FILTER (price >= 0.01) AS valid, count(price) AS priced FROM ticks""",
    ("ticks",),
)
def w5_u2_observed_write(spark, sf):
    """Rows counted while they are written, without a second pass."""
    from shelfspark.operators.quality import validate

    rows = ticks(spark, sf).withColumns(
        {"title": F.col("product_id"), "url": F.concat(F.lit("https://shop.example.com/"), "id")}
    )
    watched, seen = writers.observe_metrics(validate(rows).select("id", "price", "is_valid"), "saved")
    watched.write.parquet(scratch_path(spark, "saved"))
    return spark.createDataFrame([seen.get], "rows long, valid long, priced long")


# --- W1, W2, W15, H1, J4: product table ------------------------------------------------------------------


def _before_and_after(spark, sf):
    rows = ticks(spark, sf).withColumn("title", F.concat(F.lit("Item "), "product_id"))
    early = F.col("recorded_at") < F.lit(SPLIT).cast("timestamp_ntz")
    old, _ = store.last_sightings(rows.where(early), ("recorded_at", "id"))
    return old.withColumn("brand", F.concat(F.lit("b"), "product_id")), rows.where(~early)


@query(
    f"""WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, product_id ORDER BY recorded_at DESC, id DESC) AS rn
    FROM ticks WHERE recorded_at < TIMESTAMP '{SPLIT}') WHERE rn = 1),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, product_id ORDER BY recorded_at DESC, id DESC) AS rn
    FROM ticks WHERE recorded_at >= TIMESTAMP '{SPLIT}') WHERE rn = 1)
    SELECT coalesce(n.source, o.source) AS source, coalesce(n.product_id, o.product_id) AS product_id,
    coalesce(n.price, o.price) AS price, coalesce(n.id, o.id) AS id,
    CASE WHEN o.source IS NOT NULL THEN 'b' || o.product_id END AS brand,
    md5(coalesce(n.source, o.source) || '-' || coalesce(n.product_id, o.product_id) || '-Item '
    || coalesce(n.product_id, o.product_id)) AS data_hash
    FROM o FULL JOIN n ON o.source = n.source AND o.product_id = n.product_id""",
    ("ticks",),
)
def w1_j1_upsert(spark, sf):
    current, batch = _before_and_after(spark, sf)
    merged, _ = store.upsert(current, batch, ("recorded_at", "id"))
    return merged.select("source", "product_id", "price", "id", "brand", "data_hash")


@query(
    f"""WITH c AS (SELECT *, lag(price) OVER (PARTITION BY source, product_id ORDER BY recorded_at, id) AS p FROM ticks)
    SELECT id, source, product_id AS source_product_id, price, recorded_at, 'USD' AS currency FROM c
    WHERE recorded_at >= TIMESTAMP '{SPLIT}' AND (p IS NULL OR p <> price)""",
    ("ticks",),
)
def w2_price_history_append(spark, sf):
    current, batch = _before_and_after(spark, sf)
    added = store.new_history(current, batch, "recorded_at")
    shaped = store.history_rows(added.withColumn("availability", F.col("id").cast("string")), "recorded_at")
    return shaped.select(
        F.col("availability").cast("long").alias("id"), "source", "source_product_id", "price", "recorded_at", "currency"
    )


@query(
    f"""WITH k AS (SELECT DISTINCT source, product_id FROM ticks WHERE recorded_at < TIMESTAMP '{SPLIT}')
    SELECT id, EXISTS (SELECT 1 FROM k WHERE k.source = t.source AND k.product_id = t.product_id) AS known
    FROM ticks t WHERE recorded_at >= TIMESTAMP '{SPLIT}'""",
    ("ticks",),
)
def j4_split_existing(spark, sf):
    current, batch = _before_and_after(spark, sf)
    updates, inserts = store.split_existing(current, batch)
    return updates.select("id", F.lit(True).alias("known")).unionByName(inserts.select("id", F.lit(False).alias("known")))


@query(
    """SELECT id, CASE WHEN id % 9 = 0 THEN 'null key' END AS reason FROM ticks""",
    ("ticks",),
)
def w1_rejects(spark, sf):
    from shelfspark.operators.history import split_null_keys

    rows = ticks(spark, sf).withColumn("product_id", F.when(F.col("id") % 9 != 0, F.col("product_id")))
    good, rejects = split_null_keys(rows, store.KEYS)
    return good.select("id", F.lit(None).cast("string").alias("reason")).unionByName(rejects.select("id", "reason"))


@query(
    """SELECT 'kept' AS part, count(*) AS n FROM ticks WHERE recorded_at >= TIMESTAMP '2024-01-21 00:00:00'
    UNION ALL SELECT 'removed', count(*) FROM ticks WHERE recorded_at < TIMESTAMP '2024-01-21 00:00:00'""",
    ("ticks",),
)
def w15_retention(spark, sf):
    kept, removed = store.retain(ticks(spark, sf), "recorded_at", 10, "2024-01-31 00:00:00")
    kept_count = kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("part"), "n")
    return kept_count.unionByName(removed.select(F.lit("removed").alias("part"), F.col("removed").alias("n")))


@query(
    """SELECT source, id, price FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY recorded_at DESC, id) AS rn
    FROM ticks) WHERE rn <= 20""",
    ("ticks",),
)
def p10_first_n_per_source(spark, sf):
    return first_n_per(ticks(spark, sf), ["source"], [F.desc("recorded_at"), "id"], 20).select("source", "id", "price")


# --- W3, W4, A17-A20: runs and tasks -----------------------------------------------------------------------


def _runs(spark, sf):
    """One run per order: source by status, start at the order date."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("session_id"),
        F.lower("o_orderstatus").alias("source"),
        F.col("o_orderdate").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"),
        F.lit(None).cast("int").alias("duration_seconds"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running")
        .otherwise("failed").alias("status"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("total_products_saved"),
        F.col("o_orderpriority").alias("strategy"),
    )


@query(
    """SELECT source, list_sort(list(DISTINCT search_keyword)) AS search_keywords, CAST(3 AS INTEGER) AS max_pages, 'running' AS status,
    '2024-02-01 00:00:00' AS started_at, '3' AS max_pages_setting, true AS unique_ids
    FROM (SELECT DISTINCT source, search_keyword FROM listings) GROUP BY source""",
    ("listings",),
)
def w3_start_runs(spark, sf):
    """A run for every source of the listings with the source's keywords, stored and read back; a handful of sources."""
    wanted = listings(spark, sf).groupBy("source").agg(F.sort_array(F.collect_set("search_keyword")).alias("keywords"))
    path = scratch_path(spark, "runs")
    for r in wanted.orderBy("source").collect():
        started = runs.start_run(spark, r.source, r.keywords, {"max_pages": 3, "delay": 1.5}, "2024-02-01 00:00:00")
        started.write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    total = stored.agg(F.count(F.lit(1)) == F.count_distinct("session_id")).scalar()
    return stored.select(
        "source", "search_keywords", "max_pages", "status", F.col("started_at").cast("string").alias("started_at"),
        F.col("scraper_config")["max_pages"].alias("max_pages_setting"), total.alias("unique_ids"),
    )


@query(
    """WITH u AS (SELECT l_orderkey, max(l_shipdate) AS completed_at, count(*) AS found FROM lineitem GROUP BY l_orderkey)
    SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_orderdate AS started_at, u.completed_at,
    CASE WHEN u.completed_at IS NOT NULL THEN CAST(date_diff('second', o_orderdate, u.completed_at) AS INTEGER) END AS duration_seconds,
    CASE WHEN u.l_orderkey IS NOT NULL THEN 'completed' WHEN o_orderstatus = 'F' THEN 'completed'
    WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS status FROM orders LEFT JOIN u ON o_orderkey = l_orderkey"""
)
def w4_finish_run(spark, sf):
    updates = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").cast("string").alias("session_id"))
        .agg(F.max("l_shipdate").alias("completed_at"), F.count(F.lit(1)).alias("products_found"))
        .withColumn("status", F.lit("completed"))
    )
    done = runs.finish_run(_runs(spark, sf), updates)
    return done.select("session_id", "started_at", "completed_at", "duration_seconds", "status")


def _results(spark, sf):
    """One task result per line item: failed at low discount, otherwise with l_linenumber listings."""
    listing = F.struct(F.concat(F.lit("Item "), "l_partkey").alias("title"), (F.col("l_extendedprice") / 50.0).alias("price"))
    task = F.struct(
        F.col("l_returnflag").alias("source"), F.col("l_partkey").cast("string").alias("keyword"),
        F.col("l_linenumber").alias("page"),
    )
    return table(spark, sf, "lineitem").select(
        task.alias("task"),
        (F.col("l_discount") >= 0.035).alias("success"),
        F.array_repeat(listing, F.col("l_linenumber")).alias("data"),
        (F.col("l_quantity") / 8.0).alias("execution_time"),
    )


@query(
    """SELECT count(*) FILTER (l_discount >= 0.035) AS tasks_completed, count(*) FILTER (l_discount < 0.035) AS tasks_failed,
    CAST(sum(l_linenumber) FILTER (l_discount >= 0.035) AS BIGINT) AS total_products, round(sum(l_quantity / 8.0), 4) AS execution_time,
    round(sum(l_linenumber) FILTER (l_discount >= 0.035) / sum(l_quantity / 8.0), 4) AS products_per_second,
    round(count(*) FILTER (l_discount >= 0.035) * 100.0 / count(*), 4) AS success_rate,
    sum(l_linenumber) FILTER (l_discount >= 0.035) >= 100000 AS target_achieved FROM lineitem"""
)
def a17_run_rollup(spark, sf):
    return rounded(stats.run_rollup(_results(spark, sf), 100_000))


@query(
    """SELECT count(*) AS total_sessions, count(*) FILTER (o_orderstatus = 'F') AS successful_sessions,
    count(*) FILTER (o_orderstatus <> 'F') AS failed_sessions,
    CAST(sum(CAST(floor(o_totalprice / 1000) AS INTEGER)) AS BIGINT) AS records_collected,
    (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT o_orderpriority AS s FROM orders)) AS strategies_used,
    round(sum(CAST(floor(o_totalprice / 1000) AS INTEGER)) * 100.0 / 5000000, 4) AS success_percent FROM orders"""
)
def a18_collection_report(spark, sf):
    report = stats.collection_report(_runs(spark, sf), 5_000_000)
    return rounded(report.withColumn("strategies_used", F.array_join("strategies_used", ",")))


@query(
    """WITH b AS (SELECT date_diff('month', DATE '1995-01-01', CAST(scraped_at AS DATE)) AS batch, count(*) AS batch_records
    FROM sightings GROUP BY 1)
    SELECT batch, batch_records, CAST(sum(batch_records) OVER (ORDER BY batch) AS BIGINT) AS total_records,
    round(sum(batch_records) OVER (ORDER BY batch) * 100.0 / 1000000, 4) AS progress_percent FROM b""",
    ("sightings",),
)
def a19_batch_progress(spark, sf):
    month = (F.year("scraped_at") - 1995) * 12 + F.month("scraped_at") - 1
    batches = sightings(spark, sf).groupBy(month.cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("batch_records"))
    return rounded(stats.batch_progress(batches, 1_000_000, chunk=12))


@query(
    """WITH k AS (SELECT l_returnflag AS source, l_partkey AS keyword, bool_or(l_discount >= 0.035) AS ok,
    sum(CASE WHEN l_discount >= 0.035 THEN l_linenumber ELSE 0 END) AS p FROM lineitem GROUP BY 1, 2)
    SELECT source, CAST(sum(p) AS BIGINT) AS total_products, count(*) FILTER (ok) AS successful_keywords,
    count(*) FILTER (NOT ok) AS failed_keywords, count(*) FILTER (ok) || '/' || count(*) AS success_rate FROM k GROUP BY source"""
)
def a20_keyword_outcomes(spark, sf):
    return stats.keyword_outcomes(_results(spark, sf))


@query(
    """SELECT 'Item ' || l_partkey AS title, count(*) AS n, round(sum(l_extendedprice / 50.0), 4) AS total FROM
    (SELECT *, unnest(range(l_linenumber)) FROM lineitem WHERE l_discount >= 0.035) GROUP BY l_partkey"""
)
def p12_k7_flatten_results(spark, sf):
    rows = flatten_success(_results(spark, sf))
    return rounded(rows.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total")))


@query(
    """SELECT p_partkey, p_size % 7 <> 0 AS success, CASE WHEN p_size % 7 = 0 THEN 'ValueError: no result' END AS error,
    CASE WHEN p_size % 7 = 0 THEN 0 ELSE CAST(p_size % 3 AS INTEGER) END AS n FROM part"""
)
def u1_apply_per_task(spark, sf):
    from pyspark.sql import types as T

    def visit(task: dict):
        if task["p_size"] % 7 == 0:
            raise ValueError("no result")
        return [{"title": f"{task['p_name']} {i}"} for i in range(task["p_size"] % 3)]

    parts = readers.spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    done = apply_per_task(parts, visit, T.StructType([T.StructField("title", T.StringType())]))
    return done.select("p_partkey", "success", "error", F.size("data").alias("n"))


# --- K1-K6: frontier, with the catalogue as keyword list -----------------------------------------------------

SOURCES = ("amazon", "ebay", "walmart")
_KEYWORDS = "(SELECT p_partkey AS keyword_no, p_name AS keyword FROM part) k"
_SOURCES = "(VALUES (0, 'amazon'), (1, 'ebay'), (2, 'walmart')) s(source_no, source)"


def _keywords(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("keyword_no"), F.col("p_name").alias("keyword"))


@query(
    f"""SELECT keyword_no, keyword, source, CAST(page AS INTEGER) AS page, CAST(CASE WHEN page <= 2 THEN 1 ELSE 2 END AS INTEGER) AS priority
    FROM {_KEYWORDS}, {_SOURCES}, (SELECT unnest(range(1, 6)) AS page)"""
)
def k1_k2_frontier(spark, sf):
    planned = tasks.with_priority(tasks.frontier(_keywords(spark, sf), SOURCES, 5))
    return planned.select("keyword_no", "keyword", "source", "page", "priority")


@query(
    f"""SELECT keyword_no, keyword, source, CAST(page AS INTEGER) AS page,
    CAST(greatest(1, 100 + CASE source WHEN 'ebay' THEN 20 WHEN 'walmart' THEN 10 ELSE 0 END - (page - 1) * 10
    - CASE WHEN keyword IN ('laptop', 'tablet') THEN 15 ELSE 0 END) AS INTEGER) AS priority
    FROM (SELECT keyword_no, CASE keyword_no % 10 WHEN 3 THEN 'laptop' WHEN 7 THEN 'tablet' ELSE keyword END AS keyword FROM {_KEYWORDS}) k,
    {_SOURCES}, (SELECT unnest(range(1, 13)) AS page)"""
)
def k3_k4_priority_order(spark, sf):
    number = F.col("keyword_no") % 10
    named = F.when(number == 3, "laptop").when(number == 7, "tablet").otherwise(F.col("keyword"))
    planned = tasks.frontier(_keywords(spark, sf).withColumn("keyword", named), SOURCES, 12)
    ordered = tasks.by_priority(tasks.with_priority(planned, "yield"))
    return ordered.select("keyword_no", "keyword", "source", "page", "priority")


@query(
    f"""SELECT CAST((keyword_no * 3 + source_no) // 12 + 1 AS BIGINT) AS batch, source, keyword, keyword_no + 1 AS priority,
    CAST(CASE WHEN keyword_no < 10 THEN 4 ELSE 3 END AS INTEGER) AS max_pages FROM {_KEYWORDS}, {_SOURCES}"""
)
def k5_batches(spark, sf):
    return tasks.in_batch_order(tasks.batches(_keywords(spark, sf), SOURCES))


@query(
    f"""SELECT keyword_no, source, CAST(page AS INTEGER) AS page, CASE source
    WHEN 'amazon' THEN 'https://www.amazon.com/s?k=' || replace(keyword, ' ', '+') || '&page=' || page
    WHEN 'ebay' THEN 'https://www.ebay.com/sch/i.html?_nkw=' || replace(keyword, ' ', '+') || '&_pgn=' || page
    ELSE 'https://www.walmart.com/search/?query=' || replace(keyword, ' ', '+') || '&page=' || page END AS url
    FROM {_KEYWORDS}, {_SOURCES}, (SELECT unnest(range(1, 3)) AS page)"""
)
def f10_k6_search_urls(spark, sf):
    planned = tasks.with_search_url(tasks.frontier(_keywords(spark, sf), SOURCES, 2), blank="+")
    return planned.select("keyword_no", "source", "page", "url")


# --- G1-G3, D5, D7: reports ---------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT source, count(*) AS n FROM listings GROUP BY source), b AS (SELECT * FROM s ORDER BY n DESC, source LIMIT 1)
    SELECT CAST(1 AS INTEGER) AS position, 'Average product price across all sources: ' || printf('$%.2f', avg(price)) AS finding FROM listings
    UNION ALL SELECT 2, source || ' provided the most products (' || n || ')' FROM b
    UNION ALL SELECT 3, 'Overall data quality score: 100.0%'""",
    ("listings",),
)
def g1_key_findings(spark, sf):
    return reports.key_findings(listings(spark, sf))


@query(
    """WITH q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM ticks),
    o AS (SELECT count(*) AS n FROM ticks, q WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)),
    d AS (SELECT (count(*) - count(DISTINCT product_id)) * 100.0 / count(*) AS dup FROM ticks),
    c AS (SELECT source, count(*) AS n FROM (SELECT CASE WHEN source IN ('view', 'click', 'error') THEN 'browse' ELSE source END AS source
    FROM ticks) GROUP BY source),
    t AS (SELECT 1 AS k, printf('Duplicate rate is %.1f%%. Implement better deduplication strategies.', dup) AS r FROM d WHERE dup > 5
    UNION ALL SELECT 2, 'Consider optimizing scraping strategy for ' || (SELECT source FROM c ORDER BY n, source LIMIT 1)
    || ' - it''s underperforming compared to ' || (SELECT source FROM c ORDER BY n DESC, source LIMIT 1) || '.'
    FROM c HAVING max(n) > 3 * min(n)
    UNION ALL SELECT 3, printf('Found %d price outliers. Review data cleaning rules to handle extreme values.', n) FROM o WHERE n > 0
    UNION ALL SELECT 4, printf('Collection velocity is %.1f products/day. Consider parallel processing to increase throughput.', avg(n))
    FROM (SELECT count(*) AS n FROM ticks GROUP BY CAST(recorded_at AS DATE)) HAVING avg(n) < 100
    UNION ALL SELECT 5, 'Implement automated monitoring to track data quality metrics over time.'
    UNION ALL SELECT 6, 'Consider adding more data sources to increase coverage and comparison opportunities.'
    UNION ALL SELECT 7, 'Set up alerts for significant price changes or anomalies in the collected data.'
    UNION ALL SELECT 8, 'Regularly review and update scraping selectors to maintain data extraction accuracy.')
    SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position, r AS recommendation FROM t""",
    ("ticks",),
)
def g2_recommendations(spark, sf):
    grouped = F.when(F.col("source").isin("view", "click", "error"), "browse").otherwise(F.col("source"))
    rows = ticks(spark, sf).select(
        grouped.alias("source"), F.col("product_id").alias("title"), "price",
        F.concat(F.lit("https://shop.example.com/"), "id").alias("url"), F.col("recorded_at").alias("scraped_at"),
    )
    return reports.recommendations(rows)


@query(
    """SELECT 'data_quality' AS section, 1 AS rows UNION ALL SELECT 'findings', 3 UNION ALL SELECT 'metadata', 1
    UNION ALL SELECT 'overview', 1 UNION ALL SELECT 'price_distribution', 4 UNION ALL SELECT 'price_statistics', 1
    UNION ALL SELECT 'price_trend', 1 UNION ALL SELECT 'source_comparison', (SELECT count(DISTINCT source) FROM listings)
    UNION ALL SELECT 'velocity', 1""",
    ("listings",),
)
def g3_report_sections(spark, sf):
    sections = reports.report_tables(listings(spark, sf))
    sections.pop("recommendations")
    return readers.table_counts(sections).select(F.col("table").alias("section"), F.col("row_count").alias("rows"))


@query(
    """WITH c AS (SELECT *, lag(price) OVER (PARTITION BY source, product_id ORDER BY recorded_at, id) AS p FROM ticks)
    SELECT source, count(*) FILTER (price > p) AS rises, count(*) FILTER (price < p) AS falls, round(avg(price - p), 4) AS mean_move
    FROM c WHERE p IS NOT NULL AND p <> price AND recorded_at >= TIMESTAMP '2024-01-11 00:00:00' GROUP BY source""",
    ("ticks",),
)
def d5_price_moves(spark, sf):
    return rounded(reports.change_totals(ticks(spark, sf), 20, "2024-01-31 00:00:00", "recorded_at"))


@query(
    """WITH w AS (SELECT search_keyword, avg(price) FILTER (source = 'A') AS "A", avg(price) FILTER (source = 'N') AS "N",
    avg(price) FILTER (source = 'R') AS "R" FROM listings GROUP BY search_keyword)
    SELECT search_keyword, round("A", 4) AS "A", round("N", 4) AS "N", round("R", 4) AS "R",
    CASE least("A", "N", "R") WHEN "A" THEN 'A' WHEN "N" THEN 'N' ELSE 'R' END AS cheapest FROM w""",
    ("listings",),
)
def d7_price_comparison(spark, sf):
    return rounded(reports.price_comparison(listings(spark, sf), ("A", "N", "R")))


# --- S1-S4: streams over the events files ---------------------------------------------------------------------


def _tick_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events*.parquet").load(sf)
    return raw.select(
        F.col("event_type").alias("source"),
        F.col("user_id").cast("string").alias("product_id"),
        (F.floor(F.col("value") / 20.0) * 20.0).alias("price"),
        F.col("ts").alias("recorded_at"),
        F.col("event_id").alias("id"),
    )


@query(
    """SELECT source, product_id, price, data_hash FROM (SELECT source, product_id, price, md5(source || '-' || product_id || '-Item '
    || product_id) AS data_hash, row_number() OVER (PARTITION BY source, product_id ORDER BY recorded_at DESC, price DESC) AS rn
    FROM ticks WHERE price >= 0.01) WHERE rn = 1""",
    ("ticks",),
)
def s1_stream_ingest(spark, sf):
    landed = _tick_stream(spark, sf).select(
        F.concat(F.lit("Item "), "product_id").alias("title"),
        F.concat(F.lit("https://shop.example.com/"), "product_id").alias("url"),
        "source", "product_id", "price", F.col("recorded_at").alias("scraped_at"),
    )
    root = streams.run_ingest(landed, "ingest")
    table_now = store.read_version(spark, f"{root}/products")
    return table_now.select("source", "product_id", "price", "data_hash")


@query("SELECT DISTINCT md5(source || '-' || product_id || '-' || CAST(CAST(price AS BIGINT) AS VARCHAR)) AS data_hash FROM ticks", ("ticks",))
def s2_stream_dedup(spark, sf):
    hashed = F.md5(F.concat_ws("-", "source", "product_id", F.col("price").cast("long").cast("string")))
    unique = streams.stream_dedup(_tick_stream(spark, sf).withColumn("data_hash", hashed), "60 days", "recorded_at")
    return streams.run_available(unique.select("data_hash"), "dedup")


def _closed_tick_stream(spark, sf):
    """The ticks from files of a folder, and one tick far later that lets every window close."""
    path = scratch_path(spark, "ticks")
    rows = ticks(spark, sf)
    last = rows.orderBy(F.col("id").desc()).limit(1).withColumn("recorded_at", F.col("recorded_at") + F.expr("INTERVAL 400 DAYS"))
    rows.unionByName(last).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("SELECT CAST(recorded_at AS DATE) AS day, count(*) AS n FROM ticks GROUP BY 1", ("ticks",))
def s3_stream_daily_counts(spark, sf):
    """Windows leave the state as the watermark passes them."""
    counts = streams.stream_daily_counts(_closed_tick_stream(spark, sf), "1 day", "recorded_at")
    return streams.run_available(counts, "daily")


@query(
    """SELECT CAST(date_trunc('week', recorded_at) AS DATE) + 6 AS week, round(avg(price), 4) AS mean_price
    FROM ticks GROUP BY 1""",
    ("ticks",),
)
def s3_stream_weekly_mean(spark, sf):
    means = streams.stream_weekly_mean(_closed_tick_stream(spark, sf), "1 day", "recorded_at")
    return rounded(streams.run_available(means, "weekly"))


#: How far ticks arrive out of order in the shuffled files, and the delay the streams allow for it.
DISORDER_DAYS, DELAY = 4, "20 days"


def _shuffled_tick_stream(spark, sf, files: int = 4):
    """The ticks as files in the order of their arrival, up to some days after their time, and one tick far later.

    Every file is a micro-batch of its own, so most products have ticks that arrive after newer ones.
    """
    path = scratch_path(spark, "shuffled-ticks")
    rows = ticks(spark, sf).withColumn("_arrival", F.unix_seconds(F.col("recorded_at").cast("timestamp")) + F.pmod(F.xxhash64("id"), F.lit(DISORDER_DAYS * 86400)))
    low, high = rows.agg(F.min("_arrival"), F.max("_arrival")).first()
    place = F.least(F.floor((F.col("_arrival") - low) * files / max(high - low, 1)), F.lit(files - 1))
    last = rows.orderBy(F.col("id").desc()).limit(1).withColumns({"recorded_at": F.col("recorded_at") + F.expr("INTERVAL 400 DAYS"), "id": F.lit(-1).cast("long")})
    rows.where("price IS NOT NULL").withColumn("_file", place).unionByName(last.withColumn("_file", F.lit(files))).drop("_arrival").repartition(
        files + 1, "_file"
    ).write.partitionBy("_file").parquet(path)
    schema = ticks(spark, sf).schema
    # The folders become files of a stream one after another: sources take files by the time of their last change.
    landed = scratch_path(spark, "landed-ticks")
    for k in range(files + 1):
        spark.read.schema(schema).parquet(f"{path}/_file={k}").coalesce(1).write.parquet(f"{landed}/part{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return source.parquet(landed)


ORDERED_CHANGES = """SELECT id, source, product_id, price, previous_price, recorded_at, false AS late FROM (
    SELECT *, lag(price) OVER (PARTITION BY source, product_id ORDER BY recorded_at, id) AS previous_price FROM ticks)
    WHERE previous_price IS NULL OR price <> previous_price"""


@query(ORDERED_CHANGES, ("ticks",))
def s4_stream_price_changes(spark, sf):
    return streams.run_price_changes(_tick_stream(spark, sf), "changes")


@query(ORDERED_CHANGES, ("ticks",))
def s4_shuffled_price_changes(spark, sf):
    """Out of order over several micro-batches, equal to the batch form."""
    return streams.run_price_changes(_shuffled_tick_stream(spark, sf), "shuffled-changes", DELAY).where("id >= 0")


@query(ORDERED_CHANGES, ("ticks",))
def s4_keyed_price_changes(spark, sf):
    streams.use_rocksdb(spark)
    changes = streams.stream_price_changes(_shuffled_tick_stream(spark, sf), DELAY)
    return streams.run_available(changes, "keyed-changes").where("id >= 0")
