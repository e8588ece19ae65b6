"""Price, source, keyword and run aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.numbers import money, round_even
from shelfspark.operators.filters import recent
from shelfspark.operators.quantiles import exact_quantiles
from shelfspark.operators.skew import join_group_table

# Bounds of the cumulative price counts and of the disjoint price ranges.
PRICE_BOUNDS = (100, 500, 1000)
PRICE_RANGES = (
    ("Under $100", None, 100.0),
    ("$100-$500", 100.0, 500.0),
    ("$500-$1000", 500.0, 1000.0),
    ("Over $1000", 1000.0, None),
)


def share_present(column: str) -> Column:
    return F.avg(F.col(column).isNotNull().cast("double"))


def _count(name: str = "total_products") -> Column:
    return F.count(F.lit(1)).alias(name)


def named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def overview_columns(df: DataFrame) -> dict[str, Column]:
    """Rows, distinct sources and completeness in percent as aggregates."""
    present = [c for c in ("price", "rating", "url") if c in df.columns]
    return {
        "total_products": F.count(F.lit(1)),
        "unique_sources": F.count_distinct("source"),
        **{f"has_{c}": share_present(c) * 100 for c in present},
    }


def overview(df: DataFrame, ts: str = "scraped_at") -> DataFrame:
    return df.agg(*named(overview_columns(df)), F.min(ts).alias("earliest"), F.max(ts).alias("latest"))


def price_summary(df: DataFrame, by: Sequence[str] = (), column: str = "price") -> DataFrame:
    """count, mean, median, sample std, min, max, q1, q3 of the non-null values."""
    keys = list(by)
    rows = df.where(F.col(column).isNotNull())
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    moments = rows.groupBy(*keys).agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    quantiles = exact_quantiles(rows, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    if keys:
        return moments.join(quantiles, keys, "left")
    one_row = {
        name: quantiles.select(F.struct("q1", "median", "q3")).scalar().getField(name)
        for name in ("q1", "median", "q3")
    }
    return moments.select("*", *[value.alias(name) for name, value in one_row.items()])


def cumulative_columns(bounds: Sequence[int] = PRICE_BOUNDS) -> dict[str, Column]:
    """Rows under each bound, and rows at or over the last one, as aggregates."""
    under = {f"under_{b}": F.count_if(F.col("price") < b) for b in bounds}
    return {**under, f"over_{bounds[-1]}": F.count_if(F.col("price") >= bounds[-1])}


def cumulative_price_counts(df: DataFrame, bounds: Sequence[int] = PRICE_BOUNDS) -> DataFrame:
    return df.agg(*named(cumulative_columns(bounds)))


def price_ranges(df: DataFrame) -> DataFrame:
    """Disjoint ranges with their counts; an empty range shows 0."""
    counts = []
    for _, low, high in PRICE_RANGES:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col("price") >= low)
        if high is not None:
            inside = inside & (F.col("price") < high)
        counts.append(F.count_if(inside & F.col("price").isNotNull()))
    rows = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("range"), count.alias("n"))
        for i, ((name, _, _), count) in enumerate(zip(PRICE_RANGES, counts))
    ]
    return df.agg(F.array(*rows).alias("ranges")).select(F.inline("ranges"))


def histogram(df: DataFrame, column: str = "price", bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins are listed too."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    # A constant column gets a range of one around its value.
    span = values.agg(F.min("_v").alias("a"), F.max("_v").alias("b")).select(
        F.struct(
            F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("low"),
            F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("high"),
        )
    )
    low, high = span.scalar().getField("low"), span.scalar().getField("high")
    number = F.least(F.width_bucket(F.col("_v"), low, high, F.lit(bins)), F.lit(bins))
    counts = values.groupBy(number.alias("bin")).agg(_count("n"))
    width = (high - low) / bins
    edges = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    return edges.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (low + (F.col("bin") - 1) * width).alias("low"),
        (low + F.col("bin") * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_stats(df: DataFrame, by: str = "source", column: str = "price") -> DataFrame:
    """Quartiles, whiskers (extreme values inside 1.5 IQR) and mean per group."""
    rows = df.where(F.col(column).isNotNull() & F.col(by).isNotNull()).select(by, column)
    summary = price_summary(rows, [by], column).select(by, "n", "mean", "q1", "median", "q3")
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(column).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return (
        join_group_table(rows, summary, [by], "n")
        .groupBy(by, "n", "mean", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(column))).alias("whisker_low"),
            F.max(F.when(inside, F.col(column))).alias("whisker_high"),
            F.count_if(~inside).alias("outside"),
        )
    )


def _source_quality() -> Column:
    shares = [share_present(c) for c in ("price", "rating", "url")]
    return reduce(lambda a, b: a + b, shares) / len(shares)


def source_comparison(df: DataFrame) -> DataFrame:
    """Count, average price and rating, price range and quality score per source; one shuffle."""
    return (
        df.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(
            _count(),
            F.avg("price").alias("avg_price"),
            F.avg("rating").alias("avg_rating"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
            _source_quality().alias("data_quality_score"),
        )
    )


def source_summary(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Price count, mean, median and std per source, rounded."""
    s = price_summary(df, ["source"])
    return s.select(
        "source", F.col("n").alias("count"), *[round_even(F.col(c), digits).alias(c) for c in ("mean", "median", "std")]
    )


def source_shares(df: DataFrame) -> DataFrame:
    """Rows per source with their share of all rows, largest first."""
    counts = df.groupBy("source").agg(_count("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") * 100.0 / total).orderBy(F.desc("n"), "source")


def average_price_by_source(df: DataFrame) -> DataFrame:
    return df.where(F.col("source").isNotNull()).groupBy("source").agg(F.avg("price").alias("avg_price"))


def keyword_performance(df: DataFrame, keywords: Sequence[str] | None = None, digits: int | None = 2) -> DataFrame:
    """Price count, mean, std, rating mean and distinct sources per keyword."""
    rows = df.where(F.col("search_keyword").isNotNull())
    if keywords is not None:
        rows = rows.where(F.col("search_keyword").isin(*keywords))
    return rows.groupBy("search_keyword").agg(
        F.count("price").alias("price_count"),
        round_even(F.avg("price"), digits).alias("price_mean"),
        round_even(F.stddev_samp("price"), digits).alias("price_std"),
        round_even(F.avg("rating"), digits).alias("rating_mean"),
        F.count_distinct("source").alias("sources"),
    )


def scraper_performance(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("scraper_type").isNotNull())
        .groupBy("scraper_type")
        .agg(F.count("price").alias("price_count"), F.count_distinct("source").alias("sources"))
    )


def scraper_success(df: DataFrame) -> DataFrame:
    """Share of rows with a positive price per scraper type; a null price is a failure."""
    hit = F.when(F.col("price") > 0, 1.0).otherwise(0.0)
    return df.groupBy("scraper_type").agg(_count("total"), (F.avg(hit) * 100).alias("success_rate"))


def store_stats(df: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Totals of the store; the average is 0 when no price is known."""
    sessions = F.lit(0).cast("long") if runs is None else runs.agg(F.count(F.lit(1))).scalar()
    return df.agg(
        _count(),
        F.coalesce(F.avg("price"), F.lit(0.0)).alias("avg_price"),
        F.max("scraped_at").alias("latest_scrape"),
    ).withColumn("total_sessions", sessions)


def products_by_source(df: DataFrame) -> DataFrame:
    """Rows per source, a missing source included."""
    return df.groupBy("source").agg(_count("n"))


def daily_collection(df: DataFrame, as_of: datetime | str, days: int = 7, ts: str = "scraped_at") -> DataFrame:
    """Rows and active sources per day of the last days, newest first, as many days as asked for."""
    return (
        recent(df, ts, days, as_of)
        .groupBy(F.to_date(ts).alias("day"))
        .agg(_count("products_collected"), F.count_distinct("source").alias("sources_active"))
        .orderBy(F.desc("day"))
        .limit(days)
    )


def dataset_stats(df: DataFrame) -> DataFrame:
    """One row: total and min / max / avg of price and rating."""
    return df.agg(
        _count(),
        *[f(c).alias(f"{c}_{n}") for c in ("price", "rating") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))],
    )


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of a column, long form (kind, value, n)."""
    return df.groupBy(F.lit(column).alias("kind"), F.col(column).alias("value")).agg(_count("n"))


def report_metadata(df: DataFrame, ts: str = "scraped_at") -> DataFrame:
    """Totals, period text, average price and truncated price completeness."""
    one = df.agg(
        _count(),
        F.count_distinct("source").alias("total_sources"),
        F.min(ts).alias("_a"),
        F.max(ts).alias("_b"),
        F.avg("price").alias("_price"),
        share_present("price").alias("_q"),
    )
    period = F.concat_ws(" - ", F.date_format("_a", "MM/dd/yyyy"), F.date_format("_b", "MM/dd/yyyy"))
    return one.select(
        "total_products",
        "total_sources",
        F.when(F.col("_a").isNull(), "No data").otherwise(period).alias("collection_period"),
        F.coalesce((F.col("_q") * 100).cast("int"), F.lit(0)).alias("data_quality_score"),
        money(F.col("_price")).alias("average_price"),
    )


# --- runs and tasks ---------------------------------------------------------------------------------


def run_rollup(results: DataFrame, target: int) -> DataFrame:
    """One row over task results: completed, failed, products, rate, success and target flag."""
    one = results.agg(
        F.count_if("success").alias("tasks_completed"),
        F.count_if(~F.col("success")).alias("tasks_failed"),
        F.sum(F.when(F.col("success"), F.size(F.coalesce("data", F.array())))).alias("_products"),
        F.sum("execution_time").alias("execution_time"),
    )
    return one.select(
        "tasks_completed",
        "tasks_failed",
        F.coalesce("_products", F.lit(0)).alias("total_products"),
        "execution_time",
        F.coalesce(F.try_divide(F.col("_products").cast("double"), "execution_time"), F.lit(0.0)).alias(
            "products_per_second"
        ),
        F.coalesce(
            F.try_divide(F.col("tasks_completed") * 100.0, F.col("tasks_completed") + F.col("tasks_failed")),
            F.lit(0.0),
        ).alias("success_rate"),
        (F.coalesce("_products", F.lit(0)) >= target).alias("target_achieved"),
    )


def collection_report(runs: DataFrame, target: int) -> DataFrame:
    """Runs total / successful / failed, strategies used, and records as share of the target."""
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    return runs.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(done).alias("successful_sessions"),
        F.count_if(~done).alias("failed_sessions"),
        F.coalesce(F.sum("total_products_saved"), F.lit(0)).alias("records_collected"),
        F.array_sort(F.collect_set("strategy")).alias("strategies_used"),
    ).withColumn("success_percent", F.col("records_collected") * 100.0 / target)


def batch_progress(batches: DataFrame, target: int, chunk: int = 10_000) -> DataFrame:
    """Running total and share of the target over (batch, batch_records).

    A two-level prefix sum: chunks of consecutive batches are summed first, so no window sees more
    than one chunk of batches or one row per chunk.
    """
    numbered = batches.withColumn("_chunk", F.floor(F.col("batch") / chunk)).where(F.col("_chunk").isNotNull())
    chunk_sums = numbered.groupBy("_chunk").agg(F.sum("batch_records").alias("_sum"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunk_sums.select("_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_chunk").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_offset") + F.sum("batch_records").over(inside)
    return numbered.join(offsets, "_chunk").select(
        "batch",
        "batch_records",
        total.alias("total_records"),
        (total * 100.0 / target).alias("progress_percent"),
    )


def keyword_outcomes(results: DataFrame) -> DataFrame:
    """Per source: keywords with and without a successful task, and the rate as text k/n."""
    per_keyword = results.groupBy(F.col("task.source").alias("source"), F.col("task.keyword").alias("keyword")).agg(
        F.max("success").alias("ok"),
        F.sum(F.when(F.col("success"), F.size(F.coalesce("data", F.array()))).otherwise(0)).alias("_products"),
    )
    good, bad = F.count_if("ok"), F.count_if(~F.col("ok"))
    return per_keyword.groupBy("source").agg(
        F.sum("_products").alias("total_products"),
        good.alias("successful_keywords"),
        bad.alias("failed_keywords"),
        F.concat_ws("/", good.cast("string"), F.count(F.lit(1)).cast("string")).alias("success_rate"),
    )
