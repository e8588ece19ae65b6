"""Report tables, findings and recommendations, each a DataFrame over the listings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.numbers import money
from shelfspark.functions.text import label
from shelfspark.operators import outliers, quality, stats, trends
from shelfspark.operators.filters import recent
from shelfspark.operators.history import price_changes

# Wording of the findings.
FINDING_AVERAGE = "Average product price across all sources: %s"
FINDING_MAJORITY = "Majority of products (%d) are priced under $100"
FINDING_LARGEST = "%s provided the most products (%d)"
FINDING_QUALITY = "Overall data quality score: %.1f%%"

# Thresholds and wording of the recommendations.
MIN_COMPLETENESS = 90
MAX_DUPLICATE_RATE = 5
MAX_SOURCE_RATIO = 3
MIN_DAILY_ROWS = 100
ADVICE_COMPLETENESS = "Data completeness score is %.1f%%. Consider improving data validation and extraction rules."
ADVICE_DUPLICATES = "Duplicate rate is %.1f%%. Implement better deduplication strategies."
ADVICE_SOURCE = "Consider optimizing scraping strategy for %s - it's underperforming compared to %s."
ADVICE_OUTLIERS = "Found %d price outliers. Review data cleaning rules to handle extreme values."
ADVICE_VELOCITY = "Collection velocity is %.1f products/day. Consider parallel processing to increase throughput."
ADVICE_GENERAL = (
    "Implement automated monitoring to track data quality metrics over time.",
    "Consider adding more data sources to increase coverage and comparison opportunities.",
    "Set up alerts for significant price changes or anomalies in the collected data.",
    "Regularly review and update scraping selectors to maintain data extraction accuracy.",
)


def price_by_day(
    df: DataFrame, days: int, as_of: datetime | str, ts: str = "scraped_at", digits: int | None = 2
) -> DataFrame:
    """Daily price figures of the last days."""
    return trends.daily_trend(recent(df, ts, days, as_of), ts, digits)


def _numbered(lines: Sequence[Column], one_row: DataFrame, name: str) -> DataFrame:
    """The lines that apply, numbered from 1."""
    kept = F.array_compact(F.array(*lines))
    return one_row.select(F.posexplode(kept).alias("_at", name)).select((F.col("_at") + 1).alias("position"), name)


def _source_extremes(df: DataFrame) -> DataFrame:
    """Largest and smallest source by rows; ties go to the first by name."""
    counts = df.where(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.struct(
            F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("largest"),
            F.max("n").alias("most"),
            F.min_by("source", F.struct(F.col("n"), F.col("source"))).alias("smallest"),
            F.min("n").alias("fewest"),
        )
    )


def key_findings(df: DataFrame) -> DataFrame:
    """Average price, majority under the lowest bound, largest source, and data quality, as sentences."""
    sources = _source_extremes(df).scalar()
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("price").alias("mean"),
        F.count_if(F.col("price") < stats.PRICE_BOUNDS[0]).alias("cheap"),
        (reduce(lambda a, b: a + b, [stats.share_present(c) for c in ("price", "title", "source", "url")]) / 4).alias(
            "complete"
        ),
    ).withColumn("sources", sources)
    largest = F.col("sources.largest")
    lines = [
        F.when(F.col("mean").isNotNull(), F.format_string(FINDING_AVERAGE, money(F.col("mean")))),
        F.when(F.col("cheap") > F.col("n") * 0.5, F.format_string(FINDING_MAJORITY, F.col("cheap"))),
        F.when(largest.isNotNull(), F.format_string(FINDING_LARGEST, label(largest), F.col("sources.most"))),
        F.when(F.col("complete").isNotNull(), F.format_string(FINDING_QUALITY, F.col("complete") * 100)),
    ]
    return _numbered(lines, one, "finding")


def recommendations(df: DataFrame, ts: str = "scraped_at") -> DataFrame:
    """Advice whose conditions hold, followed by the general advice; none for an empty input."""
    sources = _source_extremes(df).scalar()
    found = outliers.iqr_outliers(df.select("price"), "price").agg(F.count(F.lit(1))).scalar()
    pace = trends.velocity(df, ts).select("avg_products_per_day").scalar()
    quality_row = df.agg(*stats.named(quality.quality_columns(df)), F.count(F.lit(1)).alias("n"))
    one = quality_row.withColumns({"sources": sources, "outliers": found, "pace": pace})
    score = F.col("completeness_score") * 100
    uneven = F.col("sources.most") > F.col("sources.fewest") * MAX_SOURCE_RATIO
    lines = [
        F.when(score < MIN_COMPLETENESS, F.format_string(ADVICE_COMPLETENESS, score)),
        F.when(
            F.col("duplicate_rate") > MAX_DUPLICATE_RATE, F.format_string(ADVICE_DUPLICATES, F.col("duplicate_rate"))
        ),
        F.when(uneven, F.format_string(ADVICE_SOURCE, F.col("sources.smallest"), F.col("sources.largest"))),
        F.when(F.col("outliers") > 0, F.format_string(ADVICE_OUTLIERS, F.col("outliers"))),
        F.when(F.col("pace") < MIN_DAILY_ROWS, F.format_string(ADVICE_VELOCITY, F.col("pace"))),
        *[F.lit(text) for text in ADVICE_GENERAL],
    ]
    return _numbered(lines, one.where("n > 0"), "recommendation")


def report_tables(df: DataFrame, ts: str = "scraped_at") -> dict[str, DataFrame]:
    """The sections of the report as named tables."""
    return {
        "metadata": stats.report_metadata(df, ts),
        "overview": stats.overview(df, ts),
        "price_statistics": stats.price_summary(df),
        "price_distribution": stats.price_ranges(df),
        "source_comparison": stats.source_comparison(df),
        "velocity": trends.velocity(df, ts),
        "price_trend": trends.weekly_trend(df, ts),
        "data_quality": quality.data_quality(df),
        "findings": key_findings(df),
        "recommendations": recommendations(df, ts),
    }


def report_sheets(df: DataFrame, digits: int | None = 2) -> dict[str, DataFrame]:
    """The sheets of the workbook export as named tables."""
    return {
        "Products": df,
        "Source_Summary": stats.source_summary(df, digits=digits),
        "Price_Analysis": stats.price_ranges(df).select("range", F.col("n").alias("count")),
        "Summary": summary_sheet(df),
    }


def summary_sheet(df: DataFrame, ts: str = "scraped_at") -> DataFrame:
    """(position, metric, value) with totals, average price and period as text."""
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("source").alias("sources"),
        F.avg("price").alias("mean"),
        F.min(ts).alias("a"),
        F.max(ts).alias("b"),
    )
    values = {
        "Total Products": F.col("n").cast("string"),
        "Unique Sources": F.col("sources").cast("string"),
        "Average Price": money(F.col("mean")),
        "Date Range": F.concat_ws(" to ", F.col("a").cast("string"), F.col("b").cast("string")),
    }
    rows = [F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), v.alias("value"))
            for i, (m, v) in enumerate(values.items(), 1)]
    return one.select(F.inline(F.array(*rows)))


def _long(df: DataFrame, section: str, entry: Column) -> DataFrame:
    """Numeric columns of a table as (section, entry, metric, value)."""
    numeric = [c for c, t in df.dtypes if t in ("double", "bigint", "int")]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric])
    return df.select(F.lit(section).alias("section"), entry.cast("string").alias("entry"), F.inline(pairs))


def _one_row_statistics(df: DataFrame) -> DataFrame:
    """The one-row sections in long form, all from a single pass over the listings."""
    sections = {
        "overview": stats.overview_columns(df),
        "price_distribution": stats.cumulative_columns(),
        "data_quality": quality.quality_columns(df),
    }
    columns = {(section, metric): c for section, metrics in sections.items() for metric, c in metrics.items()}
    one = df.agg(*[c.alias(f"{section}_{metric}") for (section, metric), c in columns.items()])
    rows = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit("all").alias("entry"),
            F.lit(metric).alias("metric"),
            F.col(f"{section}_{metric}").cast("double").alias("value"),
        )
        for section, metric in columns
    ]
    return one.select(F.inline(F.array(*rows)))


def _outlier_statistics(df: DataFrame) -> DataFrame:
    """Counts and shares of price outliers by both rules, with the quartile bounds, from one flagged pass."""
    summary = stats.price_summary(df).select(F.struct("q1", "q3", "mean", "std").alias("s")).scalar()
    s = F.col("s")
    iqr = s["q3"] - s["q1"]
    lower, upper = s["q1"] - 1.5 * iqr, s["q3"] + 1.5 * iqr
    z = F.try_divide(F.col("price") - s["mean"], s["std"])
    one = df.select("price", summary.alias("s")).agg(
        F.count("price").alias("n"),
        F.count_if((F.col("price") < lower) | (F.col("price") > upper)).alias("iqr"),
        F.count_if(F.abs(z) > 3.0).alias("z"),
        F.first(lower, ignorenulls=True).alias("lower"),
        F.first(upper, ignorenulls=True).alias("upper"),
    )
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("n")), F.lit(0.0))
    metrics = [
        ("outliers_iqr", "count", F.col("iqr")), ("outliers_iqr", "percentage", share("iqr")),
        ("outliers_iqr", "lower_bound", F.col("lower")), ("outliers_iqr", "upper_bound", F.col("upper")),
        ("outliers_z_score", "count", F.col("z")), ("outliers_z_score", "percentage", share("z")),
    ]
    rows = [
        F.struct(F.lit(s).alias("section"), F.lit("all").alias("entry"), F.lit(m).alias("metric"), v.cast("double").alias("value"))
        for s, m, v in metrics
    ]
    return one.select(F.inline(F.array(*rows)))


def _header(df: DataFrame, ts: str, generated_at: datetime | str | None) -> DataFrame:
    """Period, number of records, columns and, where given, the time of the report; texts in a column of their own."""
    one = df.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("a"), F.max(ts).alias("b"))
    none = F.lit(None).cast("string")
    entries = [
        ("date_range", "earliest", None, F.col("a").cast("string")),
        ("date_range", "latest", None, F.col("b").cast("string")),
        ("header", "total_records", F.col("n"), none),
        ("header", "columns", F.lit(len(df.columns)), F.lit(", ".join(df.columns))),
    ]
    if generated_at is not None:
        entries.append(("header", "generated_at", None, F.lit(str(generated_at))))
    rows = [
        F.struct(
            F.lit(section).alias("section"), F.lit("all").alias("entry"), F.lit(metric).alias("metric"),
            (F.lit(None) if value is None else value).cast("double").alias("value"), text.alias("text"),
        )
        for section, metric, value, text in entries
    ]
    return one.select(F.inline(F.array(*rows)))


def statistics_document(
    df: DataFrame, ts: str = "scraped_at", digits: int | None = 2, generated_at: datetime | str | None = None
) -> DataFrame:
    """All statistics in one long table (section, entry, metric, value, text), ready for a JSON sink.

    Long form keeps the result distributed however many keywords or days there are.
    """
    everything = F.lit("all")
    parts = [
        _header(df, ts, generated_at),
        _one_row_statistics(df),
        _outlier_statistics(df),
        _long(stats.price_summary(df), "price_summary", everything),
        _long(stats.source_comparison(df), "source_comparison", F.col("source")),
        _long(trends.daily_trend(df, ts, digits), "daily_trend", F.col("day")),
        _long(trends.weekly_mean(df, ts), "weekly_averages", F.col("week")),
        _long(trends.weekly_trend(df, ts), "price_trend", everything),
        _long(trends.velocity(df, ts), "velocity", everything),
        _long(stats.keyword_performance(df, digits=digits), "keyword_performance", F.col("search_keyword")),
        _long(stats.scraper_performance(df), "scraper_performance", F.col("scraper_type")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def trend_report(
    df: DataFrame, days: int, as_of: datetime | str, ts: str = "scraped_at", tiebreak: str = "id"
) -> dict[str, DataFrame]:
    """Trends and price changes of a period as named tables."""
    rows = recent(df, ts, days, as_of)
    return {
        "daily": trends.daily_trend(rows, ts),
        "weekly": trends.weekly_mean(rows, ts),
        "price_trend": trends.weekly_trend(rows, ts),
        "velocity": trends.velocity(rows, ts),
        "daily_fit": trends.daily_fit(rows, ts),
        "moving_average": trends.moving_average(trends.daily_prices(rows, ts)),
        # Changes first, the period afterwards: the price before the period counts.
        "price_changes": recent(price_changes(df, ts=ts, tiebreak=tiebreak), ts, days, as_of),
    }


def change_totals(df: DataFrame, days: int, as_of: datetime | str, ts: str, tiebreak: str = "id") -> DataFrame:
    """Price moves per source in a period: rises, falls and mean move, from the last price before each tick."""
    changes = recent(price_changes(df, ts=ts, tiebreak=tiebreak), ts, days, as_of)
    moves = changes.where(F.col("previous_price").isNotNull())
    move = F.col("price") - F.col("previous_price")
    return moves.groupBy("source").agg(
        F.count_if(move > 0).alias("rises"), F.count_if(move < 0).alias("falls"), F.avg(move).alias("mean_move")
    )


def price_comparison(df: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Mean price per keyword with one column per source, and the cheapest source."""
    wide = (
        df.where(F.col("search_keyword").isNotNull())
        .groupBy("search_keyword")
        .agg(*[F.avg(F.when(F.col("source") == s, F.col("price"))).alias(s) for s in sources])
    )
    offers = F.filter(
        F.array(*[F.struct(F.col(s).alias("price"), F.lit(s).alias("source")) for s in sources]),
        lambda o: o.price.isNotNull(),
    )
    return wide.withColumn("cheapest", F.array_min(offers).getField("source"))
