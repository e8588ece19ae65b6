"""Daily and weekly trends. Windows run over rows already reduced to one per day or week."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.numbers import round_even
from shelfspark.functions.times import week_end
from shelfspark.operators.quantiles import exact_quantiles


def daily_trend(df: DataFrame, ts: str = "scraped_at", digits: int | None = 2) -> DataFrame:
    """Price count, mean, median and distinct sources per day."""
    rows = df.where(F.col(ts).isNotNull()).select(F.to_date(ts).alias("day"), "price", "source")
    daily = rows.groupBy("day").agg(
        F.count("price").alias("price_count"),
        round_even(F.avg("price"), digits).alias("price_mean"),
        F.count_distinct("source").alias("sources"),
    )
    medians = exact_quantiles(rows, "price", {"_m": 0.5}, ["day"])
    return daily.join(medians, "day", "left").select(
        "day", "price_count", "price_mean", round_even(F.col("_m"), digits).alias("price_median"), "sources"
    )


def weekly_mean(df: DataFrame, ts: str = "scraped_at") -> DataFrame:
    """Mean price per week; weeks are named by the Sunday that ends them."""
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(week_end(F.col(ts)).alias("week"))
        .agg(F.avg("price").alias("mean_price"))
    )


def weekly_trend(df: DataFrame, ts: str = "scraped_at") -> DataFrame:
    """Slope of the weekly means per calendar week, and its direction.

    Weeks without rows keep their place on the axis but add no point. Fewer than two weeks are stable.
    """
    weekly = weekly_mean(df, ts).where(F.col("mean_price").isNotNull())
    first = weekly.agg(F.min("week")).scalar()
    indexed = weekly.withColumn("_x", F.datediff("week", first) / 7)
    slope = F.regr_slope("mean_price", "_x")
    one = indexed.agg(F.count(F.lit(1)).alias("weeks"), slope.alias("_slope"))
    several = F.col("weeks") > 1
    return one.select(
        "weeks",
        F.when(several, F.col("_slope")).otherwise(F.lit(0.0)).alias("trend_slope"),
        F.when(~several, "stable")
        .when(F.col("_slope") > 0, "increasing")
        .otherwise("decreasing")
        .alias("trend_direction"),
    )


def daily_counts(df: DataFrame, ts: str = "scraped_at") -> DataFrame:
    return (
        df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    )


def velocity(df: DataFrame, ts: str = "scraped_at") -> DataFrame:
    """Mean and largest number of rows per day, and the number of days with rows."""
    return daily_counts(df, ts).agg(
        F.avg("n").alias("avg_products_per_day"),
        F.max("n").alias("max_products_per_day"),
        F.count(F.lit(1)).alias("total_collection_days"),
    )


def daily_fit(df: DataFrame, ts: str = "scraped_at") -> DataFrame:
    """Rows per day with the least-squares line over the ordinal of the days present."""
    numbered = daily_counts(df, ts).withColumn("x", F.row_number().over(Window.orderBy("day")) - 1)
    line = numbered.agg(
        F.struct(F.regr_slope("n", "x").alias("slope"), F.regr_intercept("n", "x").alias("intercept"))
    ).scalar()
    slope, intercept = line.getField("slope"), line.getField("intercept")
    return numbered.select(
        "day", "n", slope.alias("slope"), (intercept + slope * F.col("x")).alias("fitted")
    )


def daily_prices(df: DataFrame, ts: str = "scraped_at", by: str = "source") -> DataFrame:
    """Mean price and rows per source and day."""
    return (
        df.where(F.col("price").isNotNull() & F.col(by).isNotNull() & F.col(ts).isNotNull())
        .groupBy(by, F.to_date(ts).alias("day"))
        .agg(F.avg("price").alias("mean_price"), F.count(F.lit(1)).alias("n"))
    )


# Lengths in days of the moving averages.
TREND_PERIODS = (7, 14, 30, 90)


def moving_average(daily: DataFrame, days: Sequence[int] = TREND_PERIODS, by: str = "source") -> DataFrame:
    """Moving means of the daily mean price over the last n calendar days, per source."""
    number = F.unix_date("day")
    windows = {
        f"mean_{n}d": F.avg("mean_price").over(Window.partitionBy(by).orderBy(number).rangeBetween(-(n - 1), 0))
        for n in days
    }
    return daily.withColumns(windows)
