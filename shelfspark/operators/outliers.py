"""Outlier detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.quantiles import exact_quantiles
from shelfspark.operators.skew import first_n_per, join_group_table


def _with_group_values(df: DataFrame, values: DataFrame, keys: list[str], names: Sequence[str]) -> DataFrame:
    """Rows with the values of their group; ungrouped values are inlined as scalar subqueries."""
    if keys:
        return join_group_table(df, values, keys, "_n")
    packed = values.select(F.struct(*names)).scalar()
    return df.withColumns({name: packed.getField(name) for name in names})


def iqr_outliers(df: DataFrame, column: str = "price", k: float = 1.5, by: Sequence[str] = ()) -> DataFrame:
    """Rows outside [q1 - k IQR, q3 + k IQR] together with the bounds."""
    keys = list(by)
    rows = df.where(F.col(column).isNotNull())
    quartiles = exact_quantiles(rows, column, {"_q1": 0.25, "_q3": 0.75}, keys)
    if keys:
        quartiles = quartiles.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    iqr = F.col("_q3") - F.col("_q1")
    bounds = quartiles.withColumns(
        {"lower_bound": F.col("_q1") - k * iqr, "upper_bound": F.col("_q3") + k * iqr}
    ).drop("_q1", "_q3")
    flagged = _with_group_values(rows, bounds, keys, ("lower_bound", "upper_bound"))
    outside = (F.col(column) < F.col("lower_bound")) | (F.col(column) > F.col("upper_bound"))
    return flagged.where(outside).drop("_n")


def z_outliers(df: DataFrame, column: str = "price", threshold: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Rows more than ``threshold`` sample standard deviations from the mean; none when std is 0 or null."""
    keys = list(by)
    rows = df.where(F.col(column).isNotNull())
    moments = rows.groupBy(*keys).agg(
        F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_std"), F.count(F.lit(1)).alias("_n")
    )
    flagged = _with_group_values(rows, moments, keys, ("_mean", "_std"))
    z = F.try_divide(F.col(column) - F.col("_mean"), F.col("_std"))
    return flagged.withColumn("z_score", z).where(F.abs("z_score") > threshold).drop("_mean", "_std", "_n")


def outlier_summary(
    rows: DataFrame, outliers: DataFrame, column: str, order: Sequence[Column | str], sample: int = 10
) -> DataFrame:
    """Count, share of all non-null values in percent, and the first values in a stated order."""
    total = rows.agg(F.count(column)).scalar()
    first = outliers.orderBy(*order).limit(sample).select(F.col(column).alias("_v"), *order)
    values = first.agg(F.collect_list("_v").alias("v")).scalar()
    return outliers.agg(F.count(F.lit(1)).alias("count")).select(
        "count",
        F.coalesce(F.try_divide(F.col("count") * 100.0, total), F.lit(0.0)).alias("percentage"),
        values.alias("values"),
    )


def outlier_summary_by(
    rows: DataFrame, outliers: DataFrame, column: str, by: str, order: Sequence[Column | str], sample: int = 10
) -> DataFrame:
    """As :func:`outlier_summary`, per group; groups without outliers show a count of 0."""
    totals = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(column).alias("_total"))
    counts = outliers.groupBy(by).agg(F.count(F.lit(1)).alias("_count"))
    values = (
        first_n_per(outliers, [by], order, sample)
        .groupBy(by)
        .agg(F.array_sort(F.collect_list(column)).alias("values"))
    )
    count = F.coalesce("_count", F.lit(0))
    return totals.join(counts, by, "left").join(values, by, "left").select(
        by,
        count.alias("count"),
        F.coalesce(F.try_divide(count * 100.0, "_total"), F.lit(0.0)).alias("percentage"),
        "values",
    )
