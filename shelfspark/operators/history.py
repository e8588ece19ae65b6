"""Price history: first sighting and every change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.skew import HOT_FLOOR_ROWS, HOT_SHARE, hot_groups
from shelfspark.session import checkpointed

# Rows a slice of hot products should hold at most; half of them are aimed at, as slices are drawn from a sample.
SLICE_ROWS = 2_000_000


def split_null_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a complete key, and rejects with the reason."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return df.where(~missing), df.where(missing).withColumn("reason", F.lit("null key"))


def price_changes(
    ticks: DataFrame,
    keys: Sequence[str] = ("source", "product_id"),
    ts: str = "recorded_at",
    tiebreak: str = "id",
    hot_share: int = HOT_SHARE,
    hot_floor: int = HOT_FLOOR_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Ticks whose price differs from the previous non-null price of the same product.

    Null prices are neither recorded nor a change; rows with a null key go elsewhere (split_null_keys).
    Products that hold a large share of all ticks are cut into slices by rank, which compare separately; ticks of one
    instant may lie in several slices.
    """
    keys = list(keys)
    rows, _ = split_null_keys(ticks.where(F.col("price").isNotNull()), keys)
    hot = hot_groups(rows, keys, share=hot_share, floor_rows=hot_floor)
    if hot is None:
        changes = _changes_in_window(rows, keys, ts, tiebreak)
    else:
        # At most hot_share keys.
        names = F.broadcast(hot.select(*keys))
        count = max(2, -(-2 * hot.agg(F.sum("group_rows")).first()[0] // slice_rows))
        slices = rank_slices(rows.join(names, keys, "left_semi"), count, [*keys, ts, tiebreak])
        cold = _changes_in_window(rows.join(names, keys, "left_anti"), keys, ts, tiebreak)
        changes = cold.unionByName(_changes_in_slices(slices, count, keys, ts, tiebreak))
    return changes.where(F.col("previous_price").isNull() | (F.col("price") != F.col("previous_price")))


def _changes_in_window(rows: DataFrame, keys: list[str], ts: str, tiebreak: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(ts, tiebreak)
    return rows.withColumn("previous_price", F.lag("price").over(order))


def rank_slices(rows: DataFrame, count: int, order: Sequence[str]) -> DataFrame:
    """The rows with ``_slice``, 0 to ``count`` - 1: ranges of the order, alike in size as far as a sample of it tells.

    The numbers depend on the sample, so the rows are stored with them.
    """
    return checkpointed(rows.repartitionByRange(count, *order).withColumn("_slice", F.spark_partition_id()))


def _changes_in_slices(slices: DataFrame, count: int, keys: list[str], ts: str, tiebreak: str) -> DataFrame:
    """Previous price inside each slice; the first row of a product in a slice takes the last one of the slice before."""
    # One task a slice; the windows and the ends below need no other arrangement.
    sliced = slices.repartitionByRange(count, "_slice")
    ends = slices.groupBy("_slice", *keys).agg(F.max_by("price", F.struct(F.col(ts), F.col(tiebreak))).alias("_last"))
    carried = ends.select("_slice", *keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carried"))
    inside = Window.partitionBy("_slice", *keys).orderBy(ts, tiebreak)
    # At most as many ends as slices and hot products together.
    return (
        sliced.withColumn("_before", F.lag("price").over(inside))
        .join(F.broadcast(carried), ["_slice", *keys])
        .withColumn("previous_price", F.coalesce("_before", "_carried"))
        .drop("_slice", "_before", "_carried")
    )
