"""Handling of groups that hold a large share of all rows.

A group is *hot* when it holds more than ``1 / HOT_SHARE`` of the rows. At most ``HOT_SHARE`` groups can be
hot, which is the proven bound under which a table of hot groups is broadcast; a group that is not hot is small
enough for one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import checkpointed

HOT_SHARE = 100_000
HOT_FLOOR_ROWS = 2_000_000


def hot_groups(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[Column] = (),
    share: int = HOT_SHARE,
    floor_rows: int = HOT_FLOOR_ROWS,
) -> DataFrame | None:
    """Stored table of the hot groups (keys, group_rows, measures), or None when there is none.

    Groups of fewer than ``floor_rows`` rows fit one task and never count as hot.
    """
    total = df.count()
    if total <= floor_rows:
        return None
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"), *measures)
    hot = checkpointed(sizes.where(F.col("group_rows") > max(floor_rows, total // share)))
    return None if hot.isEmpty() else hot


def join_group_table(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], size_column: str, how: str = "inner"
) -> DataFrame:
    """Join of rows with one-row-per-group values, inner or left, safe when one group holds most rows.

    Hot groups, at most ``HOT_SHARE`` of them, are broadcast; their rows are never shuffled. The
    other groups are small and go through an ordinary join on the keys.
    """
    keys = list(keys)
    stored = checkpointed(groups)
    total = stored.agg(F.sum(size_column)).scalar()
    is_hot = F.col(size_column) * HOT_SHARE > total
    cold = stored.where(~is_hot)
    if cold.isEmpty():
        return rows.join(F.broadcast(stored), keys, how)
    hot = stored.where(is_hot)
    hot_rows = rows.join(F.broadcast(hot), keys)
    cold_rows = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return hot_rows.unionByName(cold_rows)


def first_n_per(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """First ``n`` rows of every group in a stated order.

    Spark limits each group inside the map tasks before the shuffle, so a hot group sends at most ``n``
    rows per task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One whole row per key: the one with the smallest (or largest) ``order`` values.

    An aggregate rather than a ranking window: each task first reduces its own rows to one per key, so
    copies of one key never meet in one task.
    """
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    pick = (F.max_by if last else F.min_by)(F.struct(*others), rank)
    return (
        df.groupBy(*keys)
        .agg(pick.alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])
        .select(*df.columns)
    )
