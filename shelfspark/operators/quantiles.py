"""Exact quantiles without holding a group's values in one task.

The built-in exact percentile keeps every distinct value of a group in one aggregation buffer. Here the
values are counted first (one evenly hashed shuffle of distinct values). Each value falls into a narrow relative
bin; bins that contain a wanted rank are cut once more into equal parts; and only the parts that contain a wanted rank
are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_OCTAVE = 256
PARTS_PER_BIN = 4096


def _bin(value: Column) -> Column:
    """Monotone bin number of about 0.3 % relative width; depends on the value alone."""
    return F.floor(F.signum(value) * F.log2(1 + F.abs(value)) * BINS_PER_OCTAVE)


def _rank_ends(rows: Column, probability: float) -> tuple[Column, Column, Column]:
    position = (rows - 1) * F.lit(float(probability))
    low = F.floor(position)
    return low, F.ceil(position), position - low


def _holds(rank: Column, start: Column, rows: Column) -> Column:
    return (rank >= start) & (rank < start + rows)


def _narrow(
    values: DataFrame, keys: list[str], cell: str, probabilities: Sequence[float], one_group: bool
) -> DataFrame:
    """Values of the cells that hold a wanted rank, with the rows of the group and those before the cell.

    ``values`` has the keys, the cell number, _v and _c, and from an earlier call _rows and _before.
    """
    within = Window.partitionBy(*keys)
    earlier = "_rows" in values.columns
    cells = values.groupBy(*keys, cell).agg(
        F.sum("_c").alias("_cell_rows"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
        *([F.max("_rows").alias("_rows"), F.max("_before").alias("_base")] if earlier else []),
    )
    running = F.sum("_cell_rows").over(within.orderBy(cell).rowsBetween(Window.unboundedPreceding, 0))
    placed = cells.withColumns(
        {
            "_rows": F.col("_rows") if earlier else F.sum("_cell_rows").over(within),
            "_before": running - F.col("_cell_rows") + (F.col("_base") if earlier else F.lit(0)),
        }
    )
    wanted = F.lit(False)
    for p in probabilities:
        low, high, _ = _rank_ends(F.col("_rows"), p)
        for rank in (low, high):
            wanted = wanted | _holds(rank, F.col("_before"), F.col("_cell_rows"))
    target = placed.where(wanted).select(*keys, cell, "_rows", "_before", "_low", "_high")
    if one_group:
        # At most two cells per probability.
        target = F.broadcast(target)
    return values.select(*keys, cell, "_v", "_c").join(target, [*keys, cell])


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated quantiles of the present values, one row per group.

    ``probabilities`` maps output column names to probabilities. Null group keys drop out.
    """
    keys = list(by)
    wanted = list(probabilities.values())
    number = F.col(value).cast("double")
    counted = (
        df.where(number.isNotNull() & ~F.isnan(number) & _all_present(keys))
        .groupBy(*keys, number.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_bin", _bin(F.col("_v")))
        # States what the join implies, so that both uses have one plan and share one shuffle.
        .where(F.col("_bin").isNotNull())
    )
    in_bins = _narrow(counted, keys, "_bin", wanted, not keys)
    share = F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low"))
    cut = in_bins.withColumn("_part", F.coalesce(F.floor(share * PARTS_PER_BIN), F.lit(0)))
    in_parts = _narrow(cut, [*keys, "_bin"], "_part", wanted, not keys)
    running = Window.partitionBy(*keys, "_bin", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = in_parts.withColumn("_start", F.col("_before") + F.sum("_c").over(running) - F.col("_c"))
    picks = []
    outputs = []
    for i, (name, p) in enumerate(probabilities.items()):
        low, high, fraction = _rank_ends(F.col("_rows"), p)
        for end, rank in (("lo", low), ("hi", high)):
            picks.append(F.max(F.when(_holds(rank, F.col("_start"), F.col("_c")), F.col("_v"))).alias(f"_{end}{i}"))
        outputs.append(
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * fraction).alias(name)
        )
    return ranked.groupBy(*keys).agg(F.max("_rows").alias("_rows"), *picks).select(*keys, *outputs)


def approximate_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = (), accuracy: int = 10_000
) -> DataFrame:
    """Sketch-based variant: one pass, rank error of at most rows / accuracy."""
    keys = list(by)
    wanted = list(probabilities.items())
    sketch = F.approx_percentile(value, [float(p) for _, p in wanted], accuracy)
    grouped = df.where(_all_present(keys)).groupBy(*keys).agg(sketch.alias("_q"))
    return grouped.select(*keys, *[F.col("_q")[i].alias(name) for i, (name, _) in enumerate(wanted)])


def _all_present(keys: Sequence[str]) -> Column:
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return present
