"""Shards along a Hilbert curve over several metadata dimensions, with DataFrame functions only.

Each dimension is quantised to ``2 ** bits`` steps of about equal numbers of rows, the steps of a row give its place on
the curve, and the curve is cut into runs of about equal bytes. Rows near each other in every dimension land
in the same files, so that filters on any of the dimensions skip most of them.

Cases. Null texts have size 1; null dimension values come first in their dimension. Rows of one curve cell are ordered
by a hash of id and text; equal rows are interchangeable. A cell of any size is cut into runs of ``run_rows`` rows, so no
task holds a whole cell. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import global_rank, stored


def cut_points(df: DataFrame, column: str, bits: int) -> list:
    """At most ``2 ** bits - 1`` values at which a new step begins, from exact counts of the column's values."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ranked = stored(global_rank(counts, [F.col(column).isNotNull(), F.col(column)], "place"), "dimension")
    # Running counts over the ranks: within ranges of ranks first, then over the ranges' sums.
    block = F.floor(F.col("place") / 10_000)
    sums = ranked.groupBy(block.alias("block")).agg(F.sum("n").alias("block_n"))
    before = F.sum("block_n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("block_before", F.coalesce(before, F.lit(0)))
    running = ranked.withColumn("block", block).withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, "block")
    middle = F.col("block_before") + F.col("inside") + F.col("n") / 2
    total = ranked.agg(F.sum("n")).first()[0] or 1
    step = F.least(F.floor(middle * 2**bits / total), F.lit(2**bits - 1))
    firsts = running.where(F.col(column).isNotNull()).groupBy(step.alias("step")).agg(F.min(column).alias("first"))
    return sorted(r["first"] for r in firsts.collect())[:]  # one row per step


def curve_place(steps: Sequence[Column], bits: int) -> Column:
    """Place of a cell on the Hilbert curve through ``2 ** bits`` steps in each dimension.

    The axes are transformed level by level (inverse undo of the excess work of the Gray code), then encoded and their
    bits interleaved. Meant for the distinct cells, of which there are at most ``2 ** (bits * dimensions)``.
    """
    n = len(steps)
    start = F.array(*[s.cast("long") for s in steps])
    levels = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]
    plan = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in levels])

    def turn(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low = q - 1
        first, own = F.element_at(x, 1), F.element_at(x, i + 1)
        inverted = own.bitwiseAND(q) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        new_first = F.when(inverted, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        new_own = F.when(inverted | (i == 0), own).otherwise(own.bitwiseXOR(swap))
        return F.transform(x, lambda v, k: F.when(k == 0, new_first).when(k == i, new_own).otherwise(v))

    turned = F.aggregate(plan, start, turn)
    # Gray code along the axes: each axis is combined with those before it.
    gray = F.aggregate(
        turned, F.array().cast("array<long>"),
        lambda done, v: F.concat(done, F.array(F.when(F.size(done) > 0, v.bitwiseXOR(F.element_at(done, -1))).otherwise(v))),
    )
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)] or [F.lit(0).cast("long")])
    fold = F.aggregate(
        masks, F.lit(0).cast("long"),
        lambda t, q: F.when(F.element_at(gray, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
    )
    axes = F.transform(gray, lambda v: v.bitwiseXOR(fold))
    powers = F.array(*[F.lit(1 << b).cast("long") for b in range(bits)])
    order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    bit_of = F.transform(order, lambda o: F.element_at(axes, o["i"] + 1).bitwiseAND(F.element_at(powers, o["b"] + 1)))
    return F.aggregate(bit_of, F.lit(0).cast("long"), lambda place, bit: place * 2 + (bit != 0).cast("long"))


def quantised(column: Column, cuts: Sequence) -> Column:
    """Number of cut points at or below the value; null is step 0."""
    steps = [F.coalesce((column >= F.lit(c)).cast("int"), F.lit(0)) for c in cuts[1:]]
    return sum(steps[1:], steps[0]) if steps else F.lit(0)


def shard_by_curve(
    docs: DataFrame,
    dimensions: Sequence[str] = ("source", "lang", "size"),
    shards: int = 8,
    bits: int = 4,
    id_column: str = "doc_id",
    run_rows: int = 50_000,
) -> DataFrame:
    """id, size, text_crc32, the dimensions' curve place, shard and slot of every row.

    The law is ``bytes``: the curve is cut where the bytes before a row pass a multiple of total / shards, so the sizes
    of the shards differ by less than two documents. The dimension ``size`` is the binary logarithm of the size.
    """
    text = F.col("text").cast("binary")
    base = docs.select(
        F.col(id_column).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.crc32(F.lit(b""))).alias("text_crc32"),
        *[F.col(d).alias(f"dim_{d}") for d in dimensions if d != "size"],
    ).withColumn("dim_size", F.floor(F.log2(F.col("size")) * 4))
    base = stored(base, "shard-meta")
    names = [f"step_{i}" for i in range(len(dimensions))]
    cuts = [quantised(F.col(f"dim_{d}"), cut_points(base, f"dim_{d}", bits)) for d in dimensions]
    placed = base.select("id", "size", "text_crc32", *[c.cast("int").alias(n) for n, c in zip(names, cuts, strict=True)])
    placed = placed.withColumn("mark", F.xxhash64("id", "text_crc32", "size"))
    # At most 2 ** (bits * dimensions) cells, 4096 by default: the bound for the broadcast and for the running sums.
    cells = placed.groupBy(*names).agg(F.sum("size").alias("cell_bytes"), F.count(F.lit(1)).alias("cell_rows"))
    cells = stored(cells, "cells").withColumn("cell", curve_place([F.col(n) for n in names], bits))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({
        "bytes_0": F.coalesce(F.sum("cell_bytes").over(before), F.lit(0)),
        "rows_0": F.coalesce(F.sum("cell_rows").over(before), F.lit(0)),
        "cuts": F.ceil(F.col("cell_rows") / run_rows),
    }).drop("cell_bytes", "cell_rows")
    cells = stored(cells, "cell-starts")
    unsigned = F.shiftrightunsigned("mark", 32)
    rows = placed.join(F.broadcast(cells), names).withColumn("run", F.floor(unsigned * F.col("cuts") / float(1 << 32)))
    sums = rows.groupBy("cell", "run").agg(F.sum("size").alias("run_bytes"), F.count(F.lit(1)).alias("run_rows"))
    before = Window.partitionBy("cell").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = sums.select(
        "cell", "run",
        F.coalesce(F.sum("run_bytes").over(before), F.lit(0)).alias("bytes_1"),
        F.coalesce(F.sum("run_rows").over(before), F.lit(0)).alias("rows_1"),
    )
    order = Window.partitionBy("cell", "run").orderBy("mark", "id", "text_crc32", "size")
    bytes_2 = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = base.agg(F.sum("size")).first()[0] or 1
    ordered = rows.withColumns({"bytes_2": bytes_2, "rows_2": F.row_number().over(order) - 1}).join(runs, ["cell", "run"])
    ordered = ordered.select(
        "id", "size", "text_crc32", "cell",
        F.expr(f"int((bytes_0 + bytes_1 + bytes_2) * {shards} div {total})").alias("shard"),
        (F.col("rows_0") + F.col("rows_1") + F.col("rows_2")).alias("place"),
    )
    ordered = stored(ordered, "shard-order")
    firsts = ordered.groupBy("shard").agg(F.min("place").alias("first"))  # one row per shard
    return ordered.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_column), "size", "text_crc32", F.col("cell").alias("curve_place"), "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Rows of ``docs`` as Parquet, a folder per shard, in curve order within each file."""
    places = shards.select(F.col(id_column).alias("_id"), "shard", "slot")
    rows = docs.join(places, F.col(id_column).eqNullSafe(F.col("_id"))).drop("_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
