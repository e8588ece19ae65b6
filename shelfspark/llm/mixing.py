"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words. A document of the source should be taken ``target / source words`` times
on average; the whole part of that is taken outright, the fraction is a probability. Probabilities are made integral in
pairs: a random amount of words moves from one document to the other, such that the expected words of both stay, their
sum stays exactly, and at least one of the two becomes 0 or 1. What is left undecided in one leaf (a slice of a source,
by hash) is paired again further up a reduction tree, so that at most one document per source is decided by a
coin of its own: the words taken miss the target by less than the size of one document.

Cases. Null text has size 0. A null source is a source of its own, ranked last. Rows equal in id, source and size are
one unit and are taken equally often. Documents without words are decided alone, as they move no words. An empty table
gives an empty result. Other columns are ignored by the plan and kept by ``mix_sources``; none of them can clash, as the
working columns are chosen from id, source and text before any other is made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import global_rank, stored, word_count

FAN_IN = 16
_UNIT = "id string, source string, size long, n long, p double, leaf long, place long, done boolean"
_OUT = pa.schema(
    [("id", pa.string()), ("source", pa.string()), ("size", pa.int64()), ("n", pa.int64()), ("p", pa.float64())]
    + [("leaf", pa.int64()), ("place", pa.int64()), ("done", pa.bool_())]
)


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """Target words per source, from a table (source, source_size): ``share`` of all words in proportion to the weights.

    Sources by code point, null last, take the weights in turn. No target exceeds ``max_repeats`` times its source's
    size; the excess goes to the others by weight until none is above. Each round is one aggregate over the sources.
    """
    places = global_rank(sizes, [F.col("source").isNull(), F.col("source")], "place")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(places.withColumn("weight", turn).withColumn("cap", F.col("source_size") * max_repeats), "targets")
    full = F.col("cap") / F.col("weight")  # the level at which a source is full
    budget = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        below = full < level
        sums = rows.agg(F.sum(F.when(below, F.col("cap"))), F.sum(F.when(~below, F.col("weight")))).first()
        if not sums[1]:
            return rows.select("source", "source_size", F.col("cap").cast("double").alias("target"))
        raised = (budget - (sums[0] or 0)) / sums[1]
        if raised <= level:
            target = F.least(F.col("cap").cast("double"), F.col("weight") * level)
            return rows.select("source", "source_size", target.alias("target"))
        level = raised


def _coin(seed: int, *parts) -> float:
    return xxhash.xxh64_intdigest("|".join(map(str, (seed, *parts)))) / 2.0**64


def _pivot(seed: int, level: int, last: bool):
    """Streams rows sorted by (source, leaf) and decides all of a leaf but one; the last level decides that one too."""

    def settle(row: list) -> list:
        row[4], row[7] = float(_coin(seed, "end", row[0], row[1], row[2], row[6]) < row[4]), True
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = list(row)
                mass = row[2] * row[3]
                if row[4] <= 0.0 or mass == 0:
                    out.append(settle(row))
                    continue
                if held is None or held[1] != row[1] or held[5] != row[5]:
                    if held is not None:
                        out.append(settle(held) if last else held)
                    held = row
                    continue
                other = held[2] * held[3]
                up = min((1 - held[4]) * other, row[4] * mass)  # words that may move to the one held
                down = min(held[4] * other, (1 - row[4]) * mass)  # words that may move away from it
                if _coin(seed, level, held[0], row[0], held[6], row[6]) * (up + down) < down:
                    held_full, row_full = up >= (1 - held[4]) * other, up >= row[4] * mass
                    held[4] = 1.0 if held_full else held[4] + up / other
                    row[4] = 0.0 if row_full else row[4] - up / mass
                else:
                    held_empty, row_full = down >= held[4] * other, down >= (1 - row[4]) * mass
                    held[4] = 0.0 if held_empty else held[4] - down / other
                    row[4] = 1.0 if row_full else row[4] + down / mass
                free = []
                for one in (held, row):
                    if 0.0 < one[4] < 1.0:
                        free.append(one)
                    else:
                        one[7] = True
                        out.append(one)
                held = free[0] if free else None
            if out:
                yield _batch(out)
        if held is not None:
            yield _batch([settle(held) if last else held])

    return run


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)], schema=_OUT)


def mix_plan(
    units: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    max_repeats: int = 2,
    seed: int = 7,
    leaf_rows: int = 50_000,
) -> DataFrame:
    """How often each unit is taken. ``units``: (id string, source, size long), any number of equal rows.

    Returns id, source, size, n (equal rows), source_size, target, copies. The draw depends on the rows and the seed
    only, never on how they are dealt out. ``leaf_rows`` sets the number of leaves, at least 16 * 16.
    """
    same = units.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    same = stored(same, "units")
    sizes = same.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, max_repeats), "source-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    few = targets.count() <= 100_000  # a row of a source has a few dozen bytes
    joined = _with_targets(same, targets, few)
    whole = F.floor(ratio + 1e-9)
    leaves, rows = FAN_IN * FAN_IN, same.count()
    while leaves * leaf_rows < rows:
        leaves *= FAN_IN
    place = F.xxhash64(F.lit(seed), "id", "size")
    part = F.greatest(F.lit(0.0), ratio - whole)
    rest = joined.select(
        "id", "source", "size", "n", F.when(part > 1e-9, part).otherwise(0.0).alias("p"),
        F.pmod(place, F.lit(leaves)).alias("leaf"), place.alias("place"), F.lit(False).alias("done"),
    )
    decided, level = None, 0
    while True:
        last = leaves == 1
        dealt = rest.repartition("source", "leaf").sortWithinPartitions("source", "leaf", "place", "id", "size")
        step = stored(dealt.mapInArrow(_pivot(seed, level, last), _UNIT), f"mix-level{level}")
        settled = step.where("done")
        decided = settled if decided is None else decided.unionByName(settled)
        if last:
            break
        leaves, level = leaves // FAN_IN, level + 1
        rest = step.where("not done").withColumn("leaf", F.floor(F.col("leaf") / FAN_IN))
    picked = decided.select("id", "source", "size", "n", F.col("p").cast("long").alias("picked"))
    return _with_targets(picked, targets, few).select(
        "id", "source", "size", "n", "source_size", "target", (whole + F.col("picked")).cast("long").alias("copies")
    )


def _with_targets(rows: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    named = targets.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def as_units(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", size: Column | None = None) -> DataFrame:
    size = word_count(F.col("text")) if size is None else size
    return docs.select(F.col(id_column).cast("string").alias("id"), F.col(source_column).cast("string").alias("source"), size.alias("size"))


def mix_sources(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the plan takes it, with the columns of ``docs`` only."""
    plan = mix_plan(as_units(docs, id_column, source_column), **options).where("copies > 0")
    plan = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in ("id", "source", "size", "copies")])
    same = (
        docs[id_column].cast("string").eqNullSafe(F.col("_mix_id"))
        & docs[source_column].cast("string").eqNullSafe(F.col("_mix_source"))
        & word_count(docs["text"]).eqNullSafe(F.col("_mix_size"))
    )
    rows = docs.join(plan.hint("shuffle_hash"), same)
    return rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[docs[c] for c in docs.columns])
