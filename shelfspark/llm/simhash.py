"""SimHash fingerprints of word shingles, and near duplicates through deletion-variant signatures.

A fingerprint has 64 bits; each is 1 when more than half of the text's shingles, repeats included, have it set in their
hash. Fingerprints that differ in at most two bits link. Cut into two segments of 32 bits, two such fingerprints differ by at
most one bit in one of them. So each fingerprint is entered 64 times: for each segment and each place in it, under the
segment's other 31 bits. Linked fingerprints share such a signature: an equality join on it finds them, and the join condition verifies the
whole difference. A pair is taken at one signature only: the first segment that differs by at most one bit, and there
the place that differs, or place 0 when none does.

Equal fingerprints are one node from the start. A node has at most 2,080 others within two bits, so the links grow with the nodes.
The members of one signature are a few, unless many fingerprints agree in a whole segment. Segment values that more than
``crowd`` fingerprints have are told by a count beforehand, and their signatures are refined by the same rule instead: those equal in the
segment are joined by the segment and the one-wildcard variants of the halves of the other segment, those that differ there in one place by
the signature and either half of the other segment, which then differ in one bit in all, so one half is equal. Such a
key leaves 17 bits open, so at most 2^17 nodes can share it, whatever the data. Nothing is capped or dropped.

Links become components by rounds of smallest labels over stored tables. Texts are read once and never shuffled.

Cases. Null and empty texts, and texts without words, have fingerprint zero, which links like any other. Texts with fewer words
than a shingle are one shingle. Very long texts are hashed in pieces of ``PIECE`` words. Equal rows and ids give equal
results; ids may be null, and the component of rows with null ids only is null. Columns other than id and text are
ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from shelfspark.llm.common import stored
from shelfspark.llm.ngram_join import components
from shelfspark.operators.skew import join_group_table

PIECE = 500_000
CROWD = 256
#: Tables of at most so many crowded values (of one long each) are named to every task.
FEW = 100_000
SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SEGMENT = 0xFFFFFFFF


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every shingle of consecutive words, joined by a space; fewer words are one shingle."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    width = min(width, len(words))
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    parts = map(joined.__getitem__, map(slice, starts[: len(words) - width + 1].tolist(), stops[width - 1 :].tolist()))
    return np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=len(words) - width + 1)


def simhash(text: bytes | None, width: int, piece: int = PIECE) -> int:
    """The fingerprint, as a signed number of 64 bits."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and ASCII white space only
    counts, total = np.zeros(64, dtype=np.int64), 0
    for start in range(0, max(len(words) - width + 1, min(len(words), 1)), piece):
        hashes = shingle_hashes(words[start : start + piece + width - 1], width)
        total += len(hashes)
        rows = hashes.view(np.uint8).reshape(-1, 8)
        if len(rows) < 64:
            counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            for k in range(8):
                counts[8 * k : 8 * k + 8] += np.bincount(rows[:, k], minlength=256) @ _BITS
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t.as_py(), width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], ["id", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; the fingerprint is a signed long."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(width), "id long, fingerprint long")


def _segment_of(fingerprint: Column, segment: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, (segment * 32).cast("int")).bitwiseAND(F.lit(_SEGMENT))


def _without(value: Column, place: Column) -> Column:
    """The value with one bit deleted."""
    above = F.call_function("shiftleft", F.call_function("shiftrightunsigned", value, place + 1), place)
    return above.bitwiseOR(value.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place) - 1))


def _signature(segment: Column, place: Column, value: Column) -> Column:
    """One long: segment, place, and the bits left."""
    return segment.cast("long") * (1 << 36) + place.cast("long") * (1 << 31) + _without(value, place)


def signatures(nodes: DataFrame) -> DataFrame:
    """(signature, segment, place, fingerprint): 64 rows a node."""
    rows = nodes.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_k"))
    segment, place = F.floor(F.col("_k") / 32).cast("int"), F.pmod(F.col("_k"), F.lit(32))
    signature = _signature(segment, place, _segment_of(F.col("fingerprint"), segment))
    return rows.select(signature.alias("signature"), segment.alias("segment"), place.alias("place"), "fingerprint")


def _close(rows: DataFrame, keys: list[str], bits: int, taken) -> DataFrame:
    """(a, b), a < b, of fingerprints that share the keys and differ in at most ``bits`` bits, where ``taken(difference)``."""
    left, right = rows.alias("l"), rows.alias("r")
    a, b = F.col("l.fingerprint"), F.col("r.fingerprint")
    differ = a.bitwiseXOR(b)
    same = F.lit(True)
    for key in keys:
        same = same & (F.col(f"l.{key}") == F.col(f"r.{key}"))
    joined = left.join(right.hint("merge"), same & (a < b) & (F.bit_count(differ) <= bits) & taken(differ))
    return joined.select(a.alias("a"), b.alias("b"))


def _in_segment(differ: Column, segment: Column) -> Column:
    return _segment_of(differ, segment)


def crowded_signatures(nodes: DataFrame, crowd: int) -> DataFrame | None:
    """Signatures of the segment values that more than ``crowd`` fingerprints have; None when there are none."""
    values = nodes.select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), _segment_of(F.col("fingerprint"), F.lit(s)).alias("value")) for s in (0, 1)])).alias("v")
    ).select("v.*")
    counts = values.groupBy("segment", "value").count().where(F.col("count") > crowd)
    places = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("place")
    named = counts.select("segment", "value", places).select(_signature(F.col("segment"), F.col("place"), F.col("value")).alias("signature"))
    found = stored(named.distinct(), "crowded")
    return None if found.isEmpty() else found


def refined(crowded: DataFrame, bits: int) -> DataFrame:
    """Pairs within the crowded signatures, through a second signature over the other segment."""
    segment = F.col("segment")
    own = _segment_of(F.col("fingerprint"), segment)
    other = _segment_of(F.col("fingerprint"), 1 - segment)
    half = lambda k: F.call_function("shiftrightunsigned", other, (k * 16).cast("int")).bitwiseAND(F.lit(0xFFFF))
    # Equal in the segment: up to two bits in the other, so at most one in either half of it.
    equal = crowded.where("place = 0").select(
        "segment", own.alias("value"), "fingerprint", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("_k"), other.alias("_other")
    )
    part, place = F.floor(F.col("_k") / 16).cast("int"), F.pmod(F.col("_k"), F.lit(16))
    bits_of_part = F.call_function("shiftrightunsigned", F.col("_other"), (part * 16).cast("int")).bitwiseAND(F.lit(0xFFFF))
    equal = equal.select("segment", "value", "fingerprint", (F.col("_k").cast("long") * (1 << 16) + _without(bits_of_part, place)).alias("finer"))
    found = _close(equal, ["segment", "value", "finer"], bits, lambda d: F.lit(True))
    # Different in one place of the segment: up to one bit in the other, so one half of it is equal.
    apart = crowded.select("signature", "segment", "fingerprint", F.explode(F.array(*[half(F.lit(k)) + (k << 16) for k in (0, 1)])).alias("finer"))
    return found.unionByName(_close(apart, ["signature", "finer"], bits, lambda d: _in_segment(d, F.col("l.segment")) != 0))


def links(nodes: DataFrame, bits: int = 2, crowd: int = CROWD, few: int = FEW) -> DataFrame:
    """(a, b) of the different fingerprints in ``nodes`` that differ in at most ``bits`` bits, at most two."""
    if not 0 <= bits <= 2:
        raise ValueError("two segments with one wildcard find up to two bits")
    rows = signatures(nodes)
    crowded = crowded_signatures(nodes, crowd)
    if crowded is not None:
        named = F.broadcast(crowded) if crowded.count() <= few else crowded.hint("shuffle_hash")
        extra = refined(rows.join(named, "signature", "left_semi"), bits)
        rows = rows.join(named, "signature", "left_anti")

    def first_place(differ: Column) -> Column:
        in_segment = _in_segment(differ, F.col("l.segment"))
        first = (F.col("l.segment") == 0) | (F.bit_count(_in_segment(differ, F.lit(0))) > 1)
        return first & ((in_segment != 0) | (F.col("l.place") == 0))

    found = _close(rows, ["signature"], bits, first_place)
    return found if crowded is None else found.unionByName(extra).distinct()


def simhash_components(
    docs: DataFrame, width: int = 3, bits: int = 2, id_column: str = "doc_id", text: str = "text", crowd: int = CROWD, few: int = FEW
) -> DataFrame:
    """id, fingerprint (signed long), component_id (smallest id reachable, itself included) and ``component``, the smallest
    fingerprint reachable, which names the component also where ids are null."""
    rows = stored(fingerprints(docs, width, id_column, text), "fingerprints")
    nodes = stored(rows.groupBy("fingerprint").agg(F.min("id").alias("lowest"), F.count(F.lit(1)).alias("copies")), "nodes")
    labels = components(stored(links(nodes, bits, crowd, few), "links"))
    placed = nodes.join(labels, F.col("fingerprint") == F.col("node"), "left").withColumn("component", F.coalesce("label", "fingerprint"))
    lowest = placed.groupBy("component").agg(F.min("lowest").alias("component_id"))
    named = placed.select("fingerprint", "copies", "component").join(lowest, "component")
    found = join_group_table(rows, named, ["fingerprint"], "copies")
    return found.select(F.col("id").alias(id_column), "fingerprint", "component_id", "component")
