"""Substring deduplication with a count-min prefilter.

A window is ``width`` consecutive words of one document. Words covered by a window that also starts in a document with
a smaller id are removed. Three passes over the texts:

1. Every task counts its windows in a count-min sketch of two rows whose cells saturate at two; the sketches travel in
   compressed segments, each segment is merged by one task. A merged cell never underestimates.
2. Only windows whose cells all reached two are looked at again. Inside a batch, all but the smallest document of a
   window are settled at once, so a window that starts in very many documents sends one row per batch. The rest is
   dealt by window and sorted; the first document of each window stays, the others lose the window.
3. The removed stretches of each document are merged and applied to its text.

The sketch has about four cells per window, up to ``max_cells`` per row (64 MB a row by default): beyond that, windows are
still never lost, but more unique ones pass the prefilter and are grouped exactly.

Cases. Null texts have no words. Documents of fewer than ``width`` words lose nothing. Rows that repeat an id do not
remove each other's words. Null ids rank behind all others, not before one another. A window repeated inside one
document removes nothing there. Empty tables give an empty result. Extra columns are ignored. Ids must be integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import mix64, stored, window_hashes, word_hashes

SEGMENT = 1 << 22
ROWS = 2
_LAST_ID = np.iinfo(np.int64).max
_SECOND = 0xD6E8FEB86659FD93


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    spread = hashes if row == 0 else mix64(hashes ^ np.uint64(_SECOND * row % 2**64))
    return (spread >> np.uint64(64 - bits)).astype(np.uint32)


def _pack(cells: np.ndarray, segment: int, size: int) -> bytes:
    flags = np.zeros(size, dtype=bool)
    flags[cells - np.uint32(segment * size)] = True
    return zstandard.compress(np.packbits(flags, bitorder="little").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=np.uint8)


def _sketch(bits: int, width: int, flush: int = 2_000_000):
    """Segments of the sketch of a task's windows: cells reached once or more, and twice or more."""
    size = min(SEGMENT, 1 << bits)

    def segments(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(held)
        for row in range(ROWS):
            cells = np.sort(_cells(hashes, row, bits))
            first = np.concatenate([[True], cells[1:] != cells[:-1]])
            second = ~first & np.concatenate([[False], first[:-1]])
            once, twice = cells[first], cells[second]
            edges = np.arange(0, (1 << bits) + 1, size, dtype=np.int64)
            a, b = np.searchsorted(once, edges), np.searchsorted(twice, edges)
            out = [
                (row, s, _pack(once[a[s] : a[s + 1]], s, size), _pack(twice[b[s] : b[s + 1]], s, size))
                for s in range(len(edges) - 1)
                if a[s] < a[s + 1]
            ]
            if out:
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("row", "segment", "once", "twice"), r, strict=True)) for r in out],
                    schema=pa.schema([("row", pa.int32()), ("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]),
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for text in batch.column("text"):
                data = text.as_py()
                if data:
                    windows = window_hashes(word_hashes(data.split()), width)
                    held.append(windows)
                    n += len(windows)
                    if n >= flush:
                        yield from segments(held)
                        held, n = [], 0
        if n:
            yield from segments(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the sorted segments; gives back, per segment, the cells that reached two."""
    key, once, twice = None, None, None

    def done() -> pa.RecordBatch:
        packed = zstandard.compress(twice.tobytes(), 3)
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()) for k in key] + [pa.array([packed])], ["row", "segment", "twice"])

    for batch in batches:
        for row, segment, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = _unpack(a), _unpack(b)
            if key != (row, segment):
                if key is not None:
                    yield done()
                key, once, twice = (row, segment), a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if key is not None:
        yield done()


class Repeated:
    """The merged sketch: tells which windows may occur twice."""

    def __init__(self, segments: dict[tuple[int, int], bytes], bits: int):
        self.bits, size = bits, min(SEGMENT, 1 << bits) // 8
        self.planes = [np.zeros((1 << bits) // 8, dtype=np.uint8) for _ in range(ROWS)]
        for (row, segment), data in segments.items():
            self.planes[row][segment * size : (segment + 1) * size] = _unpack(data)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.arange(len(hashes))
        for row, plane in enumerate(self.planes):
            cells = _cells(hashes[maybe], row, self.bits)
            maybe = maybe[(plane[cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8)) & np.uint8(1) == 1]
        return maybe


_LOADED: dict = {}
_STARTS = "h1 long, h2 long, id long, mark long, start int, stop int"
_START_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
_START_NAMES = [c.split()[0] for c in _STARTS.split(", ")]


def _starts(segments, bits: int, width: int, flush: int = 500_000):
    """Window starts that may be repeated elsewhere (stop -1), and stretches that are settled within the batch."""

    def batch(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _START_TYPES, strict=True)], _START_NAMES)

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h1, h2, start = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2))
        lengths = [len(h[0]) for h in held]
        ids = np.repeat(np.array([h[3] for h in held], dtype=np.int64), lengths)
        marks = np.repeat(np.array([h[4] for h in held], dtype=np.int64), lengths)
        order = np.lexsort((ids, h2, h1))
        h1, h2, start, ids, marks = (x[order] for x in (h1, h2, start, ids, marks))
        first = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        smallest = ids[first][np.cumsum(first) - 1]
        gone = ids > smallest
        stay = ~gone
        yield batch(h1[stay].view(np.int64), h2[stay].view(np.int64), ids[stay], marks[stay], start[stay], np.full(stay.sum(), -1, np.int32))
        if gone.any():
            ids, marks, start = ids[gone], marks[gone], start[gone]
            order = np.lexsort((start, marks, ids))
            ids, marks, start = ids[order], marks[order], start[order]
            new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]) | (start[1:] > start[:-1] + width)])
            last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ids) - 1]])
            spread = mix64(ids[new].astype(np.uint64)).view(np.int64)
            yield batch(spread, np.zeros(len(spread), np.int64), ids[new], marks[new], start[new], start[last] + width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _LOADED.get("key") != segments.id_key:
            _LOADED.clear()  # an earlier sketch goes before the next is unpacked
            _LOADED.update(key=segments.id_key, repeated=Repeated(segments.load(), bits))
        repeated, held, n = _LOADED["repeated"], [], 0
        for rows in batches:
            for key, mark, text in zip(rows.column("id").to_pylist(), rows.column("mark").to_pylist(), rows.column("text"), strict=True):
                data = text.as_py()
                hashes = word_hashes(data.split()) if data else None
                if hashes is None or len(hashes) < width:
                    continue
                h1 = window_hashes(hashes, width)
                maybe = repeated(h1)
                if len(maybe):
                    h2 = window_hashes(hashes, width, _SECOND)[maybe]
                    held.append((h1[maybe], h2, maybe.astype(np.int32), _LAST_ID if key is None else key, mark))
                    n += len(maybe)
                    if n >= flush:
                        yield from settle(held)
                        held, n = [], 0
        if held:
            yield from settle(held)

    return run


class _Segments:
    """The merged segments, broadcast in compressed form."""

    def __init__(self, spark, segments: dict, name: str):
        self.id_key = name
        self.value = spark.sparkContext.broadcast(segments)

    def load(self) -> dict:
        return self.value.value


def _losers(width: int):
    """Streams starts sorted by (window, id): every start whose id is above the first one's is removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, least = (None, None), 0
        for batch in batches:
            h1, h2, ids, marks, start, stop = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(h1):
                continue
            settled = stop >= 0
            first = np.concatenate([[(h1[0], h2[0]) != at], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            begins = np.where(first, np.arange(len(h1)), 0)
            begins = np.maximum.accumulate(begins)
            smallest = ids[begins]
            if not first[0]:
                smallest[: np.argmax(first) if first.any() else len(first)] = least
            at, least = (h1[-1], h2[-1]), smallest[-1]
            out = settled | (ids > smallest)
            stops = np.where(settled, stop, start + width)[out].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[out]), pa.array(marks[out]), pa.array(start[out]), pa.array(stops)], ["id", "mark", "start", "stop"]
            )

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams stretches sorted by document and start; one row per document with its merged stretches."""
    held, current = [], None

    def batch(rows: list) -> pa.RecordBatch:
        ids, marks, cuts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(cuts, pa.list_(pa.int32()))], ["id", "mark", "cuts"]
        )

    for rows in batches:
        for key, mark, start, stop in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if current is None or current[0] != key or current[1] != mark:
                if current is not None:
                    held.append(current)
                    if len(held) >= 1000:
                        yield batch(held)
                        held = []
                current = (key, mark, [start, stop])
            elif start <= current[2][-1]:
                current[2][-1] = max(current[2][-1], stop)
            else:
                current[2].extend((start, stop))
    if current is not None:
        held.append(current)
        yield batch(held)


def removed_stretches(docs: DataFrame, width: int = 13, max_cells: int = 1 << 29) -> DataFrame:
    """(id, mark, cuts) of every document that loses words; ``docs`` has id long, mark long, text binary."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = 16
    while (1 << bits) < min(max_cells, n_bytes // 2):  # words have about six bytes
        bits += 1
    segments = docs.select("text").mapInArrow(_sketch(bits, width), "row int, segment int, once binary, twice binary")
    merged = segments.repartition("row", "segment").sortWithinPartitions("row", "segment")
    merged = stored(merged.mapInArrow(_merge, "row int, segment int, twice binary"), "sketch")
    # At most 2 * max_cells bits, in compressed segments.
    found = {(r["row"], r["segment"]): bytes(r["twice"]) for r in merged.toLocalIterator()}
    broadcast = _Segments(spark, found, uuid.uuid4().hex)
    starts = docs.mapInArrow(_starts(broadcast, bits, width), _STARTS)
    dealt = starts.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "id")
    losers = dealt.mapInArrow(_losers(width), "id long, mark long, start int, stop int")
    by_doc = losers.repartition("id", "mark").sortWithinPartitions("id", "mark", "start")
    return stored(by_doc.mapInArrow(_stretches, "id long, mark long, cuts array<int>"), "stretches")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (batch.slice(at, 500) for batch in batches for at in range(0, batch.num_rows, 500)):
        out = []
        for key, text, cuts in zip(*(c.to_pylist() for c in part.columns), strict=True):
            words = (text or b"").split()
            kept, at = [], 0
            for start, stop in zip((cuts or [])[::2], (cuts or [])[1::2], strict=True):
                kept += words[at:start]
                at = stop
            kept += words[at:]
            out.append((key, len(words), len(words) - len(kept), b" ".join(kept)))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "n_words", "n_removed", "kept"])


def remove_repeated_substrings(docs: DataFrame, width: int = 13, id_column: str = "doc_id", max_cells: int = 1 << 29) -> DataFrame:
    """id, n_words, n_removed and the kept words (UTF-8, joined by one space) of every row."""
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        # Tells rows apart that repeat an id with another text.
        F.xxhash64("text").alias("mark"),
        F.col("text").cast("binary").alias("text"),
    )
    cuts = removed_stretches(rows, width, max_cells)
    named = cuts.select(
        F.when(F.col("id") != F.lit(int(_LAST_ID)), F.col("id")).alias("_id"), F.col("mark").alias("_mark"), "cuts"
    )
    size = cuts.agg(F.sum(F.size("cuts") * 4 + 64)).first()[0] or 0
    named = F.broadcast(named) if size <= 32 << 20 else named.hint("shuffle_hash")
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("mark").eqNullSafe(F.col("_mark"))
    joined = rows.join(named, same, "left").select("id", "text", "cuts")
    kept = joined.mapInArrow(_apply, "id long, n_words long, n_removed long, kept binary")
    return kept.withColumnRenamed("id", id_column)
