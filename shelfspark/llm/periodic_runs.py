"""Runs of words that repeat with a period, found through string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are equal), of at least four periods, that no
neighbouring word extends. Scales t = 8, 16, 32, ... find the periods from t to 2t - 1; smaller periods are found by
comparing words that far apart, which is the base of the dyadic order.

At scale t every position i has a hash of its next t words. Position i is *synchronising* when, among the positions i to
i + t, the smallest hash stands at one of the two ends; positions whose t words have a period of at most t / 4 do not take
part. So whether i is chosen depends on its next 2t words only: equal contexts are chosen alike. Among any t consecutive
positions one is chosen, unless the words there lie in a highly periodic region; such regions are runs of period at most
t / 4, known from the lower scales, and it is these that supply the small periods which the chosen positions omit. A run
of period q in [t, 2t) has at least 4q words, so a chosen position lies in its first t words, and the next chosen position
with the same 2t words as context lies exactly q further: a nearer one would give the run a smaller period. Consecutive chosen
positions of equal context therefore propose every period; each proposal is extended word by word, which is exact, and
dropped when the stretch is too short or has a smaller period.

Hashes have 64 bits. Equal contexts always have equal hashes, so unequal words under one hash can only add proposals, which
fail the comparison, or stand between two equal contexts, which takes a collision inside one text.

The texts of a block are worked on together, longest first, each ended by a word number of its own, so that no stretch
leaves its text and a scale only touches the texts long enough for it. Memory is that of a block (``BLOCK`` words, or one
longer text, some hundred bytes a word); nothing is shuffled.

Cases. Null and empty texts, and texts without words, have no runs and nothing left. Very long texts are a block of their
own. Equal texts and rows that repeat are worked on each for itself. Ids may be null and repeat; they are handed through, as
are all columns named in ``keep``. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import WORD, mix64

BLOCK = 400_000
DIRECT = 8
PERIODS = 4
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_OUT = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS = "array<struct<start: long, length: long, period: long>>"


def has_period(w: np.ndarray, start: int, stop: int, period: int) -> bool:
    return bool((w[start : stop - period] == w[start + period : stop]).all())


def _primes(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] * (n > 1)


def is_smallest(w: np.ndarray, start: int, stop: int, period: int) -> bool:
    """Whether the stretch, at least two periods long, has no smaller period; one would divide this period."""
    return not any(has_period(w, start, stop, period // p) for p in _primes(period))


def stretches(w: np.ndarray, period: int, least: int) -> list[tuple[int, int]]:
    """Start and stop of every longest stretch of at least ``least`` words in which words ``period`` apart are equal."""
    same = np.zeros(max(len(w) - period, 0) + 2, dtype=np.int8)
    same[1:-1] = w[:-period] == w[period:]
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, stops = edges[::2], edges[1::2] + period
    long = stops - starts >= least
    return list(zip(starts[long].tolist(), stops[long].tolist()))


def extend(w: np.ndarray, at: int, period: int, step: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words ``period`` apart are equal."""
    size, left, right = step, at, at
    while right + period < len(w):
        a, b = w[right : right + size], w[right + period : right + period + size]
        differ = np.flatnonzero(a[: len(b)] != b)
        if len(differ):
            right += int(differ[0])
            break
        right, size = right + len(b), size * 2
    size = step
    while left > 0:
        low = max(left - size, 0)
        differ = np.flatnonzero(w[low:left] != w[low + period : left + period])
        if len(differ):
            left = low + int(differ[-1]) + 1
            break
        left, size = low, size * 2
    return left, right + period


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values: the end of one block and the start of the next."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, _OUT, dtype=np.uint64)
    blocks[: len(x)] = x
    rows = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def synchronising(hashes: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """Chosen positions; ``hashes`` are those of ``scale`` words, ``periodic`` marks positions that take no part."""
    names = np.where(periodic, _OUT, hashes)
    least = sliding_min(names, scale + 1)
    ends = (least == names[: len(least)]) | (least == names[scale : scale + len(least)])
    return np.flatnonzero(ends & (least != _OUT))


def proposals(chosen: np.ndarray, contexts: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """(distance, position) of consecutive chosen positions of equal context, from ``scale`` to twice that apart."""
    order = np.argsort(contexts, kind="stable")
    context, place = contexts[order], chosen[order]
    apart = np.diff(place)
    pairs = np.flatnonzero((context[1:] == context[:-1]) & (apart >= scale) & (apart < 2 * scale))
    return sorted(zip(apart[pairs].tolist(), place[pairs].tolist()))


def block_runs(w: np.ndarray, lengths: Sequence[int], direct: int = DIRECT) -> list[tuple[int, int, int]]:
    """(start, stop, period) of all runs of at least four periods.

    ``w`` holds the word numbers of texts of these lengths, longest first, each followed by a number that stands nowhere
    else. ``direct``, a power of two, is the first scale.
    """
    sizes = np.asarray(lengths, dtype=np.int64)
    reach = np.cumsum(sizes + 1)
    #: Words of the texts, from the first, that have at least so many words.
    upto = lambda least: int(reach[k - 1]) if (k := int(np.searchsorted(-sizes, -least, side="right"))) else 0
    runs: list[tuple[int, int, int]] = []
    for period in range(1, direct):
        part = w[: upto(PERIODS * period)]
        if len(part) > period:
            found = stretches(part, period, PERIODS * period)
            runs += [(a, b, period) for a, b in found if is_smallest(part, a, b, period)]
    hashes, scale = mix64(w.view(np.uint64) + _FACTOR), 1
    while n := upto(PERIODS * max(scale, direct)):
        hashes = hashes[: max(n - scale + 1, 0)]
        twice = mix64(hashes[: len(hashes) - scale] * _FACTOR + hashes[scale:])
        if scale >= direct:
            periodic = np.zeros(len(hashes), dtype=bool)
            for start, stop, period in runs:
                if PERIODS * period <= scale <= stop - start and start < n:
                    periodic[start : stop - scale + 1] = True
            chosen = synchronising(hashes, scale, periodic)
            seen = (0, -1)
            for period, at in proposals(chosen, twice[chosen], scale):
                if seen[0] == period and at < seen[1]:
                    continue
                start, stop = extend(w[:n], at, period, 2 * scale)
                seen = (period, stop - period)
                if stop - start >= PERIODS * period and is_smallest(w, start, stop, period):
                    runs.append((start, stop, period))
        hashes, scale = twice, scale * 2
    return runs


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def text_runs(texts: Sequence[bytes | None], exponent: int, least: int, direct: int = DIRECT) -> Iterator[tuple[list, bytes]]:
    """Runs (start, length, period) by start and period, and the text without repeats, of each text in order."""
    words = [(t or b"").split() for t in texts]
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    number: dict = defaultdict(count().__next__)
    lengths = [len(words[i]) for i in order]
    ends = (number[i] for i in order)  # integers, which no word equals
    numbers = chain.from_iterable(chain(map(number.__getitem__, words[i]), (next(ends),)) for i in order)
    w = np.fromiter(numbers, dtype=np.int64, count=sum(lengths) + len(lengths))
    starts = np.cumsum([0, *[n + 1 for n in lengths]])
    found: list[list] = [[] for _ in words]
    for start, stop, period in block_runs(w, lengths, direct):
        if stop - start >= max(least, exponent * period):
            k = int(np.searchsorted(starts, start, side="right")) - 1
            found[order[k]].append((start - int(starts[k]), stop - start, period))
    for text, runs in zip(words, found, strict=True):
        runs.sort(key=lambda r: (r[0], r[2]))
        yield runs, _kept(text, runs)


def _blocks(texts: Sequence[bytes | None], most: int) -> Iterator[slice]:
    """Consecutive texts of about ``most`` words, by their bytes."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or b"") // 6 + 1
        if size and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def _find(names: list[str], exponent: int, least: int, block: int):
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for part in _blocks(texts, block):
                runs, kept = zip(*text_runs(texts[part], exponent, least), strict=True)
                own = batch.slice(part.start, part.stop - part.start)
                listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs], kind)
                columns = [*[own.column(c) for c in names], listed, pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "runs", "collapsed"])

    return run


def find_periodic_runs(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", exponent: int = 4, least: int = 6, block: int = BLOCK
) -> DataFrame:
    """The columns ``keep``, ``runs`` (start, length, period, by start and period) and ``collapsed`` of every row.

    Runs have at least ``least`` words and ``exponent`` periods, 4 or more. ``collapsed`` is the text's words without those
    that any run holds after its first period, joined by one space.
    """
    if exponent < PERIODS:
        raise ValueError("runs of fewer than four periods are not all found")
    names = list(keep)
    out = T.StructType([*[docs.schema[c] for c in names], *T.StructType.fromDDL(f"runs {RUNS}, collapsed binary")])
    rows = docs.select(*names, F.col(text).cast("binary").alias("_text"))
    found = rows.mapInArrow(_find(names, exponent, least, block), out)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def longest_exponent(runs: Column) -> Column:
    """The run of the greatest length / period, the earliest of equals; null without runs."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    nothing = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, nothing, lambda a, b: F.when(better(a, b), b).otherwise(a))


def with_planted_period(text: Column, hash32: Column) -> Column:
    """The text with a period from some word on, where ``hash32`` ends in 0; other texts, and null hashes, stay.

    With n words and g = hash32 / 10, every word i from a = g % n on becomes word a + (i - a) % p, where
    p = 1 + (n - a) / (3 + g % 8), in whole numbers.
    """
    def planted(words: Column, g: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))) + 1
        place = lambda v: lambda i: F.when(i < v["a"], i).otherwise(v["a"] + F.pmod(i - v["a"], v["p"]))
        # Values used inside the inner function are bound once here, not computed again for every word.
        made = lambda v: F.transform(F.sequence(F.lit(0).cast("long"), v["n"] - 1), lambda i: F.get(v["w"], place(v)(i).cast("int")))
        bound = F.transform(F.array(F.struct(words.alias("w"), n.alias("n"), a.alias("a"), p.alias("p"))), lambda v: F.array_join(made(v), " "))
        return F.get(bound, F.lit(0))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    changed = F.get(F.transform(F.array(words), lambda w: planted(w, F.floor(hash32 / 10))), F.lit(0))
    return F.when((F.pmod(hash32, F.lit(10)) == 0) & F.regexp_like(text, F.lit(WORD)), changed).otherwise(text)
