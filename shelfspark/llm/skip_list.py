"""Fill-in-middle transformation; cut places are found in an indexable skip list over the units of a text.

A text is a sequence of units: longest runs of A-Z and a-z, and every other code point by itself. The lowest lane of the
list holds all units. A unit stands in the next lane with one chance in eight, drawn from its number, and every entry of a
lane carries how many units and how many code points lie from it to the next entry of that lane. To find the code point
where unit r begins, walk the top lane while the accumulated units do not exceed r, go down a lane, and so on; on the lowest lane the
accumulated units are exactly r, and the accumulated code points are the place. A walk takes about eight steps a lane.

Where to cut comes from the digits of a hash of seed and id (see :func:`draws`), so reruns agree and no state is shared:
every row is transformed in its own task, nothing is shuffled. A row needs some forty bytes of memory a code point.

Cases. Null and empty texts have no units and stay plain with empty output. Texts that contain a marker stay plain, as they could not
be taken apart again. Very long texts are held by one task, one at a time. Null ids are hashed as an empty string; equal ids
cut equal texts alike, so repeated rows give repeated results. Bytes that are no UTF-8 count as one code point each and come out
unchanged. Columns other than id and text are ignored unless named in ``keep``. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import mix64

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_CHANCE_BITS = 3


def unit_widths(text: str) -> np.ndarray:
    """Code points of every unit."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = ((points | 32) - np.uint32(97)) < 26
    begins = np.ones(len(points), dtype=bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    return np.diff(np.flatnonzero(begins), append=len(points))


class Heights:
    """Numbers of the units in every lane above the lowest; alike for all texts, so drawn once for the longest so far."""

    def __init__(self):
        self.size, self.lanes = 0, []

    def upto(self, n: int) -> list[np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 12)
            drawn, self.lanes = mix64(np.arange(1, self.size + 1, dtype=np.uint64)), []
            units = np.arange(self.size)
            while len(units) > 1:
                drawn_here = drawn[units] >> np.uint64(_CHANCE_BITS * len(self.lanes))
                up = (drawn_here & np.uint64((1 << _CHANCE_BITS) - 1)) == 0
                up[0] = True  # the head stands in every lane
                units = units[up]
                self.lanes.append(units)
        return [lane[: np.searchsorted(lane, n)] for lane in self.lanes]


class SkipList:
    """Units in order with their widths; ``lanes`` from the top: (place in the lane below, units, code points)."""

    def __init__(self, widths: np.ndarray, heights: Heights):
        self.size = len(widths)
        below, units, points = np.arange(self.size), np.ones(self.size, dtype=np.int64), widths
        self.lanes = [(below, units, points)]
        for numbers in heights.upto(self.size):
            if len(units) <= 1:
                break
            down = np.searchsorted(below, numbers)
            units, points, below = np.add.reduceat(units, down), np.add.reduceat(points, down), numbers
            self.lanes.insert(0, (down, units, points))

    def offset(self, rank: int) -> int:
        """Code points before unit ``rank``; the whole width at the end."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        at = passed = place = 0
        for k, (down, units, points) in enumerate(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed += int(units[at])
                place += int(points[at])
                at += 1
            if k + 1 < len(self.lanes):
                at = int(down[at]) if at < len(down) else len(self.lanes[k + 1][1])
        return place


def arrange(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def transform_text(text: str, draw: Sequence[int], heights: Heights, plain: int, suffix_first: int) -> tuple:
    """(units, form, prefix and middle code points or None, output) for four drawn numbers."""
    units = SkipList(unit_widths(text), heights)
    n = units.size
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or draw[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    form = "spm" if draw[3] % 100 < suffix_first else "psm"
    first, second = (units.offset(r) for r in sorted((draw[0] % (n + 1), draw[1] % (n + 1))))
    return n, form, first, second - first, arrange(form, text[:first], text[first:second], text[second:])


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers: the first groups of eight hexadecimal digits of the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _transform(names: list[str], plain: int, suffix_first: int, rows: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heights = Heights()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                numbers = zip(*(part.column(f"_h{i}").to_pylist() for i in range(4)), strict=True)
                done = []
                for text, draw in zip(part.column("_text"), numbers, strict=True):
                    held = (text.as_py() or b"").decode("utf-8", "surrogateescape")
                    *facts, output = transform_text(held, draw, heights, plain, suffix_first)
                    done.append((*facts, output.encode("utf-8", "surrogateescape")))
                made = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                columns = [*[part.column(c) for c in names], *made]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), key: str = "doc_id", text: str = "text", seed: int = 1,
    plain: int = 10, suffix_first: int = 20,
) -> DataFrame:
    """The columns ``keep`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain), ``output``.

    ``plain`` percent of the rows stay as they are; of the others ``suffix_first`` percent have form spm, the rest psm.
    """
    names = list(keep)
    numbers = [h.alias(f"_h{i}") for i, h in enumerate(draws(F.col(key), seed))]
    rows = docs.select(*names, F.col(text).cast("binary").alias("_text"), *numbers)
    made = "n long, form string, prefix_chars long, middle_chars long, output binary"
    out = T.StructType([*[docs.schema[c] for c in names], *T.StructType.fromDDL(made)])
    return rows.mapInArrow(_transform(names, plain, suffix_first), out).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from output and form alone. The first of each marker is the one put in, as no text holds any.

    Works on the bytes, one character each, so that what is no UTF-8 comes out unchanged too.
    """
    held = F.decode(output.cast("binary"), "ISO-8859-1")

    def between(start: Column, stop: Column) -> Column:
        return F.substring(held, start, stop - start)

    p, s, m = (F.instr(held, F.lit(x)) for x in (PREFIX, SUFFIX, MIDDLE))
    end = F.octet_length(output) + 1
    psm = F.concat(between(p + 3, s), between(m + 3, end), between(s + 3, m))
    spm = F.concat(between(p + 3, m), between(m + 3, end), between(s + 3, p))
    text = F.encode(F.when(form == "psm", psm).when(form == "spm", spm), "ISO-8859-1")
    return F.coalesce(text.cast("string"), output)
