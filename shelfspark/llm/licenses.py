"""License scan: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies them.

Templates are cut into pieces of at most ``PIECE`` words; texts are read in overlapping windows as long as the pieces.
The MinHash signature of a window has ``n`` values in bands of ``rows_per_band``; a window that agrees with a piece in a
band retrieves its template. ``band_count`` chooses the number of bands so that a window with Jaccard similarity
``similarity`` to a piece agrees in at least one band with the stated probability. Retrieved templates are then compared
exactly: the share of the template's word shingles that stand in the stretch of text where it should lie.

Texts shorter than a template's window are compared whole with it, if they have shingles enough for the containment.

Texts that have no shingle in common with any template cannot agree in any band and are passed over.

Cases. Null and empty texts have no matches. Several places of one template in a text are several rows; places that
overlap count once, with the higher containment. Rows that repeat are scanned one by one. Templates shorter than a shingle
are compared as one shingle of their words. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import mix64, window_hashes, word_hashes
from shelfspark.llm.license_texts import TEMPLATES

SHINGLE = 3
PIECE = 32
_EDGES = b"\"'.,;:!?()[]{}<>*#`"
FOUND = "license string, containment double, start_word long, end_word long"


def band_count(similarity: float, rows_per_band: int, probability: float) -> int:
    """Bands needed so that sets of this similarity agree in one with at least this probability."""
    return max(1, math.ceil(math.log(1 - probability) / math.log(1 - similarity**rows_per_band)))


def words_of(text: bytes) -> list[bytes]:
    return [w.strip(_EDGES) for w in text.lower().split()]


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    return window_hashes(hashes, min(width, max(1, len(hashes))))


class TemplateBands:
    """Band tables of all template pieces, by window length."""

    def __init__(self, templates: dict[str, str], similarity: float, rows_per_band: int, probability: float):
        self.rows = rows_per_band
        self.bands = band_count(similarity, rows_per_band, probability)
        rng = np.random.default_rng(12345)
        self.factors = rng.integers(1, 2**63, self.bands * rows_per_band, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.names, self.sets, self.lengths = [], [], []
        self.tables: dict[int, list[dict[int, list[tuple[int, int]]]]] = {}
        self.by_length: dict[int, list[int]] = {}
        every = []
        for name, text in templates.items():
            hashes = word_hashes(words_of(text.encode()))
            template = len(self.names)
            self.names.append(name)
            self.lengths.append(len(hashes))
            self.sets.append(np.unique(shingles(hashes)))
            every.append(self.sets[-1])
            length = min(PIECE, len(hashes))
            self.by_length.setdefault(length, []).append(template)
            last = len(hashes) - length
            for offset in sorted({*range(0, last + 1, PIECE // 2), last}):
                tables = self.tables.setdefault(length, [{} for _ in range(self.bands)])
                keys = self.keys(shingles(hashes[offset : offset + length]), length)
                for band in range(self.bands):
                    tables[band].setdefault(int(keys[band][0]), []).append((template, offset))
        self.every = np.unique(np.concatenate(every))
        self.known = {n: [np.array(sorted(t), dtype=np.uint64) for t in tables] for n, tables in self.tables.items()}

    def keys(self, marks: np.ndarray, length: int) -> list[np.ndarray]:
        """Band keys of every window of ``length`` words of a text with these shingles."""
        width = max(1, length - SHINGLE + 1)
        out = []
        for band in range(self.bands):
            key = None
            for factor in self.factors[band * self.rows : (band + 1) * self.rows]:
                least = sliding_min(marks * factor >> np.uint64(16), width)
                key = least if key is None else mix64(key ^ least)
            out.append(key)
        return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def scan(text: bytes, bands: TemplateBands, containment: float) -> list[tuple[int, float, int, int]]:
    """(template, containment, first word, word after the last) of every place of a template in the text."""
    words = words_of(text)
    if not words:
        return []
    hashes = word_hashes(words)
    marks = shingles(hashes)
    at = np.minimum(np.searchsorted(bands.every, marks), len(bands.every) - 1)
    if not (bands.every[at] == marks).any():
        return []
    places = set()
    for length, tables in bands.tables.items():
        if len(words) < length:
            places.update((template, 0) for template in bands.by_length[length] if len(marks) >= containment * len(bands.sets[template]))
            continue
        for band, keys in enumerate(bands.keys(marks, length)):
            known = bands.known[length][band]
            hit = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            for window in np.flatnonzero(known[hit] == keys).tolist():
                places.update((template, window - offset) for template, offset in tables[band][int(keys[window])])
    best: list[tuple[int, float, int, int]] = []
    for template, start in places:
        own, length = bands.sets[template], bands.lengths[template]
        slack = max(2, length // 4)
        low = max(0, start - slack)
        near = marks[low : start + length + slack]
        inside = np.isin(near, own)
        share = len(np.unique(near[inside])) / len(own)
        if share >= containment:
            first, last = np.flatnonzero(inside)[[0, -1]]
            best.append((template, share, low + int(first), low + int(last) + min(SHINGLE, length)))
    best.sort(key=lambda m: (m[0], -m[1], m[2], m[3]))
    kept: list[tuple[int, float, int, int]] = []
    for match in best:
        if all(match[0] != k[0] or match[3] <= k[2] or match[2] >= k[3] for k in kept):
            kept.append(match)
    return kept


_BANDS: dict = {}


def _scan(make, name: str, containment: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _BANDS.get("name") != name:
            _BANDS.update(name=name, bands=TemplateBands(*make))
        bands = _BANDS["bands"]
        for batch in batches:
            rows, out = [], []
            for place, text in enumerate(batch.column("text")):
                for match in scan(text.as_py() or b"", bands, containment):
                    rows.append(place)
                    out.append((bands.names[match[0]], *match[1:]))
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            ids = batch.column("id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                ["id", "license", "containment", "start_word", "end_word"],
            )

    return run


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    containment: float = 0.75,
    similarity: float = 0.5,
    rows_per_band: int = 1,
    probability: float = 0.999,
    id_column: str = "doc_id",
    most_templates: int = 2_000,
) -> DataFrame:
    """One row per place of a license template in a text. Templates are worked off in blocks of ``most_templates``."""
    names = sorted(templates or TEMPLATES)
    texts = (templates or TEMPLATES)
    rows = docs.select(F.col(id_column).alias("id"), F.col("text").cast("binary").alias("text"))
    schema = f"id {docs.schema[id_column].dataType.simpleString()}, {FOUND}"
    found = None
    for start in range(0, len(names), most_templates):
        block = {n: texts[n] for n in names[start : start + most_templates]}
        make = (block, similarity, rows_per_band, probability)
        part = rows.mapInArrow(_scan(make, uuid.uuid4().hex, containment), schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("id", id_column)
