"""Jaccard self-join of word shingle sets with PartEnum signatures, and the components of its links.

Two sets of sizes a and b with Jaccard similarity at least s differ in at most ``(a + b) (1 - s) / (1 + s)`` shingles.
Sets are put into size bands; a *scheme* serves the pairs inside a band, another the pairs across two neighbouring bands,
each with its own bound k on the difference. A scheme cuts the shingle domain into parts of a few sections. Two sets within k
of each other differ in at most t sections of at least ``parts - k // (t + 1)`` parts; so for every part all subsets of all
but t sections are enumerated, and the shingles inside one subset make one signature (t is 1 for sets of up to about a
hundred shingles; larger ones have parts enough to ask for equal parts). Linked sets share a signature; sharing one is only
a reason to compare.

Signatures over very few telling shingles would bring unrelated sets together. Telling are the shingles that are not
frequent: not in ``FREQUENT`` or more of every eighth distinct set, chosen by its fingerprint. That is about thirty sets at any
size of the corpus, so the groups that a passage of fewer sets may form stay as small as they are. At most ``MOST_FREQUENT``
hashes, the most frequent ones, are sent to the tasks. A set leaves out its weakest parts' signatures, as long as fewer parts are
affected than agree for certain: whatever two linked sets leave out, one common signature remains. The frequent shingles
only decide which signatures are left out, never which links are found.

Equal sets are one node from the start. Candidates are first compared by sketches, then exactly. A sketch holds one bit for every
cell of the shingle domain, whether it has an odd number of shingles; two sets differ in at least as many shingles as bits.
Sketches have two to four bits a shingle, so they also tell apart sets that are nearly similar enough.
Within a signature's group every member is first compared with the smallest one
only; links found make components, and only members of different components of a group are compared after that. So every
link between different components is found, while groups of near copies cost one comparison per member. Sets that are nearly
similar share many signatures, hence groups: they are compared by sketch once or twice, not once per group, as every member
outside its group's largest component has one home, its largest group, and meets the members of all its groups there.
Sets of different components that share a signature are still compared in pairs there, inside the tasks; only pairs that their
sketches do not rule out leave them.
Nodes are known by 64-bit fingerprints of their sets; shingles by 64-bit hashes. Texts are cut into sets once; the sets are
stored, and signatures and comparisons start from them. A very long text is one row with one set, which a task holds whole.

Cases. Null, empty and blank texts have empty sets and are linked with nothing. Rows that repeat an id are nodes by their
texts, and each row gets the component of its own text. Null ids (and ids are below 2 ** 62) rank last: a component of
null ids only has a null component. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import mix64, shingle_set, stored
from shelfspark.llm.toxicity import release

NULL_ID = 1 << 62
#: Bits of the smallest sketch.
LEAST_BITS = 1024
STAR_TURNS = 3
#: Largest difference up to which subsets of sections are enumerated.
ENUMERATED = 30
#: Of one in ``EVERY`` distinct sets, a shingle in ``FREQUENT`` of them is frequent; 4 million hashes are 32 MB.
EVERY, FREQUENT, MOST_FREQUENT = 8, 4, 4_000_000
#: Rows of an Arrow batch: texts and sets take kilobytes each, and a task holds a batch in the JVM and in Python.
BATCH_ROWS = 1000
#: Rows that a task of the set table buffers before they are written.
SET_BLOCK = {"parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false"}
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Plans made meanwhile hand Python at most so many rows at once; the session's own limit is put back, and holds if it is smaller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def set_of(text: bytes | None, width: int) -> np.ndarray:
    return shingle_set((text or b"").translate(_LOWER).split(), width)


def fingerprint(marks: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set; 0 for the empty one."""
    if not len(marks):
        return 0
    value = xxhash.xxh3_64_intdigest(marks.tobytes()) or 1
    return value - (1 << 64) if value >= 1 << 63 else value


def sketch(marks: np.ndarray) -> bytes:
    """Parities of the counts of shingles in at least two cells a shingle, a power of two of cells."""
    bits = max(LEAST_BITS, 1 << (2 * len(marks) - 1).bit_length())
    counts = np.bincount((marks & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts.astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the larger one folded to the size of the smaller."""
    if len(x) > len(y):
        x, y = y, x
    value, size = int.from_bytes(y, "little"), 4 * len(y)
    while size >= 8 * len(x):
        value = (value >> size) ^ (value & ((1 << size) - 1))
        size //= 2
    return (value ^ int.from_bytes(x, "little")).bit_count()


class Scheme:
    """One instance of the enumeration: sets whose difference is at most ``k``."""

    def __init__(self, name: int, k: int):
        self.tolerated = 1 if 0 < k <= ENUMERATED else 0
        sections = 3 if self.tolerated else 1
        least = k // (self.tolerated + 1) + 1
        self.parts = 1 if k == 0 else least + 1 + least // 6  # the surplus makes up for parts left out
        self.shape = (self.parts, sections)
        cells = self.parts * sections
        self.edges = np.array([(j << 64) // cells for j in range(1, cells)], dtype=np.uint64)
        self.subsets = np.array(list(combinations(range(sections), sections - self.tolerated)), dtype=np.int64)
        salt = np.arange(self.parts * len(self.subsets), dtype=np.uint64) + np.uint64(name << 32)
        self.salt = mix64(salt).reshape(self.parts, len(self.subsets))

    def signatures(self, marks: np.ndarray, sums: np.ndarray, telling: np.ndarray, bound: int) -> np.ndarray:
        """Signatures of a sorted set. ``sums`` are running sums of its scrambled shingles, ``telling`` running counts
        of those that are not frequent, ``bound`` is the largest difference to any set it can be linked with here."""
        at = np.concatenate([[0], np.searchsorted(marks, self.edges), [len(marks)]])
        content = (sums[at[1:]] - sums[at[:-1]]).reshape(self.shape)[:, self.subsets].sum(axis=2, dtype=np.uint64)
        counts = np.diff(telling[at]).reshape(self.shape)[:, self.subsets].sum(axis=2)
        agreeing = self.parts - bound // (self.tolerated + 1)
        # Fewer parts than agree have a subset below this strength.
        least = np.partition(counts.min(axis=1), agreeing - 1)[agreeing - 1]
        return mix64(content ^ self.salt)[counts >= least]


class Bands:
    """Size bands and their schemes for a similarity of ``percent`` / 100."""

    def __init__(self, percent: int, frequent: np.ndarray | None = None):
        self.percent = percent
        self.frequent = np.empty(0, np.uint64) if frequent is None else frequent

    def linkable(self, a: int, b: int) -> bool:
        return 100 * min(a, b) >= self.percent * max(a, b)

    def bound(self, total: int) -> int:
        """Largest difference of two linked sets with this many shingles together."""
        return total * (100 - self.percent) // (100 + self.percent)

    @lru_cache(maxsize=None)  # noqa: B019  one object per task
    def limits(self, band: int) -> tuple[int, int]:
        low = 1 if band == 0 else self.limits(band - 1)[1] + 1
        return low, max(low, low * 100 * 100 // (self.percent * self.percent))

    def band(self, size: int) -> int:
        band = 0
        while self.limits(band)[1] < size:
            band += 1
        return band

    @lru_cache(maxsize=None)  # noqa: B019
    def scheme(self, band: int, across: bool) -> Scheme:
        high = self.limits(band)[1]
        largest = high + high * 100 // self.percent if across else 2 * high
        return Scheme(2 * band + across, self.bound(largest))

    def signatures(self, marks: np.ndarray) -> np.ndarray:
        size = len(marks)
        if not size:
            return np.empty(0, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(marks), dtype=np.uint64)])
        telling = np.ones(size, dtype=np.int64)
        if len(self.frequent):
            place = np.minimum(np.searchsorted(self.frequent, marks), len(self.frequent) - 1)
            telling[self.frequent[place] == marks] = 0
        telling = np.concatenate([[0], np.cumsum(telling)])
        band = self.band(size)
        low, high = self.limits(band)
        partner = size * 100 // self.percent
        out = [self.scheme(band, False).signatures(marks, sums, telling, self.bound(size + min(high, partner)))]
        if partner > high:
            out.append(self.scheme(band, True).signatures(marks, sums, telling, self.bound(size + partner)))
        if band and self.linkable(low - 1, size):
            out.append(self.scheme(band - 1, True).signatures(marks, sums, telling, self.bound(size + low - 1)))
        return np.concatenate(out)


def _nodes(width: int, rows: int = 512):
    """(id, mark, node, n, place, cells, marks) of every text; the set itself only with the first text of a node in a task.

    ``place`` is the number of the row in the stored table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()  # a scorer of an earlier stage may still fill this Python worker
        place, seen = TaskContext.get().partitionId() << 40, {0}
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                nodes, sizes, cells, marks = [], [], [], []
                for text in part.column("text"):
                    values = set_of(text.as_py(), width)
                    nodes.append(fingerprint(values))
                    sizes.append(len(values))
                    fresh = nodes[-1] not in seen
                    seen.add(nodes[-1])
                    cells.append(sketch(values) if fresh else None)
                    marks.append(values.tobytes() if fresh else None)
                places = pa.array(range(place, place + len(nodes)), pa.int64())
                place += len(nodes)
                columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), places, pa.array(cells, pa.binary()), pa.array(marks, pa.binary())]
                names = ["id", "mark", "node", "n", "place", "cells", "marks"]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), *columns], names)

    return run


def _signatures(percent: int, slices: int, frequent, flush: int = 500_000):
    """(slice, nodes, counts, signatures) of rows (node, marks): packed arrays of a slice's nodes, how many signatures each has, and these.

    A slice holds some two million signatures, so 32 bits tell them apart there but for a few in ten thousand.
    """

    def emit(nodes: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(found)
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
        piece = ((values >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)
        order = np.argsort(piece * len(found) + owner, kind="stable")
        values, owner, piece = values[order].astype(np.uint32), owner[order], piece[order]
        first = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])]))
        members, counts = np.array(nodes, dtype=np.int64)[owner[first]], np.diff(np.append(first, len(values))).astype(np.uint32)
        begin = np.flatnonzero(np.concatenate([[True], piece[first][1:] != piece[first][:-1]]))  # of every slice
        cut, at = np.append(begin, len(first)), np.append(first[begin], len(values))
        packed = [
            [members[i:j].tobytes() for i, j in zip(cut, cut[1:])],
            [counts[i:j].tobytes() for i, j in zip(cut, cut[1:])],
            [values[i:j].tobytes() for i, j in zip(at, at[1:])],
        ]
        columns = [pa.array(piece[first][begin]), *(pa.array(c, pa.binary()) for c in packed)]
        return pa.RecordBatch.from_arrays(columns, ["slice", "nodes", "counts", "signatures"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, frequent.value)
        nodes, found, n = [], [], 0
        for batch in batches:
            for node, marks in zip(batch.column("node").to_pylist(), batch.column("marks"), strict=True):
                nodes.append(node)
                found.append(bands.signatures(np.frombuffer(marks.as_py(), dtype=np.uint64)))
                n += len(found[-1])
                if n >= flush:
                    yield emit(nodes, found)
                    nodes, found, n = [], [], 0
        if n:
            yield emit(nodes, found)

    return run


def _group_rows(signature: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(name, node, leader, size) of the groups of two nodes or more in rows sorted by (signature, node); of groups with the same members, one."""
    keep = np.concatenate([[True], (signature[1:] != signature[:-1]) | (node[1:] != node[:-1])])
    signature, node = signature[keep], node[keep]
    first = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
    sizes = np.diff(np.append(first, len(node)))
    names = mix64(np.add.reduceat(mix64(node.view(np.uint64)), first) ^ sizes.astype(np.uint64))
    several = np.flatnonzero(sizes > 1)
    if not len(several):
        return
    _, index = np.unique(names[several], return_index=True)
    chosen = np.zeros(len(sizes), dtype=bool)
    chosen[several[index]] = True
    rows = np.repeat(chosen, sizes)
    if rows.any():
        yield np.repeat(names, sizes)[rows].view(np.int64), node[rows], np.repeat(node[first], sizes)[rows], np.repeat(sizes, sizes)[rows]


def _unpacked(most: int = 8_000_000, passes: int = 8, grouped: bool = False, longest: int = 1_000_000):
    """(signature, node) of packed rows sorted by slice, without those whose signature stands once in the slice.

    A slice of more than ``most`` signatures is given out whole, as it passes. Several passes save memory.
    With ``grouped`` the rows leave as groups, (name, node, leader, size) and no signature. Only those of too long a slice, or of a pass
    of more than ``longest`` rows, still have to be sorted and grouped: they leave with their signature and without a name.
    """

    def rows(piece: int, values: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        number = (values.view(np.int32).astype(np.int64) << 24) | piece
        for i in range(0, len(number), 100_000):
            signature, node = pa.array(number[i : i + 100_000]), pa.array(nodes[i : i + 100_000])
            none = pa.nulls(len(node), pa.int64())
            columns = {"name": none, "node": node, "leader": none, "size": none, "signature": signature} if grouped else {"signature": signature, "node": node}
            yield pa.RecordBatch.from_pydict(columns)

    def groups(values: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((nodes, values))
        for columns in _group_rows(values[order], nodes[order]):
            for i in range(0, len(columns[0]), 100_000):
                name, node, leader, size = (pa.array(c[i : i + 100_000]) for c in columns)
                none = pa.nulls(len(node), pa.int64())
                yield pa.RecordBatch.from_pydict({"name": name, "node": node, "leader": leader, "size": size, "signature": none})

    def several(piece: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        values, nodes, counts = map(np.concatenate, zip(*held, strict=True))
        ends = np.cumsum(counts, dtype=np.int64)
        for k in range(passes):
            places = np.flatnonzero(values % passes == k)
            if not len(places):
                continue
            places = np.sort(values[places].astype(np.uint64) << np.uint64(32) | places.view(np.uint64))
            same = (places[1:] >> np.uint64(32)) == (places[:-1] >> np.uint64(32))
            places = places[np.append(same, False) | np.append(False, same)] & np.uint64(0xFFFFFFFF)
            places = np.sort(places.view(np.int64))
            if not len(places):
                continue
            found = values[places], nodes[np.searchsorted(ends, places, side="right")]
            yield from groups(*found) if grouped and len(places) <= longest else rows(piece, *found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, n = -1, [], 0
        for batch in batches:
            for piece, *packed in zip(batch.column("slice").to_pylist(), *(batch.column(c) for c in ("signatures", "nodes", "counts")), strict=True):
                if piece != current:
                    if held:
                        yield from several(current, held)
                    current, held, n = piece, [], 0
                values, nodes, counts = (np.frombuffer(x.as_py(), dtype=t) for x, t in zip(packed, (np.uint32, np.int64, np.uint32), strict=True))
                held.append((values, nodes, counts))
                n += len(values)
                if n > most:
                    for values, nodes, counts in held:
                        yield from rows(current, values, np.repeat(nodes, counts))
                    held = []
        if held:
            yield from several(current, held)

    return run


def _groups(most: int = 500_000):
    """Streams rows sorted by (signature, node); gives the groups of two nodes or more, each with its smallest node.

    Groups with the same members are one. A group longer than ``most`` rows is given out in pieces as it passes.
    """

    def emit(name, node, leader, size) -> pa.RecordBatch:
        columns = [pa.array(name), pa.array(node), pa.array(leader), pa.array(size)]
        return pa.RecordBatch.from_arrays(columns, ["name", "node", "leader", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, m = np.empty(0, np.int64), np.empty(0, np.int64)
        open_group: tuple[int, int] | None = None  # signature and smallest node of a group that is given out in pieces
        for batch in batches:
            s = np.concatenate([s, batch.column("signature").to_numpy(zero_copy_only=False)])
            m = np.concatenate([m, batch.column("node").to_numpy(zero_copy_only=False)])
            if not len(s):
                continue
            if open_group is not None:
                end = int(np.searchsorted(s, open_group[0], side="right"))
                if end:
                    yield emit(np.full(end, open_group[0], dtype=np.int64), m[:end], np.full(end, open_group[1]), np.full(end, most))
                    s, m = s[end:], m[end:]
                if not len(s):
                    continue
                open_group = None
            tail = int(np.searchsorted(s, s[-1]))
            if tail:
                yield from (emit(*found) for found in _group_rows(s[:tail], m[:tail]))
                s, m = s[tail:], m[tail:]
            if len(s) > most:
                open_group = (int(s[0]), int(m[0]))
                yield emit(np.full(len(s), s[0], dtype=np.int64), m, np.full(len(m), m[0]), np.full(len(m), most))
                s, m = s[:0], m[:0]
        if len(s) and open_group is None:
            yield from (emit(*found) for found in _group_rows(s, m))

    return run


def signature_groups(sets: DataFrame, percent: int, slices: int, frequent, most: int = 8_000_000) -> DataFrame:
    """(name, node, leader, size): the sets (node, marks) that share a signature, with the smallest node of each group.

    The rows of a slice are grouped where they are unpacked, in one Python step: a second one in the same tasks would keep twice as
    many Python workers. Slices of more than ``most`` signatures are sorted by Spark and grouped afterwards.
    """
    packed = "slice long, nodes binary, counts binary, signatures binary"
    signatures = sets.select("node", "marks").mapInArrow(_signatures(percent, slices, frequent), packed)
    # One task a slice, about: all its packed rows are one Arrow batch.
    dealt = signatures.repartition(slices, "slice").sortWithinPartitions("slice")
    shape = "name long, node long, leader long, size long"
    found = stored(dealt.mapInArrow(_unpacked(most, grouped=True), f"{shape}, signature long"), "groups")
    long = found.where("signature IS NOT NULL").select("signature", "node")
    found = found.where("signature IS NULL").drop("signature")
    if not long.count():
        return found
    dealt = long.repartition("signature").sortWithinPartitions("signature", "node")
    return found.unionByName(stored(dealt.mapInArrow(_groups(), shape), "long-groups"))


def _compare(percent: int):
    """Streams rows sorted by (hub, salt, hub's own row first): links of the hub with the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, np.empty(0, np.uint64)
        for batch in batches:
            hubs, nodes = [], []
            for hub, salt, node, marks in zip(*(batch.column(c) for c in ("hub", "salt", "node", "marks")), strict=True):
                hub, salt, node = hub.as_py(), salt.as_py(), node.as_py()
                values = np.frombuffer(marks.as_py(), dtype=np.uint64)
                if node == hub:
                    current, own = (hub, salt), values
                elif current == (hub, salt):
                    both = len(np.intersect1d(own, values, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(values) - both):
                        hubs.append(hub)
                        nodes.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, places: DataFrame, percent: int, hub_rows: int = 5000, small_rows: int = 400_000) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. ``places`` (node, place) tells where the set of every node stands.

    Only the sets of the pairs' nodes are read. A node with very many partners is compared in several tasks. Up to
    ``small_rows`` wanted rows (some fifty bytes each) are broadcast, more are shuffled.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / hub_rows).cast("int").alias("salts"))
    partners = pairs.join(salts, "a").select(
        F.col("b").alias("node"), F.col("a").alias("hub"), F.pmod(F.hash("b"), F.col("salts")).alias("salt")
    )
    own = salts.select(F.col("a").alias("node"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    needed = stored(partners.unionByName(own).join(places, "node"), "to-compare")
    small = needed.count() <= small_rows
    wanted = F.broadcast(needed) if small else needed.hint("shuffle_hash")
    rows = sets.select("place", "marks").join(wanted, "place").select("hub", "salt", "node", "marks")
    dealt = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("node") != F.col("hub"), "node")
    return stored(dealt.mapInArrow(_compare(percent), "a long, b long"), "links").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): the smallest node that links lead to.

    Every round takes the smallest label around each node and then the label of that label.
    """
    edges = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        around = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        closer = labels.join(around, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        of_label = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = stored(closer.join(of_label, "next").select("node", "label", F.least("next", "far").alias("next")), "labels")
        changed = moved.where("label != next").limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def _allowed(n, m, percent: int):
    """Largest difference of two linked sets of these sizes."""
    return (n + m) * (100 - percent) // (100 + percent)


def _possible(percent: int):
    """Pairs that their sizes and sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            fits, most = 100 * np.minimum(n, m) >= percent * np.maximum(n, m), _allowed(n, m, percent)
            x, y = batch.column("x"), batch.column("y")
            keep = pa.array([i for i in np.flatnonzero(fits).tolist() if differing(x[i].as_py(), y[i].as_py()) <= most[i]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    return run


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be links by their sizes and sketches."""
    left = classes.select(F.col("node").alias("a"), "n", F.col("cells").alias("x"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("cells").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y")
    return joined.mapInArrow(_possible(percent), "a long, b long")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after further links: components of the labels that these connect."""
    of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("at"))
    of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("bt"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("at", "a").alias("a"), F.coalesce("bt", "b").alias("b"))
    moved = components(ends.where("a != b"))
    new = moved.join(labels, "node", "left_anti")
    moved = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return stored(known.unionByName(new), "labels")


def open_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, node, label, main) of the groups whose members lie in several components; main is the largest of these."""
    member = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = member.groupBy("name", "label").agg(F.count(F.lit(1)).alias("size"))
    main = parts.groupBy("name").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("parts"))
    return stored(member.join(main.where("parts > 1").drop("parts"), "name").select("name", "node", "label", "main"), "open-groups")


def stars(rows: DataFrame, turn: int) -> DataFrame:
    """One pair for every member outside its group's largest component, with some member of that component."""
    hub = rows.where("label = main").groupBy("name").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("a"))
    met = rows.where("label != main").join(hub, "name")
    return met.groupBy(F.col("node").alias("b"), "main").agg(F.min_by("a", F.xxhash64("a", "node")).alias("a")).select("a", "b").distinct()


def _cross(percent: int, chunk: int = 200):
    """Streams rows sorted by (home, block, the block's own rows first): pairs of an own row and another that may be links."""

    def folded(sketches: list[bytes]) -> np.ndarray:
        shape = (-1, LEAST_BITS // 64)
        return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.uint64).reshape(shape), axis=0) for x in sketches])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        held: list[tuple] = []
        own: tuple = ()
        whole: list[bytes] = []  # the sketches of the own rows
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                part = batch.slice(start, chunk)
                keys = list(zip(part.column("home").to_pylist(), part.column("block").to_pylist(), strict=True))
                node, label, n, first = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "n", "own"))
                sketches = part.column("cells").to_pylist()
                short = folded(sketches)
                edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
                for low, high in zip(edges, edges[1:]):
                    if keys[low] != current:
                        current, held, own, whole = keys[low], [], (), []
                    mine = low + int(first[low:high].sum())  # own rows come first
                    if mine > low:
                        held.append((node[low:mine], label[low:mine], n[low:mine], short[low:mine]))
                        own = tuple(np.concatenate(c) for c in zip(*held, strict=True))
                        whole += sketches[low:mine]
                    if mine == high or not own:
                        continue
                    big, small = np.maximum.outer(own[2], n[mine:high]), np.minimum.outer(own[2], n[mine:high])
                    i, j = np.nonzero((100 * small >= percent * big) & (own[1][:, None] != label[mine:high]))
                    j += mine
                    most = _allowed(own[2][i], n[j], percent)
                    near = np.flatnonzero(np.bitwise_count(own[3][i] ^ short[j]).sum(axis=1, dtype=np.int64) <= most).tolist()
                    good = [p for p in near if differing(whole[i[p]], sketches[j[p]]) <= most[p]]
                    if good:
                        a, b = own[0][i[good]], node[j[good]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def cross_pairs(rows: DataFrame, classes: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """Pairs of members of one group in different components that may be links.

    Every member outside the largest component of some group has a home, the largest of these groups. The members at home in one
    group are cut into blocks, and every block meets the members of all the groups of its own members, each of them once.
    """
    outside = rows.where("label != main").select("name", "node")
    sizes = rows.groupBy("name").agg(F.count(F.lit(1)).alias("size"))
    home = outside.join(sizes, "name").groupBy("node").agg(F.max(F.struct("size", "name")).alias("home")).select("node", F.col("home.name").alias("home"))
    blocks = home.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = stored(home.join(blocks, "home").select("home", F.pmod(F.hash("node"), F.col("blocks")).alias("block"), "node"), "homes")
    met = outside.join(own, "node").select("name", "home", "block").distinct()
    others = rows.select("name", "node").join(met, "name").select("home", "block", "node").distinct()
    nodes = rows.groupBy("node").agg(F.min("label").alias("label")).join(classes.select("node", "n", "cells"), "node")
    dealt = own.withColumn("own", F.lit(True)).unionByName(others.withColumn("own", F.lit(False))).join(nodes, "node")
    dealt = dealt.repartition("home", "block").sortWithinPartitions("home", "block", F.desc("own"), "node")
    return dealt.mapInArrow(_cross(percent), "a long, b long").distinct()


def frequent_shingles(sets: DataFrame, places: DataFrame, every: int = EVERY, least: int = FREQUENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """Sorted hashes of the shingles in ``least`` or more of one in ``every`` distinct sets (node, place, marks).

    A set may stand once in every task; that at its node's place (``places``) counts.
    """

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for marks in batch.column("marks"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(marks.as_py(), dtype=np.int64))], ["mark"])

    counted = F.pmod("node", F.lit(every)) == 0
    chosen = sets.where(counted).join(places.where(counted).select("place"), "place", "left_semi").select("marks")
    counts = chosen.mapInArrow(unfold, "mark long").groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "mark").limit(most)
    return np.sort(found.toArrow().column("mark").to_numpy().view(np.uint64))


def link_components(docs: DataFrame, width: int = 5, percent: int = 75, id_column: str = "doc_id") -> DataFrame:
    """id, n_shingles and component_id (smallest id reachable by links) of every row of ``docs``.

    ``component`` names the group also where ids are null or repeat (null for empty sets), ``mark`` is a hash of the text.
    """
    with small_batches(docs.sparkSession):
        return _linked(docs, width, percent, id_column)


def _linked(docs: DataFrame, width: int, percent: int, id_column: str) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    shape = "id long, mark long, node long, n long, place long, cells binary, marks binary"
    rows = stored(texts.withColumn("mark", F.xxhash64("text")).mapInArrow(_nodes(width), shape), "sets", SET_BLOCK)
    sets = rows.where("marks IS NOT NULL")
    ranked = F.coalesce(F.col("id"), F.lit(NULL_ID))
    place = F.min(F.when(F.col("cells").isNotNull(), F.col("place")))
    one = rows.where("n > 0").groupBy("node").agg(F.min(ranked).alias("rep"), F.max("n").alias("n"), F.min("cells").alias("cells"), place.alias("place"))
    classes = stored(one, "classes")
    shingles = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    places = classes.select("node", "place")
    frequent = spark.sparkContext.broadcast(frequent_shingles(sets, places))  # at most MOST_FREQUENT hashes
    slices = 64
    while slices * 2_000_000 < shingles:
        slices *= 2
    groups = signature_groups(sets, percent, slices, frequent)
    frequent.destroy()
    near = groups.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    near = stored(possible(near, classes, percent), "pairs")
    labels = components(verify(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, places, percent))

    def add(pairs: DataFrame) -> int:
        """Compare the pairs; the number of new links."""
        nonlocal labels
        pairs = stored(pairs, "pairs")
        found = 0 if pairs.isEmpty() else verify(pairs, sets, places, percent)
        new = found and found.count()
        if new:
            labels = merged(labels, found)
        return new

    # The other smallest members, then some member of the largest component, then all that is left.
    place = labels.select(F.col("node").alias("a"), F.col("label").alias("at"))
    place_b = labels.select(F.col("node").alias("b"), F.col("label").alias("bt"))
    apart = near.join(place, "a", "left").join(place_b, "b", "left")
    add(apart.where(~F.coalesce("at", "a").eqNullSafe(F.coalesce("bt", "b"))).select("a", "b"))
    members = stored(groups.where("size > 2").select("name", "node").distinct(), "members")
    rows_open = open_groups(members, labels)
    for turn in range(STAR_TURNS):
        new = add(possible(stars(rows_open, turn), classes, percent))
        if new:
            rows_open = open_groups(members, labels)
        if new * 50 < labels.count():  # further turns would find little
            break
    add(cross_pairs(rows_open, classes, percent))
    lowest = classes.join(labels, "node").groupBy("label").agg(F.min("rep").alias("lowest"))
    named = labels.join(lowest, "label").select("node", "label", "lowest")
    joined = rows.join(classes.select("node", "rep"), "node", "left").join(named, "node", "left")
    lowest = F.when(F.col("n") > 0, F.coalesce("lowest", "rep")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(lowest < NULL_ID, lowest).alias("component_id"),
        F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("component"),
        "mark",
    )
