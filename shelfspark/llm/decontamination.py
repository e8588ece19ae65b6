"""Benchmark decontamination: a BM25 index of the test items, queried with every training passage.

The test items are the documents of an inverted index, the corpus is the stream of queries. Items longer than
``PART`` words are indexed in parts that overlap, so that every run of ``run_words`` words lies whole in a part. Every
text is cut into passages of two adjacent chunks of ``PART`` words, each chunk in two passages. A passage retrieves every
part whose BM25 score reaches a share of the part's score against itself: ``threshold``, or less where the verification
accepts less, that is the smallest share of a run of ``run_words`` words of the part or of the words that its overlaps
ask for. Block-max WAND leaves out what cannot reach it: postings are kept in blocks of parts with the largest impact of
each term per block, and a passage looks into a block only when the sum of these maxima could reach the threshold.
Everything retrieved is verified on the words themselves, passage after passage: the share of the question's and of the
answer's word n-grams found around the passage, and the longest run of words in common. The verified passage with the
highest score is given.

Before, a text is looked up in the n-grams and runs of the items: an item is passed over only if the whole text holds
less of them than the verification of any of its passages asks for. This loses nothing and spares most texts the scores.

The index is built for blocks of items of bounded size, so a test set of any size is worked off in as many passes over the
corpus as it has blocks; texts are never shuffled.

Cases. Null and empty texts and items match nothing. Rows that repeat are matched one by one; items that repeat an id
count as items of their own. An item without an answer is verified by its question. Empty tables give an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import window_hashes

PART = 64
BLOCK = 64
K1, B = 1.2, 0.75
NGRAM = 5
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MATCH = "score double, question_overlap double, answer_overlap double, longest_run long, start_word long"


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(_KEEP).split()


class ItemIndex:
    """Inverted index of a block of items (id, question, answer)."""

    def __init__(self, items: list[tuple], overlap: float = 0.5, run_words: int = 13):
        self.overlap, self.run_words = overlap, run_words
        self.ids = [i for i, _, _ in items]
        self.question = [words_of(q) for _, q, _ in items]
        self.answer = [words_of(a) for _, _, a in items]
        carried = max(run_words, NGRAM) - 1  # words of the next part
        parts: list[tuple[int, list[bytes], int, int]] = []  # item, words, its own range of places in the item
        for place, (q, a) in enumerate(zip(self.question, self.answer, strict=True)):
            words = q + a
            pieces = -(-len(words) // PART)
            for k in range(pieces):
                low, high = k * len(words) // pieces, (k + 1) * len(words) // pieces
                parts.append((place, words[low : high + carried], low, high))
        parts.sort(key=lambda part: len(part[1]))  # parts of like length have like impacts, so the maxima of a block are tight
        self.owner = np.array([part[0] for part in parts], dtype=np.int64)
        self.parts_of: dict[int, list[int]] = {}
        for part, owner in enumerate(self.owner.tolist()):
            self.parts_of.setdefault(owner, []).append(part)
        df = Counter(w for part in parts for w in set(part[1]))
        self.vocabulary = {w: t for t, w in enumerate(df)}
        mean = sum(len(part[1]) for part in parts) / max(1, len(parts))
        idf = {w: math.log(1 + (len(parts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        self.blocks = -(-len(parts) // BLOCK)
        self.block_max = np.zeros((len(df) + 1, self.blocks), dtype=np.float32)
        # Smallest score of each part that the verification can accept.
        self.least = np.zeros(len(parts))
        # Postings of a block: its terms in order, and their impacts on its parts.
        self.postings: list[tuple[np.ndarray, np.ndarray]] = []
        for block in range(self.blocks):
            rows: dict[int, np.ndarray] = {}
            for column, (item, words, low, high) in enumerate(parts[block * BLOCK : (block + 1) * BLOCK]):
                scores, times = {}, Counter(words)
                for w, tf in times.items():
                    scores[w] = idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
                own = sum(scores.values())  # the part's score against itself
                for w, score in scores.items():
                    rows.setdefault(self.vocabulary[w], np.zeros(BLOCK))[column] = score / own
                spread = np.array([scores[w] / own / times[w] for w in words])
                self.least[block * BLOCK + column] = self._least(item, spread, low, high)
            terms = np.array(sorted(rows), dtype=np.int64)
            impacts = np.array([rows[t] for t in terms.tolist()])
            self.postings.append((terms, np.vstack([impacts, np.zeros(BLOCK)])))
            self.block_max[terms, block] = impacts.max(axis=1)
        self._seed()

    def _least(self, item: int, spread: np.ndarray, low: int, high: int) -> float:
        """A lower bound of the score of what the verification accepts of a part, a term's impact spread over its places."""
        least = math.inf
        if len(spread) >= self.run_words:
            sums = np.concatenate([[0.0], np.cumsum(spread)])
            least = float((sums[self.run_words :] - sums[: -self.run_words]).min())
        asked, middle = [], len(self.question[item])
        for start, end in ((0, middle), (middle, middle + len(self.answer[item]))):
            n = min(NGRAM, end - start)
            first, last = max(low, start), min(high, end - n + 1)
            if n and last > first:
                # So many n-grams cover at least so many words: no fewer impacts than the smallest.
                covered = max(1, math.ceil(self.overlap * (last - first) - 1e-9)) + n - 1
                asked.append(float(np.sort(spread[first - low : last - low + n - 1])[:covered].sum()))
        if asked:
            # Some part of a long item holds its share of one side's n-grams, but may lack the other's.
            least = min(least, sum(asked) if len(self.parts_of[item]) == 1 else min(asked))
        return least

    def _seed(self) -> None:
        """Tables of the n-grams that a text must hold for an item: a share of them, or one whole run."""
        self.need = np.full(len(self.ids), math.inf)
        grams: dict[tuple[int, bool], list[tuple[np.ndarray, int]]] = {}
        for item, (q, a) in enumerate(zip(self.question, self.answer, strict=True)):
            side = max(q, a, key=len)
            if not side:
                continue
            n = min(NGRAM, len(side))
            self.need[item] = self.overlap * (len(side) - n + 1) - 1e-9
            grams.setdefault((n, False), []).append((window_hashes(self.terms(side).astype(np.uint64), n), item))
            if len(q) + len(a) >= self.run_words > 0:
                runs = window_hashes(self.terms(q + a).astype(np.uint64), self.run_words)
                grams.setdefault((self.run_words, True), []).append((runs, item))
        self.seeds = []
        for (n, whole), held in grams.items():
            hashes = np.concatenate([h for h, _ in held])
            owners = np.repeat([item for _, item in held], [len(h) for h, _ in held])
            order = np.argsort(hashes)
            keys, starts = np.unique(hashes[order], return_index=True)
            self.seeds.append((n, whole, keys, np.append(starts, len(order)), owners[order]))

    def terms(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in the vocabulary, -1 for others."""
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words], dtype=np.int64)

    def candidates(self, terms: np.ndarray) -> list[int]:
        """Items that the verification could accept somewhere in a text of these terms."""
        if self.overlap <= 0 or self.run_words <= 0:
            return sorted(self.parts_of)
        held = np.concatenate([[0], np.cumsum(terms >= 0)])
        found: set[int] = set()
        counts = None
        for n, whole, keys, starts, owners in self.seeds:
            inside = np.flatnonzero(held[n:] - held[:-n] == n) if len(terms) >= n else ()
            if not len(inside):
                continue
            hashes = window_hashes(terms.astype(np.uint64), n)[inside]
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hits = np.unique(at[keys[at] == hashes])
            if not len(hits):
                continue
            items = np.concatenate([owners[starts[k] : starts[k + 1]] for k in hits.tolist()])
            if whole:
                found.update(items.tolist())
            else:
                more = np.bincount(items, minlength=len(self.ids))
                counts = more if counts is None else counts + more
        if counts is not None:
            found.update(np.flatnonzero(counts >= self.need).tolist())
        return sorted(found)

    def passages(self, terms: np.ndarray, least: np.ndarray, items: list[int]) -> Iterator[tuple[int, float, int]]:
        """Item, score and first word of every passage that reaches ``least`` of a part of one of the items."""
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return
        pairs = np.unique((at // PART) * (len(self.vocabulary) + 1) + terms[at])
        chunk, term = np.divmod(pairs, len(self.vocabulary) + 1)
        n = -(-len(terms) // PART)
        first = np.searchsorted(chunk, np.arange(n + 2))
        ends = first[np.minimum(np.arange(n) + 2, n)]
        slack = 1e-4  # the maxima are stored in single precision
        wanted: dict[int, list[int]] = {}
        for part in sorted(p for i in items for p in self.parts_of.get(i, ())):
            wanted.setdefault(part // BLOCK, []).append(part % BLOCK)
        for block, columns in wanted.items():
            asked = least[[block * BLOCK + c for c in columns]]
            # Bounds of a passage are those of its two chunks together, each summed by itself in double precision.
            bound = np.bincount(chunk, self.block_max[term, block], n)
            may = np.flatnonzero(bound + np.append(bound[1:], 0.0) >= asked.min() - slack)
            if not len(may):
                continue
            own, impacts = self.postings[block]
            impacts = impacts[:, columns]
            rows = np.searchsorted(own, term)
            rows[own[np.minimum(rows, len(own) - 1)] != term] = len(own)  # the row of zeros
            for p in may.tolist():
                # A term in both chunks counts once.
                scores = impacts[np.unique(rows[first[p] : ends[p]])].sum(axis=0)
                for column in np.flatnonzero(scores >= asked - 1e-9).tolist():
                    yield int(self.owner[block * BLOCK + columns[column]]), float(scores[column]), p * PART

    def retrieve(self, words: list[bytes], threshold: float) -> dict[int, tuple[float, int]]:
        """Best score and passage (first word) of every item that some passage of the text retrieves."""
        found: dict[int, tuple[float, int]] = {}
        for item, score, start in self.passages(self.terms(words), np.full(len(self.owner), threshold), sorted(self.parts_of)):
            if score > found.get(item, (0.0, 0))[0]:
                found[item] = (score, start)
        return found

    def leaks(self, words: list[bytes], threshold: float) -> Iterator[tuple]:
        """Item, score, overlaps, longest run and first word of the best verified passage of every item in the text."""
        terms = self.terms(words)
        items = self.candidates(terms)
        found: dict[int, list[tuple[float, int]]] = {}
        for item, score, start in self.passages(terms, np.minimum(threshold, self.least), items) if items else ():
            found.setdefault(item, []).append((-score, start))
        for item, places in found.items():
            for score, start in sorted(places):
                q, a, longest = self.verify(item, words, start)
                if (q >= self.overlap and a >= self.overlap) or longest >= self.run_words:
                    yield item, -score, q, a, longest, start
                    break

    def verify(self, item: int, words: list[bytes], start: int) -> tuple[float, float, int]:
        """Shares of the question's and the answer's n-grams near the passage, and the longest run in common."""
        question, answer = self.question[item], self.answer[item]
        length = len(question) + len(answer)
        near = words[max(0, start - length) : start + 2 * PART + length]

        def overlap(part: list[bytes]) -> float:
            n = min(NGRAM, len(part))
            if not n:
                return 1.0
            held = {tuple(near[i : i + n]) for i in range(len(near) - n + 1)}
            own = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
            return sum(g in held for g in own) / len(own)

        return overlap(question), overlap(answer), longest_run(question + answer, near)


def longest_run(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest run of words that both contain."""
    places: dict[bytes, list[int]] = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    best, runs = 0, {}
    for w in b:
        runs = {i: runs.get(i - 1, 0) + 1 for i in places.get(w, ())}
        best = max(best, max(runs.values(), default=0))
    return best


def item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """Items (id, question, answer) in lists of about ``block_words`` words."""
    held, size = [], 0
    for row in items.orderBy("id").toLocalIterator():
        held.append((row["id"], row["question"], row["answer"]))
        size += len(words_of(row["question"])) + len(words_of(row["answer"]))
        if size >= block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


_INDEX: dict = {}


def _search(items, name: str, threshold: float, overlap: float, run_words: int, names: list[str], item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _INDEX.get("name") != name:
            _INDEX.update(name=name, index=ItemIndex(items.value, overlap, run_words))
        index = _INDEX["index"]
        for batch in batches:
            rows, out = [], []
            for place, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                if not words:
                    continue
                for item, score, q, a, longest, start in index.leaks(words, threshold):
                    rows.append(place)
                    out.append((index.ids[item], score, q, a if index.answer[item] else None, longest, start))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (item_type, pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            ids = batch.column("id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    return run


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.3,
    overlap: float = 0.5,
    run_words: int = 13,
    id_column: str = "doc_id",
    item_column: str = "item_id",
    block_words: int = 2_000_000,
) -> DataFrame:
    """One row per row of ``docs`` and item it contains: ids, score, overlaps, longest run, first word of the passage.

    ``items`` has the item id, question and answer. A match is verified when both overlaps reach ``overlap``, or when
    ``run_words`` words in a row are the same. ``threshold`` is the largest share of an item's own score that is asked for.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("id"), "text")
    id_type, item_kind = docs.schema[id_column].dataType, items.schema[item_column].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"id {id_type.simpleString()}, item {item_kind.simpleString()}, {MATCH}"
    names = [c.split()[0] for c in schema.split(", ")]
    found = None
    for block in item_blocks(items.select(F.col(item_column).alias("id"), "question", "answer"), block_words):
        shared = spark.sparkContext.broadcast(block)  # bounded by block_words
        search = _search(shared, uuid.uuid4().hex, threshold, overlap, run_words, names, to_arrow_type(item_kind))
        part = texts.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.withColumnsRenamed({"id": id_column, "item": item_column})


def question_and_answer(text: Column) -> tuple[Column, Column]:
    """A test item's last sentence is its answer, what stands before its question; a single sentence is a question."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    split = r"^(.*[.?!]) ([^.?!]*[.?!]*)$"
    question = F.regexp_extract(clean, split, 1)
    return F.when(question == "", clean).otherwise(question), F.regexp_extract(clean, split, 2)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    question, answer = question_and_answer(F.col("text"))
    return benchmark.select("item_id", question.alias("question"), answer.alias("answer"))
