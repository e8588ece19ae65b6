"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary documents, compare how likely each makes the words of a text. A
model predicts each character of a word from the four before it (absolute discounting on the class's own counts); what
the class has rarely or never seen backs off to one shared Kneser-Ney model of orders four to one, whose continuation
counts come from every document of the corpus, labelled or not. Characters instead of whole words let inflected and
compounded expressions share evidence with those that were seen.

Score of a text: the length-normalised difference of the two log-likelihoods over the whole text, over its words with
the largest differences, over its most toxic stretch of words, and the excess of words over a level that counts as
evidence, per word and per square root of words; a logistic function of these and of the length, fitted on labelled rows
that the counts did not use, gives a value between 0 and 1. The difference of a single word, or piece of a long one, counts
with ``LIMIT`` (12) at most in either direction, so that no single word decides about a text.

Bounds (parameters): class counts and the fit use at most ``max_labelled`` labelled rows, those with the smallest hash.
Shared counts cover all rows, and every distinct gram of five characters has its own. The counts are a table that grows
with the corpus. Up to ``most_grams`` grams, each gram's value is broadcast (16 bytes a gram); beyond, the grams' values are computed in Spark and joined
with the distinct grams of each chunk of texts, and every chunk is scored beside its own grams only.

Words longer than ``PIECE`` characters, as in texts without blanks, are cut into consecutive pieces that are counted and
scored like words; a piece carries the four characters before it, and only the last has an end mark.

Cases. Null and empty texts score as texts without evidence. Rows that repeat are scored alike. Null labels, and labels
of unknown documents, are ignored; with labels of one class only every text gets the share of that class. Empty tables
give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import mix64, stored

ORDER = 5
PIECE = 64
DISCOUNT = 0.75
_EDGES = b"\"'.,;:!?()[]{}<>|-*#$%&+_=/\\~`"
FEATURES = ("mean_llr", "top_llr", "third_llr", "window_llr", "excess_llr", "evidence_llr", "log_words")
#: A word's difference counts as evidence above this value: about twelve to one.
EVIDENCE = 2.5
#: Bound of a word's difference.
LIMIT = 12.0
MODELS, CALIBRATION = 2, 1  # shares of the labelled rows


def pieces(word: bytes) -> list[str]:
    """A word as the models see it: lower case, without punctuation around it, four blanks before, its end marked.

    Long words are several pieces, each behind the four characters before it.
    """
    text = word.strip(_EDGES).decode("utf-8", "replace").lower()
    padded = "    " + text + "\n"
    if len(text) <= PIECE:
        return [padded]
    cut = [padded[i : i + PIECE + ORDER - 1] for i in range(0, len(text) - PIECE, PIECE)]
    return [*cut, padded[len(cut) * PIECE :]]


def pieces_of(words: list[bytes]) -> tuple[list[str], np.ndarray]:
    """The pieces of many words one after the other, and how many each word has."""
    if not words:
        return [], np.zeros(0, dtype=np.int64)
    # Words hold no line break, so they can be decoded and lowered together.
    texts = b"\n".join([w.strip(_EDGES) for w in words]).decode("utf-8", "replace").lower().split("\n")
    if max(map(len, texts)) <= PIECE:
        return ["    " + t + "\n" for t in texts], np.ones(len(texts), dtype=np.int64)
    cut = [["    " + t + "\n"] if len(t) <= PIECE else pieces(w) for w, t in zip(words, texts, strict=True)]
    return list(chain.from_iterable(cut)), np.array([len(c) for c in cut])


def slices(padded: list[str], characters: int = 650_000) -> Iterator[list[str]]:
    """Consecutive pieces with about so many characters together."""
    ends = np.cumsum([len(p) for p in padded])
    start = 0
    while start < len(padded):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + characters, "right")))
        yield padded[start:end]
        start = end


def codes(padded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of pieces in one array, and the pieces' lengths."""
    points = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    return points, np.array([len(p) for p in padded])


def _tails(characters: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the strings that end at each place, one character longer each time; ``characters`` go backwards."""
    value, out = np.zeros(len(characters[0]), dtype=np.uint64), []
    for c in characters:
        value = value * np.uint64(0x100000001B3) + c + np.uint64(1)
        out.append(mix64(value))
    return out


def _hashes(characters: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the last 1 to 5 characters, and of the 0 to 4 characters before the last one."""
    return _tails(characters), [np.zeros(len(characters[0]), dtype=np.uint64), *_tails(characters[1:])]


def grams(padded: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For every character of every piece (end mark included): it and the four before, backwards; and its piece."""
    points, lengths = codes(padded)
    inside = np.ones(len(points), dtype=bool)
    for k in range(ORDER - 1):
        inside[np.cumsum(lengths) - lengths + k] = False
    at = np.flatnonzero(inside)
    return [points[at - k] for k in range(ORDER)], np.repeat(np.arange(len(padded)), lengths - (ORDER - 1))


def spelled(characters: list[np.ndarray], places: np.ndarray) -> list[str]:
    """The grams at these places."""
    rows = np.stack([c[places] for c in reversed(characters)], axis=1).astype("<u4")
    whole = rows.tobytes().decode("utf-32-le", "replace")
    return [whole[i : i + ORDER] for i in range(0, len(whole), ORDER)]


def _gather(flush: int = 200_000, flush_bytes: int = 1 << 28):
    """Counts of five-character grams in a task: in all rows, in toxic and in ordinary labelled rows."""

    def emit(padded: list[str], weights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        done = 0
        for part in slices(padded):
            characters, owner = grams(part)
            keys, first, inverse = np.unique(_tails(characters)[ORDER - 1], return_index=True, return_inverse=True)
            sums = [np.bincount(inverse, w[done : done + len(part)][owner], len(keys)).astype(np.int64) for w in weights]
            done += len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spelled(characters, first)), *[pa.array(s) for s in sums]], ["gram", "n_all", "n_toxic", "n_plain"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, held = [Counter(), Counter(), Counter()], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            words = list(raw[0])
            padded, per_word = pieces_of(words)
            # Words of punctuation only are not counted.
            real = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded)) > ORDER
            weights = [np.fromiter(map(c.get, words, repeat(0)), dtype=np.float64, count=len(words)) for c in raw]
            weights = [np.repeat(w, per_word)[real] for w in weights]
            yield from emit([p for p, wanted in zip(padded, real.tolist(), strict=True) if wanted], weights)

        for batch in batches:
            for text, kind in zip(batch.column("text"), batch.column("kind").to_pylist(), strict=True):
                text = text.as_py() or b""
                words = text.split()
                held += len(text)
                raw[0].update(words)
                if kind is not None:
                    raw[1 if kind else 2].update(words)
                if len(raw[0]) >= flush or held >= flush_bytes:
                    yield from flushed()
                    raw, held = [Counter(), Counter(), Counter()], 0
        yield from flushed()

    return run


def gram_values(counts: DataFrame) -> DataFrame:
    """``value``: the log-likelihood difference of every gram of the counts, as ``Backoff`` gives it, as a table."""
    # The one gram that is scored but not counted: that of words of punctuation only.
    empty = counts.sparkSession.createDataFrame([("    \n", 0, 0, 0)], counts.schema)
    counts = counts.unionByName(empty)
    longest = counts.groupBy(F.substring("gram", 2, ORDER - 1).alias("s")).agg(F.count_if(F.col("n_all") > 0).alias("kinds"))
    orders = {ORDER - 1: stored(longest, "char-kinds")}
    for n in range(ORDER - 2, 0, -1):
        orders[n] = orders[n + 1].groupBy(F.substring("s", 2, n).alias("s")).agg(F.count_if(F.col("kinds") > 0).alias("kinds"))
    # One row.
    total, types = orders[1].agg(F.sum("kinds").cast("double"), F.count_if(F.col("kinds") > 0).cast("double")).first()
    own = F.greatest(F.col("kinds") - DISCOUNT, F.lit(0.0))
    shared = orders[1].select("s", (own / total + DISCOUNT * types / total / (types + 1)).alias("prob"))
    for n in range(2, ORDER):
        # As many rows as there are characters in a context.
        context = Window.partitionBy(F.substring("s", 1, n - 1))
        rows = orders[n].select(
            "s", "kinds", F.sum("kinds").over(context).alias("total"), F.count_if(F.col("kinds") > 0).over(context).alias("types"),
            F.substring("s", 2, n - 1).alias("shorter"),
        )
        below = shared.select(F.col("s").alias("shorter"), F.col("prob").alias("below"))
        prob = own / F.col("total") + DISCOUNT * F.col("types") / F.col("total") * F.col("below")
        shared = rows.join(below, "shorter").select("s", F.when(F.col("total") > 0, prob).otherwise(F.col("below")).alias("prob"))
    context = Window.partitionBy(F.substring("gram", 1, ORDER - 1))
    rows = counts.select("gram", "n_toxic", "n_plain", F.substring("gram", 2, ORDER - 1).alias("s"), *[
        f(c).over(context).alias(f"{name}_{c}")
        for c in ("n_toxic", "n_plain")
        for name, f in (("sum", F.sum), ("types", lambda c: F.count_if(F.col(c) > 0)))
    ])

    def log(c: str) -> Column:
        n, prob = F.col(f"sum_{c}").cast("double"), F.col("prob")
        mixed = (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"types_{c}") * prob) / F.greatest(n, F.lit(1.0))
        trust = n / (n + 5.0)
        return F.log(trust * F.when(n > 0, mixed).otherwise(prob) + (1 - trust) * prob)

    return rows.join(shared, "s").select("gram", (log("n_toxic") - log("n_plain")).alias("value"))


class Backoff:
    """Log-likelihood differences of words from the gathered counts."""

    def __init__(self, spellings: list[str], n_all: np.ndarray, n_toxic: np.ndarray, n_plain: np.ndarray):
        self_hash, contexts = _hashes(backwards(spellings))
        # Shared model: order n counts the different characters seen before each gram of n characters.
        lower = np.zeros(0)
        shared = None
        self.shared: list[tuple[np.ndarray, np.ndarray]] = []
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, ORDER):
            longer, index = np.unique(self_hash[n], return_index=True)
            keys, at = np.unique(self_hash[n - 1], return_inverse=True)
            kinds = np.bincount(at[index], minlength=len(keys)).astype(np.float64)
            first = np.unique(self_hash[n - 1], return_index=True)[1]
            context = contexts[n - 1][first]
            names, where = np.unique(context, return_inverse=True)
            total = np.bincount(where, kinds)
            types = np.bincount(where).astype(np.float64)
            below = shared[np.searchsorted(lower, self_hash[n - 2][first])] if n > 1 else np.full(len(keys), 1.0 / (len(keys) + 1))
            prob = (kinds - DISCOUNT) / total[where] + DISCOUNT * types[where] / total[where] * below
            self.shared.append((keys, prob))
            self.rest.append((names, DISCOUNT * types / total))
            lower, shared = keys, prob
        self.floor = 1.0 / (len(self.shared[0][0]) + 1) if len(spellings) else 1.0
        # Class models: their own counts of five characters.
        self.classes = []
        order = np.argsort(self_hash[ORDER - 1])
        self.keys = self_hash[ORDER - 1][order]
        names, where = np.unique(contexts[ORDER - 1], return_inverse=True)
        self.contexts = names
        for counts in (n_toxic, n_plain):
            counts = counts.astype(np.float64)
            total = np.bincount(where, counts, len(names)) if len(names) else np.zeros(0)
            types = np.bincount(where, counts > 0, len(names)) if len(names) else np.zeros(0)
            self.classes.append((counts[order], total, types))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def differences(self, words: list[str]) -> np.ndarray:
        """ln P(word | toxic) - ln P(word | ordinary), a bounded value for each word."""
        return self.of_pieces(["    " + w + "\n" for w in words])

    def of_pieces(self, padded: list[str]) -> np.ndarray:
        """The same for pieces."""
        if not padded:
            return np.zeros(0)
        characters, owner = grams(padded)
        return np.clip(np.bincount(owner, self.of_grams(characters), len(padded)), -LIMIT, LIMIT)

    def of_grams(self, characters: list[np.ndarray]) -> np.ndarray:
        """ln P(character | toxic) - ln P(character | ordinary) for grams of five characters, given backwards."""
        hashes, contexts = _hashes(characters)
        prob = np.full(len(characters[0]), self.floor)
        for n in range(1, ORDER):
            keys, probs = self.shared[n - 1]
            names, rest = self.rest[n - 1]
            i, seen = self._find(keys, hashes[n - 1])
            j, known = self._find(names, contexts[n - 1])
            backed = np.where(known, rest[j] if len(rest) else 1.0, 1.0) * prob
            prob = np.where(seen, probs[i] if len(probs) else prob, backed)
        i, seen = self._find(self.keys, hashes[ORDER - 1])
        j, known = self._find(self.contexts, contexts[ORDER - 1])
        logs = []
        for counts, total, types in self.classes:
            if not len(counts):
                logs.append(np.log(prob))
                continue
            n, kinds = np.where(known, total[j], 0.0), np.where(known, types[j], 0.0)
            own = np.where(seen, counts[i], 0.0)
            mixed = (np.maximum(own - DISCOUNT, 0.0) + DISCOUNT * kinds * prob) / np.maximum(n, 1.0)
            # A context the class has met a few times only says little: it is weighed with the shared model.
            trust = n / (n + 5.0)
            logs.append(np.log(trust * np.where(n > 0, mixed, prob) + (1 - trust) * prob))
        return logs[0] - logs[1]


def backwards(spellings: list[str]) -> list[np.ndarray]:
    """The characters of grams, the last ones first."""
    points = np.frombuffer("".join(spellings).encode("utf-32-le"), dtype=np.uint32).reshape(-1, ORDER).astype(np.uint64)
    return [points[:, ORDER - 1 - k] for k in range(ORDER)]


class GramValues:
    """Log-likelihood differences of words from a table that has the value of each of their grams."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    @staticmethod
    def names(spellings: list[str]) -> np.ndarray:
        """The hashes by which grams are found."""
        return _tails(backwards(spellings))[ORDER - 1]

    def of_pieces(self, padded: list[str]) -> np.ndarray:
        if not padded or not len(self.keys):
            return np.zeros(len(padded))
        characters, owner = grams(padded)
        hashes = _tails(characters)[ORDER - 1]
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        values = np.where(self.keys[at] == hashes, self.values[at], 0.0)
        return np.clip(np.bincount(owner, values, len(padded)), -LIMIT, LIMIT)


def features(values: np.ndarray, lengths: np.ndarray, window: int = 8) -> tuple[float, ...]:
    """Length-normalised differences of one text: whole, top words, most toxic stretch, excess over the evidence level."""
    return tuple(c[0] for c in batch_features(values, lengths, np.array([len(values)]), window).tolist())


def batch_features(values: np.ndarray, lengths: np.ndarray, per_text: np.ndarray, window: int = 8) -> np.ndarray:
    """The features of many texts, one row a feature; text after text, ``per_text`` tells how many values each has.

    Every figure comes from its text's values alone, in their order, so it does not depend on the other texts.
    """
    out = np.zeros((len(FEATURES), len(per_text)))
    texts = np.flatnonzero(per_text)
    if not len(texts):
        return out
    n = per_text[texts]
    ends = np.cumsum(n)
    starts = ends - n
    owner = np.repeat(np.arange(len(texts)), n)

    def largest(v: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(v, starts)

    total = np.add.reduceat(values, starts)
    top = largest(values)
    # The third largest: the largest once the two before it are out, each time one place a text.
    rest, third = values.copy(), top
    for _ in range(2):
        places = np.flatnonzero(rest == third[owner])
        rest[places[np.unique(owner[places], return_index=True)[1]]] = -np.inf
        third = largest(rest)
    stretch = np.zeros(len(values))
    for k in range(min(window, len(values))):
        stretch[: len(values) - k] += values[k:]
    # Stretches that reach into the next text do not count.
    stretch[ends[owner] - np.arange(len(values)) < window] = -np.inf
    best = np.where(n >= window, largest(stretch) / window, total / n)
    excess = np.add.reduceat(np.maximum(values - EVIDENCE, 0.0), starts)
    normalised = total / np.add.reduceat(lengths, starts) * 5.0
    out[:, texts] = [normalised, top, np.where(n >= 3, third, 0.0), best, excess / n * 10.0, excess / n**0.5, np.log(n)]
    return out


_MODEL: dict = {}


def release() -> None:
    """Give up the scorer that a task of this Python worker has left behind."""
    _MODEL.clear()


class Scorer:
    """Features of texts; the values of words are kept for the next texts."""

    def __init__(self, model: Backoff | GramValues, known_pieces: int = 400_000):
        self.model, self.known_pieces = model, known_pieces
        self._forget()

    def _forget(self) -> None:
        # Number of each word; of word k, the pieces first[k] to first[k + 1] with their values and lengths.
        self.known: dict[bytes, int] = {}
        self.first, self.values, self.lengths = np.zeros(1, dtype=np.int64), np.zeros(0), np.zeros(0)

    def _learn(self, new: list[bytes]) -> None:
        padded, per_word = pieces_of(new)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(per_word)])
        self.values = np.concatenate([self.values, *[self.model.of_pieces(part) for part in slices(padded)]])
        lengths = np.fromiter(map(len, padded), dtype=np.float64, count=len(padded))
        self.lengths = np.concatenate([self.lengths, lengths - (ORDER - 1)])

    def columns(self, column: pa.Array) -> list[pa.Array]:
        texts = [(t.as_py() or b"").split() for t in column]
        if len(self.values) > self.known_pieces:
            self._forget()
        self._learn([w for w in set().union(*texts) if w not in self.known])
        per_text = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        words = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(per_text.sum()))
        # Places of the words' pieces, and pieces of each text.
        n = self.first[words + 1] - self.first[words]
        before = np.concatenate([[0], np.cumsum(n)])
        places = np.repeat(self.first[words] - before[:-1], n) + np.arange(before[-1])
        ends = np.cumsum(per_text)
        rows = batch_features(self.values[places], self.lengths[places], before[ends] - before[ends - per_text])
        return [pa.array(row, pa.float64()) for row in rows]


def _score(model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _MODEL.get("name") != name:
            _MODEL.update(name=name, scorer=Scorer(GramValues(*model.value)))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                columns = _MODEL["scorer"].columns(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), *columns], ["id", "mark", *FEATURES])

    return run


def _cut(flush: int, flush_bytes: int = 1 << 25):
    """Texts in numbered chunks, each followed by rows with the distinct grams of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, words, held = TaskContext.get().partitionId() << 32, set(), 0
        names = ["chunk", "id", "mark", "text", "gram"]

        def gram_rows(kinds: list) -> Iterator[pa.RecordBatch]:
            seen = np.empty(0, dtype=np.uint64)
            for part in slices([p for w in words for p in pieces(w)]):
                characters, _ = grams(part)
                keys, first = np.unique(_tails(characters)[ORDER - 1], return_index=True)
                new = ~np.isin(keys, seen)
                seen = np.union1d(seen, keys)
                spellings = spelled(characters, first[new])
                nulls = [pa.nulls(len(spellings), kind) for kind in kinds]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(spellings), pa.int64()), *nulls, pa.array(spellings, pa.string())], names)

        kinds: list = []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in names[1:4]]
            texts, start = batch.column("text"), 0
            for place in range(batch.num_rows):
                text = texts[place].as_py() or b""
                words.update(text.split())
                held += len(text)
                full = len(words) >= flush or held >= flush_bytes
                if full or place == batch.num_rows - 1:
                    part = batch.slice(start, place + 1 - start)
                    start = place + 1
                    numbers, none = pa.array([chunk] * part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([numbers, *[part.column(c) for c in names[1:4]], none], names)
                if full:
                    yield from gram_rows(kinds)
                    chunk, words, held = chunk + 1, set(), 0
        if words:
            yield from gram_rows(kinds)

    return run


def _score_chunks():
    """Scores texts in the order of chunks, each chunk's grams with their values before its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, spellings, values, scorer = None, [], [], None
        for batch in batches:
            chunks, is_text = batch.column("chunk").to_numpy(), batch.column("gram").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(is_text.astype(np.int8)) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if start == end:
                    continue
                if chunks[start] != current:
                    current, spellings, values, scorer = chunks[start], [], [], None
                if not is_text[start]:
                    spellings.extend(batch.column("gram").slice(start, end - start).to_pylist())
                    values.append(batch.column("value").slice(start, end - start).to_numpy())
                    continue
                if scorer is None:
                    scorer = Scorer(GramValues(GramValues.names(spellings), np.concatenate([np.zeros(0), *values])))
                    spellings, values = [], []
                for first in range(start, end, 500):
                    part = batch.slice(first, min(500, end - first))
                    columns = scorer.columns(part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), *columns], ["id", "mark", *FEATURES])

    return run


def score_by_chunks(rows: DataFrame, counts: DataFrame, schema: str, chunk_words: int = 200_000) -> DataFrame:
    """Features of every row from counts of any size: texts are shuffled once, beside the values of their grams."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "mark", "text"))
    cut = stored(rows.mapInArrow(_cut(chunk_words), f"chunk long, {kinds}, gram string"), "toxicity-chunks")
    valued = cut.where("gram is not null").join(stored(gram_values(counts), "char-values"), "gram")
    texts = cut.where("gram is null").withColumn("value", F.lit(None).cast("double"))
    both = texts.unionByName(valued).repartition("chunk").sortWithinPartitions("chunk", F.col("gram").isNull())
    return both.mapInArrow(_score_chunks(), schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the last is the constant) of a ridge-penalised logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    id_column: str = "doc_id",
    label_column: str = "toxic",
    max_labelled: int = 50_000,
    most_grams: int = 1 << 20,
) -> DataFrame:
    """id, ``score`` and a hash of the text (``mark``) of every row of ``docs``.

    ``usable`` selects the rows of ``labels`` that may be learnt from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    known = labels.where(usable) if usable is not None else labels
    known = known.select(F.col(id_column).alias("id"), F.col(label_column).cast("boolean").alias("kind")).dropna()
    known = known.groupBy("id").agg(F.max("kind").alias("kind"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    sample = stored(sample.withColumn("fit", F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(MODELS + CALIBRATION)) >= MODELS), "labelled")
    # At most max_labelled rows of an id and two flags.
    counted = rows.join(F.broadcast(sample.where("not fit").drop("fit")), "id", "left").select("text", "kind")
    counts = counted.mapInArrow(_gather(), "gram string, n_all long, n_toxic long, n_plain long")
    counts = stored(counts.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n_all", "n_toxic", "n_plain")]), "char-counts")
    schema = f"id {docs.schema[id_column].dataType.simpleString()}, mark long, " + ", ".join(f"{f} double" for f in FEATURES)
    if counts.count() <= most_grams:
        model = counts.orderBy("gram").toArrow()  # at most ``most_grams`` rows
        spellings = model.column("gram").to_pylist()
        backoff = Backoff(spellings, *[model.column(c).to_numpy() for c in ("n_all", "n_toxic", "n_plain")])
        # The one gram that is scored but not counted is that of words of punctuation only. Sixteen bytes a gram.
        spellings.append("    \n")
        shared = spark.sparkContext.broadcast((GramValues.names(spellings), backoff.of_grams(backwards(spellings))))
        del model, backoff, spellings
        scored = rows.mapInArrow(_score(shared, uuid.uuid4().hex), schema)
    else:
        scored = score_by_chunks(rows, counts, schema)
    scored = stored(scored, "toxicity")
    fit = scored.join(F.broadcast(sample.where("fit")), "id").select(*FEATURES, F.col("kind").cast("int").alias("kind")).toArrow()
    y = fit.column("kind").to_numpy().astype(float)
    if len(np.unique(y)) == 2:
        x = np.column_stack([fit.column(f).to_numpy() for f in FEATURES])
        weights = fit_logistic(x, y)
    else:
        weights = np.array([0.0] * len(FEATURES) + [30.0 if len(y) and y[0] else -30.0])
    margin = sum((F.col(f) * float(w) for f, w in zip(FEATURES, weights, strict=False)), F.lit(float(weights[-1])))
    return scored.select(F.col("id").alias(id_column), "mark", (1.0 / (1.0 + F.exp(-margin))).alias("score"), *FEATURES)


def fold(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4
