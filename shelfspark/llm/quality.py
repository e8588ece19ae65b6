"""Quality rules with risk-controlled thresholds.

A fixed set of base rules comes first. Beyond it every document gets a badness score from its counts, and each stratum a
cutoff above which documents are rejected. Cutoffs are chosen on labelled rows, so that, with probability
``1 - delta`` over all strata at once, the cutoff of every stratum rejects at most the share ``risk`` of its good documents:

* for each candidate cutoff the hypothesis "it rejects more than ``risk`` of the good ones" is tested exactly: with k of
  n good labelled documents rejected, its p-value is P(Binomial(n, risk) <= k);
* the cutoffs of a stratum form an ordered family, from the most lenient on: testing goes on to the next stricter one as
  long as each was proven at level ``delta / strata`` (fixed sequence within a stratum, Bonferroni between strata);
* the strictest proven cutoff that still rejects a labelled bad document is taken; with none proven, nothing is rejected.

Cases. Null texts have no words and fail the base rules. Rows without label take no part in the choice; a label of null
neither. Rows that repeat are judged one by one. A null stratum is a stratum of its own. With empty tables the result is
empty, without labels nothing but the base rules rejects. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import stored, window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long"
#: Candidate cutoffs of the badness score, fixed beforehand, most lenient first.
CUTOFFS = tuple(round(1.0 - 0.05 * i, 2) for i in range(1, 20))


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur at least twice in the text."""
    windows = window_hashes(hashes, width)
    if len(windows) < 2:
        return 0
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    edges[starts] += 1
    edges[starts + width] -= 1
    return int(np.count_nonzero(np.cumsum(edges[:-1]) > 0))


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """The counts of one text, in the order of ``COUNTS``."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    letters = text.translate(None, _SPACE)
    # Every code point has one byte that does not continue another.
    points = len(letters) - int(np.count_nonzero((np.frombuffer(letters, np.uint8) & 0xC0) == 0x80))
    symbols = len(letters) - len(letters.translate(None, SYMBOLS))
    upper = len(letters) - len(letters.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    seen: set[bytes] = set()
    repeats = 0
    for line in text.split(b"\n"):
        if line.strip(_SPACE):
            repeats += line in seen
            seen.add(line)
    return len(words), points, symbols, repeats, repeated_words(word_hashes(words)), upper


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in COUNTS.split(", ")]
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            rows = [text_counts(t) for t in part.column("text").to_pylist()]
            counted = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("stratum"), *counted], ["id", "stratum", *names])


def badness() -> Column:
    """Score from 0 to 1 of the document's counts, the largest of several shares; rising in each of them."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    shares = [
        F.col("n_symbols") / words,
        F.col("n_repeat_words") / words,
        F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        F.lit(1.0) - F.least(F.col("n_words") / 40.0, F.lit(1.0)),
    ]
    return F.greatest(F.lit(0.0), *[F.least(s, F.lit(1.0)) for s in shares])


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed from exact log probabilities."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def proven(n_good: int, false: Sequence[int], level: float, risk: float) -> int:
    """How many cutoffs, from the most lenient on, are proven; the first that is not ends the sequence."""
    for place, k in enumerate(false):
        # Far above the mean the p-value is near 1: no need to sum.
        if n_good == 0 or k > n_good * risk or binomial_cdf(k, n_good, risk) > level:
            return place
    return len(false)


def choose_cutoffs(labelled: DataFrame, risk: float, delta: float, cutoffs: Sequence[float] = CUTOFFS) -> DataFrame:
    """(stratum, cutoff, n_good) for every stratum with a proven cutoff, from (stratum, quality, badness)."""
    good = F.col("quality") == 1
    sums = [F.sum((good & (F.col("badness") > c)).cast("long")).alias(f"good_{i}") for i, c in enumerate(cutoffs)]
    caught = [F.sum((~good & (F.col("badness") > c)).cast("long")).alias(f"bad_{i}") for i, c in enumerate(cutoffs)]
    table = labelled.groupBy("stratum").agg(F.sum(good.cast("long")).alias("n_good"), *sums, *caught)
    table = stored(table, "strata")
    level = delta / max(1, table.count())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for row in rows:
                n = proven(row["n_good"], [row[f"good_{i}"] for i in range(len(cutoffs))], level, risk)
                # A stricter cutoff that catches no further bad document is not worth its false rejections.
                useful = [i for i in range(n) if row[f"bad_{i}"] > (row[f"bad_{i - 1}"] if i else 0)]
                if useful:
                    out.append((row["stratum"], float(cutoffs[useful[-1]]), row["n_good"]))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int64()), strict=True)],
                ["stratum", "cutoff", "n_good"],
            )

    return table.mapInArrow(choose, "stratum string, cutoff double, n_good long")


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    stratum_column: str = "lang",
    min_words: int = 10,
    repeat_percent: int = 20,
    risk: float = 0.02,
    delta: float = 0.1,
) -> DataFrame:
    """Counts, base verdict, badness, cutoff and final verdict of every row of ``docs``."""
    text = docs.select(
        F.col(id_column).alias("id"), F.col(stratum_column).cast("string").alias("stratum"), F.col("text").cast("binary").alias("text")
    )
    id_type = docs.schema[id_column].dataType.simpleString()
    counts = text.mapInArrow(_count, f"id {id_type}, stratum string, {COUNTS}")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    counts = stored(counts.withColumns({"base_failed": failed, "badness": badness()}), "text-counts")
    verdicts = labels.select(F.col(id_column).alias("id"), F.col("quality")).where("quality is not null").distinct()
    # The rules stand behind the base rules, so they are judged on what those let through.
    cutoffs = stored(choose_cutoffs(counts.where("not base_failed").join(verdicts, "id"), risk, delta), "cutoffs")
    named = cutoffs.withColumnRenamed("stratum", "_stratum")
    small = cutoffs.count() <= 100_000
    rows = counts.join(F.broadcast(named) if small else named, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    over = F.coalesce(F.col("badness") > F.col("cutoff"), F.lit(False))
    kept = ~F.col("base_failed") & ~over
    return rows.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", kept.alias("kept"), "stratum", "badness", "cutoff",
    )
