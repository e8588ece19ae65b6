"""Token counts through a digest cache.

The cache is a table (content digest, tokenizer digest, n_tokens). Documents are joined with it by the digests of their
normalised content and of the tokenizer file; only one document of each missing content is encoded, and its count is
appended. Texts are shuffled only when neither the missing nor the other documents are few, and then by document, so
copies make no hot key.

Encoding: white space is dropped by the tokenizer and no token spans it, so a text is cut there into pieces; each
distinct piece of a batch is encoded once, all new pieces of a batch in one call, and the counts are added up. Counts of
pieces are kept in the Python worker up to ``PIECES`` entries. Long texts need no more memory than their pieces.

Cases. Null and empty texts have no bytes and no tokens. Equal texts, and rows that repeat, share one cache entry. A
null id is a value like any other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import stored

PIECES = 400_000
#: At most so many (id, hash) pairs of sixteen bytes are broadcast.
FEW = 1_000_000
CACHE = "content string, tokenizer string, n_tokens long"
_PUNCTUATION = b".,"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def collapsed(text: Column) -> Column:
    """Normal form for tokenizers that drop white space: runs of ASCII white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


class PieceCounter:
    """Token counts of texts for a tokenizer that splits at white space and drops it."""

    def __init__(self, path: str, pieces: int = PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = pieces
        self.known: dict[bytes, int] = {}

    def learn(self, pieces: list[bytes]) -> None:
        """Encode pieces of a few hundred KB at a time, joined by spaces, and tell their tokens apart by offset."""
        start = 0
        while start < len(pieces):
            end, size = start, 0
            while end < len(pieces) and (size < 200_000 or end == start):
                size += len(pieces[end]) + 1
                end += 1
            texts = [p.decode("utf-8", "replace") for p in pieces[start:end]]
            begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
            encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            at = np.searchsorted(begins, [a for a, _ in encoded.offsets], side="right") - 1
            self.known.update(zip(pieces[start:end], np.bincount(at, minlength=len(texts)).tolist(), strict=True))
            start = end

    @staticmethod
    def halves(piece: bytes) -> tuple[bytes, ...]:
        """A word and the full stops or commas after it are encoded apart, as the tokenizer itself cuts there."""
        word = piece.rstrip(_PUNCTUATION)
        if word and len(word) < len(piece) and word[-1:].isalnum():
            return word, piece[len(word) :]
        return (piece,)

    def count(self, texts: list[bytes]) -> list[int]:
        counters = [Counter(t.split()) for t in texts]
        if len(self.known) > self.most:
            self.known = {}
        known, new = self.known, {}
        for counter in counters:
            for piece in counter:
                if piece not in known:
                    for half in self.halves(piece):
                        if half not in known:
                            new[half] = True
        self.learn(list(new))
        out = []
        for counter in counters:
            total = 0
            for piece, times in counter.items():
                n = known.get(piece)
                if n is None:
                    n = known[piece] = sum(known[h] for h in self.halves(piece))
                total += n * times
            out.append(total)
        return out


_COUNTERS: dict[str, PieceCounter] = {}


def _encode(path: str, rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.setdefault(path, None) or PieceCounter(path)
        _COUNTERS[path] = counter
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                counts = counter.count(part.column("content_text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return run


def _chosen(texts: DataFrame, keys: DataFrame, missing: DataFrame) -> DataFrame:
    """content and content_text of the documents that stand for the missing contents.

    Either those documents or all the others are named to every task when they are few; else the texts are shuffled.
    """
    rows = texts.withColumn("content", F.sha2(F.col("content_text").cast("binary"), 256)).withColumn("_mark", F.xxhash64("content"))
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_mark") == F.col("mark"))
    n_missing = missing.count()
    if n_missing > FEW and keys.count() - n_missing <= FEW:
        marked = keys.withColumn("mark", F.xxhash64("content"))
        others = marked.join(missing.select(F.col("id").alias("_id"), F.col("mark").alias("_mark")), same, "left_anti")
        rows = rows.join(F.broadcast(others.select("id", "mark").distinct()), same, "left_anti")
    else:
        wanted = missing.select("id", "mark")
        rows = rows.join(F.broadcast(wanted) if n_missing <= FEW else wanted.hint("shuffle_hash"), same, "left_semi")
    return rows.select("content", "content_text")


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, id_column: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_tokens of every row; counts of contents that the cache lacks are added to it.

    ``tokenizer_path`` must be readable on every executor and name a tokenizer that splits at white space and drops it.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(collapsed(F.col("text")).cast("binary"), 256)
    keys = docs.select(F.col(id_column).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("content"))
    keys = stored(keys, "token-keys")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    held = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version).select("content")
    missing = keys.join(held.distinct(), "content", "left_anti").groupBy("content").agg(F.min("id").alias("id"))
    missing = stored(missing.withColumn("mark", F.xxhash64("content")), "to-encode")
    texts = _chosen(docs.select(F.col(id_column).alias("_id"), collapsed(F.col("text")).alias("content_text")), keys, missing)
    encoded = texts.select("content", F.col("content_text").cast("binary").alias("content_text")).mapInArrow(
        _encode(tokenizer_path), "content string, n_tokens long"
    )
    encoded.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version)
    counts = counts.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(counts, "content").select(F.col("id").alias(id_column), "n_bytes", "n_tokens")
