import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import queries
from shelfspark.llm.common import mix64
from shelfspark.llm.periodic_runs import (
    extend, find_periodic_runs, proposals, sliding_min, stretches, synchronising, text_runs, with_planted_period,
)

from odd_rows import LONG, ODD_ROWS


def brute(words, exponent=4, least=6):
    """All runs by comparing words at every distance."""
    found = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            start, stop = i, j + q
            if stop - start >= max(least, exponent * q):
                if not any(all(words[k] == words[k + p] for k in range(start, stop - p)) for p in range(1, q)):
                    found.append((start, stop - start, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    drop = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def random_words(rng):
    """Texts of few different words with periods inside periods, copies and single changes."""
    kind = rng.randrange(6)
    alphabet = "abcdefghij"[: rng.choice([1, 2, 3, 10])]
    make = lambda n: [rng.choice(alphabet) for _ in range(n)]
    if kind == 0:
        return make(rng.randrange(0, 200))
    if kind == 1:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randrange(1, 11)):
            a, b = b, b + a
        return b * rng.choice([1, 1, 5])
    out = make(rng.randrange(0, 30))
    for _ in range(rng.randrange(1, 5)):
        base = make(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 40]))
        if kind == 3:  # a period made of periods
            base = base * rng.randrange(2, 7) + make(rng.randrange(0, 9))
        length = int(len(base) * rng.choice([3, 3.9, 4, 4, 4.1, 5, 7.5]))
        part = (base * 8)[:length]
        if kind == 4 and part:
            part[rng.randrange(len(part))] = "x"
        out += part + make(rng.randrange(0, 12))
    return out


@pytest.mark.parametrize("direct", [1, 2, 8, 32])
def test_all_runs_are_found(direct):
    rng = random.Random(direct)
    texts = [random_words(rng) for _ in range(400)]
    got = list(text_runs([" ".join(t).encode() for t in texts], 4, 6, direct))
    for words, (runs, kept) in zip(texts, got, strict=True):
        expected = brute(words)
        assert runs == expected, " ".join(words)
        assert kept.decode() == collapsed(words, expected)


def test_greater_exponents_and_lengths():
    rng = random.Random(5)
    texts = [random_words(rng) for _ in range(100)]
    got = list(text_runs([" ".join(t).encode() for t in texts], 6, 20))
    assert [r for r, _ in got] == [brute(t, 6, 20) for t in texts]


def test_positions_are_consistent_and_dense():
    """Equal contexts are chosen alike, and every gap longer than the scale lies in a highly periodic region."""
    rng = random.Random(2)
    for scale in (4, 8, 16):
        w = []
        while len(w) < 3000:
            base = [rng.randrange(3) for _ in range(rng.choice([1, 2, 3, 50]))]
            w += base * rng.choice([1, 2, 30]) + [rng.randrange(50) for _ in range(rng.randrange(20))]
        w = np.array(w)
        names: dict = {}
        at = lambda i, n: tuple(w[i : i + n].tolist())
        period = lambda t: next(p for p in range(1, len(t) + 1) if t[p:] == t[:-p] or p == len(t))
        ids = np.array([names.setdefault(at(i, scale), len(names)) for i in range(len(w) - scale + 1)], dtype=np.uint64)
        periodic = np.array([4 * period(at(i, scale)) <= scale for i in range(len(ids))])
        chosen = synchronising(mix64(ids), scale, periodic)
        held, by_context = set(chosen.tolist()), {}
        for i in range(len(w) - 2 * scale + 1):
            by_context.setdefault(at(i, 2 * scale), set()).add(i in held)
        assert all(len(v) == 1 for v in by_context.values())
        for a, b in zip(chosen, chosen[1:]):
            assert b - a <= scale or 4 * period(at(a + 1, 3 * scale - 1)) <= scale
        pairs = proposals(chosen, np.array([hash(at(i, 2 * scale)) for i in chosen]), scale)
        assert all(at(i, 2 * scale) == at(i + d, 2 * scale) and scale <= d < 2 * scale for d, i in pairs)


def test_parts():
    x = np.array([5, 3, 9, 1, 7, 7, 2], dtype=np.uint64)
    for width in range(1, 8):
        assert sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]
    w = np.array([9, 1, 2, 1, 2, 1, 2, 1, 2, 8])
    assert stretches(w, 2, 8) == [(1, 9)] and stretches(w, 2, 9) == []
    assert {extend(w, at, 2, step) for at in range(1, 7) for step in (1, 2, 50)} == {(1, 9)}


@pytest.mark.parametrize("block", [1, 400_000])
def test_odd_rows(make, block):
    rows = [*ODD_ROWS, (20, "a b " * 5000 + LONG + " " + "q " * 7, "a"), (21, "É é x É é x É é x É é x", "b")]
    docs = make(rows).withColumns({"runs": F.lit(1), "collapsed": F.lit("c"), "_text": F.lit("t")})
    got = find_periodic_runs(docs, ["doc_id", "source"], block=block).collect()
    plain = lambda t: (t or "").encode().split()
    expected = []
    for key, text, source in rows:
        runs = [(0, 10_000, 2), (40_000, 7, 1)] if key == 20 else brute(plain(text)) if len(text or "") < 1000 else []
        expected.append((key, source, runs, collapsed([x.decode() for x in plain(text)], runs)))
    assert sorted([(r.doc_id, r.source, [tuple(x) for x in r.runs], r.collapsed) for r in got], key=str) == sorted(expected, key=str)
    assert find_periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_periodic_runs(docs, exponent=3)


def planted(doc_id, text):
    """The contract's input words."""
    words = [w.decode() for w in (text or "").encode().split()]
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{i}x{k * k % 97}" for k in range(i % 90))) for i in range(300)] + [(None, "a b"), (10, None), (11, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = with_planted_period(F.col("text"), F.crc32(F.col("doc_id").cast("string")))
    got = sorted([(r.doc_id, (r.t or "").split()) for r in docs.select("doc_id", text.alias("t")).collect()], key=str)
    assert got == sorted([(i, planted(i, t)) for i, t in rows], key=str)
    assert sum(planted(i, t) != (t or "").split() for i, t in rows) > 10


def test_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(random_words(rng) if i % 3 else [f"w{rng.random()}" for _ in range(rng.randrange(300))])) for i in range(240)]
    rows += [(1000, None), (1001, ""), (1002, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.asDict() for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc_id, text in rows:
        words = planted(doc_id, text)
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        assert got[doc_id] == {
            "doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": best[1] and 1000 * best[1] // best[2], "runs_sha256": sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
            "collapsed_sha256": sha(collapsed(words, runs)),
        }
