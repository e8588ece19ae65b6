import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfspark.llm import queries
from shelfspark.llm.simhash import links, simhash, simhash_components

from odd_rows import LONG, ODD_ROWS


def plain_simhash(text, width=3):
    """The contract in plain Python."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    width = min(width, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + width]).encode(), seed=42).intdigest() for i in range(len(words) - width + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=2):
    """Smallest id of everything reachable, by comparing all pairs; ``prints`` are (id, unsigned fingerprint)."""
    values = sorted({f for _, f in prints})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    array = np.array(values, dtype=np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= bits).tolist():
            a, b = sorted((find(v), find(values[i + 1 + j])))
            root[b] = a
    lowest: dict = {}
    for i, f in prints:
        if i is not None:
            lowest[find(f)] = min(i, lowest.get(find(f), i))
    return {(i, f): lowest.get(find(f)) for i, f in prints}


signed = lambda v: v - (1 << 64) if v >> 63 else v


def test_fingerprints():
    texts = [t for _, t, _ in ODD_ROWS if t != LONG]
    texts += [" ".join(LONG.split()[:200]), "A b\tC d", "É é É x y", "a", "a b", "A B C", "z " * 40, None]
    for text in texts:
        for width in (1, 3):
            for piece in (1, 7, 500_000):
                assert simhash(None if text is None else text.encode(), width, piece) == signed(plain_simhash(text, width)), text


def families(rng, n):
    """Fingerprints in chains and clouds of few bits, some around equal segments."""
    out = [0, 1, 3, 7, 15, (1 << 64) - 1, 1 << 63, 1 << 63 | 1 << 31]
    while len(out) < n:
        base = rng.getrandbits(64) if rng.random() < 0.7 else rng.getrandbits(32) << rng.choice([0, 32])
        free = [rng.randrange(64) for _ in range(rng.choice([2, 4, 8]))]
        for _ in range(rng.randrange(1, 40)):
            out.append(base)
            step = base
            for b in rng.sample(free, min(len(free), rng.choice([1, 1, 2, 2, 3]))):
                step ^= 1 << b
            base = step
    return sorted(set(out))


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("crowd,few", [(256, 100_000), (3, 100_000), (0, 0)])
def test_no_link_is_lost(spark, bits, crowd, few):
    values = families(random.Random(7 + bits), 1500)
    # A crowd: many values with an equal segment, each way.
    rng = random.Random(1)
    values = sorted({*values, *[rng.getrandbits(10) << 3 | 5 << 40 for _ in range(300)], *[rng.getrandbits(9) << 40 | 77 for _ in range(200)]})
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long").repartition(3)
    found = [tuple(r) for r in links(nodes, bits, crowd, few).collect()]
    array = np.array(values, dtype=np.uint64)
    expected = set()
    for i in range(len(array)):
        near = np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= bits) + i + 1
        expected |= {tuple(sorted((signed(values[i]), signed(values[j])))) for j in near.tolist()}
    assert len(found) == len(set(found)) and set(found) == expected
    with pytest.raises(ValueError):
        links(nodes, 3)


@pytest.mark.parametrize("crowd", [256, 1])
def test_odd_rows(make, crowd):
    rows = [(i, " ".join(t.split()[:3000]) if t == LONG else t, s) for i, t, s in ODD_ROWS]
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(900)]
    for i in range(60):
        base[rng.randrange(900)] = "new"
        rows.append((100 + rng.randrange(50), " ".join(base), "s"))
    docs = make(rows).withColumns({"fingerprint": F.lit("f"), "component": F.lit(1), "copies": F.lit(2)})
    got = simhash_components(docs, crowd=crowd).collect()
    prints = [(i, plain_simhash(t)) for i, t, _ in rows]
    expected = plain_components(prints)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == sorted([(i, signed(f), expected[i, f]) for i, f in prints], key=str)
    assert len({r.component for r in got}) < len({f for _, f in prints})
    assert simhash_components(docs.limit(0)).count() == 0
    only_null = simhash_components(make([(None, "a b c", "s"), (None, "a b c", "s")])).collect()
    assert [(r.doc_id, r.component_id) for r in only_null] == [(None, None)] * 2


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op13_simhash(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = [(r.doc_id, plain_simhash(r.text)) for r in docs]
    expected = plain_components(prints)
    assert got == {i: (f"{f:016x}", expected[i, f]) for i, f in prints}
