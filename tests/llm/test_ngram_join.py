import random

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm import ngram_join
from shelfspark.llm.common import shingle_set
from shelfspark.llm.ngram_join import Bands, _groups, components, cross_pairs, differing, frequent_shingles, link_components, merged, sketch, verify

from odd_rows import LONG, ODD_ROWS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """(id, set size, smallest reachable id) by comparing all pairs."""
    sets = []
    for _, text, *_ in rows:
        words = (text or "").translate(LOWER).encode().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()})
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    members = {}
    for i, row in enumerate(rows):
        members.setdefault(find(i), []).append(row[0])
    lowest = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    key = lambda t: tuple((x is None, x or 0) for x in t)
    return sorted(((r[0], len(sets[i]), lowest[find(i)]) for i, r in enumerate(rows)), key=key)


def result(docs):
    rows = [tuple(r)[:3] for r in link_components(docs).select("doc_id", "n_shingles", "component_id").collect()]
    return sorted(rows, key=lambda t: tuple((x is None, x or 0) for x in t))


def changed(words, rng, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in words]


def test_linked_sets_share_a_signature():
    """Pairs at the very edge of the similarity, of all sizes and size differences."""
    rng = np.random.default_rng(1)
    for percent in (75, 90):
        bands = Bands(percent, np.sort(rng.integers(0, 2**64, 10, dtype=np.uint64)))
        for size in [*range(1, 60), 100, 177, 178, 179, 400, 1500]:
            for _ in range(6):
                common = int(rng.integers(max(1, size // 2), size + 1))
                others = common * 100 // percent - common  # how many more elements the union may have
                left = int(rng.integers(0, others + 1))
                values = rng.integers(0, 2**63, common + others, dtype=np.uint64) * np.uint64(2)
                a = np.unique(values[: common + left])
                b = np.unique(np.concatenate([values[:common], values[common + left :]]))
                both = len(np.intersect1d(a, b))
                assert 100 * both >= percent * (len(a) + len(b) - both)
                assert len(np.intersect1d(bands.signatures(a), bands.signatures(b))), (percent, len(a), len(b))


def test_thin_sets_share_a_signature():
    """Sets whose shingles crowd in few parts must not lose their common signature either."""
    rng = np.random.default_rng(2)
    for i in range(300):
        n = int(rng.integers(4, 80))
        base = np.unique(rng.integers(0, 2**50, n, dtype=np.uint64) + rng.integers(0, 3, n, dtype=np.uint64) * np.uint64(2**62))
        drop = len(base) // 7
        other = np.unique(np.append(base[drop:], rng.integers(0, 2**64, drop // 2, dtype=np.uint64)))
        both = len(np.intersect1d(base, other))
        # Frequent shingles, here those of one set, of half of it, or none, may not cost a link either.
        bands = Bands(75, (base, base[::2], base[:0])[i % 3])
        if 100 * both >= 75 * (len(base) + len(other) - both):
            assert len(np.intersect1d(bands.signatures(base), bands.signatures(other)))


def test_against_all_pairs(spark, make):
    rng = random.Random(7)
    rows, at = [], 0
    for family in range(40):
        words = [f"f{family}w{rng.randrange(200)}" for _ in range(rng.choice([1, 3, 5, 8, 20, 60, 200]))]
        passage = "a passage that very many of the texts have in common word by word".split()
        for _ in range(rng.randrange(1, 8)):
            text = changed(words, rng, rng.choice([0, 0.01, 0.03, 0.06]))
            if family % 3 == 0:
                text = text + passage
            rows.append((at, " ".join(text).upper() if at % 5 == 0 else "\n".join(text), "s"))
            at += 1
    rng.shuffle(rows)
    assert result(make(rows)) == plain(rows)


def test_chain_of_near_copies(spark, make):
    """A large group in which neighbours are similar and the ends are not."""
    words = [f"w{i}" for i in range(400)]
    rows = [(500 - i, " ".join(words[i : i + 120]), "s") for i in range(0, 260, 4)]
    rows += [(1000 + i, " ".join(words[:60]) + " " + " ".join(f"u{i}x{k}" for k in range(80)), "s") for i in range(80)]
    assert result(make(rows)) == plain(rows)


def test_odd_rows(spark, make):
    assert result(make(ODD_ROWS)) == plain(ODD_ROWS)
    assert result(make(ODD_ROWS).limit(0)) == []
    assert len(shingle_set(LONG.encode().split())) > 9_000


@pytest.mark.parametrize("most", [2, 500_000])
def test_groups_over_batches(most):
    rng = random.Random(3)
    rows = sorted({(rng.randrange(40), rng.randrange(30)) for _ in range(400)} | {(99, n) for n in range(300)})
    rows = sorted(rows + rows[:50])
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 17])], ["signature", "node"]) for i in range(0, len(rows), 17)
    ]
    got = {}
    for batch in _groups(most)(iter(batches)):
        for name, node, leader in zip(*(c.to_pylist() for c in batch.columns[:3])):
            got.setdefault((name, leader), set()).add(node)
    expected = {}
    for signature, node in rows:
        expected.setdefault(signature, set()).add(node)
    found = {frozenset(v) for v in got.values()}
    assert found == {frozenset(v) for v in expected.values() if len(v) > 1} and all(k[1] == min(v) for k, v in got.items())


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 60), (-5, 60), (70, 71)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys((50, 40, 60, -5), -5), 70: 70, 71: 70}
    assert components(links.limit(0)).count() == 0


def test_frequent_shingles_cover_all_sets(spark):
    """Counted over distinct sets, whatever tasks hold them, and not over copies."""
    common, other = np.arange(10, dtype=np.uint64), np.arange(100, 104, dtype=np.uint64)
    sets = [(8 * i, np.append(common, np.uint64(1000 + i)).tobytes()) for i in range(4)]
    sets += [(80, other.tobytes())] * 50  # one set that stands in many tasks
    sets += [(8 * i + 1, np.append(other, np.uint64(2000 + i)).tobytes()) for i in range(20)]  # not among those counted
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(sets)], "place long, node long, marks binary").repartition(7)
    places = rows.groupBy("node").agg({"place": "min"}).toDF("node", "place")
    assert frequent_shingles(rows, places).tolist() == list(range(10))
    assert frequent_shingles(rows, places, every=1).tolist() == [*range(10), *range(100, 104)]
    assert len(frequent_shingles(rows, places, most=3)) == 3
    assert not len(frequent_shingles(rows.limit(0), places))


@pytest.mark.parametrize("small_rows", [0, 400_000])
def test_sets_are_compared_exactly(spark, small_rows):
    """Both ways to bring the sets to their pairs."""
    marks = {1: range(75), 2: range(100), 3: range(26, 101), 4: range(74)}
    sets = spark.createDataFrame([(n, 10 * n, np.array(m, dtype=np.uint64).tobytes()) for n, m in marks.items()], "node long, place long, marks binary")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (1, 4), (1, 3)], "a long, b long")
    found = verify(pairs, sets, sets.select("node", "place"), 75, hub_rows=1, small_rows=small_rows)
    assert sorted((r.a, r.b) for r in found.collect()) == [(1, 2), (1, 4)]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for size in (1, 5, 300, 511, 513, 1500, 9000):
        for other in (1, size, size * 5 // 4, 3 * size):
            common = min(size, other) * 3 // 4
            values = rng.integers(0, 2**64, size + other, dtype=np.uint64)
            a, b = np.unique(values[:size]), np.unique(np.append(values[:common], values[size : size + other - common]))
            bits = differing(sketch(a), sketch(b))
            assert bits == differing(sketch(b), sketch(a)) <= len(np.setxor1d(a, b)) and bits % 2 == len(np.setxor1d(a, b)) % 2
            assert not differing(sketch(a), sketch(a))


def test_nearly_similar_sets_are_crossed_once(spark, monkeypatch):
    """Sets a little less similar than asked, in forty groups together: one row each arrives, and only linked pairs leave."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 390, dtype=np.uint64)
    marks = [np.unique(np.append(base[rng.random(390) < 0.8], rng.integers(0, 2**64, 78, dtype=np.uint64))) for _ in range(60)]
    marks[41] = np.unique(np.append(marks[40][20:], base[:20]))
    classes = spark.createDataFrame([(i, len(m), sketch(m)) for i, m in enumerate(marks)], "node long, n long, cells binary")
    rows = [(g, i, i, 0) for g in range(40) for i in range(60) if i < 3 or (i + g) % 7]
    rows = spark.createDataFrame(rows, "name long, node long, label long, main long")
    found = {(r.a, r.b) for r in cross_pairs(rows, classes, 75).collect()}
    both = {(i, j): len(np.intersect1d(marks[i], marks[j])) for i in range(60) for j in range(i + 1, 60)}
    links = {p for p, n in both.items() if 100 * n >= 75 * (len(marks[p[0]]) + len(marks[p[1]]) - n)}
    assert (40, 41) in links and links <= found and len(found) < 30

    def arriving(percent):
        def run(batches):
            for k, batch in enumerate(batches):
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(range(k << 32, (k << 32) + batch.num_rows), pa.int64())], ["a", "b"])

        return run

    monkeypatch.setattr(ngram_join, "_cross", arriving)
    assert cross_pairs(rows, classes, 75).count() <= 2 * 60 + 60  # about two thousand with one meeting per group


def test_merged_labels(spark):
    known = components(spark.createDataFrame([(1, 2), (2, 3), (7, 8), (10, 11)], "a long, b long"))
    links = spark.createDataFrame([(3, 8), (8, 20), (20, 21), (0, 11), (30, 31), (1, 3)], "a long, b long")
    got = {r.node: r.label for r in merged(known, links).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 7, 8, 20, 21), 1), **dict.fromkeys((0, 10, 11), 0), 30: 30, 31: 30}
    assert {r.node: r.label for r in merged(known, links.limit(0)).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 10: 10, 11: 10}


@pytest.mark.parametrize("most", [3, 100])
def test_lone_signatures_stay_behind(most):
    packed = [(0, [5, 6], [2, 1], [1, 2, 1]), (0, [7], [2], [3, 2**32 - 1]), (1, [5], [1], [9]), (3, [8], [2], [2**32 - 1, 4]), (3, [9], [2], [4, 2**32 - 1])]
    names = ["slice", "nodes", "counts", "signatures"]
    rows = [(s, np.array(n, np.int64).tobytes(), np.array(c, np.uint32).tobytes(), np.array(v, np.uint32).tobytes()) for s, n, c, v in packed]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 2])], names) for i in range(0, len(rows), 2)]
    got = sorted((v, n) for b in ngram_join._unpacked(most)(iter(batches)) for v, n in zip(*(c.to_pylist() for c in b.columns)))
    number = lambda piece, v: (int(np.uint32(v).view(np.int32)) << 24) | piece
    kept = [(number(0, 1), 5), (number(0, 1), 6), (number(3, -1 % 2**32), 8), (number(3, -1 % 2**32), 9), (number(3, 4), 8), (number(3, 4), 9)]
    alone = [(number(0, 2), 5), (number(0, 3), 7), (number(0, -1 % 2**32), 7)]  # a slice too long to look at as a whole
    assert got == sorted(kept + alone * (most == 3))


@pytest.mark.parametrize("most", [50, 8_000_000])
def test_slices_are_grouped_in_one_python_step(spark, monkeypatch, most):
    rng = random.Random(11)
    family = [rng.getrandbits(64) for _ in range(60)]
    sets = [np.array(sorted({*rng.sample(family, 57), rng.getrandbits(64)}), np.uint64) for _ in range(40)]
    sets += [np.array(sorted(rng.getrandbits(64) for _ in range(30)), np.uint64) for _ in range(40)]
    rows = spark.createDataFrame([(n - 40, s.tobytes()) for n, s in enumerate(sets)], "node long, marks binary")
    plans, plain_stored = [], ngram_join.stored

    def watched(df, name, *options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain_stored(df, name, *options)

    monkeypatch.setattr(ngram_join, "stored", watched)
    frequent = spark.sparkContext.broadcast(np.empty(0, np.uint64))
    got = {}
    for r in ngram_join.signature_groups(rows, 75, 2, frequent, most).collect():
        got.setdefault((r.name, r.leader, r.size), set()).add(r.node)
    expected = {}
    for n, marks in enumerate(sets):
        for value in set(Bands(75).signatures(marks).tolist()):
            expected.setdefault(value, set()).add(n - 40)
    expected = {frozenset(v) for v in expected.values() if len(v) > 1}
    assert len(expected) > 10 and {frozenset(v) for v in got.values()} == expected
    assert all(leader == min(v) and size == len(v) for (_, leader, size), v in got.items())
    assert len(plans) == 1 + (most == 50)
    for plan in plans:  # tasks between two shuffles take no more than one Python worker each
        assert all(part.count("MapInArrow") <= 1 for part in plan.split("Exchange"))


def test_a_pass_too_long_is_left_to_the_sort():
    values, nodes = np.array([8, 8, 16, 3, 3, 5], np.uint32), np.array([4, 9, 2, 4, 9, 7], np.int64)
    columns = [pa.array([0]), *(pa.array([x.tobytes()]) for x in (nodes, np.ones(6, np.uint32), values))]
    batch = pa.RecordBatch.from_arrays(columns, ["slice", "nodes", "counts", "signatures"])

    def rows(longest):
        return [r for b in ngram_join._unpacked(grouped=True, longest=longest)(iter([batch])) for r in b.to_pylist()]

    assert sorted((r["node"], r["leader"], r["size"], r["signature"]) for r in rows(2)) == [(4, 4, 2, None)] * 2 + [(9, 4, 2, None)] * 2
    assert sorted((r["signature"] >> 24, r["node"], r["name"]) for r in rows(1)) == [(3, 4, None), (3, 9, None), (8, 4, None), (8, 9, None)]


@pytest.mark.parametrize("limit", ["10000", "0", "70"])
def test_texts_reach_python_in_small_batches(spark, make, monkeypatch, limit):
    key, nodes = "spark.sql.execution.arrow.maxRecordsPerBatch", ngram_join._nodes
    most = min(int(limit) or 10000, 1000)

    def arriving(*args):
        def run(batches):
            def seen():
                for batch in batches:
                    assert batch.num_rows <= most
                    yield batch

            yield from nodes(*args)(seen())

        return run

    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        docs = make([(i, f"a{i} b{i} c{i} d{i} e{i}", "s") for i in range(4000)]).coalesce(1)
        monkeypatch.setattr(ngram_join, "_nodes", arriving)
        assert link_components(docs).where("component_id = doc_id AND n_shingles = 1").count() == 4000
        assert spark.conf.get(key) == limit
    finally:
        spark.conf.set(key, before)
