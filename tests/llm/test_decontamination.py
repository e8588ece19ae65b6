import random

import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm.decontamination import BLOCK, PART, ItemIndex, benchmark_items, find_leaks, longest_run, words_of

from odd_rows import ODD_ROWS


def texts(seed, n, low, high):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to"]
    return [[rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(600)}" for _ in range(rng.randrange(low, high))] for _ in range(n)]


def test_pruning_loses_nothing():
    """Block-max retrieval equals scoring every passage against every part."""
    items = [(i, " ".join(w[:-3]), " ".join(w[-3:])) for i, w in enumerate(texts(1, 150, 5, 160))]
    index = ItemIndex(items)
    for k, words in enumerate(texts(2, 25, 1, 500)):
        words = words + words_of(items[k][1])[: 20 + k] + words[:30]
        words = [w if isinstance(w, bytes) else w.encode() for w in words]
        expected = {}
        for start in range(0, len(words), PART):
            terms = {index.vocabulary[w] for w in words[start : start + 2 * PART] if w in index.vocabulary}
            for block, (own, impacts) in enumerate(index.postings):
                scores = sum((row for t, row in zip(own.tolist(), impacts) if t in terms), np.zeros(BLOCK))
                for column, score in enumerate(scores):
                    if score >= 0.3:
                        item = int(index.owner[block * BLOCK + column])
                        expected[item] = max(expected.get(item, 0.0), score)
        got = {item: score for item, (score, _) in index.retrieve(words, 0.3).items()}
        assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-9 for i in got)


def test_planted_items(spark, make):
    rng = random.Random(5)
    items = [(i, " ".join(w) + ". Then " + " ".join(w[::-1][:6]) + ".") for i, w in enumerate(texts(3, 60, 15, 200))]
    rows, planted = [], set()
    for i, words in enumerate(texts(4, 120, 0, 700)):
        if i % 4 == 0:
            item = rng.randrange(len(items))
            at = rng.randrange(len(words) + 1)
            words = words[:at] + items[item][1].upper().split() + words[at:]
            planted.add((i, item))
        rows.append((i, "\n".join(words), "s"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = find_leaks(make(rows), benchmark_items(benchmark))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == planted
    assert found.where("question_overlap < 0.99").count() == 0
    blocks = find_leaks(make(rows), benchmark_items(benchmark), block_words=500)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == planted


def test_questions_and_answers(spark):
    rows = spark.createDataFrame([(1, "One two? Three four."), (2, "Only one"), (3, None), (4, "A b. C d.\nE f!")], "item_id long, text string")
    got = {r.item_id: (r.question, r.answer) for r in benchmark_items(rows).collect()}
    assert got == {1: ("One two?", "Three four."), 2: ("Only one", ""), 3: ("", ""), 4: ("A b. C d.", "E f!")}


def test_longest_run():
    assert longest_run(list("abcabd"), list("xxabdxabc")) == 3 and longest_run([], list("a")) == 0


def test_odd_rows(spark, make):
    benchmark = spark.createDataFrame([(1, "one two three four five six seven"), (1, None), (2, "")], "item_id long, text string")
    found = find_leaks(make(ODD_ROWS), benchmark_items(benchmark))
    assert sorted(str(r.doc_id) for r in found.collect()) == ["10", "9", "None"]
    assert find_leaks(make(ODD_ROWS), benchmark_items(benchmark.limit(0))).count() == 0
    assert find_leaks(make(ODD_ROWS).limit(0), benchmark_items(benchmark)).count() == 0
    assert found.where(F.col("answer_overlap").isNull()).count() == 3


def test_partial_leaks_of_everyday_words(spark, make):
    """A run of thirteen words is found even if it carries a small share of its item's score, and if two parts share it."""
    rng = random.Random(8)
    other = [(i, " ".join(w)) for i, w in enumerate(texts(6, 40, 30, 90))]
    common = "the of and to the and of to of the to and the".split()
    short = [f"rare{i}" for i in range(24)] + common + [f"rare{i}" for i in range(24, 48)]
    long = [f"long{i}" for i in range(200)]
    items = [*other, (100, " ".join(short)), (101, " ".join(long))]
    filler = [[f"z{rng.randrange(5000)}" for _ in range(300)] for _ in range(4)]
    rows = [(1, " ".join(filler[0] + common + filler[1]), "s")]
    rows += [(2 + k, " ".join(filler[2] + long[at : at + 13] + filler[3]), "s") for k, at in enumerate(range(0, 187, 11))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(make(rows), benchmark_items(benchmark)).collect()}
    assert found == {(1, 100)} | {(r[0], 101) for r in rows[1:]}


def test_nothing_verified_is_missed():
    """Candidates, thresholds and bounds lose no pair whose run of words or overlaps stand in one passage."""
    rng = random.Random(12)
    items = [(i, " ".join(w[:-k]), " ".join(w[len(w) - k :])) for i, w in enumerate(texts(13, 80, 6, 150)) for k in [rng.randrange(1, 5)]]
    index = ItemIndex(items)
    for i, (_, q, a) in enumerate(items):
        own = words_of(q) + words_of(a)
        at = rng.randrange(len(own))
        piece = own[at : at + rng.choice([13, 20, 40])] if i % 2 else own[: len(own) // 2 + 5] + own[-6:]
        words = [b"z"] * rng.randrange(200) + piece[:60] + [b"z"] * 100
        got = {m[0] for m in index.leaks(words, 0.3)}
        expected = set()
        for item in range(len(items)):
            for start in range(0, len(words), PART):
                q_share, a_share, longest = index.verify(item, words, start)
                if (q_share >= 0.5 and a_share >= 0.5) or longest >= 13:
                    expected.add(item)
        assert got == expected


def test_copy_behind_scattered_words(spark, make):
    """A passage that holds an item's words out of order does not hide the copy elsewhere in the text."""
    rng = random.Random(9)
    item = [f"q{i}" for i in range(30)]
    shuffled = sorted(item, key=lambda w: rng.random())
    filler = [f"z{i}" for i in range(400)]
    rows = [(1, " ".join(shuffled + filler + item), "s"), (2, " ".join(shuffled + filler + item[:20]), "s"), (3, " ".join(shuffled + filler), "s")]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, "nothing of this stands in any text")], "item_id long, text string")
    found = find_leaks(make(rows), benchmark_items(benchmark)).collect()
    assert sorted((r.doc_id, r.item_id, r.longest_run) for r in found) == [(1, 7, 30), (2, 7, 20)]
    assert all(r.start_word > 300 for r in found)


def test_bounds_in_long_texts():
    """The error of the bounds does not grow with the text: a score at the threshold is found behind 320,000 words."""
    item = [f"q{i}".encode() for i in range(60)]
    index = ItemIndex([(1, " ".join(w.decode() for w in item), "")])
    for k in range(8):
        words = (item[:54] + [b"z"] * (PART - 54)) * 5000 + [b"z"] * 2 * PART + item[: 55 + k % 4] + [b"z"] * k
        score = float(sum(index.postings[0][1][index.vocabulary[w], 0] for w in item[: 55 + k % 4]))
        assert 0 in index.retrieve(words, score)
