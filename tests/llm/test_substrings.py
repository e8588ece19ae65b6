import random

import pytest
from pyspark.sql import functions as F

from shelfspark.llm.substrings import remove_repeated_substrings

from odd_rows import ODD_ROWS


def plain(rows, width):
    first = {}
    texts = [(k, (t or "").encode().split()) for k, t, *_ in rows]
    place = lambda k: 2**63 if k is None else k
    for key, words in texts:
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            first[window] = min(place(key), first.get(window, place(key)))
    out = []
    for key, words in texts:
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < place(key):
                gone.update(range(i, i + width))
        out.append((key, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def result(docs, **options):
    rows = [(r[0], r[1], r[2], bytes(r[3])) for r in remove_repeated_substrings(docs, **options).collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("max_cells", [1 << 29, 1 << 4])
def test_against_plain(spark, make, max_cells):
    rng = random.Random(4)
    passages = [[f"p{i}w{k}" for k in range(rng.choice([12, 13, 14, 40]))] for i in range(6)]
    rows = []
    for i in range(250):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages) if rng.random() < 0.4 else [f"u{rng.randrange(40)}" for _ in range(rng.randrange(20))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words), "s"))
    rng.shuffle(rows)
    assert result(make(rows), max_cells=max_cells) == plain(rows, 13)


def test_odd_rows(spark, make):
    assert result(make(ODD_ROWS)) == plain(ODD_ROWS, 13)
    assert result(make(ODD_ROWS), width=5) == plain(ODD_ROWS, 5)
    assert result(make(ODD_ROWS).limit(0)) == []


def test_very_common_passage_over_many_batches(spark, make):
    passage = " ".join(f"c{i}" for i in range(30))
    rows = [(i, f"own{i} {passage} end{i}", "s") for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        kept = remove_repeated_substrings(make(rows))
        assert kept.where("doc_id > 0 AND n_removed = 30").count() == 2999
        assert kept.where((F.col("doc_id") == 0) & (F.col("n_removed") == 0)).count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
