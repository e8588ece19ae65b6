import random

import pytest
from pyspark.sql import functions as F

from shelfspark.llm.mixing import as_units, mix_plan, mix_sources

from odd_rows import ODD_ROWS


def filled(sizes, weights, share, cap):
    """Targets by repeated resharing, one source at a time."""
    left, targets = share * sum(sizes.values()), {}
    free = dict(weights)
    while free:
        level = left / sum(free.values())
        over = [s for s in free if free[s] * level > cap * sizes[s]]
        if not over:
            return targets | {s: w * level for s, w in free.items()}
        for s in over:
            targets[s] = cap * sizes[s]
            left -= targets[s]
            del free[s]
    return targets


def test_targets_and_words(spark, make):
    rng = random.Random(3)
    sources = ["hot"] * 6 + ["Z", "ä", "b", None]
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 200])), rng.choice(sources)) for i in range(1500)]
    plan = mix_plan(as_units(make(rows)), leaf_rows=10).toPandas()
    sizes, largest = {}, {}
    for _, text, source in rows:
        n = len(text.split())
        sizes[source] = sizes.get(source, 0) + n
        largest[source] = max(largest.get(source, 0), n)
    order = sorted(s for s in sizes if s is not None) + [None]
    expected = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    for source, rows_ in plan.groupby(plan["source"].fillna("null")):
        key = None if source == "null" else source
        assert rows_["target"].iloc[0] == pytest.approx(expected[key])
        assert rows_["source_size"].iloc[0] == sizes[key]
        assert abs((rows_["copies"] * rows_["size"] * rows_["n"]).sum() - expected[key]) < largest[key]
    assert plan["copies"].between(0, 2).all()
    assert sum(expected.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_same_draw_however_dealt(spark, make):
    rows = [(i, "w " * (i % 17 + 1), f"s{i % 3}") for i in range(400)]
    one = mix_plan(as_units(make(rows).coalesce(1))).select("id", "copies").toPandas()
    two = mix_plan(as_units(make(rows[::-1]).repartition(5))).select("id", "copies").toPandas()
    assert dict(one.values) == dict(two.values)


def test_expected_copies_are_kept(spark, make):
    """Over many seeds each document is taken as often as its source's target asks for."""
    rows = [(i, "w " * n, "a" if i < 4 else "b") for i, n in enumerate([1, 2, 3, 4, 5, 5])]
    taken = [0] * 6
    for seed in range(3):
        for row in mix_plan(as_units(make(rows)), seed=seed).collect():
            taken[int(row["id"])] += row["copies"]
    # Weights 3 and 1 over 20 words: a is full at 2 * 10, b takes the rest, 10 of 10.
    assert taken[:4] == [6] * 4 and taken[4:] == [3] * 2


def test_odd_rows(spark, make):
    docs = make(ODD_ROWS)
    mixed = mix_sources(docs)
    assert mixed.columns == docs.columns
    plan = mix_plan(as_units(docs))
    assert mixed.count() == plan.agg(F.sum(F.col("copies") * F.col("n"))).first()[0]
    assert mix_plan(as_units(docs.limit(0))).count() == 0
    assert mix_sources(docs.limit(0)).count() == 0
