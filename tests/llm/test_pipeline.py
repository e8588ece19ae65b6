import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm.common import stored

from odd_rows import ODD_ROWS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with toxic documents, copies, leaks and clean documents."""
    rng = random.Random(9)
    syllables = ["an", "the", "on", "er", "sh", "ou", "ti", "re", "ha", "en"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    items = [(i, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(8)) + ".") for i in range(10)]
    docs, labels, kinds = [], [], {}
    for i in range(600):
        words = [word() for _ in range(rng.randrange(40, 150))]
        kind = ("toxic", "copy", "leak", "clean", "clean", "clean")[i % 6]
        if kind == "toxic":
            for _ in range(4):
                words[rng.randrange(len(words))] = "idiot" + rng.choice(["", "s", "ic"])
        if kind == "copy" and i > 6:
            words = docs[i - 4][1].split() + (["tail"] if i % 12 == 1 else [])
        if kind == "leak":
            words[5:5] = items[rng.randrange(10)][1].split()
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(kind == "toxic")))
        kinds[i] = kind
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, kinds, {d[0]: d[1] for d in docs}


def test_stages(spark, folder):
    path, kinds, texts = folder
    rows = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = rows.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stored(stage(spark, rows, path), name)
        seen[name] = [r.doc_id for r in rows.select("doc_id").collect()]
        assert name == "shards" or rows.columns == columns
    toxic = {i for i, k in kinds.items() if "idiot" in texts[i]}
    assert set(texts) - set(seen["toxicity"]) == toxic
    # Of equal or nearly equal texts the first stays; here copies follow their originals.
    kept = set(seen["near_duplicates"])
    assert all(i in kept for i in seen["toxicity"] if kinds[i] in ("clean", "leak"))
    for i in seen["toxicity"]:
        if kinds[i] == "copy" and texts[i].removesuffix(" tail") in {texts[j] for j in kept if j < i}:
            assert i not in kept
    leaks = {i for i in kept if kinds[i] == "leak"}
    assert leaks & set(seen["decontamination"]) == set() and kept - leaks == set(seen["decontamination"])
    assert set(seen["mix"]) <= set(seen["decontamination"]) and max(seen["mix"].count(i) for i in set(seen["mix"])) <= 2
    assert sorted(seen["mix"]) == sorted(seen["shards"])


def test_run_equals_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    again = corpus_pipeline.run(spark, folder[0])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect())) and out.count() > 0


@pytest.mark.parametrize("place", range(5))
def test_odd_rows(spark, folder, place):
    rows = [(k, t, None, s, None, 1) for k, t, s in ODD_ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mark int").drop("mark")
    docs = docs.withColumn("label", F.lit("x"))
    name, stage = corpus_pipeline.STAGES[place]
    kept = stage(spark, docs, folder[0])
    assert stage(spark, docs.limit(0), folder[0]).count() == 0
    if name in ("toxicity", "decontamination"):
        assert kept.count() == len(ODD_ROWS)
    if name == "near_duplicates":
        # One each of the long text, of the seven words, and of the two single texts; the four without words stay.
        assert kept.count() == 8
    if name == "shards":
        assert kept.count() == len(ODD_ROWS)
