import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm.toxicity import (
    DISCOUNT, EVIDENCE, FEATURES, ORDER, Backoff, _gather, batch_features, features, fit_logistic, pieces, pieces_of, score_toxicity,
)

from odd_rows import ODD_ROWS

SYLLABLES = ["an", "the", "on", "er", "sh", "ou", "ti", "re", "ha", "en"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    stems = ["idio", "zumpel"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 200))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(stems) + rng.choice(SYLLABLES + ["ts", "ck", "ming"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, make):
    rows, labels = corpus(1200)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = score_toxicity(make(rows), table, F.col("doc_id") % 4 != 2).toPandas().set_index("doc_id")["score"]
    held = [(scores[i], t) for i, _, t in labels if i % 4 == 2]
    assert all(0 <= s <= 1 for s, _ in held)
    assert np.mean([(s >= 0.3) == t for s, t in held]) > 0.97
    # The labels of rows that may not be learnt from change nothing.
    other = spark.createDataFrame([(i, q, 1 - t if i % 4 == 2 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = score_toxicity(make(rows), other, F.col("doc_id") % 4 != 2).toPandas().set_index("doc_id")["score"]
    assert np.allclose(scores, again[scores.index])


def test_model_is_a_distribution():
    """The probabilities of a class's characters after a known context add up to one, however they back off."""
    words = ["abc", "abd", "xbc", "abcde"]
    grams = [("    " + w + "\n")[i : i + ORDER] for w in words for i in range(len(w) + 1)]
    spelled = sorted(set(grams))
    counts = np.array([grams.count(g) for g in spelled])
    model = Backoff(spelled, counts, counts, counts * 0)
    assert model.differences(["abc", ""]).shape == (2,)
    shared = model.shared[0]
    assert abs(shared[1].sum() + 0) <= 1 + 1e-9 and (shared[1] > 0).all()
    assert model.differences(["abc"])[0] > 0  # seen by the toxic class only


def test_features_and_fit():
    assert features(np.zeros(0), np.zeros(0)) == (0.0,) * 7
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = (x[:, 0] + 0.1 * rng.normal(size=500) > 0).astype(float)
    w = fit_logistic(x, y)
    assert ((x @ w[:2] + w[2] > 0) == y).mean() > 0.95


def test_odd_rows(spark, make):
    labels = spark.createDataFrame([(6, 1, 0), (7, 1, 1), (None, 1, 1), (10, 1, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    out = score_toxicity(make(ODD_ROWS), labels).toPandas()
    assert len(out) == len(ODD_ROWS) and out["score"].between(0, 1).all()
    assert score_toxicity(make(ODD_ROWS), labels.limit(0)).where("score >= 0.3").count() == 0
    assert score_toxicity(make(ODD_ROWS).limit(0), labels).count() == 0


def test_every_gram_has_its_own_counts(spark, make):
    """Counts beyond what is broadcast are joined as a table; the features are the same as with the whole table at hand."""
    rows, labels = corpus(300)
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "x" * 300 + " " + "-" * 5 + " ok", "s"), (1002, "twice", "s"), (None, "no id", "s")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["doc_id", "mark", "score", *FEATURES]
    small = sorted(map(tuple, score_toxicity(make(rows), table).select(names).collect()), key=str)
    large = sorted(map(tuple, score_toxicity(make(rows), table, most_grams=10).select(names).collect()), key=str)
    assert [r[:2] for r in small] == [r[:2] for r in large] and len(small) == len(rows)
    assert np.allclose([r[2:] for r in small], [r[2:] for r in large])


def test_counts_are_whole(spark):
    """No gram vanishes however many there are: the counts are those of plain Python."""
    rng = random.Random(4)
    words = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    expected = Counter(("    " + w + "\n")[i : i + ORDER] for w in words for i in range(len(w) + 1))
    texts = spark.createDataFrame([(" ".join(words[k::3]).encode(), None) for k in range(3)], "text binary, kind boolean")
    got = texts.mapInArrow(_gather(), "gram string, n_all long, n_toxic long, n_plain long").groupBy("gram").sum("n_all")
    assert {r[0]: r[1] for r in got.collect()} == expected


def test_the_end_of_long_words_counts(spark, make):
    """Texts without blanks are counted and scored to their end, wherever what tells them apart stands."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        text = "".join(rng.choice(SYLLABLES) for _ in range(200))
        rows.append((i, text + "zumpelidio" * 3 * (i % 4 == 0) + "the" * 10, "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = score_toxicity(make(rows), table, F.col("doc_id") % 5 != 2).toPandas().set_index("doc_id")["score"]
    assert np.mean([(scores[i] >= 0.3) == t for i, _, t in labels if i % 5 == 2]) > 0.97
    assert pieces(b"a" * 64) == ["    " + "a" * 64 + "\n"]
    assert pieces("一".encode() * 130) == ["    " + "一" * 64, "一" * 68, "一" * 6 + "\n"]


def plain_features(values, lengths, window=8):
    """The features of one text, figure by figure."""
    if not len(values):
        return (0.0,) * len(FEATURES)
    ranked = sorted(values)
    width = min(window, len(values))
    excess = sum(max(v - EVIDENCE, 0.0) for v in values)
    return (
        sum(values) / sum(lengths) * 5.0, ranked[-1], ranked[-3] if len(values) > 2 else 0.0,
        max(sum(values[i : i + width]) for i in range(len(values) - width + 1)) / width,
        excess / len(values) * 10.0, excess / len(values) ** 0.5, math.log(len(values)),
    )


def test_features_of_many_texts():
    """Texts of all lengths, with ties, one after the other: the same as text by text, and no text depends on the others."""
    rng = random.Random(8)
    texts = [[rng.choice([-3.0, 0.5, 2.75, 2.75, rng.gauss(0, 4)]) for _ in range(n)] for n in [0, 1, 2, 3, 7, 8, 9, 0, 0, 200, 1, 8, 0]]
    texts += [[rng.gauss(0, 4) for _ in range(rng.randrange(30))] for _ in range(200)]
    lengths = [[rng.randrange(1, 20) for _ in t] for t in texts]
    flat = [np.array([x for t in column for x in t], dtype=float) for column in (texts, lengths)]
    got = batch_features(*flat, np.array([len(t) for t in texts])).T
    assert np.allclose(got, [plain_features(t, n) for t, n in zip(texts, lengths, strict=True)])
    alone = [features(np.array(t), np.array(n, dtype=float)) for t, n in zip(texts, lengths, strict=True)]
    assert (got == np.array(alone)).all()
    assert batch_features(np.zeros(0), np.zeros(0), np.zeros(0, dtype=int)).shape == (len(FEATURES), 0)


def test_pieces_of_many_words():
    words = [b"Plain", b"--", "ΣΑΣ".encode(), b"(quoted)", b"\xff\xc3", "İx".encode(), b"b"]
    long = [*words, b"a" * 64, b"a" * 65, "一".encode() * 130, b"'" * 200]
    for some in (words, long, []):
        padded, per_word = pieces_of(some)
        assert padded == [p for w in some for p in pieces(w)] and per_word.tolist() == [len(pieces(w)) for w in some]


def plain_kneser_ney(counted, word):
    """ln P(word | toxic) - ln P(word | ordinary) character by character, from dictionaries of strings."""
    seen = {g for g, (n, _, _) in counted.items() if n > 0}
    kinds = {ORDER - 1: Counter(g[1:] for g in seen)}
    for n in range(ORDER - 2, 0, -1):
        kinds[n] = Counter(g[1:] for g in kinds[n + 1])

    def shared(gram):
        if not gram:
            return 1.0 / (len(kinds[1]) + 1)
        n = len(gram)
        inside = [k for g, k in kinds[n].items() if g[:-1] == gram[:-1]]
        below = shared(gram[1:])
        if not inside:
            return below
        return max(kinds[n][gram] - DISCOUNT, 0.0) / sum(inside) + DISCOUNT * len(inside) / sum(inside) * below

    def of_class(gram, which):
        inside = [c[which] for g, c in counted.items() if g[:-1] == gram[:-1]]
        total, backed = sum(inside), shared(gram[1:])
        if not total:
            return backed
        own = max(counted.get(gram, (0, 0, 0))[which] - DISCOUNT, 0.0)
        mixed = (own + DISCOUNT * sum(c > 0 for c in inside) * backed) / total
        trust = total / (total + 5.0)
        return trust * mixed + (1 - trust) * backed

    padded = "    " + word + "\n"
    return sum(math.log(of_class(padded[i : i + ORDER], 1)) - math.log(of_class(padded[i : i + ORDER], 2)) for i in range(len(word) + 1))


def test_against_plain_kneser_ney():
    """Words that were seen, partly seen and never seen, with unknown characters, against dictionaries of strings."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))
    counted: dict = {}
    for kind in (0, 1, 2):
        for _ in range(60):
            padded = "    " + word() + "\n"
            for i in range(len(padded) - ORDER + 1):
                row = counted.setdefault(padded[i : i + ORDER], [0, 0, 0])
                row[0] += 1
                row[kind] += kind > 0
    spellings = sorted(counted)
    model = Backoff(spellings, *[np.array([counted[g][k] for g in spellings]) for k in range(3)])
    words = [word() for _ in range(80)] + ["", "zz", "abzcd"]
    expected = [plain_kneser_ney(counted, w) for w in words]
    assert np.allclose(model.differences(words), np.clip(expected, -12, 12)) and max(map(abs, expected)) > 0.5
