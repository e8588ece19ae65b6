import math
import random
import re
from collections import Counter

from shelfspark.llm.quality import binomial_cdf, proven, quality_rules, text_counts

from odd_rows import ODD_ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
    )


def test_counts():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "é", "日本 ", "\n", "a b c d e f\n", "#", "&x", "\t", " "]) for _ in range(rng.randrange(60)))
        assert text_counts(text.encode())[:5] == plain_counts(text)


def test_binomial():
    for n in (1, 7, 40):
        for k in range(n + 1):
            direct = sum(math.comb(n, i) * 0.13**i * 0.87 ** (n - i) for i in range(k + 1))
            assert abs(binomial_cdf(k, n, 0.13) - direct) < 1e-12


def test_sequence_stops_at_first_failure():
    assert proven(1000, [0, 1, 500, 0], 0.01, 0.05) == 2
    assert proven(10, [0], 0.01, 0.05) == 0 and proven(0, [0], 0.01, 0.05) == 0


def test_false_rejection_is_limited(spark):
    """Over many draws the chosen cutoffs break the promise no more often than stated."""
    rng = random.Random(5)
    level, risk, broken = 0.1, 0.05, 0
    for _ in range(400):
        true = [0.0, 0.02, 0.06, 0.2]
        chosen = proven(300, [sum(rng.random() < p for _ in range(300)) for p in true], level, risk)
        broken += chosen > 0 and true[chosen - 1] > risk
    assert broken <= 400 * level


def test_rules(spark, make):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "a") for i in range(400)]
    junk = [(1000 + i, " ".join(f"w{i}x{k}#$" for k in range(60)), "a") for i in range(100)]
    docs = make(good + junk + [(5000, "few words", "a")])
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in junk[:50]] + [(None, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules(docs, labels).toPandas().set_index("doc_id")
    assert out.loc[[r[0] for r in good], "kept"].all()
    assert not out.loc[[r[0] for r in junk], "kept"].any() and not out.loc[[r[0] for r in junk], "base_failed"].any()
    assert out.loc[5000, "base_failed"] and not out.loc[5000, "kept"]
    unlabelled = quality_rules(docs, labels.limit(0)).toPandas()
    assert (unlabelled["kept"] == ~unlabelled["base_failed"]).all()


def test_odd_rows(spark, make):
    docs = make(ODD_ROWS)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality_rules(docs, labels, stratum_column="source").toPandas()
    assert len(out) == len(ODD_ROWS)
    assert sorted(map(tuple, out[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].values.tolist())) == sorted(
        plain_counts(t) for _, t, _ in ODD_ROWS
    )
    assert quality_rules(docs.limit(0), labels).count() == 0
