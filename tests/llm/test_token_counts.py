import uuid

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfspark.llm import token_counts
from shelfspark.llm.token_counts import PieceCounter, count_tokens
from shelfspark.session import scratch_path

from odd_rows import LONG, ODD_ROWS

PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = [
    "it's they'll, don't... stop!!", "a<|endoftext|>b <|startoftext|> <|endoftext|>,", "Ünïcödé ÉCOLE ǅ ΑΣ ς İ", "éa ́x   y　z",
    "日本語。テスト 123 4,5 6.7.", "a.,b ,, . .. x», ٠١, 1,", "\U0001f600\U0001f600 👩‍👩‍👧 ok", "\x00 \x1f\x7f", "A" * 5000 + "," * 300,
]


def direct(text):
    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def test_pieces_add_up():
    counter = PieceCounter(PATH, pieces=3)
    for text in [*TRICKY, LONG[:20_000], *TRICKY]:
        assert counter.count([text.encode()]) == [direct(text)], text[:40]


@pytest.mark.parametrize("few", [1_000_000, 3, 0])
def test_counts(spark, make, monkeypatch, few):
    monkeypatch.setattr(token_counts, "FEW", few)
    rows = [*ODD_ROWS, *[(100 + i, t, "s") for i, t in enumerate(TRICKY)]]
    cache = scratch_path(spark, f"cache-{uuid.uuid4().hex}")
    got = sorted(map(tuple, count_tokens(make(rows), cache, PATH).collect()), key=str)
    assert got == sorted(((k, len((t or "").encode()), direct(t)) for k, t, _ in rows), key=str)


def test_cache_is_used_and_grows(spark, make):
    cache = scratch_path(spark, f"cache-{uuid.uuid4().hex}")
    rows = [(1, "one two", "s"), (2, " one\n two ", "s"), (3, "three", "s")]
    first = {r.doc_id: r.n_tokens for r in count_tokens(make(rows), cache, PATH).collect()}
    assert first[1] == first[2] == direct("one two")
    held = spark.read.parquet(cache)
    assert held.count() == 2
    # A stored count is believed, so what it says shows that nothing was encoded again.
    held.selectExpr("content", "tokenizer", "n_tokens + 1000 AS n_tokens").write.mode("append").parquet(cache)
    again = {r.doc_id: r.n_tokens for r in count_tokens(make([*rows, (4, "four", "s")]), cache, PATH).collect()}
    assert again == {1: first[1] + 1000, 2: first[1] + 1000, 3: first[3] + 1000, 4: direct("four")}
    assert spark.read.parquet(cache).select("content").distinct().count() == 3
    assert count_tokens(make(rows).limit(0), cache, PATH).count() == 0
