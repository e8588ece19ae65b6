import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import queries
from shelfspark.llm.skip_list import Heights, SkipList, fill_in_middle, restored, unit_widths

from odd_rows import ODD_ROWS

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TRICKY = [
    "abc DEF", "Ünïcode É x", "日本語 text\n\r\t 12", "\U0001f600a\U0001f600b", "a<P>b", "x<S>", "<M>", "<", "<<P", "P>", "a" * 3000, " " * 3000,
    "é" * 5000 + "z", "one<P two<S three<M four", "[\\]^_`{|}@Zz", "\x00a\x00",
]


def plain_version(doc_id, text):
    """The contract in plain Python: units by the pattern, places by adding up."""
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_every_rank():
    heights = Heights()
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 8, 9, 500, 5000, 100):
        widths = rng.integers(1, 9, n)
        units = SkipList(widths, heights)
        before = [0, *np.cumsum(widths).tolist()]
        assert [units.offset(r) for r in range(n + 1)] == before
        with pytest.raises(IndexError):
            units.offset(n + 1)


def test_lanes_are_express():
    """Every lane holds about an eighth of the one below, so a walk is short."""
    units = SkipList(np.ones(300_000, dtype=np.int64), Heights())
    sizes = [len(u) for _, u, _ in units.lanes]
    assert len(sizes) >= 5 and sizes[0] <= 8 and all(5 < b / a < 12 for a, b in zip(sizes[-3:], sizes[-2:]))
    assert all(u.sum() == p.sum() == 300_000 for _, u, p in units.lanes)


def test_units():
    for text in [*TRICKY, *[t for _, t, _ in ODD_ROWS if t]]:
        assert unit_widths(text).tolist() == [len(u) for u in UNITS.findall(text)]


def test_transformation_and_round_trip(make):
    rng = random.Random(3)
    letters = "abZ <>PSM é\U0001f600\n1"
    rows = [*ODD_ROWS, *[(100 + i, t, "s") for i, t in enumerate(TRICKY * 12)]]
    rows += [(1000 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(60))), "s") for i in range(400)]
    docs = make(rows).withColumns({"form": F.lit("x"), "output": F.lit(1), "_text": F.lit("t")})
    got = fill_in_middle(docs, ["doc_id", "source"]).withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    expected = [(i, s, *plain_version(i, t), t or "") for i, t, s in rows]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0
    all_cut = fill_in_middle(docs, ["text"], plain=0, suffix_first=100).collect()
    assert all(r.form == ("plain" if not r.text or re.search("<[PSM]>", r.text) else "spm") for r in all_cut)


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT id AS doc_id, CAST(concat(X'61FF20', X'C3', encode(CAST(id AS STRING), 'UTF-8')) AS STRING) AS text FROM range(50)")
    got = fill_in_middle(docs, ["doc_id", "text"]).withColumn("again", restored(F.col("output"), F.col("form")))
    assert got.where(F.col("again").cast("binary") != F.col("text").cast("binary")).count() == 0


def test_query_beside_sql(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([*TRICKY, None, ""] * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_fill_in_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.execute(queries.ORACLES["op12_fill_in_middle"])
    assert got.columns == [c[0] for c in expected.description]
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert {r.doc_id: r.restored_sha256 for r in got.collect()} == {i: sha(t) for i, t in rows}
