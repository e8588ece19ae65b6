import gzip
import hashlib
import io

import pytest

from shelfspark.llm.warc import BLOCK, gzip_member, open_folder, read_archives, read_records, record_bytes, write_archives

PAGES = [
    (1, "http://a", "x" * 1500), (2, None, "x" * 1500), (3, "http://c", None), (4, "http://d", "short"), (5, "u", "short"),
    (6, "http://f", "é" * 700_000), (6, "http://f", "é" * 700_000), (None, "http://h", "y" * 999), (9, "line\r\nbreak", ""),
]


def read(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS record_id", "'z' AS digest")
    paths = write_archives(pages, **options)
    return paths, read_archives(paths).toPandas().set_index("position", drop=False)


@pytest.mark.parametrize("archive_bytes", [1 << 27, 1])
def test_round_trip(spark, archive_bytes):
    _, records = read(spark, PAGES, archive_bytes=archive_bytes)
    assert len(records) == len(PAGES) and records["digest_ok"].all() and records["error"].isna().all()
    for page_id, url, html in PAGES:
        data = (html or "").encode()
        rows = records[records["record_id"] == f"urn:page:{'null' if page_id is None else page_id}"]
        assert (rows["payload_bytes"] == len(data)).all() and len(rows) >= 1
        assert (rows["payload_digest"] == hashlib.sha1(data).hexdigest()).all()
        revisit = page_id == 1
        assert (rows["record_type"] == ("revisit" if revisit else "response")).all()
        assert list(rows["refers_to"].dropna()) == (["urn:page:2"] if revisit else [])
        if url is None:
            assert rows["target_uri"].isna().all()


def test_empty(spark):
    _, records = read(spark, [])
    assert len(records) == 0


def test_one_member_per_record(spark, tmp_path):
    paths, _ = read(spark, PAGES[:5], folder=f"file://{tmp_path}/w")
    members = 0
    for row in paths.collect():
        store, name = open_folder(row["path"])
        data = store.open_input_stream(name, compression=None).read()
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == data.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00")
        members += data.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00")
    assert members == 5


def member(payload: bytes, **changes) -> bytes:
    digest = "sha1:" + __import__("base64").b32encode(hashlib.sha1(payload).digest()).decode()
    raw = record_bytes("urn:page:1", "u", payload, digest, len(payload), None)
    for old, new in changes.get("replace", []):
        raw = raw.replace(old, new)
    return gzip_member(raw, 6)


def test_damage_is_told(spark, tmp_path):
    good = member(b"p" * (3 * BLOCK))
    bad_digest = next(read_records(io.BytesIO(member(b"abc", replace=[(b"abc", b"abd")]))))
    assert not bad_digest["digest_ok"]
    for data, kind in ((good + good[:-20], EOFError), (good + member(b"q", replace=[(b"Content-Length: ", b"Content-Length: 9")]), ValueError)):
        records = read_records(io.BytesIO(data))
        assert next(records)["digest_ok"]
        with pytest.raises(kind):
            next(records)
    (tmp_path / "bad.warc.gz").write_bytes(good + b"no gzip")
    found = read_archives(spark.createDataFrame([(f"file://{tmp_path}/bad.warc.gz",)], "path string")).toPandas()
    assert len(found) == 2 and found["error"].notna().sum() == 1


def test_archives_spread_over_tasks(spark):
    """As many tasks as archives read them, also where the paths are a few bytes."""
    rows = [(i, f"u{i}", f"{i} " * 400) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    paths = write_archives(pages, archive_bytes=1)
    records = read_archives(paths)
    parts = records.selectExpr("spark_partition_id() AS part", "path").distinct().groupBy("part").count().collect()
    assert paths.count() == 40 and records.rdd.getNumPartitions() == 40
    assert len(parts) > 15 and max(r["count"] for r in parts) < 10


def test_short_payloads_meet_nobody(spark):
    """Null and empty pages, thousands of them, have no join key in common."""
    from shelfspark.llm.warc import revisit_plan

    pages = spark.range(3000).selectExpr("id", "CAST(NULL AS string) AS url", "CAST('' AS binary) AS payload")
    plan = revisit_plan(pages, 1000)
    assert plan.count() == 3000 and plan.where("refers_to IS NOT NULL").isEmpty()
