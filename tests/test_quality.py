import random

from pyspark.sql import functions as F

from shelfspark.operators import filters, quality, skew
from shelfspark.schemas import LISTING


def test_validate(spark):
    rows = [
        ("T", "https://a.com/x", "s", 5.0), (None, "https://a.com/x", "s", 5.0), ("", None, None, 0.001),
        ("T", "a.com/x", "s", 2e7), ("T", "https://a.com", "s", None), ("T", "https://a.com", "s", 100000.0),
    ]
    df = spark.createDataFrame(rows, "title string, url string, source string, price double")
    got = [r.validation_errors for r in quality.validate(df).collect()]
    assert got == [
        [], ["Missing required field: title"],
        ["Missing required field: title", "Missing required field: url", "Missing required field: source",
         "Price out of range: 0.001", "Invalid URL format: None"],
        ["Price out of range: 20000000.0", "Invalid URL format: a.com/x"], [], [],
    ]
    text = spark.createDataFrame([("T", "https://a.com", "s", "cheap"), ("T", "https://a.com", "s", "7")],
                                 "title string, url string, source string, price string")
    assert [r.validation_errors for r in quality.validate(text).collect()] == [["Invalid price format: cheap"], []]


def test_clean_and_split(spark):
    df = spark.createDataFrame(
        [("amazon", " A &amp; B\n", "$5.00", "8", "/dp/1", ""), ("x", "T", "free", None, "p", None)],
        "source string, title string, price string, rating string, url string, image_url string",
    )
    good, bad = quality.split_valid(df)
    row = good.first()
    assert (row.title, row.price, row.rating, row.url, row.image_url) == ("A & B", 5.0, 4.0, "https://www.amazon.com/dp/1", "")
    assert bad.first().validation_errors == ["Price out of range: 0.0", "Invalid URL format: p"]


def test_clean_frame_keeps_first_in_order(spark):
    rows = [("t", "s", "5", 2), ("t", "s", "6", 1), ("t", None, "7", 3), ("t", None, "8", 4), ("u", "s", "-1", 5), ("v", "s", "x", 6)]
    df = spark.createDataFrame(rows, "title string, source string, price string, id int")
    assert {(r.title, r.source, r.price) for r in quality.clean_frame(df, ["id"]).collect()} == {("t", "s", 6.0), ("t", None, 7.0)}


def test_mark_duplicates_with_null_keys(spark):
    rows = [(1, "t", "s"), (2, "t", "s"), (3, "t", None), (4, "t", None), (5, None, None), (6, "u", "s"), (7, "t", "s")]
    df = spark.createDataFrame(rows, "id int, title string, source string")
    got = {r.id: (r.copies, r.is_repeat) for r in quality.mark_duplicates(df, "id").collect()}
    assert got == {1: (3, False), 2: (3, True), 7: (3, True), 3: (2, False), 4: (2, True), 5: (1, False), 6: (1, False)}


def test_group_join_hot_and_cold(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_SHARE", 4)
    rng = random.Random(1)
    keys = ["hot" if rng.random() < 0.4 else f"k{rng.randint(0, 50)}" for _ in range(500)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v int")
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = skew.join_group_table(df, sizes, ["k"], "n")
    assert "Union" in joined._jdf.queryExecution().toString()
    assert {(r.v, r.n) for r in joined.collect()} == {(i, keys.count(k)) for i, k in enumerate(keys)}
    assert joined.count() == 500


def test_quality_figures(spark):
    df = spark.createDataFrame([("t", "s", 1.0, None, "u"), ("t", "s", 0.0, 2.0, None), (None, "s", None, 2.0, "u")],
                               "title string, source string, price double, rating double, url string")
    q = quality.data_quality(df).first()
    assert round(q.completeness_score, 4) == round((2 / 3 + 2 / 3 + 1 + 2 / 3) / 4, 4)
    assert round(q.duplicate_rate, 4) == 66.6667 and round(q.invalid_data_rate, 4) == 66.6667
    assert quality.price_quality(df).first()[0] == 66
    assert quality.completeness(df.drop("rating")).columns == ["has_price", "has_url"]


def test_filters(spark, golden):
    assert filters.by_keyword(golden, "LAP").count() == 1
    assert filters.recent(golden, "scraped_at", 1, "2025-07-01 11:30:00").count() == 1
    conformed = filters.conform(golden.withColumn("junk", F.lit(1)))
    assert conformed.schema.fieldNames() == LISTING.fieldNames()
    row = conformed.first()
    assert (row.currency, row.is_valid, row.additional_images) == ("USD", True, None)
    assert filters.to_output(conformed).where("source = 'amazon'").first().scraped_at == "2025-06-30T10:00:00"
    assert "data_hash" not in filters.to_output(conformed).columns
    promo = spark.createDataFrame([("Sponsored x",), ("Shop on eBay",), ("ok",), (None,)], "title string")
    assert [r.title for r in filters.not_promotional(promo).collect()] == ["ok", None]
    created = spark.createDataFrame([(None, "a"), ("b", "c")], "created_at string, scraped_at string")
    assert [r.created_at for r in filters.with_created_at(created).collect()] == ["a", "b"]
