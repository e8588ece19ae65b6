import pytest
from pyspark.sql import functions as F

from shelfspark.functions import hashing, numbers, text, times, urls

PRICES = [
    ("$599.99", 599.99), ("$1,234", None), ("$1,234.56", 1234.56), ("12,50", 12.5), ("FREE shipping", 0.0),
    ("$10.00 to $20.00", None), ("", None), ("abc", None), (None, None), ("1.234,56", 1.23456), ("5.", 5.0),
    (".", None), ("$1,234,567", None), ("EUR 7", 7.0), ("USD 1,2", 1.2), ("12,", 12.0), (".5", 0.5),
    ("$12.00 free returns", 0.0),
]
RATINGS = [
    ("4.5 out of 5 stars", 4.5), ("8", 4.0), ("10", 5.0), ("100", 5.0), ("no rating", None), ("", None),
    (None, None), ("5.", 5.0), ("-3", 3.0),
]
TEXTS = [
    ("  Dell &amp; HP  laptop\n", "Dell & HP laptop"), ("a é b", "a  b"), ("Tom&nbsp;&nbsp;Jerry", "Tom Jerry"),
    ("&copy; 2024", " 2024"), ("5&quot; screen", '5" screen'), ("– x", " x"), (None, ""), ("", ""),
    ("a\x1c\x1db\x85c d", "a b c d"), ("&amp;lt;", "&lt;"),
]
LINKS = [
    ("/dp/B0ABCDEFGH", "https://www.amazon.com", "https://www.amazon.com/dp/B0ABCDEFGH"),
    ("//cdn.x.com/i.jpg", "https://www.amazon.com", "https://cdn.x.com/i.jpg"),
    ("http://a.com/x", "https://www.amazon.com", "http://a.com/x"),
    ("p/1", "https://www.amazon.com", "https://www.amazon.com/p/1"),
    ("../q", "https://www.amazon.com", "https://www.amazon.com/q"),
    ("?k=1", "https://www.amazon.com", "https://www.amazon.com?k=1"),
    ("", "https://www.amazon.com", ""), (None, "https://www.amazon.com", ""),
    ("/dp/B0ABCDEFGH", "https://h.com/a/b", "https://h.com/dp/B0ABCDEFGH"),
    ("p/1", "https://h.com/a/b", "https://h.com/a/p/1"), ("../q", "https://h.com/a/b", "https://h.com/q"),
    ("?k=1", "https://h.com/a/b", "https://h.com/a/b?k=1"),
]


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["out"] for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_extract_price(spark):
    got = values(spark, [(t,) for t, _ in PRICES], "t string", numbers.extract_price(F.col("t")))
    assert got == [p for _, p in PRICES]


def test_extract_rating(spark):
    got = values(spark, [(t,) for t, _ in RATINGS], "t string", numbers.extract_rating(F.col("t")))
    assert got == [p for _, p in RATINGS]


def test_clean_text(spark):
    got = values(spark, [(t,) for t, _ in TEXTS], "t string", text.clean_text(F.col("t")))
    assert got == [p for _, p in TEXTS]


def test_unescape_agrees_with_the_standard(spark):
    """Every name of the table, numbers of all kinds, and random strings made of the pieces of references."""
    import html
    import random
    from html.entities import html5

    rng = random.Random(5)
    numbers = [0, 1, 8, 9, 10, 11, 13, 14, 31, 65, 127, 128, 129, 150, 159, 160, 0xD800, 0xDFFF, 0xFDD0, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFF, 0x110000, 10**9, 10**20]
    shown = [f"a&{name}b" for name in html5] + [f"&{name.rstrip(';')}" for name in html5]
    shown += [f"x&#{z}{n}{end}y" for n in numbers for z in ("", "000") for end in (";", "")]
    shown += [f"x&#{x}0{n:x}{end}z" for n in numbers for x in "xX" for end in (";", "")]
    bits = ["&", "&amp", ";", "#", "x", "X", "41", "lt", "amp;", "not", "it;", "notin", "nbsp;", " ", "\t", "\n", "\f", "<", "é", "😀", "&#", "&#x", "A", "copy", "frac12", "0", "q" * 40]
    shown += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(6000)]
    shown += ["", "&", "&&", "a&", "&;", "&#;", "&#x;", "&amp;lt;", "&amp;amp;amp;", "AT&T", "&" * 5000, "&lt;" * 20_000, None]
    got = values(spark, [(t,) for t in shown], "t string", text.unescape(F.col("t")))
    wrong = [(t[:60], g[:60], html.unescape(t)[:60]) for t, g in zip(shown, got, strict=True) if t is not None and g != html.unescape(t)]
    assert not wrong, wrong[:10]
    assert got[-1] is None


def test_squeeze_agrees_with_split(spark):
    """Every blank character there is, alone and in runs."""
    import random
    import sys

    rng = random.Random(6)
    blanks = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    shown = [f"a{b}b" for b in blanks] + [f" {b}a {b}{b}c{b}" for b in blanks]
    shown += ["".join(rng.choice([*blanks, " ", " ", "x", "yz", "é"]) for _ in range(rng.randrange(12))) for _ in range(2000)]
    got = values(spark, [(t,) for t in shown], "t string", text.squeeze(F.col("t")))
    assert got == ["".join(c for c in " ".join(t.split()) if " " <= c <= "~") for t in shown]


def test_clean_text_stays_in_the_jvm(spark):
    plan = spark.createDataFrame([("a &amp; b",)], "t string").select(text.clean_text(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_normalize_url(spark):
    got = values(spark, [x[:2] for x in LINKS], "u string, b string", urls.normalize_url(F.col("u"), F.col("b")))
    assert got == [x[2] for x in LINKS]


def test_normalize_url_agrees_with_urljoin(spark):
    from urllib.parse import urljoin

    base = "https://shop.example.com/a/b?c=d"
    shown = ["/x y", "/a?", "/a#", "/a;p", "/.", "/a/./b", "/a//b", "x", "#f", "mailto:me@x.org", "HTTP://Y.org/", "/"]
    got = values(spark, [(u, base) for u in shown], "u string, b string", urls.normalize_url(F.col("u"), F.col("b")))
    assert got == [urljoin(base, u) for u in shown]


def test_url_parts(spark):
    rows = [("https://A.com:80/x",), ("//b.com/x",), ("ftp:/c",), ("nothing",), (None,), ("http://d.com",)]
    assert values(spark, rows, "u string", urls.url_authority(F.col("u"))) == ["a.com:80", "b.com", "", "", "", "d.com"]
    assert values(spark, rows, "u string", urls.is_valid_url(F.col("u"))) == [True, False, False, False, False, True]


@pytest.mark.parametrize(
    "url,source,rule,expected",
    [
        ("https://www.amazon.com/x/dp/B0ABCDEFGH/ref", "amazon", "static", "B0ABCDEFGH"),
        ("https://www.ebay.com/itm/1234?x=1", "ebay", "static", "1234"),
        ("https://www.ebay.com/itm/v1-9a?x=1", "ebay", "static", None),
        ("https://www.ebay.com/itm/v1-9a?x=1", "ebay", "browser", "v1-9a"),
        ("https://www.walmart.com/ip/some-name/555", "walmart", "static", "555"),
        ("https://other.com/dp/B0ABCDEFGH", "other", "static", None),
    ],
)
def test_product_id(spark, url, source, rule, expected):
    column = urls.product_id_from_url(F.col("u"), F.col("s"), rule)
    assert values(spark, [(url, source)], "u string, s string", column) == [expected]


def test_hashes(spark):
    rows = [("amazon", "prod1", "Gaming Laptop Dell XPS"), ("ebay", None, "X")]
    column = hashing.listing_hash(F.col("s"), F.col("p"), F.col("t"))
    assert values(spark, rows, "s string, p string, t string", column) == [
        "e5851d8ad9c82fcca0b88c47e08844f9", "5d1d4a7b667742caa1203d32cd90f7cf",
    ]


def test_float_text(spark):
    rows = [(1.5,), (1e7,), (123456789.25,), (0.005,), (100001.0,), (None,)]
    assert values(spark, rows, "x double", numbers.float_text(F.col("x"))) == [
        "1.5", "10000000.0", "123456789.25", "0.005", "100001.0", None,
    ]


def test_rounding_and_time(spark):
    assert values(spark, [(2.5,), (3.5,), (0.125,)], "x double", numbers.round_even(F.col("x"), 0))[:2] == [2.0, 4.0]
    weeks = values(spark, [("2024-01-01",), ("2024-01-07",), ("2024-01-08",)], "d string",
                   times.week_end(F.col("d").cast("timestamp_ntz")).cast("string"))
    assert weeks == ["2024-01-07", "2024-01-07", "2024-01-14"]
    assert values(spark, [("x",), ("2024-01-01T10:00:00",)], "d string", times.to_time(F.col("d")).cast("string")) == [
        None, "2024-01-01 10:00:00",
    ]


def test_title_fallback(spark):
    rows = [("$5 off this very long line\nshort\n  A good long product title \nmore", "amazon"),
            ("Rating of this product 4\nAnother fine long title", "amazon"),
            ("12 bids on this fine item\nno", "ebay"), ("", "ebay"), (None, "amazon")]
    column = text.title_fallback(F.col("t"), F.col("s"))
    assert values(spark, rows, "t string, s string", column) == [
        "A good long product title", "Another fine long title", None, None, None,
    ]


def test_search_url(spark):
    column = urls.search_url(F.col("s"), F.col("k"), F.col("p"), "+")
    assert values(spark, [("ebay", "gaming laptop", 2)], "s string, k string, p int", column) == [
        "https://www.ebay.com/sch/i.html?_nkw=gaming+laptop&_pgn=2"
    ]


def test_condition_and_shipping(spark):
    rows = [(" Brand New ",), ("Pre-owned",), (None,)]
    assert values(spark, rows, "t string", text.condition_text(F.col("t"))) == ["Brand New", None, None]
    assert values(spark, [("Free delivery",), ("pick up",)], "t string", text.shipping_text(F.col("t"))) == [
        "Free delivery", None,
    ]
