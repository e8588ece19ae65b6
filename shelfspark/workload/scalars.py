"""Scalar functions over texts, numbers and addresses taken from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.adapters import listings, sightings, table, ticks
from shelfspark.functions import hashing, numbers, text, times, urls
from shelfspark.operators import filters, quality
from shelfspark.sources.readers import analysis_scan
from shelfspark.workload.registry import query, rounded

# --- F1 ---------------------------------------------------------------------------------------------

_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]+"
# Entities that occur in the pages; like the decoder, the closing semicolon may be missing.
_DECODED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), "
    "'&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
)
_CLEAN = (
    "regexp_replace(trim(regexp_replace(" + _DECODED + ", '" + _BLANKS + "', ' ', 'g')), '[^\\x20-\\x7E]', '', 'g')"
)
_CLEAN_HTML = _CLEAN.replace("{c}", "html")


@query(f"SELECT page_id, md5({_CLEAN_HTML}) AS cleaned, length({_CLEAN_HTML}) AS chars FROM pages")
def f1_clean_text_pages(spark, sf):
    cleaned = text.clean_text(F.col("html"))
    rows = table(spark, sf, "pages").select("page_id", cleaned.alias("c"))
    return rows.select("page_id", F.md5("c").alias("cleaned"), F.length("c").cast("long").alias("chars"))


@query(
    "SELECT doc_id, md5(regexp_replace(trim(regexp_replace(text, '" + _BLANKS + "', ' ', 'g')), '[^\\x20-\\x7E]', '', 'g')) "
    "AS cleaned FROM documents"
)
def f1_clean_text_documents(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"))


# --- F2, F3: price and rating texts written from the line items ----------------------------------------


def _price_texts(spark, sf):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole = F.expr("CAST(round(l_extendedprice * 100) AS BIGINT) div 100")
    part = F.lpad((cents % 100).cast("string"), 2, "0")
    shown = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("$"), F.format_number(whole, 0), F.lit("."), part))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("EUR "), whole, F.lit(","), part))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("$"), F.format_number(whole, 0)))
        .when(F.col("l_linenumber") == 4, F.concat(F.lit("FREE shipping over "), whole))
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("$"), whole, F.lit(".00 to $"), whole + 10, F.lit(".00")))
        .when(F.col("l_linenumber") == 6, F.concat(F.lit("USD "), whole, F.lit(".")))
        .otherwise(F.lit("call us"))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", shown.alias("shown"))


_PRICE_TEXTS = """WITH d AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
    FROM lineitem), t AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE l_linenumber
    WHEN 1 THEN '$' || format('{:,}', cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0')
    WHEN 2 THEN 'EUR ' || (cents // 100) || ',' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0')
    WHEN 3 THEN '$' || format('{:,}', cents // 100) WHEN 4 THEN 'FREE shipping over ' || (cents // 100)
    WHEN 5 THEN '$' || (cents // 100) || '.00 to $' || (cents // 100 + 10) || '.00'
    WHEN 6 THEN 'USD ' || (cents // 100) || '.' ELSE 'call us' END AS shown FROM d)"""


@query(
    _PRICE_TEXTS
    + """, p AS (SELECT *, regexp_replace(shown, '[^0-9.,]', '', 'g') AS digits FROM t)
    SELECT l_orderkey, l_partkey, l_linenumber, shown, CASE WHEN contains(lower(shown), 'free') THEN 0.0::DOUBLE
    ELSE TRY_CAST(CASE WHEN contains(digits, ',') AND contains(digits, '.') THEN replace(digits, ',', '')
    WHEN len(string_split(digits, ',')) = 2 AND length(string_split(digits, ',')[2]) <= 2 THEN replace(digits, ',', '.')
    ELSE digits END AS DOUBLE) END AS price FROM p"""
)
def f2_extract_price(spark, sf):
    return _price_texts(spark, sf).withColumn("price", numbers.extract_price(F.col("shown")))


@query(
    r"""WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'not rated'
    ELSE (l_partkey % 12) || '.' || (l_linenumber) || ' out of stars' END AS shown FROM lineitem),
    r AS (SELECT *, TRY_CAST(nullif(regexp_extract(shown, '([0-9]+\.?[0-9]*)', 1), '') AS DOUBLE) AS n FROM t)
    SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN n > 5 THEN CASE WHEN n / 2 > 5 THEN 5.0 ELSE n / 2 END
    ELSE n END, 4) AS rating FROM r"""
)
def f3_extract_rating(spark, sf):
    shown = F.when(F.col("l_linenumber") % 3 == 0, F.lit("not rated")).otherwise(
        F.concat((F.col("l_partkey") % 12).cast("string"), F.lit("."), F.col("l_linenumber"), F.lit(" out of stars"))
    )
    rows = table(spark, sf, "lineitem")
    return rounded(rows.select("l_orderkey", "l_partkey", "l_linenumber", numbers.extract_rating(shown).alias("rating")))


# --- F4, F7-F10: addresses ----------------------------------------------------------------------------


@query(
    r"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https:' || regexp_replace(url, '^[a-z]+:', '')
    WHEN 2 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/dp/' || page_id
    WHEN 3 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_replace(regexp_extract(url,
    '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') || 'p/' || page_id
    WHEN 4 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/b/' || page_id ELSE '' END AS link FROM pages"""
)
def f4_normalize_url(spark, sf):
    kind, number = F.col("page_id") % 6, F.col("page_id").cast("string")
    written = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.regexp_replace("url", "^[a-z]+:", ""))
        .when(kind == 2, F.concat(F.lit("/dp/"), number))
        .when(kind == 3, F.concat(F.lit("p/"), number))
        .when(kind == 4, F.concat(F.lit("/a/../b/"), number))
    )
    return table(spark, sf, "pages").select("page_id", urls.normalize_url(written, F.col("url")).alias("link"))


@query(
    r"""SELECT page_id, regexp_matches(CASE WHEN page_id % 4 = 0 THEN replace(url, '://', ':/') ELSE url END,
    '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]') AS valid FROM pages"""
)
def f7_validate_url(spark, sf):
    shown = F.when(F.col("page_id") % 4 == 0, F.replace("url", F.lit("://"), F.lit(":/"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", urls.is_valid_url(shown).alias("valid"))


@query(
    r"""SELECT page_id, lower(regexp_extract(upper(url), '^[A-Z]+://([^/?#]*)', 1)) || ':8080' AS domain FROM pages"""
)
def f8_extract_domain(spark, sf):
    with_port = F.regexp_replace(F.upper("url"), r"^([A-Z]+://[^/?#]*)", "$1:8080")
    return table(spark, sf, "pages").select("page_id", urls.url_authority(with_port).alias("domain"))


@query(
    """SELECT p_partkey, s AS source, CASE WHEN s = 'ebay' AND p_size % 2 = 0 THEN NULL
    WHEN s = 'amazon' THEN 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') ELSE CAST(p_partkey AS VARCHAR) END AS static_id,
    CASE WHEN s = 'amazon' THEN 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')
    WHEN s = 'ebay' AND p_size % 2 = 0 THEN 'v1-' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS browser_id
    FROM part, (VALUES ('amazon'), ('ebay'), ('walmart')) v(s)"""
)
def f9_product_id_from_url(spark, sf):
    number = F.col("p_partkey").cast("string")
    parts = table(spark, sf, "part").select(
        "p_partkey", "p_size", F.explode(F.array(*[F.lit(s) for s in urls.BASE_URLS])).alias("source")
    )
    asin = F.concat(F.lit("B"), F.lpad(number, 9, "0"))
    item = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("v1-"), number)).otherwise(number)
    url = (
        F.when(F.col("source") == "amazon", F.concat(F.lit("https://www.amazon.com/x/dp/"), asin, F.lit("/ref")))
        .when(F.col("source") == "ebay", F.concat(F.lit("https://www.ebay.com/itm/"), item, F.lit("?x=1")))
        .otherwise(F.concat(F.lit("https://www.walmart.com/ip/some-name/"), number))
    )
    return parts.select(
        "p_partkey",
        "source",
        urls.product_id_from_url(url, F.col("source")).alias("static_id"),
        urls.product_id_from_url(url, F.col("source"), "browser").alias("browser_id"),
    )


# --- F5, F6 -----------------------------------------------------------------------------------------


@query(
    """SELECT order_no, line_no, product_id, md5(source || '-' || CASE WHEN line_no = 7 THEN 'None' ELSE product_id END
    || '-' || title) AS listing_hash FROM listings""",
    ("listings",),
)
def f5_listing_hash(spark, sf):
    maybe = F.when(F.col("line_no") != 7, F.col("product_id"))
    hashed = hashing.listing_hash(F.col("source"), maybe, F.col("title"))
    return listings(spark, sf).select("order_no", "line_no", "product_id", hashed.alias("listing_hash"))


@query(
    """SELECT order_no, line_no, product_id, md5(title || url || CAST(order_no AS VARCHAR) || '.5' || source) AS content_hash
    FROM listings""",
    ("listings",),
)
def f6_content_hash(spark, sf):
    hashed = hashing.content_hash(F.col("title"), F.col("url"), F.col("order_no") + 0.5, F.col("source"))
    return listings(spark, sf).select("order_no", "line_no", "product_id", hashed.alias("content_hash"))


# --- F11-F19 ----------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Open box ' || p_name WHEN p_size % 3 = 1 THEN 'USED' END AS condition,
    CASE WHEN p_size % 2 = 0 THEN 'Free delivery' ELSE NULL END AS shipping FROM part"""
)
def f11_f12_condition_and_shipping(spark, sf):
    size = F.col("p_size")
    condition = F.when(size % 3 == 0, F.concat(F.lit(" Open box "), "p_name")).when(size % 3 == 1, "USED\n").otherwise("ok")
    shipping = F.when(size % 2 == 0, "\tFree delivery ").otherwise("pick up")
    return table(spark, sf, "part").select(
        "p_partkey", text.condition_text(condition).alias("condition"), text.shipping_text(shipping).alias("shipping")
    )


@query(
    """SELECT event_id, round(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE), 4) AS number,
    TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP) AS moment,
    CAST(ts AS DATE) AS day FROM events"""
)
def f13_f14_f15_coercion(spark, sf):
    number = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("user_id").cast("string"))
    moment = F.when(F.col("event_id") % 7 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return rounded(
        table(spark, sf, "events").select(
            "event_id",
            numbers.to_number(number).alias("number"),
            times.to_time(moment).alias("moment"),
            times.to_day(F.col("ts")).alias("day"),
        )
    )


@query(
    """SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS label,
    round_even(c_custkey / 8.0, 2) AS even, '$' || printf('%.2f', c_custkey / 4.0) AS shown FROM customer"""
)
def f16_f17_round_and_label(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        text.label(F.col("c_mktsegment")).alias("label"),
        numbers.round_even(F.col("c_custkey") / 8.0).alias("even"),
        numbers.money(F.col("c_custkey") / 4.0).alias("shown"),
    )


@query(
    """SELECT o_orderkey, o_orderpriority AS first, CAST(o_custkey AS VARCHAR) AS depth FROM orders"""
)
def f18_json_codec(spark, sf):
    encoded = table(spark, sf, "orders").select(
        "o_orderkey",
        text.as_json(F.array("o_orderpriority", "o_orderstatus")).alias("keywords"),
        text.as_json(F.create_map(F.lit("depth"), F.col("o_custkey").cast("string"))).alias("config"),
    )
    return encoded.select(
        "o_orderkey",
        F.from_json("keywords", "array<string>")[0].alias("first"),
        F.from_json("config", "map<string,string>")["depth"].alias("depth"),
    )


@query(
    r"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x:
    regexp_replace(x, '^[\s\x0b\x1c-\x1f\x{85}\pZ]+|[\s\x0b\x1c-\x1f\x{85}\pZ]+$', '', 'g')) AS lines FROM documents)
    SELECT doc_id, list_filter(lines, lambda x: length(x) > 15 AND NOT starts_with(x, '$')
    AND NOT contains(lower(x), 'bid'))[1] AS title FROM l"""
)
def f19_title_fallback(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text.title_fallback(F.col("text"), F.lit("ebay")).alias("title"))


# --- P and R rows ---------------------------------------------------------------------------------------


@query(
    """SELECT source, title, round(price, 4) AS price, search_keyword, scraper_type, scraped_at, scraped_at AS created_at,
    product_id, brand FROM listings WHERE price > 0""",
    ("listings",),
)
def r1_analysis_scan(spark, sf):
    rows = analysis_scan(listings(spark, sf)).drop("rating", "url")
    return rounded(rows)


@query(
    """SELECT 'USD' AS currency, source, product_id, round(price, 4) AS price, CAST(NULL AS DOUBLE) AS rating,
    true AS is_valid, 'static' AS scraper_type, strftime(recorded_at, '%Y-%m-%dT%H:%M:%S.%f') AS scraped_at FROM ticks""",
    ("ticks",),
)
def p1_p2_conform_and_serialise(spark, sf):
    rows = ticks(spark, sf).withColumnRenamed("recorded_at", "scraped_at")
    out = filters.to_output(filters.conform(rows))
    return rounded(out.select("currency", "source", "product_id", "price", "rating", "is_valid", "scraper_type", "scraped_at"))


@query(
    """SELECT order_no, line_no, product_id, round(price, 4) AS price FROM listings WHERE price > 0 AND source IN ('A', 'R')
    AND search_keyword ILIKE '%prom%' AND scraped_at >= TIMESTAMP '2000-11-09 00:00:00'""",
    ("listings",),
)
def p3_p6_p7_filters(spark, sf):
    rows = filters.positive_price(listings(spark, sf))
    rows = filters.enabled_only(filters.by_keyword(rows, "prom"), ["A", "R"])
    recent = filters.recent(rows, "scraped_at", 360, "2001-11-04 00:00:00")
    return rounded(recent.select("order_no", "line_no", "product_id", "price"))


@query(
    """SELECT order_no, line_no, product_id, title FROM (SELECT *, CASE line_no WHEN 1 THEN 'SPONSORED ' || title
    WHEN 2 THEN 'Shop on eBay' WHEN 3 THEN NULL ELSE title END AS t FROM listings) WHERE line_no NOT IN (1, 2)""",
    ("listings",),
)
def p8_not_promotional(spark, sf):
    titled = (
        F.when(F.col("line_no") == 1, F.concat(F.lit("SPONSORED "), "title"))
        .when(F.col("line_no") == 2, F.lit("Shop on eBay"))
        .when(F.col("line_no") != 3, F.col("title"))
    )
    rows = listings(spark, sf).withColumn("plain", F.col("title")).withColumn("title", titled)
    kept = filters.not_promotional(rows)
    return kept.select("order_no", "line_no", "product_id", F.col("plain").alias("title"))


# --- V1, X10 ------------------------------------------------------------------------------------------


@query(
    """WITH v AS (SELECT id, CASE WHEN id % 11 = 0 THEN '' ELSE 'Item ' || id END AS title, source,
    CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN 'item/' || id ELSE 'https://shop.example.com/' || id END AS url,
    price * 300.0 AS price FROM ticks),
    e AS (SELECT id, list_filter([CASE WHEN title = '' THEN 'Missing required field: title' END,
    CASE WHEN url IS NULL THEN 'Missing required field: url' END,
    CASE WHEN price < 0.01 OR price > 100000 THEN 'Price out of range: ' || CAST(price AS BIGINT) || '.0' END,
    CASE WHEN url IS NULL OR url LIKE 'item/%' THEN 'Invalid URL format: ' || coalesce(url, 'None') END],
    lambda x: x IS NOT NULL) AS errors FROM v)
    SELECT id, len(errors) = 0 AS is_valid, array_to_string(errors, '; ') AS errors FROM e""",
    ("ticks",),
)
def v1_validate(spark, sf):
    number = F.col("id").cast("string")
    rows = ticks(spark, sf).select(
        "id",
        F.when(F.col("id") % 11 == 0, "").otherwise(F.concat(F.lit("Item "), number)).alias("title"),
        "source",
        F.when(F.col("id") % 13 == 0, None)
        .when(F.col("id") % 17 == 0, F.concat(F.lit("item/"), number))
        .otherwise(F.concat(F.lit("https://shop.example.com/"), number))
        .alias("url"),
        (F.col("price") * 300.0).alias("price"),
    )
    checked = quality.validate(rows)
    return checked.select("id", "is_valid", F.array_join("validation_errors", "; ").alias("errors"))


@query(
    """SELECT order_no, line_no, product_id, title || ' & co' AS title, brand || ' x' AS brand, round(price, 2) AS price,
    'https://www.amazon.com/dp/' || product_id AS url FROM (SELECT order_no, line_no, product_id, title, brand,
    CAST(order_no AS DOUBLE) + 0.25 AS price FROM listings)""",
    ("listings",),
)
def x10_clean_listings(spark, sf):
    rows = listings(spark, sf).select(
        "order_no",
        "line_no",
        "product_id",
        F.lit("amazon").alias("source"),
        F.concat(F.lit("  "), "title", F.lit(" &amp;  co\n")).alias("title"),
        F.concat("brand", F.lit("\t x")).alias("brand"),
        F.concat(F.lit("$"), "order_no", F.lit(".25")).alias("price"),
        F.concat(F.lit("/dp/"), "product_id").alias("url"),
    )
    return rounded(quality.clean_listings(rows).drop("source"))


@query(
    """WITH v AS (SELECT id, source, CASE WHEN id % 11 = 0 THEN NULL ELSE 'Item ' || id END AS title, price FROM ticks)
    SELECT source, count(*) FILTER (title IS NOT NULL AND price >= 0.01) AS good,
    count(*) FILTER (title IS NULL OR price < 0.01) AS bad FROM v GROUP BY source""",
    ("ticks",),
)
def d1_split_valid(spark, sf):
    rows = ticks(spark, sf).select(
        "source",
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("Item "), "id")).alias("title"),
        "price",
        F.concat(F.lit("https://shop.example.com/"), "id").alias("url"),
    )
    good, bad = quality.split_valid(rows)
    marked = good.select("source", F.lit(1).alias("g")).unionByName(bad.select("source", F.lit(0).alias("g")))
    return marked.groupBy("source").agg(F.count_if(F.col("g") == 1).alias("good"), F.count_if(F.col("g") == 0).alias("bad"))


@query(
    """SELECT order_no, line_no, product_id, CASE source WHEN 'A' THEN 'static' WHEN 'R' THEN 'selenium' END AS scraper_type
    FROM sightings""",
    ("sightings",),
)
def x11_route(spark, sf):
    from shelfspark.operators.extract import route

    names = F.when(F.col("source") == "A", "ebay").when(F.col("source") == "R", "amazon").otherwise("other")
    rows = sightings(spark, sf).select("order_no", "line_no", "product_id", names.alias("source"))
    return route(rows).drop("source")
