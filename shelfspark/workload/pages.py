"""Extraction and classification over the pages table and over pages written from the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.adapters import table
from shelfspark.operators import classify, extract
from shelfspark.sources.readers import dealt, read_pages, spread
from shelfspark.workload.registry import query, rounded

# --- Pages written from the catalogue: a complete card, one without title, one without price ----------


def _parts(spark, sf) -> DataFrame:
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    dollars = F.expr("CAST(round(p_retailprice * 100) AS BIGINT) div 100")
    amount = F.concat(F.lit("$"), F.format_number(dollars, 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    asin = F.concat(F.lit("B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    # Few narrow rows become long pages, so they are dealt out before the markup is written.
    return dealt(table(spark, sf, "part"), "p_partkey").select(
        "p_partkey",
        F.concat_ws(" ", "p_name", "p_brand", F.lit("&amp; more")).alias("label"),
        F.col("p_type").alias("keyword"),
        amount.alias("amount"),
        asin.alias("asin"),
        F.concat((F.col("p_size") % 5).cast("string"), F.lit(".5 out of 5 stars")).alias("stars"),
    )


def _page(parts: DataFrame, source: str, url, *cards) -> DataFrame:
    body = F.concat(F.lit("<html><body><p>Results<br><b>for you"), *cards, F.lit("</body></html>"))
    return parts.select(
        F.col("p_partkey").alias("page_id"),
        F.lit(source).alias("source"),
        url.alias("url"),
        F.col("keyword").alias("search_keyword"),
        F.lit(1).alias("page_number"),
        body.alias("html"),
    )


def _html(template: str):
    """Concatenation of literal markup and the columns named in braces."""
    pieces = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        if piece:
            pieces.append(F.col(piece) if i % 2 else F.lit(piece))
    return F.concat(*pieces)


AMAZON_CARD = (
    '<div data-component-type="s-search-result" data-asin="{asin}"><h2><a href="/dp/{asin}/ref"><span>%s</span></a></h2>'
    '%s<i class="a-icon-alt" alt="{stars}" aria-label="{stars}"></i>'
    '<img class="s-image" src="//img.example.com/{asin}.jpg"></div>'
)
AMAZON_PRICE = '<span class="a-price"><span class="a-offscreen">{amount}</span></span>'
EBAY_CARD = (
    '<li class="s-item"><a class="s-item__link" href="https://www.ebay.com/itm/{p_partkey}?x=1">'
    '<div class="s-item__title">%s</div></a>%s<span class="s-item__shipping">Free shipping</span>'
    '<span class="s-item__subtitle">Pre-owned used</span>'
    '<div class="s-item__image"><img src="https://i.ebayimg.com/{p_partkey}.jpg"></div></li>'
)
EBAY_PRICE = '<span class="s-item__price">{amount}</span>'
WALMART_CARD = (
    '<div data-automation-id="product-tile"><a href="/ip/some-name/{p_partkey}"></a>'
    '<span data-automation-id="product-title">%s</span>%s<span class="average-rating">{stars}</span></div>'
)
WALMART_PRICE = '<div data-automation-id="product-price"><span>{amount}</span></div>'
GENERIC_CARD = '<div class="product"><h2>%s</h2>%s<a href="p/{p_partkey}"></a><img src="/i/{p_partkey}.jpg"></div>'
GENERIC_PRICE = '<span class="price">{amount}</span>'


def _three(card: str, price: str) -> list:
    return [_html(card % pair) for pair in (("{label}", price), ("", price), ("{label}", ""))]


def amazon_pages(spark, sf) -> DataFrame:
    return _page(_parts(spark, sf), "amazon", F.lit("https://www.amazon.com/s?k=x"), *_three(AMAZON_CARD, AMAZON_PRICE))


def ebay_pages(spark, sf) -> DataFrame:
    shop = _html(EBAY_CARD % ("Shop on eBay", EBAY_PRICE))
    cards = [*_three(EBAY_CARD, EBAY_PRICE), shop]
    return _page(_parts(spark, sf), "ebay", F.lit("https://www.ebay.com/sch/i.html"), *cards)


def walmart_pages(spark, sf) -> DataFrame:
    url = F.lit("https://www.walmart.com/search/")
    return _page(_parts(spark, sf), "walmart", url, *_three(WALMART_CARD, WALMART_PRICE))


def generic_pages(spark, sf) -> DataFrame:
    """25 equal cards per page."""
    card = _html(GENERIC_CARD % ("{label}", GENERIC_PRICE))
    return _page(_parts(spark, sf), "shop", F.lit("https://shop.example.com/a"), F.repeat(card, F.lit(25)))


_CATALOGUE = """SELECT p_partkey AS page_id, p_name || ' ' || p_brand || ' & more' AS title, p_type AS search_keyword,
    CAST(round(p_retailprice * 100) AS BIGINT) / 100.0 AS price, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS asin,
    CAST(p_partkey AS VARCHAR) AS id, CAST(p_size % 5 AS DOUBLE) + 0.5 AS stars FROM part"""
_POSITIONS = "(VALUES (1, true), (3, false)) v(pos, has_price)"
_BASE = """page_id, CAST(pos AS INTEGER) AS position_on_page, search_keyword, title,
    CASE WHEN has_price THEN round(price, 2) END AS price"""
_COMMON = ["page_id", "position_on_page", "search_keyword", "title", "price"]


@query(
    f"""SELECT {_BASE}, 'https://www.amazon.com/dp/' || asin || '/ref' AS url, asin AS product_id, stars AS rating,
    'https://img.example.com/' || asin || '.jpg' AS image_url FROM ({_CATALOGUE}), {_POSITIONS}"""
)
def x1_amazon_cards(spark, sf):
    rows = extract.extract_listings(amazon_pages(spark, sf))
    return rows.select(*_COMMON, "url", "product_id", "rating", "image_url")


@query(
    f"""SELECT {_BASE}, 'https://www.ebay.com/itm/' || id || '?x=1' AS url, id AS product_id,
    'Pre-owned used' AS condition, 0.0::DOUBLE AS shipping_cost, 'https://i.ebayimg.com/' || id || '.jpg' AS image_url
    FROM ({_CATALOGUE}), {_POSITIONS}"""
)
def x2_ebay_cards(spark, sf):
    rows = extract.extract_listings(ebay_pages(spark, sf))
    return rows.select(*_COMMON, "url", "product_id", "condition", "shipping_cost", "image_url")


@query(
    f"""SELECT {_BASE}, 'https://www.walmart.com/ip/some-name/' || id AS url, id AS product_id, stars AS rating
    FROM ({_CATALOGUE}), {_POSITIONS}"""
)
def x3_walmart_cards(spark, sf):
    rows = extract.extract_listings(walmart_pages(spark, sf))
    return rows.select(*_COMMON, "url", "product_id", "rating")


@query(
    f"""SELECT page_id, CAST(pos AS INTEGER) AS position_on_page, search_keyword, title, round(price, 2) AS price,
    'p/' || id AS url, '/i/' || id || '.jpg' AS image_url
    FROM ({_CATALOGUE}), (SELECT unnest(range(1, 26)) AS pos)"""
)
def x4_generic_cards(spark, sf):
    return extract.extract_listings(generic_pages(spark, sf)).select(*_COMMON, "url", "image_url")


@query(
    f"""SELECT {_BASE}, 'https://www.amazon.com/dp/' || asin || '/ref' AS url, asin AS product_id, stars AS rating,
    'scrapy' AS scraper_type FROM ({_CATALOGUE}), {_POSITIONS}"""
)
def x5_framework_cards(spark, sf):
    rows = extract.extract_framework_listings(amazon_pages(spark, sf))
    return rows.select(*_COMMON, "url", "product_id", "rating", "scraper_type")


@query(
    f"""SELECT page_id, CAST(pos AS INTEGER) AS position_on_page, search_keyword,
    CASE WHEN pos = 2 THEN fallback ELSE title END AS title, CASE WHEN pos < 3 THEN round(price, 2) END AS price,
    'https://www.amazon.com/dp/' || asin || '/ref' AS url, asin AS product_id,
    CASE WHEN stars = 0 THEN NULL ELSE stars END AS rating
    FROM (SELECT *, CAST(NULL AS VARCHAR) AS fallback FROM ({_CATALOGUE})), (VALUES (1), (3)) v(pos)"""
)
def x6_rendered_amazon_cards(spark, sf):
    rows = extract.extract_rendered_listings(amazon_pages(spark, sf))
    return rows.select(*_COMMON, "url", "product_id", "rating")


@query(
    f"""SELECT page_id, CAST(pos AS INTEGER) AS position_on_page, search_keyword,
    title, CASE WHEN has_price THEN round(price, 2) END AS price,
    'https://www.ebay.com/itm/' || id || '?x=1' AS url, id AS product_id,
    'Pre-owned used' AS condition, 'https://i.ebayimg.com/' || id || '.jpg' AS image_url
    FROM ({_CATALOGUE}), {_POSITIONS}"""
)
def x7_rendered_ebay_cards(spark, sf):
    rows = extract.extract_rendered_listings(ebay_pages(spark, sf))
    return rows.select(*_COMMON, "url", "product_id", "condition", "image_url")


@query(
    """SELECT p_partkey AS page_id, p_name || ' from ' || p_brand AS description,
    CASE WHEN p_size % 2 = 0 THEN 'In Stock' ELSE 'Only ' || p_size || ' left' END AS availability FROM part"""
)
def x9_amazon_details(spark, sf):
    stock = F.when(F.col("p_size") % 2 == 0, F.lit(" In  Stock\n")).otherwise(
        F.concat(F.lit("Only "), F.col("p_size"), F.lit(" left"))
    )
    html = F.concat(
        F.lit('<div id="feature-bullets"><h3>About</h3><ul><li>'), "p_name", F.lit("</li> <li>from "), "p_brand",
        F.lit('</li></ul></div><div id="availability"><span>'), stock, F.lit("</span></div>"),
    )
    pages = spread(table(spark, sf, "part"), "p_partkey").select(
        F.col("p_partkey").alias("page_id"), F.lit("amazon").alias("source"), html.alias("html")
    )
    return extract.extract_details(pages).select("page_id", "description", "availability")


@query(
    """SELECT p_partkey AS page_id, ['ebay', 'walmart', 'elsewhere'][p_partkey % 3 + 1] AS source,
    CASE WHEN p_partkey % 3 = 2 THEN 'All about ' || p_name END AS description,
    CASE WHEN p_partkey % 3 = 0 THEN p_type || ' (98.7%)' END AS seller_name,
    CASE WHEN p_partkey % 3 = 1 THEN 'Brand' || p_brand || 'Size:' || p_size || ' cm' END AS specifications,
    p_brand AS brand, p_size || ' cm' AS size, CASE WHEN p_partkey % 3 = 2 THEN p_type || '; ' || p_brand END AS kind,
    CAST(CASE WHEN p_partkey % 3 = 2 THEN 4 ELSE 2 END AS INTEGER) AS labels FROM part"""
)
def x9_detail_pages(spark, sf):
    """Detail pages of three kinds, written from the catalogue: a table, a table with the cells left open, a definition list."""
    text = lambda *parts: F.concat(*[F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])
    ebay = text('<div class="seller-persona"> ', "$p_type", "  (98.7%)\n</div><table><tr><th>Item</th><th>Specifics</th></tr><tr><th>Brand</th><td>",
                "$p_brand", "</td></tr><tr><td>Size:</td><td> ", "$p_size", " </td><td>cm</td></tr><tr><td>alone</td></tr></table>")
    walmart = text("<table><tr><td>Brand</td><td>other</td></tr></table><table class='specs-table'><tr><td>Brand<td>", "$p_brand",
                   "<tr><td>Size:<td>", "$p_size", " cm</table>")
    other = text("<p class='long-description'>All about ", "$p_name", "</p><dl><dt>Brand<dd>", "$p_brand", "<dt>Size</dt><dt>Height</dt><dd>", "$p_size",
                 " cm</dd><dt>Kind</dt><dd>", "$p_type", "</dd><dd>", "$p_brand", "</dd><dd>", "$p_type", "</dd></dl>")
    number = F.col("p_partkey") % 3
    pages = spread(table(spark, sf, "part"), "p_partkey").select(
        F.col("p_partkey").alias("page_id"),
        F.when(number == 0, "ebay").when(number == 1, "walmart").otherwise("elsewhere").alias("source"),
        F.when(number == 0, ebay).when(number == 1, walmart).otherwise(other).alias("html"),
    )
    details = extract.extract_details(pages).drop("availability", "position")
    pairs = extract.extract_specifications(pages).select("page_id", F.col("specifications").alias("map"))
    of = lambda label: F.try_element_at("map", F.lit(label))
    return details.join(pairs, "page_id").select(
        "page_id", "source", "description", "seller_name", "specifications", of("Brand").alias("brand"), of("Size").alias("size"),
        of("Kind").alias("kind"), F.size("map").alias("labels"),
    )


@query(
    """SELECT page_id, CAST(regexp_extract(html, '(?s)<article>(.*)</article>', 1) <> '' AS BOOLEAN) AS has_article,
    CASE WHEN contains(html, '<div class="ad">') THEN true ELSE false END AS has_ad FROM pages"""
)
def x9_generic_page_fields(spark, sf):
    rules = {None: {"description": ["article"], "availability": [".ad"]}}
    pages = read_pages(spark, f"{sf}/pages.parquet").select("page_id", F.lit("web").alias("source"), "html")
    found = extract.extract_details(pages, rules)
    return found.select(
        "page_id",
        (F.coalesce("description", F.lit("")) != "").alias("has_article"),
        F.col("availability").isNotNull().alias("has_ad"),
    )


@query(
    r"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?s)<a\s+href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h,
    regexp_extract_all(html, '(?s)<a\s+href="([^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM pages),
    b AS (SELECT page_id, url, CAST(unnest(range(1, len(h) + 1)) AS INTEGER) AS position, unnest(h) AS href, unnest(t) AS t FROM a)
    SELECT page_id, position, href,
    CASE WHEN href LIKE 'http%' THEN href ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href END AS link,
    regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(t, '<[^>]*>', '', 'g'), '&middot;?', '·', 'g'),
    '&copy;?', '©', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')), '[^\x20-\x7E]', '', 'g') AS text FROM b"""
)
def x12_page_links(spark, sf):
    return extract.page_links(read_pages(spark, f"{sf}/pages.parquet"))


@query(
    r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?s)<(?:h1|title)\b[^>]*>(.*?)</(?:h1|title)>', 1) AS t FROM pages),
    b AS (SELECT page_id, CAST(unnest(range(1, len(t) + 1)) AS INTEGER) AS position, unnest(t) AS t FROM a)
    SELECT page_id, position,
    regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&middot;?', '·', 'g'),
    '&copy;?', '©', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')), '[^\x20-\x7E]', '', 'g') AS heading FROM b"""
)
def x12_page_headings(spark, sf):
    return extract.page_headings(read_pages(spark, f"{sf}/pages.parquet"))


# Damage put into pages, by page_id % 9; the other pages stay as they are.
DAMAGE = {2: "CAST(NULL AS STRING)", 4: "''", 5: "concat(html, chr(0))", 7: "regexp_replace(html, '<', '(')"}


@query(
    r"""WITH p AS (SELECT page_id, url, CASE page_id % 9 WHEN 2 THEN NULL WHEN 4 THEN '' WHEN 5 THEN html || chr(0)
        WHEN 7 THEN replace(html, '<', '(') ELSE html END AS html FROM pages),
    e AS (SELECT page_id, html, CASE WHEN html IS NULL THEN 'no page' WHEN contains(html, chr(0)) THEN 'binary content'
        WHEN trim(html) = '' THEN 'empty page' WHEN NOT regexp_matches(html, '<[a-zA-Z!/]') THEN 'no markup' END AS error FROM p)
    SELECT page_id, error, CASE WHEN error IS NULL
        THEN CAST(len(regexp_extract_all(html, '(?s)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>')) AS BIGINT) ELSE 0 END AS links FROM e"""
)
def x12_damaged_pages(spark, sf):
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in DAMAGE.items())
    damaged = read_pages(spark, f"{sf}/pages.parquet").withColumn("html", F.expr(f"CASE page_id % 9 {cases} ELSE html END"))
    # One row a page: a page that cannot be read is told with its error, and the others go on.
    counted = extract.page_links(damaged).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))
    told = damaged.select("page_id", extract.page_error(F.col("html")).alias("error"))
    return told.join(counted, "page_id", "left").select("page_id", "error", F.coalesce("links", F.lit(0)).alias("links"))


# --- Classification ----------------------------------------------------------------------------------

# Markup placed into every page, by page_id % 8, so that each rule has something to find.
SNIPPETS = (
    "",
    '<div class="g-recaptcha"></div>',
    '<form action="/c"><input name="captcha"></form>',
    '<iframe src="https://hcaptcha.com/x"></iframe>',
    "<p>Please verify you are human</p>",
    '<div id="cf-wrapper">cloudflare</div>',
    "<p>Access Denied - unusual traffic, automated queries</p>",
    '<div class="box challenge-form" id="challenge-x">Security check</div>',
)
STATUSES = (200, 200, 503, 200, 429)


def suspect_pages(spark, sf) -> DataFrame:
    """The pages table with markup, status and address marks that depend on the page id."""
    snippet = F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), (F.col("page_id") % 8 + 1).cast("int"))
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.col("page_id") % 5 + 1).cast("int"))
    marked = F.concat("url", F.when(F.col("page_id") % 3 == 0, "&verify=recaptcha").otherwise(""))
    return read_pages(spark, f"{sf}/pages.parquet").select(
        "page_id",
        marked.alias("url"),
        F.regexp_extract("url", "^[a-z]+://(?:[^/?#]*\\.)?([^/?#.]+\\.[a-z]+)", 1).alias("source"),
        status.alias("status"),
        F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), snippet)).alias("html"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


SUSPECT_SQL = f"""WITH s AS (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '&verify=recaptcha' ELSE '' END AS url,
    regexp_extract(url, '^[a-z]+://(?:[^/?#]*\\.)?([^/?#.]+\\.[a-z]+)', 1) AS source,
    {_sql_list(STATUSES)}[page_id % 5 + 1] AS status,
    replace(html, '<body>', '<body>' || {_sql_list(SNIPPETS)}[page_id % 8 + 1]) AS html FROM pages)"""


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_sql_text(w)})" for w in words) + ")"


def _sql_score(terms: list[tuple[str, float]]) -> str:
    return "0.0::DOUBLE" + "".join(f" + CASE WHEN {t} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for t, w in terms)


def _sql_element(selector: str) -> str:
    return f"regexp_matches(html, {_sql_text(classify.element_pattern(selector))})"


_BLOCKED = (
    f"(status IN (403, 429, 503) OR {_sql_any('lower(html)', classify.BLOCKED_PHRASES)} OR length(html) < 500)"
)


@query(f"{SUSPECT_SQL} SELECT page_id, {_BLOCKED} AS blocked FROM s")
def b1_blocked_pages(spark, sf):
    pages = suspect_pages(spark, sf)
    return pages.select("page_id", classify.is_blocked(F.col("html"), F.col("status")).alias("blocked"))


@query(
    f"{SUSPECT_SQL} SELECT page_id, CASE "
    + " ".join(f"WHEN contains(lower(html), {_sql_text(w)}) THEN {_sql_text(w)}" for w in classify.FIRST_INDICATORS)
    + " END AS indicator FROM s"
)
def b2_first_indicator(spark, sf):
    return suspect_pages(spark, sf).select("page_id", classify.first_indicator(F.col("html")).alias("indicator"))


def _score_sql() -> str:
    weights = classify.score_weights()
    title = "lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
    terms = [(f"contains(lower(html), {_sql_text(w)})", x) for w, x in weights["text"]]
    terms += [(_sql_element(s), x) for s, x in weights["elements"]]
    terms += [(_sql_any("lower(url)", classify.SCORE_URL), 0.3), (_sql_any(title, classify.SCORE_TITLE), 0.25)]

    def seen(term: str) -> str:
        tests = [f"contains(lower(html), {_sql_text(w)})" for w in classify.SCORE_TEXT if term in w]
        tests += [_sql_element(s) for s in classify.SCORE_ELEMENTS if term in s]
        tests += [f"contains(lower(url), {_sql_text(p)})" for p in classify.SCORE_URL if term in p]
        tests += [f"contains({title}, {_sql_text(t)})" for t in classify.SCORE_TITLE if term in t]
        return "(" + " OR ".join(tests) + ")"

    return f"""{SUSPECT_SQL}, c AS (SELECT page_id, {_sql_score(terms)} AS score, {seen("recaptcha")} AS re,
    {seen("hcaptcha")} AS h, {seen("cloudflare")} AS cf FROM s)
    SELECT page_id, round(score, 4) AS score, score > 0.3 AS detected, CASE WHEN score > 0.3 THEN CASE WHEN re
    THEN 'reCAPTCHA' WHEN h THEN 'hCAPTCHA' WHEN cf THEN 'Cloudflare' ELSE 'Generic CAPTCHA' END END AS challenge_type FROM c"""


@query(_score_sql())
def b3_challenge_score(spark, sf):
    pages = suspect_pages(spark, sf)
    title = classify.page_title(F.col("html"))
    scored = pages.select("page_id", classify.challenge_score(F.col("html"), F.col("url"), title).alias("_s"))
    return rounded(scored.select("page_id", "_s.*"))


def _verdict_sql() -> str:
    weights = classify.verdict_weights()
    title = "lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
    text = [(f"contains(lower(html), {_sql_text(w)})", x) for w, x in weights["text"]]
    elements = [(_sql_element(s), x) for s, x in weights["elements"]]
    url = [(f"contains(lower(url), {_sql_text(p)})", x) for p, x in weights["url"]]
    forms = "regexp_extract_all(lower(html), '(?s)<form\\b[^>]*>(.*?)</form>', 1)"
    frames = "regexp_extract_all(lower(html), '<iframe\\b[^>]*\\ssrc\\s*=\\s*[\"'']([^\"'']*)', 1)"
    form_hits = f"len(list_filter({forms}, lambda f: {_sql_any('f', classify.VERDICT_FORM)}))"
    frame_hits = f"len(list_filter({frames}, lambda f: {_sql_any('f', classify.VERDICT_IFRAME)}))"
    network = [(f"contains(html, {_sql_text(s)})", 0.3) for s in classify.VERDICT_SERVICES]

    def kind(terms: list, names: tuple, otherwise: str) -> str:
        def seen(term: str) -> str:
            hits = [t for t, n in zip([t for t, _ in terms], names) if term in n]
            return "(" + " OR ".join(hits) + ")" if hits else "false"

        rest = otherwise if otherwise != "captcha" else f"CASE WHEN {seen('captcha')} THEN 'generic_captcha' END"
        return (
            f"CASE WHEN {seen('recaptcha')} THEN 'recaptcha' WHEN {seen('hcaptcha')} THEN 'hcaptcha' "
            f"WHEN {seen('cloudflare')} THEN 'cloudflare' ELSE {rest} END"
        )

    return f"""{SUSPECT_SQL}, c AS (SELECT page_id, least({_sql_score(text)}, 1.0) AS text_score,
    least({_sql_score(elements)}, 1.0) AS element_score, least({_sql_score(url)}, 1.0) AS url_score,
    least(CASE WHEN {_sql_any(title, classify.VERDICT_TITLE)} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN {form_hits} > 0 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + {frame_hits} * 0.5::DOUBLE, 1.0) AS behaviour_score,
    least({_sql_score(network)}, 1.0) AS network_score,
    {kind(text, classify.VERDICT_TEXT, "captcha")} AS k1,
    {kind(elements, classify.VERDICT_ELEMENTS, "'generic_captcha'")} AS k2,
    {kind(url, classify.VERDICT_URL, "'url_based_challenge'")} AS k3 FROM s),
    k AS (SELECT page_id, k, count(*) AS n FROM (SELECT page_id, unnest([k1, k2, k3, 'behavioral_analysis', 'network_analysis']) AS k
    FROM c) WHERE k IS NOT NULL GROUP BY ALL),
    m AS (SELECT page_id, k AS challenge_type FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, k) AS rn
    FROM k) WHERE rn = 1)
    SELECT c.page_id, round(text_score, 4) AS text_score, round(element_score, 4) AS element_score,
    round(url_score, 4) AS url_score, round(behaviour_score, 4) AS behaviour_score, round(network_score, 4) AS network_score,
    text_score + element_score + url_score + behaviour_score + network_score > 0.3 AS detected,
    round(least(text_score + element_score + url_score + behaviour_score + network_score, 1.0), 4) AS confidence,
    challenge_type FROM c JOIN m ON c.page_id = m.page_id"""


@query(_verdict_sql())
def b4_challenge_verdict(spark, sf):
    return rounded(classify.challenge_verdict(suspect_pages(spark, sf)).drop("url", "source", "status"))


@query(
    f"""{SUSPECT_SQL} SELECT source, count(*) AS attempted, count(*) FILTER (NOT {_BLOCKED}) AS successful,
    count(*) FILTER ({_BLOCKED}) AS blocked FROM s GROUP BY source"""
)
def b6_block_rates(spark, sf):
    return classify.block_rates(suspect_pages(spark, sf))
