"""Product rows out of pages.

A task parses each page once and reports, per product card and field, what each selector found. Everything
after that — choosing between the findings, cleaning, numbers, addresses, ids — is column expressions.
"""

from __future__ import annotations

import html as html_entities
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.markup import Element, FirstFinder, label_values, parse
from shelfspark.functions.numbers import extract_price, extract_rating
from shelfspark.functions.text import (
    PROMOTIONAL_TITLES,
    clean_text,
    condition_text,
    contains_any,
    shipping_text,
    squeeze,
    title_fallback,
)
from shelfspark.functions.urls import BASE_URLS, by_source, normalize_url, normalized, product_id_from_url
from shelfspark.operators.quality import clean_listings

CARDS_PER_BATCH = 2_000
FIELDS = ("title", "link", "price", "rating", "image", "condition", "shipping")
# What the rows of a page's cards take over from the page.
PAGE_COLUMNS = ("page_id", "source", "search_keyword", "page_number", "scraped_at")
_ATTRIBUTES = {
    "href": "href",
    "src": "src",
    "alt": "alt",
    "title": "title",
    "data_src": "data-src",
    "aria_label": "aria-label",
    "data_a_price": "data-a-price",
}
_HIT = T.StructType([T.StructField(n, T.StringType()) for n in ("text", *_ATTRIBUTES)])

# Card containers (tried in order) and selectors per field, by source; None is any other source.
LISTING_RULES = {
    "amazon": {
        "containers": ['[data-component-type="s-search-result"]'],
        "title": ["h2 a span, .s-title-instructions-style span"],
        "link": ["h2 a"],
        "price": [".a-price-whole, .a-price .a-offscreen"],
        "rating": [".a-icon-alt"],
        "image": [".s-image"],
    },
    "ebay": {
        "containers": [".s-item"],
        "title": [".s-item__title"],
        "link": [".s-item__link"],
        "price": [".s-item__price"],
        "image": [".s-item__image img"],
        "condition": [".s-item__subtitle"],
        "shipping": [".s-item__shipping"],
    },
    "walmart": {
        "containers": ['[data-automation-id="product-tile"]'],
        "title": ['[data-automation-id="product-title"]'],
        "link": ["a"],
        "price": ['[data-automation-id="product-price"] span'],
        "rating": [".average-rating"],
        "image": ['img[data-automation-id="product-image"]'],
    },
    None: {
        "containers": [".product", ".item", ".result", '[data-testid*="product"]', '[class*="product"]'],
        "title": ["h1", "h2", "h3", ".title", '[class*="title"]', '[class*="name"]'],
        "link": ["a"],
        "price": [".price", '[class*="price"]', '[data-testid*="price"]'],
        "image": ["img"],
    },
}

# The same for pages rendered by a browser, with fallbacks per field.
ROBUST_RULES = {
    "amazon": {
        "containers": [
            '[data-component-type="s-search-result"]', ".s-result-item", '[data-asin]:not([data-asin=""])',
            ".sg-col-inner", "[data-asin]", ".s-item", ".product", "[data-component-type]",
        ],
        "title": [
            "h2 a span", ".s-title-instructions-style span", "h2 span", ".s-color-base", "a[title]",
            ".a-link-normal span",
        ],
        "link": ["h2 a", "a[title]", "a"],
        "price": [".a-price .a-offscreen", ".a-price-whole", ".a-price", "[data-a-price]", ".s-price"],
        "rating": [".a-icon-alt", ".a-icon", '[aria-label*="stars"]'],
        "image": [".s-image", "img", "[data-src]"],
    },
    "ebay": {
        "containers": [
            ".s-item", ".srp-item", ".srp-river-results .s-item", '[data-view="mi:1686"]', '[id*="item"]', ".item",
            ".listing", ".product",
        ],
        "title": [".s-item__title", ".s-item__title span", ".it-ttl a", ".vip-title", "h3.it-ttl", '[role="heading"]'],
        "link": [".s-item__link", ".it-ttl a", 'a[href*="/itm/"]', "a"],
        "price": [
            ".s-item__price", ".notranslate", ".it-price", ".u-flL.notranslate",
            ".s-item__detail.s-item__detail--primary .notranslate",
        ],
        "image": [".s-item__image img", ".img img", "img"],
        "condition": [".s-item__subtitle", ".clipped", ".SECONDARY_INFO"],
        "shipping": [".s-item__shipping", ".vi-acc-del-range", ".u-flL"],
    },
}

# What the address of a browser-rendered card must contain.
ROBUST_LINK_PATTERNS = {"amazon": "/dp/", "ebay": r"/itm/|ebay\.com"}
MIN_TITLE_CHARS = 10

# Fields of a product's own page, by source.
DETAIL_RULES = {
    "amazon": {"description": ["#feature-bullets ul"], "availability": ["#availability span"]},
    "ebay": {"seller_name": [".seller-persona"]},
    "walmart": {"specifications": [".specs-table"]},
    None: {"description": [".description", '[class*="description"]', '[class*="detail"]']},
}
DETAIL_FIELDS = ("description", "availability", "seller_name", "specifications")


_NOTHING = (None,) * (len(_ATTRIBUTES) + 1)


def _finding(element: Element) -> tuple:
    """The values of a finding, in the order of ``_HIT``."""
    attrs = element.attrs
    return (html_entities.unescape(element.text()), *[attrs.get(a) for a in _ATTRIBUTES.values()])


def _hits(flat: list[tuple | None], ends: list[int]) -> pa.Array:
    """Arrays of findings; the array of a card ends where ``ends`` tells."""
    columns = zip(*[h or _NOTHING for h in flat]) if flat else [()] * len(_NOTHING)
    missing = pa.array([h is None for h in flat], pa.bool_())
    structs = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=_HIT.names, mask=missing)
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), structs)


class _Findings:
    """What every selector of every field found, card by card."""

    def __init__(self, fields: tuple[str, ...]):
        self.fields = fields
        self.empty()

    def empty(self) -> None:
        self.cards, self.flat, self.ends = [], [[] for _ in self.fields], [[] for _ in self.fields]

    def add(self, source: str | None, position: int, card: Element, found: dict[int, Element], places: list[list[int]]) -> None:
        read_once = {place: _finding(e) for place, e in found.items()}
        for flat, ends, of_field in zip(self.flat, self.ends, places):
            flat += [read_once.get(place) for place in of_field]
            ends.append(len(flat))
        # Without containers the card is the page itself.
        self.cards.append((position, card.attrs.get("data-asin"), card.lines() if card.parent is not None else None))

    def take(self) -> list[pa.Array]:
        columns = [*map(pa.array, zip(*self.cards)), *map(_hits, self.flat, self.ends)]
        self.empty()
        return columns


def _first_found(found: dict[int, Element], places: list[int]) -> Element | None:
    for place in places:
        if place in found:
            return found[place]
    return None


def _text(element: Element | None) -> str | None:
    if element is None:
        return None
    text = element.text()
    return html_entities.unescape(text) if "&" in text else text


class _Listings:
    """What a listing takes from a card: of a field the first finding, of the price all.

    Addresses are resolved here: ``link`` as listings are read, ``url`` and ``image`` as they are cleaned after that.
    """

    def __init__(self, rules: dict, base_urls: dict[str, str]):
        self.base_urls = base_urls
        count = max((len(rule.get("price", ())) for rule in rules.values()), default=0)
        self.no_prices = (None,) * count
        prices = [f"price_{n}" for n in range(1, count + 1)]
        self.names = ("title", "link", "url", "image", "rating", "condition", "shipping", *prices)
        self.empty()

    def empty(self) -> None:
        self.cards = []

    def add(self, source: str | None, position: int, card: Element, found: dict[int, Element], places: list[list[int]]) -> None:
        titles, links, prices, ratings, images, conditions, shippings = places
        base = "" if source is None else self.base_urls.get(source) or ""
        link = image = rating = condition = shipping = None
        for place in links:
            if place in found:
                link = found[place].attrs.get("href")
                break
        for place in images:
            if place in found:
                image = found[place].attrs.get("src")
                break
        if source != "ebay":
            link = normalized(link, base) if link else None
        if ratings:
            rating = _first_found(found, ratings)
            rating = _text(rating) if source == "walmart" else rating and rating.attrs.get("alt")
        if conditions or shippings:
            condition, shipping = _text(_first_found(found, conditions)), _text(_first_found(found, shippings))
        # An element that several selectors find in a row gives its price once.
        texts, before = [], None
        for place in prices:
            if place in found and found[place] is not before:
                before = found[place]
                texts.append(_text(before))
        self.cards.append(
            (
                position, _text(_first_found(found, titles)), link, normalized(link, base) if link else link,
                normalized(image, base) if image else image, rating, condition, shipping, *texts, *self.no_prices[len(texts) :],
            )
        )

    def take(self) -> list[pa.Array]:
        positions, *columns = zip(*self.cards)
        self.empty()
        return [pa.array(positions, pa.int32()), *[pa.array(c, pa.string()) for c in columns]]


def _read_cards(
    pages: DataFrame, rules: dict, fields: tuple[str, ...], held: _Findings | _Listings, added: list[T.StructField], max_cards: int | None
) -> DataFrame:
    """One row per card: the columns of the page without html, and those added, which ``held`` gathers."""
    carried = [f for f in pages.schema.fields if f.name != "html"]
    schema = T.StructType(carried + added)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        names = [f.name for f in carried]
        readers = {}
        for kind, rule in rules.items():
            finder = FirstFinder([s for f in fields for s in rule.get(f, ())])
            places = [[finder.selectors.index(s) for s in rule.get(f, ())] for f in fields]
            readers[kind] = FirstFinder(rule["containers"]) if "containers" in rule else None, finder, places
        for batch in batches:
            # Cards leave in small batches, column by column; many long pages never pile up in a worker.
            sources, markups = batch.column("source"), batch.column("html")
            at = []
            for i in range(batch.num_rows):
                source, markup = sources[i].as_py(), markups[i].as_py()
                reader = readers.get(source if source in rules else None)
                if markup is not None and reader is not None:
                    page = parse(markup)
                    containers, finder, places = reader
                    order = page.order
                    cards = [page] if containers is None else containers.all(order)[:max_cards]
                    for position, card in enumerate(cards, 1):
                        held.add(source, position, card, finder.first(order[card.place + 1 : card.last]), places)
                        at.append(i)
                    page.release()
                if at and (len(at) >= CARDS_PER_BATCH or i == batch.num_rows - 1):
                    columns = [*batch.select(names).take(pa.array(at)).columns, *held.take()]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)
                    at = []

    return pages.mapInArrow(read, schema)


def find_cards(
    pages: DataFrame, rules: dict, fields: tuple[str, ...] = FIELDS, max_cards: int | None = None
) -> DataFrame:
    """One row per card: the columns of the page without html, position over all cards, and findings per field.

    ``pages`` needs html and source. Each field is an array with one entry per selector, null where the selector
    found nothing. ``max_cards`` limits the cards of a page; by default all count.
    """
    added = [
        T.StructField("position", T.IntegerType()),
        T.StructField("card_id", T.StringType()),
        T.StructField("card_text", T.StringType()),
        *[T.StructField(f, T.ArrayType(_HIT)) for f in fields],
    ]
    return _read_cards(pages, rules, fields, _Findings(fields), added, max_cards)


def find_listings(pages: DataFrame, rules: dict, base_urls: dict[str, str], max_cards: int | None = None) -> DataFrame:
    """One row per card as ``find_cards`` finds them, with only what a listing takes from the findings (see ``_Listings``)."""
    held = _Listings(rules, base_urls)
    added = [T.StructField("position", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in held.names]]
    used = [c for c in PAGE_COLUMNS if c in pages.columns]
    return _read_cards(pages.select(*used, "html"), rules, FIELDS, held, added, max_cards)


def _first(hits: Column, good=None) -> Column:
    found = F.filter(hits, lambda h: h.isNotNull() if good is None else (h.isNotNull() & good(h)))
    return F.try_element_at(found, F.lit(1))


def _first_truthy_else_last(numbers: Column) -> Column:
    """Selectors are tried until a number other than zero comes out; otherwise the last result stands."""
    return F.coalesce(
        F.try_element_at(F.filter(numbers, lambda n: n != 0), F.lit(1)), F.try_element_at(numbers, F.lit(-1))
    )


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _rows(cards: DataFrame, scraper_type: str, picked: dict[str, Column]) -> DataFrame:
    carried = [c for c in PAGE_COLUMNS if c in cards.columns]
    values = cards.select(*carried, "position", *[value.alias(name) for name, value in picked.items()])
    # One struct a card is generated, so that filters on the picked values do not choose and clean them over again. The
    # values are picked before, as a generator would compute a term anew wherever it occurs.
    return values.select(
        *carried,
        F.col("position").alias("position_on_page"),
        F.lit(scraper_type).alias("scraper_type"),
        F.inline(F.array(F.struct(*[F.col(name).alias(name.removeprefix("_")) for name in picked]))),
    )


def extract_listings(
    pages: DataFrame, rules: dict = LISTING_RULES, base_urls: dict = BASE_URLS, max_cards: int | None = None
) -> DataFrame:
    """Listing rows of fetched pages: page_id, url, html, source and, where known, keyword and page number."""
    cards = find_listings(pages, rules, base_urls, max_cards)
    source = F.col("source")
    price_texts = [c for c in cards.columns if c.startswith("price_")]
    cards = cards.withColumns({f"_{c}": extract_price(_filled(F.col(c))) for c in price_texts})
    last = F.lit(None).cast("double")
    for c in price_texts:
        last = F.when(F.col(c).isNotNull(), F.col(f"_{c}")).otherwise(last)
    picked = {
        "_title": clean_text(F.col("title")),
        "_url": F.col("url"),
        "_price": F.coalesce(*[F.when(F.col(f"_{c}") != 0, F.col(f"_{c}")) for c in price_texts], last),
        "_rating": extract_rating(_filled(F.col("rating"))),
        "_image_url": F.col("image"),
        "_condition": F.when(source == "ebay", clean_text(F.col("condition"))),
        "_shipping_cost": F.when(source == "ebay", extract_price(_filled(squeeze(F.col("shipping"))))),
        "_link": F.col("link"),
    }
    rows = _rows(cards, "static", picked).where(F.col("title") != "")
    rows = rows.where((source != "ebay") | ~contains_any(F.col("title"), PROMOTIONAL_TITLES[:1]))
    rows = rows.withColumn("product_id", product_id_from_url(F.col("link"), source)).drop("link")
    return clean_listings(rows, base_urls, resolved=("url", "image_url"))


def extract_framework_listings(
    pages: DataFrame, rules: dict = LISTING_RULES, max_cards: int | None = None
) -> DataFrame:
    """Variant of the crawling framework: addresses resolve against the page, ids only for one source."""
    cards = find_cards(pages.withColumn("_page_url", F.col("url")), rules, max_cards=max_cards)
    href = _first(F.col("link")).getField("href")
    picked = {
        "_title": clean_text(_first(F.col("title")).getField("text")),
        "_url": F.when(href != "", normalize_url(href, F.col("_page_url"))),
        "_price": extract_price(_filled(_first(F.col("price")).getField("text"))),
        "_rating": extract_rating(_filled(_first(F.col("rating")).getField("alt"))),
        "_image_url": _first(F.col("image")).getField("src"),
    }
    rows = _rows(cards, "scrapy", picked).where(F.col("title") != "")
    amazon_id = F.when(F.col("source") == "amazon", product_id_from_url(F.col("url"), F.col("source")))
    return rows.withColumn("product_id", amazon_id)


def extract_rendered_listings(
    pages: DataFrame, rules: dict = ROBUST_RULES, base_urls: dict = BASE_URLS, max_cards: int | None = None
) -> DataFrame:
    """Variant for browser-rendered pages: every field falls back over several selectors."""
    cards = find_cards(pages, rules, max_cards=max_cards)
    source = F.col("source")
    base = by_source(source, base_urls)
    titles = F.transform(F.filter("title", lambda h: h.isNotNull()), lambda h: squeeze(h.text))
    title = F.coalesce(
        F.try_element_at(F.filter(titles, lambda t: F.length(t) > MIN_TITLE_CHARS), F.lit(1)),
        _filled(F.try_element_at(titles, F.lit(-1))),
        F.when(
            source == "amazon",
            _filled(F.try_element_at(F.filter("title", lambda h: h.isNotNull()), F.lit(-1)).getField("title")),
        ),
        title_fallback(F.col("card_text"), source),
    )
    marked = by_source(source, ROBUST_LINK_PATTERNS)
    link = F.try_element_at(
        F.filter(F.transform("link", lambda h: h.href), lambda u: u.isNotNull() & F.regexp(u, marked)), F.lit(1)
    )
    price_texts = F.transform(
        F.filter("price", lambda h: h.isNotNull()),
        lambda h: F.coalesce(_filled(h.text), F.when(source == "amazon", h.data_a_price)),
    )
    prices = F.transform(F.filter(price_texts, lambda t: F.contains(t, F.lit("$"))), extract_price)
    rating_texts = F.transform(
        F.filter("rating", lambda h: h.isNotNull()), lambda h: F.coalesce(_filled(h.aria_label), _filled(h.text))
    )
    ratings = F.transform(F.filter(rating_texts, lambda t: t.isNotNull()), extract_rating)
    images = F.transform(
        F.filter("image", lambda h: h.isNotNull()), lambda h: F.coalesce(_filled(h.src), h.data_src)
    )
    good_image = F.filter(
        images,
        lambda u: F.contains(u, F.lit("http")) & ((source != "ebay") | F.contains(u, F.lit("ebayimg"))),
    )
    picked = {
        "_title": title,
        "_url": normalize_url(link, base),
        "_price": _first_truthy_else_last(prices),
        "_rating": _first_truthy_else_last(ratings),
        "_image_url": F.coalesce(F.try_element_at(good_image, F.lit(1)), F.try_element_at(images, F.lit(-1))),
        "_condition": F.try_element_at(
            F.array_compact(F.transform("condition", lambda h: condition_text(h.text))), F.lit(1)
        ),
        "_shipping": F.try_element_at(
            F.array_compact(F.transform("shipping", lambda h: shipping_text(h.text))), F.lit(1)
        ),
        "_card_id": F.col("card_id"),
    }
    rows = _rows(cards, "selenium", picked).where(F.col("title") != "").withColumn("url", _filled(F.col("url")))
    promotional = (source == "ebay") & contains_any(F.col("title"), PROMOTIONAL_TITLES)
    found = product_id_from_url(F.col("url"), source, "browser")
    product_id = F.coalesce(found, F.when(source == "amazon", F.col("card_id")))
    return clean_listings(rows.where(~promotional).withColumn("product_id", product_id).drop("card_id"), base_urls)


def extract_details(pages: DataFrame, rules: dict = DETAIL_RULES) -> DataFrame:
    """Description, availability, seller and specifications of product pages, one row per page."""
    found = find_cards(pages, rules, DETAIL_FIELDS)
    return found.select(
        *[c for c in pages.columns if c != "html"],
        *[
            F.when(_first(F.col(f)).isNotNull(), clean_text(_first(F.col(f)).getField("text"))).alias(f)
            for f in DETAIL_FIELDS
        ],
    )


def extract_specifications(pages: DataFrame, rules: dict = DETAIL_RULES) -> DataFrame:
    """The columns of the page without html, and ``specifications``: a map of labels to values, one row per page.

    Read from the element the rules name for the source, else from all tables and definition lists of the page. Values of
    a repeated label are joined by "; ". Pages without any have an empty map, null pages a null one.
    """
    carried = [f for f in pages.schema.fields if f.name != "html"]
    pairs = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("value", T.StringType())]))
    schema = T.StructType([*carried, T.StructField("_pairs", pairs)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(pairs)
        for batch in batches:
            for start in range(0, batch.num_rows, CARDS_PER_BATCH):
                part = batch.slice(start, CARDS_PER_BATCH)
                found = []
                for html, source in zip(part.column("html"), part.column("source"), strict=True):
                    if html.as_py() is None:
                        found.append(None)
                        continue
                    page, held = parse(html.as_py()), {}
                    selectors = rules.get(source.as_py(), {}).get("specifications", ())
                    place = next((e for e in (page.first(s) for s in selectors) if e is not None), page)
                    for label, value in label_values(place):
                        held.setdefault(label, {})[value] = True
                    found.append([{"label": label, "value": "; ".join(values)} for label, values in held.items()])
                columns = [part.column(f.name) for f in carried]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], [f.name for f in schema.fields])

    rows = pages.select(*[f.name for f in carried], "html").mapInArrow(read, schema)
    return rows.withColumn("specifications", F.map_from_entries("_pairs")).drop("_pairs")


# Sources read as plain pages, and sources that need a browser.
STATIC_SOURCES = ("ebay", "walmart")
RENDERED_SOURCES = ("amazon",)


def route(df: DataFrame) -> DataFrame:
    """Reading mode per source as a column; null for sources of neither kind."""
    source = F.col("source")
    mode = F.when(source.isin(*STATIC_SOURCES), "static").when(source.isin(*RENDERED_SOURCES), "selenium")
    return df.withColumn("scraper_type", mode)


# Patterns over whole pages. Every loop is possessive, so it neither goes back nor recurses, however long the page; a tag
# ends its attempt at the next "<" outside quotes, and unclosed comments and scripts run to the end of the page, so a
# page is read once from start to end. Quotes enclose only after an equals sign, as in browsers.
_ASSIGNED = r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>\"'][^\s<>]*+|(?=[\s/>]))"
_IN_TAG = rf"(?:[^<>=]++|{_ASSIGNED})*+"
_UNSEEN = r"!--.*?(?:-->|\z)|(script|style)(?=[\s/>])[^>]*+>.*?(?:</\3\s*+>|\z)"
# Attributes up to the address, which may not start inside a name or a value.
_TO_HREF = rf"(?:[\s/]++|(?!href\s*+=)[^\s/<>=]++|{_ASSIGNED})*+"
_HREF = r"href\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s<>\"'][^\s<>]*+)"
_ANCHOR = rf"(?is)<(?:a(?=[\s/]){_TO_HREF}{_HREF}{_IN_TAG}>((?:[^<]++|<!--.*?-->|<(?!/?a[\s/>]))*+)|{_UNSEEN})"
_HEADING = rf"(?is)<(?:(h1|title)(?=[\s/>]){_IN_TAG}>((?:[^<]++|<!--.*?-->|<(?!/?(?:h1|title|body|p|div)[\s/>]))*+)|{_UNSEEN})"
_TAG = r"(?is)<!--.*?-->|</?[a-z!](?:[^<>=]++|" + _ASSIGNED + r")*+>"


def page_error(html: Column) -> Column:
    """Why a page cannot be read; null for pages that can."""
    return (
        F.when(html.isNull(), F.lit("no page"))
        .when(~F.is_valid_utf8(html), F.lit("not UTF-8"))
        .when(F.contains(html, F.lit("\x00")), F.lit("binary content"))
        .when(~F.regexp_like(html, F.lit(r"\S")), F.lit("empty page"))
        .when(~F.regexp_like(html, F.lit(r"<[a-zA-Z!/]")), F.lit("no markup"))
    )


def _readable(html: Column) -> Column:
    return F.when(page_error(html).isNull(), html)


def _elements(html: Column, pattern: str) -> Column:
    """First and second group of a pattern: what names an element, and its inner markup. Comments and scripts have no name."""
    found = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("inner")
    )
    return F.filter(found, lambda e: e["name"] != "")


def _inner_text(inner: Column) -> Column:
    return clean_text(F.regexp_replace(inner, _TAG, ""))


def page_links(pages: DataFrame) -> DataFrame:
    """Anchors of a page in order: position, address as written and resolved, text.

    Attributes may stand in any order, case and quotes; anchors without an address are no links. The text ends at the
    closing tag, the next anchor or the end of the page. Pages that cannot be read have none (see page_errors).
    """
    anchors = _elements(_readable(F.col("html")), _ANCHOR)
    found = pages.select("page_id", "url", F.posexplode(anchors).alias("_at", "_link"))
    return found.withColumn("href", F.regexp_replace("_link.name", r"(?s)^([\"'])(.*)\1$", "$2")).select(
        "page_id",
        (F.col("_at") + 1).alias("position"),
        "href",
        normalize_url(F.col("href"), F.col("url")).alias("link"),
        _inner_text(F.col("_link.inner")).alias("text"),
    )


def page_headings(pages: DataFrame) -> DataFrame:
    """Title and top headings of a page in order; an unclosed one ends where the next element starts."""
    found = _elements(_readable(F.col("html")), _HEADING)
    return pages.select("page_id", F.posexplode(found).alias("_at", "_heading")).select(
        "page_id", (F.col("_at") + 1).alias("position"), _inner_text(F.col("_heading.inner")).alias("heading")
    )


def page_errors(pages: DataFrame) -> DataFrame:
    """The pages that cannot be read, with the reason; all others go through links and headings."""
    return pages.select("page_id", "url", page_error(F.col("html")).alias("error")).where("error IS NOT NULL")
