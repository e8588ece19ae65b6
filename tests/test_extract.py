from shelfspark.functions.markup import parse
from shelfspark.operators import extract

AMAZON = (
    '<div data-component-type="s-search-result" data-asin="B0ABCDEFGH"><h2><a href="/dp/B0ABCDEFGH"><span>Fine &amp; long title'
    '</span></a></h2><span class="a-price"><span class="a-offscreen">$1,234.56</span></span>'
    '<i class="a-icon-alt" alt="4.5 out of 5"></i><img class="s-image" src="//i.com/1.jpg"></div>'
    '<div data-component-type="s-search-result"><p>untitled</div>'
    '<div data-component-type="s-search-result"><h2><a href="/dp/B0ABCDEFGX"><span>No price here</span></a></h2></div>'
)
EBAY = (
    '<ul><li class="s-item"><a class="s-item__link" href="https://www.ebay.com/itm/1234"><div class="s-item__title">Phone</div></a>'
    '<span class="s-item__price">$12.00</span><span class="s-item__shipping">Free shipping</span>'
    '<span class="s-item__subtitle">Pre-owned</span></li>'
    '<li class="s-item"><span class="s-item__price">$1.00</span></li>'
    '<li class="s-item"><div class="s-item__title">Shop on eBay</div></li>'
    '<li class="s-item"><div class="s-item__title">Case</div></li></ul>'
)
WALMART = (
    '<div data-automation-id="product-tile"><a href="/ip/some-name/555"></a><span data-automation-id="product-title">Lamp</span>'
    '<div data-automation-id="product-price"><span>$9.99</span></div><span class="average-rating">4.2</span></div>'
)
GENERIC = '<div class="product"><h2>Title</h2><span class="price">$5.00</span><a href="p/1"></a><img src="i.jpg"></div>' * 25


def pages(spark, *rows):
    return spark.createDataFrame(
        [(i, s, "https://page.example.com/x", h, "kw", 1) for i, (s, h) in enumerate(rows)],
        "page_id long, source string, url string, html string, search_keyword string, page_number int",
    )


def rows(df):
    return {(r.source, r.position_on_page): r for r in df.collect()}


def test_static_cards(spark):
    got = rows(extract.extract_listings(pages(spark, ("amazon", AMAZON), ("ebay", EBAY), ("walmart", WALMART), ("x", GENERIC))))
    first = got["amazon", 1]
    assert (first.title, first.price, first.rating, first.product_id) == ("Fine & long title", 1234.56, 4.5, "B0ABCDEFGH")
    assert first.url == "https://www.amazon.com/dp/B0ABCDEFGH" and first.image_url == "https://i.com/1.jpg"
    assert ("amazon", 2) not in got and got["amazon", 3].price is None
    phone = got["ebay", 1]
    assert (phone.price, phone.shipping_cost, phone.condition, phone.product_id) == (12.0, 0.0, "Pre-owned", "1234")
    assert ("ebay", 2) not in got and ("ebay", 3) not in got and got["ebay", 4].title == "Case"
    lamp = got["walmart", 1]
    assert (lamp.title, lamp.price, lamp.rating, lamp.product_id) == ("Lamp", 9.99, 4.2, "555")
    assert len([k for k in got if k[0] == "x"]) == 25 and got["x", 25].price == 5.0
    assert extract.extract_listings(pages(spark, ("x", GENERIC)), max_cards=20).count() == 20


def test_generic_falls_back_over_containers_and_prices(spark):
    html = ('<section class="result"><h3>Bike</h3><b class="price"> </b><i class="x-price">$0</i>'
            '<em data-testid="the-price">$7</em></section>')
    got = extract.extract_listings(pages(spark, ("shop", html))).first()
    # "$0" and the blank are no usable price, so the next selector decides.
    assert got.title == "Bike" and got.price == 7.0


def test_rendered_cards(spark):
    html = AMAZON.replace("No price here", "Short").replace("untitled", "A line long enough to be a title")
    got = rows(extract.extract_rendered_listings(pages(spark, ("amazon", html), ("ebay", EBAY), ("other", GENERIC))))
    assert got["amazon", 1].title == "Fine & long title" and got["amazon", 1].scraper_type == "selenium"
    assert got["amazon", 2].title == "A line long enough to be a title"
    assert got["amazon", 3].title == "Short" and got["amazon", 3].url == "https://www.amazon.com/dp/B0ABCDEFGX"
    assert got["ebay", 1].shipping == "Free shipping" and got["ebay", 1].condition is None
    assert ("ebay", 3) not in got and not [k for k in got if k[0] == "other"]


def test_rendered_amazon_id_from_attribute(spark):
    html = '<div data-asin="B000000001"><h2><span>Title without any link</span></h2><span class="a-price" data-a-price="$3.50"></span></div>'
    got = extract.extract_rendered_listings(pages(spark, ("amazon", html))).first()
    assert (got.product_id, got.url, got.price) == ("B000000001", None, 3.5)


def test_framework_cards(spark):
    got = rows(extract.extract_framework_listings(pages(spark, ("amazon", AMAZON), ("walmart", WALMART))))
    assert got["amazon", 1].url == "https://page.example.com/dp/B0ABCDEFGH"
    assert got["amazon", 1].product_id == "B0ABCDEFGH" and got["walmart", 1].product_id is None
    assert got["walmart", 1].scraper_type == "scrapy"


def test_details(spark):
    html = ('<div id="feature-bullets"><ul><li>One <li>Two</ul></div><div id="availability"><span> In Stock </span></div>'
            '<div class="specs-table">a</div><div class="seller-persona">Bob</div><p class="my-detail">D</p>')
    got = {r.source: r for r in extract.extract_details(
        pages(spark, ("amazon", html), ("ebay", html), ("walmart", html), ("x", html), ("amazon2", ""))).collect()}
    assert (got["amazon"].description, got["amazon"].availability) == ("One Two", "In Stock")
    assert got["ebay"].seller_name == "Bob" and got["walmart"].specifications == "a" and got["x"].description == "D"
    assert got["amazon2"].description is None


def test_null_and_empty_pages(spark):
    assert extract.extract_listings(pages(spark, ("amazon", None), ("amazon", ""), ("x", "<<<"))).collect() == []


def test_markup_tolerates_broken_html():
    root = parse('<p>a<br>b<p>c<b>d</p><img src=x.png alt=y><div class=k id=z>e</div></section>f<script>g</script>')
    assert root.text() == "abcdef"
    assert root.first("img").attrs == {"src": "x.png", "alt": "y"}
    assert root.first("div.k#z").text() == "e"


def test_selectors():
    root = parse('<div data-asin=""><a title="t">1</a></div><div data-asin="q"><h3 class="it-ttl x"><a>2</a></h3></div>')
    assert [e.attrs["data-asin"] for e in root.select('[data-asin]:not([data-asin=""])')] == ["q"]
    assert root.first("a[title]").text() == "1" and root.first("h3.it-ttl a").text() == "2"
    assert [e.text() for e in root.select("h3 a, a[title]")] == ["1", "2"]
    assert root.first('[class*="ttl"]').tag == "h3" and root.first("ul") is None


def test_deep_and_damaged_pages(spark):
    deep = "<p>" * 100_000 + "</i>" * 1000
    got = extract.extract_listings(
        pages(spark, ("x", deep + GENERIC), ("x", "<![foo[bar" + GENERIC), ("x", "<div class='product'><h2>Open"), ("x", None))
    ).collect()
    assert sorted((r.page_id, r.title) for r in got if r.position_on_page == 1) == [(0, "Title"), (1, "Title"), (2, "Open")]
    assert len(got) == 51


def test_one_walk_finds_what_single_selectors_find():
    from shelfspark.functions.markup import FirstFinder

    page = parse('<div id="a" class="x y"><span data-q="ab">1</span><p><span class="x">2</span></p></div><a href="/itm/3" class="y">3</a>')
    selectors = ["span", ".x", ".x span", "p span, .none", '[data-q*="b"]', "#a", ".y", 'a[href*="/itm/"]', ".none", '[class]:not([id="a"])', "*"]
    found = FirstFinder(selectors).find(page)
    assert {s: found.get(s) for s in selectors} == {s: page.first(s) for s in selectors}


def test_links_of_any_form(spark):
    html = (
        "<a href=\"/one\">1</a><A class='b' HREF='/two' title=\"a > b\">2</A><a\nhref=/three>3</a><a name=x>no</a>"
        "<article>no</article><a data-href='/no'>no</a><a href=\"\">4</a><H1 class=x>Head</H1><title>Open <b>bold</b><body>rest"
    )
    page = spark.createDataFrame([(1, "https://s.com/p", html), (2, "https://s.com/p", None)], "page_id long, url string, html string")
    assert [(r.position, r.href, r.text) for r in extract.page_links(page).collect()] == [
        (1, "/one", "1"), (2, "/two", "2"), (3, "/three", "3"), (4, "", "4"),
    ]
    assert [r.heading for r in extract.page_headings(page).collect()][0] == "Head"


def linked(spark, *htmls):
    rows = spark.createDataFrame([(i, "https://s.com/p/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return [(r.page_id, r.href, r.text) for r in extract.page_links(rows).collect()], [
        (r.page_id, r.heading) for r in extract.page_headings(rows).collect()
    ]


def test_pages_that_broke_the_stack(spark):
    """Long headings, blanks, attributes and texts, each alone and unclosed."""
    million = "x" * 1_000_000
    links, headings = linked(
        spark, f"<h1>{million}</h1>", "<h1>" + "<i>y</i>" * 200_000, f"<a{' ' * 100_000}href=/b>t</a>", f"<a title={'z' * 100_000} href=/c>t</a>",
        f"<a title='{'<b> ' * 100_000}' href=\"/d\">t</a>", "<a " * 300_000, "<a x='" * 100_001, "<script>" * 100_000, "<!--" * 100_000,
        f"<a href=/e>{'<b>q</b> ' * 100_000}", "<a href=/f " + "k=v " * 50_000 + ">t</a>", "<h1" * 300_000, "<a href=" + "'" * 300_001,
    )
    assert [(p, h) for p, h, _ in links if p != 6] == [(2, "/b"), (3, "/c"), (4, "/d"), (9, "/e"), (10, "/f")]
    assert [(p, len(h)) for p, h in headings] == [(0, 1_000_000), (1, 200_000)]


def test_addresses_as_browsers_read_them(spark):
    cases = {
        "<a href=/one>1</a>": "/one", "<a class=x href=/two/>1</a>": "/two/", "<a HREF = '/three'>1</a>": "/three",
        "<a title='href=/no' href='/four'>1</a>": "/four", '<a title="x href=\'/no\' y" href="/five">1</a>': "/five",
        "<a data-href=/no href=/six>1</a>": "/six", "<a href=/it's>1</a>": "/it's", "<a x=1\nhref=\n'/seven'>1</a>": "/seven",
        "<a/href=/eight>1</a>": "/eight", "<a alt='a>b' href=/nine>1</a>": "/nine", "<a href=/ten?a=1&b=2#c>1</a>": "/ten?a=1&b=2#c",
        "<a href=''>1</a>": "", "<a rel='x'href='/eleven'>1</a>": "/eleven", "<a href='/first' href='/second'>1</a>": "/first",
        "<a it's href=/twelve>1</a>": "/twelve",
    }
    links, _ = linked(spark, *cases)
    assert links == [(i, h, "1") for i, h in enumerate(cases.values())]
    nothing = ["<a>1</a>", "<a name=x>1</a>", "<abbr href=/x>1</abbr>", "<a title='href=/no'>1</a>", "<a data-href=/x>1</a>", "< a href=/x>1</a>", "<a href=/x", "<a href='/x>1</a>"]
    assert linked(spark, *nothing)[0] == []


def test_comments_and_scripts_are_not_read(spark):
    links, headings = linked(
        spark,
        "<!-- <a href=/no>no</a> --><a href=/yes>y<!-- <a href=/no>x</a> -->es</a><h1>A<!-- b -->B</h1>",
        "<script>var s = '<a href=/no>no</a><h1>no</h1>';</script><style>a{}</style><a href=/yes>yes</a><title>T</title>",
        "<a href=/yes>yes</a><!-- never closed <a href=/no>no</a><h1>no</h1>",
        "<a href=/one>1<a href=/two>2</a><h1>open <b title='a > b'>bold</b><p>rest",
        "<scripted><a href=/yes>yes</a></scripted>",
    )
    assert links == [(0, "/yes", "yes"), (1, "/yes", "yes"), (2, "/yes", "yes"), (3, "/one", "1"), (3, "/two", "2"), (4, "/yes", "yes")]
    assert headings == [(0, "AB"), (1, "T"), (3, "open bold")]


def test_errors_of_pages(spark):
    rows = spark.createDataFrame(
        [(1, b"<a href=/x>1</a>"), (2, None), (3, b""), (4, b" \n\t"), (5, b"plain text"), (6, b"<a href=/x>\xff\xfe</a>"), (7, b"<a\x00>"), (8, b"1 < 2")],
        "page_id long, html binary",
    )
    rows = rows.selectExpr("page_id", "'u' AS url", "CAST(html AS STRING) AS html")
    errors = {r.page_id: r.error for r in extract.page_errors(rows).collect()}
    assert errors == {2: "no page", 3: "empty page", 4: "empty page", 5: "no markup", 6: "not UTF-8", 7: "binary content", 8: "no markup"}
    assert [r.page_id for r in extract.page_links(rows).collect()] == [1]


def test_specifications(spark):
    deep = "<table><tr><td>a<td>b" * 20_000
    rows = pages(
        spark, ("walmart", "<table><tr><td>x<td>no</table><div class='specs-table'><table><tr><th>Color :<td> dark  <b>red</b><tr><td><td>y</table></div>"),
        ("ebay", "<dl><dt>A<dd>1<dd>2<dt>B<dt>C<dd>3<script>4</script></dl><td>out</td><tr><td>one</td></tr>"), ("x", None), ("x", "<p>none"), ("x", deep),
    )
    got = {r.page_id: r.specifications for r in extract.extract_specifications(rows).collect()}
    assert got == {0: {"Color": "dark red"}, 1: {"A": "1; 2", "B": "3", "C": "3"}, 2: None, 3: {}, 4: {"a": "b"}}


TAGS = (
    "<div>", '<p class="a b">', '<a href="/x?a=1&amp;b=2" id="k">', "<br/>", "<IMG SRC=x>", '<img src="a>b"  alt="">', "<li data-x='1' data-x=2>", "</div>",
    "</p>", "</a >", "</LI>", "< 5 &lt; 6", "text &amp; more", "<!-- <p> -->", "<script>if (a<b) '</p>'</script>", "<textarea><b></textarea>", "</script>",
    '<td\nclass="x"\t>', "<b", "</", '<i title="a"title="b">', '<u a="1" a="2">', "<!DOCTYPE html>", "</>", "<title>a<b>c</title>",
)


def test_plain_tags_read_as_the_standard_parser_reads_them(monkeypatch):
    import gc
    import random
    import weakref

    from shelfspark.functions import markup

    def tree(element):
        return (element.tag, list(element.attrs.items()), [c if isinstance(c, str) else tree(c) for c in element.content])

    draw = random.Random(5)
    pages = ["".join(draw.choices(TAGS, k=draw.randint(1, 14))) for _ in range(4000)]
    quick = [tree(markup.parse(p)) for p in pages]
    monkeypatch.setattr(markup, "_PLAIN_START", markup.re.compile("(?!)"))
    monkeypatch.setattr(markup, "_PLAIN_END", markup.re.compile("(?!)"))
    assert quick == [tree(markup.parse(p)) for p in pages]

    class Watched(markup.Element):
        __slots__ = ("__weakref__",)

    monkeypatch.setattr(markup, "Element", Watched)
    gc.disable()
    try:
        page = markup.parse("<div><p>a</p></div>")
        inner = weakref.ref(page.first("p"))
        page.release()
        del page
        assert inner() is None
    finally:
        gc.enable()


def test_picked_values_are_cleaned_once(spark):
    pages = spark.createDataFrame([(1, "shop", "u", "<p>")], "page_id long, source string, url string, html string")
    plan = extract.extract_listings(pages)._jdf.queryExecution().optimizedPlan().toString()
    # Once where a title is picked, once where listings are cleaned; filters take the picked value.
    assert not [line for line in plan.split("\n") if "Filter (" in line and "regexp_replace" in line]


def test_what_a_listing_takes_is_what_the_selectors_found(spark):
    """Cards narrowed inside the tasks give the rows that all findings of all selectors give."""
    import random

    from pyspark.sql import functions as F

    from shelfspark.functions.numbers import extract_price
    from shelfspark.functions.text import clean_text
    from shelfspark.functions.urls import by_source, normalize_url

    draw = random.Random(7)
    urls = ("p/1", "/ip/x/2", "//c.d/e", "https://a.b/c", "../up", "/a/./b", "/cr\r", "", "?q", "javascript:x", "HTTP://Y", " /z", "/\u00e9?", "https:rel")
    texts = ("$1,234.56", "$0", "0", "free", "", " ", "1,5", "T &amp;amp; U", "a  b", "caf\u00e9", "$7")
    elements = (
        '<h2>%s</h2>', '<b class="title">%s</b>', '<i class="price x-price">%s</i>', '<b class="my-price">%s</b>', '<em data-testid="price">%s</em>', "<p>%s",
    )
    def card():
        inner = "".join(draw.choice(elements) % draw.choice(texts) for _ in range(5))
        return f'<div class="{draw.choice(("product", "item"))}">{inner}<a href="{draw.choice(urls)}">l</a><img src="{draw.choice(urls)}"></div>'

    source = ("shop", "walmart", "x", None)
    html = ["".join(card() for _ in range(draw.randint(0, 4))) for _ in range(400)]
    page = pages(spark, *[(draw.choice(source), h) for h in html]).repartition(4)
    bases = {"shop": "shop.com/dir/", "walmart": "https://www.walmart.com"}
    rules = {None: extract.LISTING_RULES[None]}
    hit = lambda field, name: F.try_element_at(F.filter(field, lambda h: h.isNotNull()), F.lit(1)).getField(name)
    base = F.coalesce(by_source(F.col("source"), bases), F.lit(""))
    prices = F.transform(F.filter("price", lambda h: h.isNotNull()), lambda h: extract_price(F.nullif(h.text, F.lit(""))))
    url = F.when(hit("link", "href") != "", normalize_url(hit("link", "href"), base))
    whole = extract.find_cards(page, rules).select(
        "page_id", F.col("position").alias("position_on_page"), clean_text(clean_text(hit("title", "text"))).alias("title"),
        F.coalesce(F.try_element_at(F.filter(prices, lambda n: n != 0), F.lit(1)), F.try_element_at(prices, F.lit(-1))).alias("price"),
        F.when(F.length(url) > 0, normalize_url(url, base)).otherwise(url).alias("url"),
        F.when(F.length(hit("image", "src")) > 0, normalize_url(hit("image", "src"), base)).otherwise(hit("image", "src")).alias("image_url"),
    )
    got = extract.extract_listings(page, rules, bases).select(*whole.columns)
    expected = [r for r in whole.orderBy("page_id", "position_on_page").collect() if r.title != ""]
    assert len(expected) > 300 and got.orderBy("page_id", "position_on_page").collect() == expected


def test_a_listing_needs_one_step_in_python(spark):
    """Addresses are resolved where pages are read; findings that no listing takes stay there, and no findings are filtered row by row."""
    page = pages(spark, ("shop", GENERIC))
    plan = extract.extract_listings(page)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "_joined" not in plan
    read = extract.find_listings(page, extract.LISTING_RULES, extract.BASE_URLS)
    assert all(kind in ("bigint", "int", "string") for _, kind in read.dtypes)
    assert read.first().asDict() == {
        "page_id": 0, "source": "shop", "search_keyword": "kw", "page_number": 1, "position": 1, "title": "Title", "link": "p/1", "url": "p/1",
        "image": "i.jpg", "rating": None, "condition": None, "shipping": None, "price_1": "$5.00", "price_2": None, "price_3": None,
    }


def test_elements_below_an_element_stand_together():
    page = parse('<div><p>a<br><b>b</div><ul/><i class="x y">c</i><a href="1" class="z">d<p>e')
    for at, element in enumerate(page.order):
        assert page.order[element.place] is element and element.place == at
        assert page.order[element.place + 1 : element.last] == list(element.walk())
    assert page.order == list(page.walk())


def test_catalogue_rows_are_dealt_out_however_the_scan_cuts_them(spark, tmp_path):
    from shelfspark.workload import pages as workload

    part = spark.createDataFrame(
        [(i, "n", "b", "t", 1, 9.5) for i in range(4000)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    )
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        # More splits than cores, but one row group: all rows would stand in one task.
        assert spark.read.parquet(f"{tmp_path}/part.parquet").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        rows = workload.generic_pages(spark, str(tmp_path)).rdd.mapPartitions(lambda found: [sum(1 for _ in found)]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(rows) == 4000 and len(rows) >= 4 * spark.sparkContext.defaultParallelism and max(rows) < 4000 / 8
