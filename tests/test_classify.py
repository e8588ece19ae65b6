import pytest
from pyspark.sql import functions as F

from shelfspark.operators import classify

SEARCH = "<html><body><h1>Product Search Results</h1>" + "<div class='product'>Product 1</div>" * 20 + \
    "<div class='product'>Product 2</div>" * 20 + "</body></html>"
SHOPPING = "<html><body><h1>Shopping Results</h1>" + "<div class='item'>Product Description Here</div>" * 30 + "</body></html>"
WELCOME = "<html><body>Welcome to our store! Browse thousands of products." + "x" * 600 + "</body></html>"


@pytest.mark.parametrize(
    "status,text,blocked",
    [
        (403, "Access denied - robot detected", True),
        (200, "Complete the CAPTCHA below to continue", True),
        (200, "Please verify you are a human user", True),
        (200, "Access denied - robot detected", True),
        (200, SEARCH, False),
        (200, SHOPPING, False),
        (200, WELCOME, False),
        (429, WELCOME, True),
        (503, WELCOME, True),
        (200, "y" * 499, True),
        (200, "y" * 500, False),
        (200, WELCOME + "robotics", True),
        (None, None, True),
    ],
)
def test_blocked(spark, status, text, blocked):
    df = spark.createDataFrame([(status, text)], "status int, text string")
    assert df.select(classify.is_blocked(F.col("text"), F.col("status"))).first()[0] is blocked


def score(spark, html, url="https://x.org", title=""):
    df = spark.createDataFrame([(html, url, title)], "h string, u string, t string")
    return df.select(classify.challenge_score(F.col("h"), F.col("u"), F.col("t")).alias("s")).first()["s"]


def test_score(spark):
    clean = score(spark, "<p>hello</p>")
    assert (clean.score, clean.detected, clean.challenge_type) == (0.0, False, None)
    # Words captcha and recaptcha .4 each; class token and partial class of recaptcha .5 each; div with captcha .2.
    found = score(spark, '<div class="g-recaptcha"></div>')
    assert found.detected and found.challenge_type == "reCAPTCHA"
    assert found.score == pytest.approx(0.4 + 0.4 + 0.5 + 0.5 + 0.2)
    by_title = score(spark, "<p>x</p>", title="Security challenge")
    assert by_title.score == pytest.approx(0.25) and not by_title.detected
    both = score(spark, "<p>x</p>", url="https://x.org/verify", title="Security")
    assert both.score == pytest.approx(0.55) and both.challenge_type == "Generic CAPTCHA"


def test_element_patterns(spark):
    cases = [
        (".captcha", '<div class="a captcha b">', True), (".captcha", '<div class="captchas">', False),
        ("#captcha", "<p id='captcha'>", True), ("#captcha", "<p id='captcha2'>", False),
        ("div[id*='captcha']", '<div x="1" id="my-captcha-1">', True), ("div[id*='captcha']", '<p id="captcha">', False),
        ("iframe[src*='hcaptcha']", '<iframe src="//hcaptcha.com">', True), ("[class*='blocked']", "blocked class", False),
    ]
    for selector, html, expected in cases:
        df = spark.createDataFrame([(html,)], "h string")
        assert df.select(F.col("h").rlike(classify.element_pattern(selector))).first()[0] is expected, selector


def verdict(spark, html, url="https://x.org"):
    return classify.challenge_verdict(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")).first()


def test_verdict(spark):
    clean = verdict(spark, "<p>hello</p>")
    assert not clean.detected and clean.confidence == 0.0 and clean.challenge_type == "behavioral_analysis"
    framed = verdict(spark, '<iframe src="https://hcaptcha.com/1"></iframe><iframe src="https://hcaptcha.com/2"></iframe>')
    assert framed.behaviour_score == 1.0 and framed.network_score == pytest.approx(0.3)
    assert framed.challenge_type == "hcaptcha" and framed.confidence == 1.0
    # The form must hold the word itself; a word between two forms does not count.
    between = verdict(spark, "<form>a</form>verify<form>b</form>")
    assert between.behaviour_score == 0.0


def test_first_indicator_and_rates(spark):
    pages = spark.createDataFrame(
        [("a", 200, WELCOME), ("a", 403, WELCOME), ("b", 200, "rate limit robot")], "source string, status int, html string"
    )
    assert [r[0] for r in pages.select(classify.first_indicator(F.col("html"))).collect()] == [None, None, "robot"]
    rates = {r.source: (r.attempted, r.successful, r.blocked) for r in classify.block_rates(pages).collect()}
    assert rates == {"a": (2, 1, 1), "b": (1, 0, 1)}


def test_missing_page_is_no_challenge(spark):
    page = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    got = classify.challenge_verdict(page).first()
    assert got.confidence == 0.0 and not got.detected and got.behaviour_score == 0.0
