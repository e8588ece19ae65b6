"""Classification of blocked and challenge pages from their text and markup. All expressions run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A page is blocked by status, by one of these phrases, or by being very short.
BLOCKED_STATUS = (403, 429, 503)
BLOCKED_PHRASES = (
    "access denied",
    "blocked",
    "captcha",
    "cloudflare",
    "please verify you are human",
    "unusual traffic",
    "automated queries",
    "robot",
    "bot detected",
)
MIN_PAGE_CHARS = 500

# Indicators of which the first match is reported.
FIRST_INDICATORS = (
    "captcha",
    "robot",
    "automation",
    "security check",
    "access denied",
    "rate limit",
    "too many requests",
)

# Text indicators, element selectors and patterns of the weighted score.
SCORE_TEXT = (
    "captcha", "recaptcha", "hcaptcha", "cloudflare",
    "verify you are human", "i'm not a robot", "prove you're human",
    "security check", "suspicious activity", "unusual traffic",
    "please verify", "verify your identity", "bot detection",
    "are you a robot", "human verification", "challenge",
    "access denied", "blocked", "forbidden", "rate limit",
    "automated queries", "unusual activity", "confirm you're human",
)
SCORE_TEXT_HIGH = ("captcha", "recaptcha", "hcaptcha", "cloudflare")
SCORE_TEXT_MIDDLE = ("verify you are human", "i'm not a robot", "bot detection")
SCORE_ELEMENTS = (
    "iframe[src*='recaptcha']", ".g-recaptcha", "#g-recaptcha", "[class*='recaptcha']",
    "iframe[src*='hcaptcha']", ".h-captcha", "#h-captcha", "[class*='hcaptcha']",
    "div[class*='captcha']", "div[id*='captcha']", "#captcha", ".captcha",
    ".cf-browser-verification", "#cf-wrapper", "[class*='cloudflare']",
    "[class*='challenge']", "[id*='challenge']", "[class*='verification']", "[id*='verification']",
    "[class*='bot-protection']", "[class*='anti-bot']", "[class*='security-check']",
    "[class*='access-denied']", "[class*='blocked']", "[class*='forbidden']",
)
ELEMENT_TERMS_HIGH = ("recaptcha", "hcaptcha", "cloudflare")
SCORE_URL = ("captcha", "recaptcha", "challenge", "verify", "security", "blocked")
SCORE_TITLE = ("captcha", "verify", "security", "challenge", "access denied", "blocked")
SCORE_THRESHOLD = 0.3

# The same for the five-method verdict.
VERDICT_TEXT = SCORE_TEXT[:20]
VERDICT_TEXT_HIGH = ("captcha", "recaptcha", "hcaptcha")
VERDICT_TEXT_MIDDLE = ("verify you are human", "i'm not a robot")
VERDICT_ELEMENTS = SCORE_ELEMENTS[:22]
VERDICT_URL = ("captcha", "recaptcha", "hcaptcha", "cloudflare", "challenge", "verify", "security", "protection")
VERDICT_URL_HIGH = ("captcha", "recaptcha", "cloudflare")
VERDICT_TITLE = ("captcha", "verify", "security", "challenge")
VERDICT_FORM = ("captcha", "verify", "challenge")
VERDICT_IFRAME = ("captcha", "recaptcha", "hcaptcha")
VERDICT_SERVICES = ("www.google.com/recaptcha", "hcaptcha.com", "cloudflare.com", "funcaptcha.com")


def element_pattern(selector: str) -> str:
    """Regular expression for raw markup that stands for a simple selector."""
    in_tag = r"<[a-zA-Z][^>]*\s"
    partial = re.fullmatch(r"(\w*)\[(\w+)\*='([^']+)'\]", selector)
    if partial:
        tag, name, value = partial.groups()
        head = rf"<{tag}\b[^>]*\s" if tag else in_tag
        return rf"{head}{name}\s*=\s*[\"'][^\"'>]*{re.escape(value)}"
    value = re.escape(selector[1:])
    if selector.startswith("#"):
        return rf"{in_tag}id\s*=\s*[\"']{value}[\"']"
    return rf"{in_tag}class\s*=\s*[\"']([^\"'>]*\s)?{value}(\s[^\"'>]*)?[\"']"


def has_element(html: Column, selector: str) -> Column:
    """Markup test; the plain search for the selector's word spares most pages the regular expression."""
    word = re.sub(r".*='([^']+)'\]|^[.#]", r"\1", selector)
    return F.contains(html, F.lit(word)) & html.rlike(element_pattern(selector))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def is_blocked(text: Column, status: Column) -> Column:
    """Blocked by status, by phrase, or shorter than the minimum."""
    return (
        F.coalesce(status.isin(*BLOCKED_STATUS), F.lit(False))
        | F.coalesce(_any(F.lower(text), BLOCKED_PHRASES), F.lit(False))
        | (F.coalesce(F.length(text), F.lit(0)) < MIN_PAGE_CHARS)
    )


def first_indicator(text: Column) -> Column:
    """First indicator, in list order, that the text holds; null when none."""
    lowered = F.lower(text)
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(w)), F.lit(w)) for w in FIRST_INDICATORS])


def _hits(tests: Sequence[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))


def _score(tests: Sequence[tuple[Column, float]]) -> Column:
    """Weights added one after the other, in list order."""
    return reduce(lambda total, t: total + F.when(t[0], F.lit(t[1])).otherwise(F.lit(0.0)), tests, F.lit(0.0))


def _text_weight(word: str, high: tuple, middle: tuple, weights: tuple[float, float, float]) -> float:
    return weights[0] if word in high else weights[1] if word in middle else weights[2]


def score_weights() -> dict[str, list[tuple[str, float]]]:
    """Indicators of the weighted score with their weights."""
    return {
        "text": [(w, _text_weight(w, SCORE_TEXT_HIGH, SCORE_TEXT_MIDDLE, (0.4, 0.3, 0.1))) for w in SCORE_TEXT],
        "elements": [(s, 0.5 if any(t in s for t in ELEMENT_TERMS_HIGH) else 0.2) for s in SCORE_ELEMENTS],
    }


def verdict_weights() -> dict[str, list[tuple[str, float]]]:
    """Indicators of the text, element and address methods with their weights."""
    return {
        "text": [
            (w, _text_weight(w, VERDICT_TEXT_HIGH, VERDICT_TEXT_MIDDLE, (0.3, 0.25, 0.1))) for w in VERDICT_TEXT
        ],
        "elements": [(s, 0.4 if any(t in s for t in ELEMENT_TERMS_HIGH) else 0.2) for s in VERDICT_ELEMENTS],
        "url": [(p, 0.5 if p in VERDICT_URL_HIGH else 0.2) for p in VERDICT_URL],
    }


def challenge_type(indicators: Column, otherwise: Column) -> Column:
    """Type from the indicators found: recaptcha before hcaptcha before cloudflare before the given other one."""

    def has(term: str) -> Column:
        return F.exists(indicators, lambda i: F.contains(i, F.lit(term)))

    kind = F.when(has(ELEMENT_TERMS_HIGH[0]), ELEMENT_TERMS_HIGH[0])
    for term in ELEMENT_TERMS_HIGH[1:]:
        kind = kind.when(has(term), term)
    return kind.otherwise(otherwise)


def challenge_score(html: Column, url: Column, title: Column) -> Column:
    """Struct of score, detected flag and type from text, markup, address and title."""
    source, address, name = F.lower(html), F.lower(url), F.lower(title)
    weights = score_weights()
    text = [(F.contains(source, F.lit(w)), w, x) for w, x in weights["text"]]
    elements = [(has_element(html, s), s, x) for s, x in weights["elements"]]
    in_url = [(F.contains(address, F.lit(p)), f"url:{p}") for p in SCORE_URL]
    in_title = [(F.contains(name, F.lit(t)), f"title:{t}") for t in SCORE_TITLE]
    score = _score(
        [(test, x) for test, _, x in text + elements]
        + [(_any(address, SCORE_URL), 0.3), (_any(name, SCORE_TITLE), 0.25)]
    )
    tests = [(test, w) for test, w, _ in text + elements] + in_url + in_title

    def has(term: str) -> Column:
        """Whether a test fired whose indicator holds the term; which tests those are is known beforehand."""
        return reduce(lambda a, b: a | b, [test for test, indicator in tests if term in indicator])

    kind = F.when(has("recaptcha"), "reCAPTCHA").when(has("hcaptcha"), "hCAPTCHA").when(has("cloudflare"), "Cloudflare")
    detected = score > SCORE_THRESHOLD
    return F.struct(
        score.alias("score"),
        detected.alias("detected"),
        F.when(detected, kind.otherwise("Generic CAPTCHA")).alias("challenge_type"),
    )


def _capped(score: Column) -> Column:
    # A page that is missing scores nothing; the smaller of null and one would be one.
    return F.least(F.coalesce(score, F.lit(0.0)), F.lit(1.0))


def _most_frequent(values: Column) -> Column:
    """Most frequent entry of a short array; ties go to the first by name."""
    counted = F.transform(
        F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda w: w == v))).alias("n"), v.alias("v"))
    )
    return F.array_min(counted).getField("v")


def challenge_verdict(pages: DataFrame) -> DataFrame:
    """Scores of the five methods, their capped sum, detection flag and the most frequent type.

    Visibility of elements and open windows cannot be known from stored pages; markup stands for both.
    """
    html, source = F.col("html"), F.lower("html")
    address, title = F.lower("url"), F.lower(page_title(F.col("html")))
    weights = verdict_weights()
    text = [(F.contains(source, F.lit(w)), w, x) for w, x in weights["text"]]
    elements = [(has_element(html, s), s, x) for s, x in weights["elements"]]
    in_url = [(F.contains(address, F.lit(p)), p, x) for p, x in weights["url"]]
    forms = F.regexp_extract_all(source, F.lit(r"(?s)<form\b[^>]*>(.*?)</form>"), F.lit(1))
    frames = F.regexp_extract_all(source, F.lit(r"<iframe\b[^>]*\ssrc\s*=\s*[\"']([^\"']*)"), F.lit(1))
    behaviour = F.when(_any(title, VERDICT_TITLE), 0.3).otherwise(0.0)
    behaviour = behaviour + F.when(F.exists(forms, lambda f: _any(f, VERDICT_FORM)), 0.4).otherwise(0.0)
    behaviour = behaviour + F.coalesce(F.size(F.filter(frames, lambda f: _any(f, VERDICT_IFRAME))), F.lit(0)) * F.lit(0.5)
    network = [(F.contains(html, F.lit(s)), 0.3) for s in VERDICT_SERVICES]

    def hits(tests: list) -> Column:
        return _hits([(test, name) for test, name, _ in tests])

    scored = pages.select(
        *[c for c in pages.columns if c != "html"],
        _capped(_score([(t, x) for t, _, x in text])).alias("text_score"),
        _capped(_score([(t, x) for t, _, x in elements])).alias("element_score"),
        _capped(_score([(t, x) for t, _, x in in_url])).alias("url_score"),
        _capped(behaviour).alias("behaviour_score"),
        _capped(_score(network)).alias("network_score"),
        hits(text).alias("_text"),
        hits(elements).alias("_elements"),
        hits(in_url).alias("_url"),
    )
    generic = F.when(F.exists("_text", lambda i: F.contains(i, F.lit("captcha"))), "generic_captcha")
    types = F.array_compact(
        F.array(
            challenge_type(F.col("_text"), generic),
            challenge_type(F.col("_elements"), F.lit("generic_captcha")),
            challenge_type(F.col("_url"), F.lit("url_based_challenge")),
            F.lit("behavioral_analysis"),
            F.lit("network_analysis"),
        )
    )
    total = reduce(
        lambda a, b: a + b,
        [F.col(f"{m}_score") for m in ("text", "element", "url", "behaviour", "network")],
    )
    return scored.withColumns(
        {
            "detected": total > SCORE_THRESHOLD,
            "confidence": _capped(total),
            "challenge_type": _most_frequent(types),
        }
    ).drop("_text", "_elements", "_url")


def block_rates(pages: DataFrame, by: str = "source") -> DataFrame:
    """Attempted, successful and blocked pages per source; pages carry html and status."""
    blocked = is_blocked(F.col("html"), F.col("status"))
    return (
        pages.select(by, blocked.alias("_blocked"))
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("attempted"),
            F.count_if(~F.col("_blocked")).alias("successful"),
            F.count_if("_blocked").alias("blocked"),
        )
    )
