"""Text functions on columns."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a condition or a shipping text, and promotional titles.
CONDITION_WORDS = ("new", "used", "refurbished", "open")
SHIPPING_WORDS = ("shipping", "free")
PROMOTIONAL_TITLES = ("shop on ebay", "sponsored", "advertisement")
# Word that disqualifies a fallback title line, by source.
TITLE_LINE_STOP_WORDS = {"amazon": "rating", "ebay": "bid"}
TITLE_LINE_MIN_CHARS = 15

# Blanks as Python sees them: Unicode white space plus the four separators x1C-x1F. A space alone needs no collapsing, and
# most characters are told by the first look.
_BLANKS = r"(?U)(?![\x21-\x7E])(?: [\s\x1c-\x1f]++|[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*+)"


# A reference as it stands after its ampersand: a number, or a name of at most 32 characters.
_REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# An ampersand that a reference follows.
_REFERS = r"&(?:#(?:[0-9]|[xX][0-9a-fA-F])|[^\t\n\f <&#;])"
# Names that older pages write without a semicolon also count as the beginning of a longer word; the longest one does.
_OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
# The names most pages use, asked for before the whole table is.
_USUAL = ("amp;", "nbsp;", "lt;", "gt;", "quot;", "apos;")
# References to 128-159 mean the characters that Windows code page 1252 has there, if any.
_C1 = "".join(map(chr, range(128, 160)))
_WINDOWS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))


def _named(name: Column) -> Column:
    """The characters of a name of the standard table, or null."""
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in html5.items())), F.lit("\x01"), F.lit("\x02"))
    found = F.when(name == _USUAL[0], F.lit(html5[_USUAL[0]]))
    for usual in _USUAL[1:]:
        found = found.when(name == usual, F.lit(html5[usual]))
    return found.otherwise(F.element_at(table, name))


def _numbered(reference: Column) -> Column:
    """The character of a decimal or hexadecimal number; unusable numbers give the replacement character or nothing."""
    hexadecimal = F.lower(F.substring(reference, 2, 1)) == "x"
    digits = F.regexp_extract(reference, r"^#[xX]?0*([0-9a-fA-F]*)", 1)
    # Seven digits hold every code point; longer numbers are none.
    number = F.when(digits == "", F.lit(0)).when(F.length(digits) > 7, F.lit(1 << 30)).otherwise(
        F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
    )
    character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    unprintable = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127) | number.between(0xFDD0, 0xFDEF)
    return (
        F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit("\ufffd"))
        .when(unprintable | (number % 65536 >= 65534), F.lit(""))
        .when(number.between(128, 159), F.translate(character, _C1, _WINDOWS))
        .otherwise(character)
    )


def _after_ampersand(part: Column) -> Column:
    """What follows an ampersand, with the reference it begins with resolved; the ampersand itself where there is none."""
    reference = F.regexp_extract(part, _REFERENCE, 0)
    rest = F.substring(part, F.length(reference) + 1, F.length(part))
    opening = F.regexp_extract(reference, f"^(?:{_OPEN_NAMES})", 0)
    return (
        F.when(reference == "", F.concat(F.lit("&"), part))
        .when(F.startswith(reference, F.lit("#")), F.concat(_numbered(reference), rest))
        .otherwise(
            F.coalesce(
                F.concat(_named(reference), rest),
                F.when(opening != "", F.concat(_named(opening), F.substring(part, F.length(opening) + 1, F.length(part)))),
                F.concat(F.lit("&"), part),
            )
        )
    )


def unescape(text: Column) -> Column:
    """HTML entities resolved as the standard asks, once each: numbers, names, and names without a semicolon.

    Texts are cut at their ampersands; every piece begins with at most one reference.
    """
    pieces = F.split(text, "&", -1)
    resolved = F.transform(F.slice(pieces, 2, F.size(pieces)), _after_ampersand)
    return F.when(F.contains(text, F.lit("&")) & F.regexp_like(text, F.lit(_REFERS)), F.concat(F.element_at(pieces, 1), F.array_join(resolved, ""))).otherwise(text)


def squeeze(text: Column) -> Column:
    """Blanks collapsed and trimmed, then every character outside printable ASCII dropped."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, _BLANKS, " ")), r"[^\x20-\x7E]++", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_text(text: Column) -> Column:
    return F.coalesce(squeeze(unescape(text)), F.lit(""))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """True when the text holds one of the plain words as a substring (lower case on both sides)."""
    lowered = F.lower(text)
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(lowered, F.lit(word))
    return hit


def condition_text(text: Column) -> Column:
    return F.when(contains_any(text, CONDITION_WORDS), strip(text))


def shipping_text(text: Column) -> Column:
    return F.when(contains_any(text, SHIPPING_WORDS), strip(text))


def title_fallback(text: Column, source: Column) -> Column:
    """First line long enough for a title that is neither a price nor a rating / bid line."""
    stop = F.lit(None).cast("string")
    for name, word in TITLE_LINE_STOP_WORDS.items():
        stop = F.when(source == name, F.lit(word)).otherwise(stop)
    lines = F.transform(F.split(text, "\n"), strip)
    good = F.filter(
        lines,
        lambda line: (F.length(line) > TITLE_LINE_MIN_CHARS)
        & ~F.startswith(line, F.lit("$"))
        & ~F.coalesce(F.contains(F.lower(line), stop), F.lit(False)),
    )
    return F.try_element_at(good, F.lit(1))


def label(text: Column) -> Column:
    return F.initcap(text)


def as_json(value: Column) -> Column:
    return F.to_json(value)
