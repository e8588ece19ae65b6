"""Numbers out of text, coercion and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Top of the rating scale.
MAX_RATING = 5.0


def to_number(value: Column) -> Column:
    """Number, or null when the value is no number (the word nan included)."""
    return F.nullif(value.try_cast("double"), F.lit(float("nan")))


def extract_price(text: Column) -> Column:
    """Price in a text: 0 for free items, null when no single number remains.

    With comma and point the comma separates thousands; a lone comma with at most two characters after it is
    a decimal comma.
    """
    digits = F.regexp_replace(text, r"[^0-9.,]", "")
    comma, point = F.contains(digits, F.lit(",")), F.contains(digits, F.lit("."))
    without_commas = F.replace(digits, F.lit(","), F.lit(""))
    one_comma = F.length(digits) - F.length(without_commas) == 1
    after_comma = F.length(digits) - F.instr(digits, ",")

    def read(number_text: Column) -> Column:
        free = F.contains(F.lower(text), F.lit("free"))
        return F.when(free, F.lit(0.0)).otherwise(number_text.try_cast("double"))

    # The digits stand in the first condition, which is always evaluated; so each row computes them once.
    return (
        F.when(comma & point, read(without_commas))
        .when(one_comma & (after_comma <= 2), read(F.replace(digits, F.lit(","), F.lit("."))))
        .otherwise(read(digits))
    )


def extract_rating(text: Column) -> Column:
    """First number of a text on a scale of five; ten-point ratings are halved."""
    number = F.regexp_extract(text, r"([0-9]+\.?[0-9]*)", 1).try_cast("double")
    return (
        F.when(number > 2 * MAX_RATING, F.lit(MAX_RATING)).when(number > MAX_RATING, number / 2).otherwise(number)
    )


def round_even(value: Column, digits: int | None = 2) -> Column:
    """Half-even rounding; ``None`` leaves the value as it is."""
    return value if digits is None else F.bround(value, digits)


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.2f", value))


def float_text(value: Column) -> Column:
    """A double in plain decimal notation with at least one decimal (for magnitudes up to 1e16)."""
    plain = value.cast("string")
    wide = F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"0+$", "")
    wide = F.when(F.endswith(wide, F.lit(".")), F.concat(wide, F.lit("0"))).otherwise(wide)
    return F.when(F.contains(plain, F.lit("E")) & (F.abs(value) < 1e16), wide).otherwise(plain)
