"""Dirty keys and text: coercion rules shared by batch and streaming callers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"

# Fixed value: plain decimal text, optional exponent; excludes 'inf', 'nan', '1.0d', hex.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _as_number(value: Column) -> Column:
    text = stripped(value)
    return F.when(text.rlike(NUMBER_PATTERN), text).try_cast("double")


def numeric_key(value: Column) -> Column:
    """Integer key from text or number; white space around it is dropped, anything non-integral is null.

    A decimal reads plain numbers only, so 'inf', 'nan' and '1.0d' are null without a pattern.
    """
    number = stripped(value).try_cast("decimal(38,10)")
    return F.when(number % 1 == 0, number).try_cast("long")


def stripped(value: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", "")


def clean_text(value: Column) -> Column:
    """Trimmed text; empty and ``N/A`` are null."""
    text = stripped(value)
    return F.when((text != "") & (text != "N/A"), text)


def numeric_or_default(value: Column, default: float) -> Column:
    """Number, or the default where the value is absent or not a number."""
    return F.coalesce(_as_number(value), F.lit(float(default)))


def starts_credit(invoice: Column) -> Column:
    """Credit notes carry an invoice id that starts with ``C``."""
    return F.startswith(invoice.cast("string"), F.lit("C"))


def price_cents(price: Column) -> Column:
    """Money identity at cent precision, halves to even."""
    return F.rint(price.cast("double") * 100).cast("long")


def line_revenue(quantity: Column, price: Column) -> Column:
    """Line amount from the raw price, in decimals so that sums ignore row order."""
    return (quantity.cast("decimal(18,0)") * price.cast("decimal(18,6)")).cast("decimal(38,6)")


def concat_level(*columns: Column) -> Column:
    """Interaction level ``a|b|c``; an absent part is the text ``nan``."""
    return F.concat_ws("|", *[missing_as_level(c) for c in columns])


def missing_as_level(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("nan"))
