"""Amounts and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_amount(text: Column, decimals: bool = True) -> Column:
    """DECIMAL(12,2) of the first run of digits with thousands commas, with or without its decimals; null if none."""
    run = F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)" if decimals else r"([0-9][0-9,]*)", 1)
    return F.regexp_replace(run, ",", "").try_cast("decimal(12,2)")


def from_minor_units(raw: Column, digits: Column) -> Column:
    """An amount from its smallest units."""
    return (raw.cast("decimal(20,0)") / F.pow(F.lit(10), digits).cast("decimal(10,0)")).cast("decimal(12,2)")


def shown_amount(amount: Column, currency: str = "KSh") -> Column:
    """The amount with thousands commas, cut to whole units; a dash if there is none."""
    return F.coalesce(F.concat(F.lit(f"{currency} "), F.format_number(F.floor(amount), 0)), F.lit("—"))


def short_number(value: Column) -> Column:
    """A number's text without a needless .0."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def first_within(text: Column, pattern: str, low: float, high: float) -> Column:
    """The first number that the pattern's group finds and that lies within the bounds."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return F.get(F.filter(found, lambda x: x.between(low, high)), F.lit(0))
