"""Numbers and ranges written in a table cell, with comma decimals or dot thousands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(tok: Column) -> Column:
    no_dots = F.replace(tok, F.lit("."), F.lit(""))
    comma = F.replace(no_dots, F.lit(","), F.lit("."))
    text = (
        F.when(F.contains(tok, F.lit(",")), comma)
        .when(tok.rlike(r"\.\d{3}$"), no_dots)
        .otherwise(tok)
    )
    return text.try_cast("double")


def parse_numbers(c: Column) -> Column:
    """All numbers of a text. A comma is decimal; a dot before a last group of three digits
    separates thousands, any other dot is decimal."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\d[\d.,]*"), F.lit(0)), _number)


def parse_range(c: Column, less_word: str = "az") -> Column:
    """(lo, hi) of a cell such as `3.1- 10` or `less than 5` (marked by `less_word`)."""
    n = parse_numbers(c)
    first, second = F.coalesce(F.get(n, F.lit(0)), F.lit(0.0)), F.get(n, F.lit(1))
    less = F.contains(c, F.lit(less_word))
    return F.struct(
        F.when(less, F.lit(0.0)).otherwise(first).alias("lo"),
        F.when(less, first).otherwise(F.coalesce(second, first)).alias("hi"),
    )


def pick_inside(bounds: Column) -> Column:
    """A value inside a range: its middle, or a little above a single value."""
    lo, hi = bounds["lo"], bounds["hi"]
    return F.when(hi <= lo, F.bround(lo + 0.5, 1)).otherwise(F.bround((lo + hi) / 2, 1))
