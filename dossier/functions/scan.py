"""Running values over an ordered group that may be far larger than one task.

A plain window puts a whole group on one task. Here a group is first cut into spans of
`span` consecutive positions. Running values are computed inside each span, one summary row
per span is carried forward over the (short) list of spans, and the carry is joined back.
No task ever holds more than one span of rows, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.config import SPAN_ROWS

_SPAN = "__span"


@dataclass(frozen=True)
class Running:
    """One running value: kind is sum, min, max, last (non-null so far) or prev (row before)."""

    name: str
    kind: str
    value: Column


def _summary(r: Running, order: Column) -> Column:
    if r.kind == "sum":
        return F.sum(r.value)
    if r.kind == "min":
        return F.min(r.value)
    if r.kind == "max":
        return F.max(r.value)
    if r.kind == "last":
        # struct order decides; the null rows are left out before max() sees them
        return F.max(F.when(r.value.isNotNull(), F.struct(order.alias("o"), r.value.alias("v"))))["v"]
    if r.kind == "prev":
        return F.max(F.struct(order.alias("o"), r.value.alias("v")))["v"]
    raise ValueError(f"unknown kind {r.kind}")


def _local(r: Running, w) -> Column:
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if r.kind == "sum":
        return F.sum(r.value).over(upto)
    if r.kind == "min":
        return F.min(r.value).over(upto)
    if r.kind == "max":
        return F.max(r.value).over(upto)
    if r.kind == "last":
        return F.last(r.value, ignorenulls=True).over(upto)
    return F.lag(r.value, 1).over(w)


def _carry(r: Running, w) -> Column:
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    col = F.col(r.name)
    if r.kind == "sum":
        return F.sum(col).over(before)
    if r.kind == "min":
        return F.min(col).over(before)
    if r.kind == "max":
        return F.max(col).over(before)
    if r.kind == "last":
        return F.last(col, ignorenulls=True).over(before)
    return F.lag(col, 1).over(w)


def _combine(r: Running, first_in_span: Column) -> Column:
    here, there = F.col(r.name), F.col(f"__c_{r.name}")
    if r.kind == "sum":
        return F.coalesce(here + there, here, there)
    if r.kind == "min":
        return F.least(here, there)
    if r.kind == "max":
        return F.greatest(here, there)
    if r.kind == "last":
        return F.coalesce(here, there)
    return F.when(first_in_span, there).otherwise(here)


def running_values(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[Running],
    span: int = SPAN_ROWS,
) -> DataFrame:
    """Add running values over `order` (a unique long within `keys`)."""
    keys = list(keys)
    spanned = df.withColumn(_SPAN, F.expr(f"`{order}` div {int(span)}"))
    w_in = Window.partitionBy(*keys, _SPAN).orderBy(order)
    has_prev = any(r.kind == "prev" for r in values)
    here = spanned.select("*", *[_local(r, w_in).alias(r.name) for r in values])
    if has_prev:
        here = here.withColumn("__first", F.row_number().over(w_in) == 1)
    else:
        here = here.withColumn("__first", F.lit(False))
    totals = spanned.groupBy(*keys, _SPAN).agg(
        *[_summary(r, F.col(order)).alias(r.name) for r in values]
    )
    w_out = Window.partitionBy(*keys).orderBy(_SPAN)
    carry = totals.select(*keys, _SPAN, *[_carry(r, w_out).alias(f"__c_{r.name}") for r in values])
    joined = here.join(carry, [*keys, _SPAN], "left")
    names = {r.name for r in values}
    return joined.select(
        *[F.col(c) for c in df.columns if c not in names],
        *[_combine(r, F.col("__first")).alias(r.name) for r in values],
    )
