"""Study buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventide import fixed_values as fv


def _edges(value: Column, edges, last: str) -> Column:
    out = F.when(value.isNull(), "unknown")
    for bound, label in edges:
        out = out.when(value < bound, label)
    return out.otherwise(last)


def runway_bucket(months: Column) -> Column:
    return _edges(months, ((fv.RUNWAY_CRITICAL_MONTHS, "a. <6mo"),
                           (fv.RUNWAY_WARN_MONTHS, "b. 6-12mo"), (24, "c. 12-24mo")), "d. >24mo")


def size_bucket(market_cap: Column) -> Column:
    return _edges(market_cap, ((300e6, "micro <$300M"), (2e9, "small $0.3-2B")), "mid+ >$2B")


def burst_bucket(burst: Column) -> Column:
    return _edges(burst, ((0.75, "a. quiet <0.75x"), (1.5, "b. normal 0.75-1.5x"),
                          (3.0, "c. elevated 1.5-3x")), "d. burst >3x")


def count_bucket(n: Column) -> Column:
    return _edges(n, ((1, "a. none"), (3, "b. 1-2"), (6, "c. 3-5")), "d. 6+")


def cover_bucket(days: Column) -> Column:
    return _edges(days, ((1.5, "a. <1.5 days"), (3, "b. 1.5-3 days"), (6, "c. 3-6 days")),
                  "d. 6+ days")


def net_flow_bucket(usd: Column) -> Column:
    return (F.when(usd.isNull(), "unknown")
            .when(usd > 250_000, "a. net buying >$250k").when(usd > 0, "b. net buying")
            .when(usd == 0, "c. none").when(usd > -250_000, "d. net selling")
            .otherwise("e. net selling >$250k"))


def cut(value: Column, cuts) -> Column:
    """Right-closed intervals; values outside all of them are NULL."""
    out = None
    for lo, hi, label in cuts:
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (value > lo)
        if hi is not None:
            inside = inside & (value <= hi)
        inside = inside & value.isNotNull()
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def interaction(first: Column, second: Column, both: str, first_only: str,
                second_only: str) -> Column:
    """Four-way label of two conditions; an unknown operand counts as false."""
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    return (F.when(a & b, both).when(a, first_only).when(b, second_only).otherwise("neither"))
