"""Running sums and numbers over a whole table without gathering it: rows get the number of a range of values, sums run inside the
ranges, and each range is offset by the totals of those before it. The ranges' bounds are literals in the plan, so every branch of a
plan deals rows out alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def range_of(frame: DataFrame, column: str, parts: int = PARTS) -> Column:
    """The number of the range, of about equal sizes, in which a numeric column lies. Equal values share a range."""
    shares = [k / parts for k in range(1, parts)]
    bounds = frame.agg(F.percentile_approx(F.col(column), shares, 10_000).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(column)))


def offsets(frame: DataFrame, part: str, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """Per range: the sums of all ranges before it, a row per range."""
    per = frame.groupBy(part).agg(*[c.alias(n) for n, c in sums.items()])
    w = Window.orderBy(F.desc(part) if descending else F.asc(part)).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(part, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums])
