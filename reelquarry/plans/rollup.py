"""Planner helpers: the rollup that serves a time range, and predicates built from optional criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86_400


def choose_rollup(seconds: int) -> str:
    """raw up to two hours, minute to a day, hour to a week, day beyond."""
    if seconds > 7 * DAY:
        return "day"
    if seconds > DAY:
        return "hour"
    return "minute" if seconds > 2 * HOUR else "raw"


def read_range(tables: dict[str, DataFrame], metric: str, start: int, end: int) -> DataFrame:
    """Points of a metric in [start, end) from the rollup that fits the range (columns metric, t, value)."""
    table = tables.get(choose_rollup(end - start), tables["raw"])
    return table.where((F.col("metric") == metric) & (F.col("t") >= start) & (F.col("t") < end))


def roll_up(points: DataFrame, seconds: int) -> DataFrame:
    return points.groupBy("metric", (F.floor(F.col("t") / seconds) * seconds).alias("t")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def active_rights(at: Column, territory: str | None = None) -> Column:
    """Rights with start <= at and an open or later end; a null territory is worldwide."""
    out = (F.col("start_t") <= at) & (F.col("end_t").isNull() | (F.col("end_t") >= at))
    return out & (F.col("territory").isNull() | (F.col("territory") == territory)) if territory else out


def usage(asset: str | None = None, kind: str | None = None, start: str | None = None, end: str | None = None) -> Column:
    """Usage rows by optional criteria; dates are inclusive."""
    out = F.lit(True)
    for wanted, test in ((asset, lambda: F.col("asset_id") == asset), (kind, lambda: F.col("usage_type") == kind), (start, lambda: F.col("usage_date") >= start), (end, lambda: F.col("usage_date") <= end)):
        if wanted is not None:
            out = out & test()
    return out
