"""Grouped statistics of the media library, each with its own rank, default and division rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _at(values: Column, index: Column) -> Column:
    return F.get(values, index.cast("int"))


#: Ranges of about equal depth into which each group's values are cut.
RANGES = 100


def ranked_values(df: DataFrame, group: str, value: str, ranges: int = RANGES) -> DataFrame:
    """(group, value, c, lo, hi, n): each distinct value with the rows below it, up to it and in all; nulls are left out.

    Values are counted first, with partial counts before the shuffle. Approximate quantiles cut each group into
    ranges; a running count over the few ranges and one within each range give exact places, so that a group
    of any size is sorted by as many tasks as it has ranges.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    shares = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)])
    edges = counts.groupBy(F.col(group).alias("_g")).agg(F.percentile_approx(value, shares, F.lit(10 * ranges)).alias("_edges"))
    laid = counts.join(edges, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_g", "_edges")
    own = W.partitionBy("_g").orderBy("_r")
    depth = laid.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.sum("c").alias("_rows"))
    depth = depth.withColumn("_before", F.sum("_rows").over(own) - F.col("_rows")).withColumn("n", F.sum("_rows").over(W.partitionBy("_g"))).drop("_rows")
    placed = laid.join(depth, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    hi = F.col("_before") + F.sum("c").over(W.partitionBy(group, "_range").orderBy(value))
    return placed.withColumn("hi", hi).select(group, value, "c", (F.col("hi") - F.col("c")).alias("lo"), "hi", "n")


def percentile_conventions(df: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """The five percentile conventions and the upper median of each group; nulls are left out.

    All read one distribution of values and their places, so a group is never held as a list.
    """
    run = ranked_values(df, group, value)
    n = F.col("n")
    linear = p / 100 * (n - 1)

    def pick(index: Column) -> Column:
        return F.max(F.when((index >= F.col("lo")) & (index < F.col("hi")), F.col(value)))

    below, above = pick(F.floor(linear)), pick(F.ceil(linear))
    share = F.max(linear - F.floor(linear))
    return run.groupBy(group).agg(
        F.max("n").alias("n"),
        pick(F.greatest(F.ceil(p / 100 * n) - 1, F.lit(0))).alias("nearest_rank"),
        pick(F.floor(linear)).alias("floor_index"),
        pick(F.round(linear)).alias("rounded_index"),
        pick(F.least(F.floor(n * p / 100), n - 1)).alias("floor_n"),
        F.round(below + (above - below) * share, 6).alias("interpolated"),
        pick(F.floor(n / 2)).alias("upper_median"),
    )


def full_rollup(df: DataFrame, keys: list, value: str, order: str) -> DataFrame:
    """Count, min, max, average, sum and rate (last less first; null below two rows) of each group."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min(v).alias("min_v"),
        F.max(v).alias("max_v"),
        F.round(F.avg(v), 6).alias("avg_v"),
        F.round(F.sum(v), 4).alias("sum_v"),
        F.round(F.when(F.count("*") >= 2, F.max_by(v, F.col(order)) - F.min_by(v, F.col(order))), 6).alias("rate_v"),
    )


def stability(v: Column) -> Column:
    """1 less the coefficient of variation, within 0 to 1; 1 below two values; of mean 0, 1 without spread and 0 with it."""
    mean, std = F.avg(v), F.stddev_pop(v)
    flat = F.when(std < 1e-12, 1.0).otherwise(0.0)
    return F.when(F.count(v) < 2, 1.0).when(F.abs(mean) < 1e-12, flat).otherwise(F.greatest(F.least(1 - F.try_divide(std, mean), F.lit(1.0)), F.lit(0.0)))


def summary_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pooling, stability and spread: mean, harmonic mean, population deviation, 1 - CV, share below a mark."""
    v = F.col(value)
    mean, std = F.avg(v), F.stddev_pop(v)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.round(mean, 6).alias("mean"),
        F.round(F.count(v) / F.sum(1 / F.greatest(v, F.lit(1e-10))), 6).alias("harmonic"),
        F.round(std, 6).alias("std"),
        F.round(stability(v), 6).alias("stability"),
        F.round(F.avg((v < 50).cast("int")), 6).alias("below_50"),
    )


def trending(views: DataFrame, now: int | Column, half_life: float = 86_400.0) -> DataFrame:
    """Decayed views, distinct viewers, mean duration and score of each item."""
    from reelquarry.functions.scoring import half_life_weight

    now = F.lit(now) if isinstance(now, int) else now
    grouped = views.groupBy("item_id").agg(
        F.sum(half_life_weight((now - F.col("t")).cast("double"), half_life)).alias("weighted"),
        F.countDistinct("user_id").alias("unique_viewers"),
        F.avg("duration").alias("avg_duration"),
    )
    score = F.col("weighted") * F.greatest(F.log(F.col("unique_viewers") + 1.0), F.lit(1.0))
    return grouped.select("item_id", F.round(score, 4).alias("score"), F.floor("weighted").cast("long").alias("view_count"), "unique_viewers", F.round("avg_duration", 6).alias("avg_duration_s"))


def duplicate_groups(df: DataFrame, digest: Column, id_col: str, size: str) -> DataFrame:
    """Groups of equal digests: members, first id and bytes that all but the first waste."""
    return (
        df.withColumn("digest", digest).groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"), (F.sum(size) - F.min_by(size, F.col(id_col))).alias("wasted"))
        .where("n > 1")
    )


def histogram(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """(upper, n): a fixed number of buckets of whole width over the range, empty ones too, by their upper bounds.

    Equal values give one bucket at that value; no values give none.
    """
    edge = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo IS NOT NULL")
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / buckets), F.lit(1))
    edge = edge.select("lo", "hi", width.alias("width"), F.when(F.col("lo") == F.col("hi"), 1).otherwise(buckets).cast("long").alias("slots"))
    place = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("width")), F.col("slots") - 1)
    counted = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(place.alias("bucket")).agg(F.count("*").alias("n"))
    slots = edge.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("bucket"), "lo", "hi", "width", "slots")
    upper = F.when(F.col("slots") == 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bucket") + 1) * F.col("width"))
    return slots.join(counted, "bucket", "left").select(upper.cast("double").alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def iqr_outliers(df: DataFrame, key: str, value: str, mild: float = 1.5, extreme: float = 3.0) -> DataFrame:
    """Rows outside the fences of their group (strictly); groups below four rows give none."""
    places = ranked_values(df, key, value)

    def quartile(p: float) -> Column:
        at = p * (F.col("n") - 1)

        def pick(index: Column) -> Column:
            return F.max(F.when((index >= F.col("lo")) & (index < F.col("hi")), F.col(value)))

        low = pick(F.floor(at))
        return low + (pick(F.ceil(at)) - low) * F.max(at - F.floor(at))

    q = places.groupBy(key).agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), F.max("n").alias("n")).where("n >= 4")
    spread = F.col("q3") - F.col("q1")
    v = F.col(value)

    def outside(k: float) -> Column:
        return (v < F.col("q1") - k * spread) | (v > F.col("q3") + k * spread)

    return df.join(q, key).where(outside(mild)).withColumn("extreme", outside(extreme))
