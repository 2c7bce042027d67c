"""Monitoring: logs, metric series, latency and call profiles, transfers, batch and cost reports, trend tests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelquarry.operators.folds import ordered_fold

# fixed values: log levels in order
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
#: Aggregations that a series query may ask for.
AGGREGATES = {
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": lambda c: F.count(c).cast("double"),
}


def at_least(level: Column, least: str) -> Column:
    """Whether a log level is `least` or above; unknown levels are below all."""
    return F.array_position(F.array(*map(F.lit, LEVELS)), F.upper(level)) > LEVELS.index(least.upper())


def contains(text: Column, needle: str) -> Column:
    """Case-insensitive containment; an empty needle is in every text."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def series(points: DataFrame, metric: str, start: Column, end: Column, aggregate: str | None = None) -> DataFrame:
    """Points (metric, t, value) of one metric within [start, end]; with `aggregate` one row at `start`, or none without points."""
    own = points.where((F.col("metric") == metric) & (F.col("t") >= start) & (F.col("t") <= end))
    if aggregate is None:
        return own.select("metric", "t", "value")
    made = own.agg(AGGREGATES[aggregate]("value").alias("value"), F.count("*").alias("n"), F.first(start).alias("t")).where("n > 0")
    return made.select(F.lit(metric).alias("metric"), "t", "value")


def series_many(points: DataFrame, asked: list[tuple[str, str]], start: Column, end: Column) -> DataFrame:
    """(metric, aggregate, value) for several metrics in one pass over the points."""
    own = points.where(F.col("metric").isin(*{m for m, _ in asked}) & (F.col("t") >= start) & (F.col("t") <= end))
    grouped = own.groupBy("metric").agg(F.struct(*[f("value").alias(k) for k, f in AGGREGATES.items()]).alias("v"))
    wanted = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(a).alias("a")) for m, a in asked])
    picked = F.coalesce(*[F.when(F.col("w.a") == k, F.col(f"v.{k}")) for k in AGGREGATES])
    return grouped.select("metric", "v", F.explode(F.filter(wanted, lambda w: w["m"] == F.col("metric"))).alias("w")).select("metric", F.col("w.a").alias("aggregate"), picked.alias("value"))


def retained(points: DataFrame, now: Column, keep: dict[str, int]) -> DataFrame:
    """Points (resolution, t, ...) that are no older than their resolution keeps them, in seconds; unknown resolutions stay."""
    limit = F.coalesce(*[F.when(F.col("resolution") == r, F.lit(s)) for r, s in keep.items()])
    return points.where(limit.isNull() | (F.col("t") >= now - limit))


def last_range(t: Column, now: Column, amount: int, unit: str) -> Column:
    """Whether a time lies in the last so many seconds, minutes, hours or days."""
    return (t >= now - amount * {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86_400}[unit]) & (t <= now)


def transfer_statistics(df: DataFrame, key: str, size: str, seconds: str, ok: Column) -> DataFrame:
    """Mean and peak of the records' own throughput in MiB/s (0 without time), success rate and bytes of each key."""
    rate = F.when(F.col(seconds) > 0, F.col(size) / F.col(seconds) / 1048576.0).otherwise(0.0)
    return df.groupBy(key).agg(F.avg(rate).alias("avg_mbps"), F.max(rate).alias("peak_mbps"), F.avg(ok.cast("int")).alias("success_rate"), F.sum(size).alias("bytes"))


def stage_latency(df: DataFrame, stage: str, ms: str) -> DataFrame:
    return df.groupBy(stage).agg(F.avg(ms).alias("avg_ms"), F.count("*").alias("samples"))


def slowest_stage(latency: DataFrame, stage: str) -> DataFrame:
    """The stage of greatest mean, the last name on ties."""
    return latency.where("samples > 0").agg(F.max_by(stage, F.struct("avg_ms", stage)).alias(stage), F.max("avg_ms").alias("avg_ms"))


def end_to_end(latency: DataFrame, stage: str, path: list[str]) -> DataFrame:
    """Sum of the whole milliseconds of the means along a path; unknown stages count 0, repeated ones each time."""
    times = F.coalesce(*[F.when(F.col(stage) == s, F.lit(path.count(s))) for s in dict.fromkeys(path)])
    return latency.agg(F.coalesce(F.sum(F.floor("avg_ms") * F.coalesce(times, F.lit(0))), F.lit(0)).cast("long").alias("total_ms"))


def hotspots(df: DataFrame, name: str, spent: str, threshold: float) -> DataFrame:
    """Functions with at least `threshold` percent of all time."""
    own = df.groupBy(name).agg(F.sum(spent).alias("total"), F.count("*").alias("samples"))
    # one row is broadcast
    share = F.coalesce(F.try_divide(100.0 * F.col("total"), F.col("everything")), F.lit(0.0))
    return own.crossJoin(F.broadcast(own.agg(F.sum("total").alias("everything")))).withColumn("percent", share).where(F.col("percent") >= threshold).drop("everything")


def call_edges(calls: DataFrame) -> DataFrame:
    """(caller, callee, calls, total) from single calls (caller, callee, spent)."""
    return calls.groupBy("caller", "callee").agg(F.count("*").alias("calls"), F.sum("spent").alias("total"))


def fold_stacks(samples: DataFrame, stack: str, cap: int) -> DataFrame:
    """(frames, depth, value): samples of every stack prefix up to `cap` frames, the root with all of them at depth 0."""
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(stack), F.lit(cap))), lambda n: F.slice(stack, F.lit(1), n))
    frames = samples.select(F.explode(prefixes).alias("frames"))
    return frames.groupBy(F.array_join("frames", ";").alias("frames"), F.size("frames").alias("depth")).agg(F.count("*").alias("value"))


def job_report(tasks: DataFrame, job: str, ok: Column, ms: str) -> DataFrame:
    """One row: mean of the jobs' success rates, mean of their durations, jobs with failures; zeros without jobs."""
    jobs = tasks.groupBy(job).agg(F.avg(ok.cast("int")).alias("rate"), F.sum(ms).alias("ms"))
    return jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col("rate") < 1).alias("failed_jobs"), F.coalesce(F.avg("rate"), F.lit(0.0)).alias("success_rate"), F.coalesce(F.avg("ms"), F.lit(0.0)).alias("avg_ms"))


def outcome_summary(df: DataFrame, ok: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(~ok).alias("errors"), F.count_if(ok).alias("successes"))


def cost_report(entries: DataFrame, amount: str, dims: list[str]) -> DataFrame:
    """(by, value, cost): totals by each dimension and in all, from one pass; values are given as text."""
    sets = [[F.col(d)] for d in dims] + [[]]
    out = entries.groupingSets(sets, *dims).agg(F.sum(amount).alias("cost"), *[F.grouping(d).alias(f"_{d}") for d in dims])
    by, value = F.lit("all"), F.lit(None).cast("string")
    for d in dims:
        by, value = F.when(F.col(f"_{d}") == 0, d).otherwise(by), F.when(F.col(f"_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return out.select(by.alias("by"), value.alias("value"), "cost")


def mann_kendall(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, n, s, variance, z, significant) of series with four values or more; ties enter the variance.

    The series is folded in order with a sorted list of what came before: n log n steps, and a key's values as state.
    """

    def fold(k: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        from bisect import bisect_left, bisect_right, insort
        from itertools import groupby
        from math import sqrt

        seen: list[float] = []
        s = 0
        for (v,) in rows:
            if v is not None:
                s += bisect_left(seen, v) - (len(seen) - bisect_right(seen, v))
                insort(seen, v)
        n = len(seen)
        if n < 4:
            return
        ties = (len(list(g)) for _, g in groupby(seen))
        variance = max((n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in ties)) / 18, 0.0)
        z = (s - (s > 0) + (s < 0)) / max(sqrt(variance), 2.220446049250313e-16)
        yield (k[0], n, float(s), variance, z, abs(z) > 1.96)

    return ordered_fold(df, [key], order, [value], f"{key} {dict(df.dtypes)[key]}, n long, s double, variance double, z double, significant boolean", fold)


def moving_average(df: DataFrame, key: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """(key, calls, ema, least, most): the exponential average of a key's values in order, begun with the first."""

    def fold(k: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        n, ema, low, high = 0, 0.0, None, None
        for (v,) in rows:
            if v is None:
                continue
            ema = float(v) if not n else alpha * v + (1 - alpha) * ema
            low, high, n = v if low is None else min(low, v), v if high is None else max(high, v), n + 1
        if n:
            yield (k[0], n, ema, low, high)

    return ordered_fold(df, [key], order, [value], f"{key} {dict(df.dtypes)[key]}, calls long, ema double, least double, most double", fold)


def peaks(df: DataFrame, key: str, order: str, value: str, distance: int) -> DataFrame:
    """(key, place): strict local maxima at least `distance` rows apart; a higher one nearer than that takes the last one's place."""
    w = W.partitionBy(key).orderBy(order)
    v = F.col(value)
    found = df.select(key, (F.row_number().over(w) - 1).cast("long").alias("place"), v.alias("v"), F.lag(value).over(w).alias("p"), F.lead(value).over(w).alias("q")).where("v > p AND v > q")

    def fold(k: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for place, height in rows:
            if last is None or place - last[0] >= distance:
                if last is not None:
                    yield (k[0], last[0])
                last = (place, height)
            elif height > last[1]:
                last = (place, height)
        if last is not None:
            yield (k[0], last[0])

    return ordered_fold(found, [key], ["place"], ["place", "v"], f"{key} {dict(df.dtypes)[key]}, place long", fold)


def hour_buckets(events: DataFrame, key: str, order: list[str], time: str, keep: int = 86_400, width: int = 3600) -> DataFrame:
    """(key, start, n): views counted in buckets that begin with a first view and take those less than `width` later.

    When a bucket begins, those that began `keep` or longer ago go.
    """

    def fold(k: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[list[int]] = []
        for (t,) in rows:
            if held and t - held[-1][0] < width:
                held[-1][1] += 1
                continue
            held = [b for b in [*held, [t, 1]] if t - b[0] < keep]
        for start, n in held:
            yield (k[0], start, n)

    return ordered_fold(events, [key], order, [time], f"{key} {dict(events.dtypes)[key]}, start long, n long", fold)


def velocity_trending(buckets: DataFrame, key: str, now: Column, half_life_hours: float = 6.0, window_hours: int = 6) -> DataFrame:
    """Score (decayed counts), velocity (views an hour of the last `window_hours`) and the fixed engagement rate of each key."""
    from reelquarry.functions.scoring import exponential_decay

    age = (now - F.col("start")) / 3600.0
    recent = F.sum(F.when(F.col("start") >= now - window_hours * 3600, F.col("n")).otherwise(0))
    return buckets.groupBy(key).agg(F.sum(F.col("n") * exponential_decay(age, half_life_hours)).alias("score"), (recent / window_hours).alias("velocity"), F.lit(0.5).alias("engagement_rate"))
