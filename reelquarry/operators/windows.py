"""Window operators: anomalies, gaps, islands, uptime, sessions, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rolling_z(df: DataFrame, key: str, order: list[str], value: str, window: int) -> DataFrame:
    """z of each value within the last `window` rows, itself included; null below two rows or without spread."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(1 - window, 0)
    std = F.stddev_pop(value).over(w)
    z = F.when((F.count(value).over(w) >= 2) & (std > 1e-9), (F.col(value) - F.avg(value).over(w)) / std)
    return df.withColumn("z", z)


def gaps(df: DataFrame, key: str, start: str, end: str, minimum: int) -> DataFrame:
    """Gaps between neighbours that are strictly longer than `minimum`."""
    w = W.partitionBy(key).orderBy(start, end)
    return df.withColumn("next_start", F.lead(start).over(w)).where(F.col("next_start") - F.col(end) > minimum).select(key, F.col(end).alias("gap_start"), F.col("next_start").alias("gap_end"))


def adjacent_overlaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(start, end)
    return df.withColumn("prev_start", F.lag(start).over(w)).withColumn("prev_end", F.lag(end).over(w)).where(F.col(start) < F.col("prev_end"))


def islands(df: DataFrame, key: str, order: str, gap: int, out: str = "island") -> DataFrame:
    """Numbers runs whose neighbours lie at most `gap` apart."""
    w = W.partitionBy(key).orderBy(order, *[c for c in ("event_id",) if c in df.columns])
    new = (F.col(order) - F.lag(order).over(w) > gap).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn(out, F.sum("_new").over(w)).drop("_new")


def sessions(views: DataFrame, gap: int = 1800) -> DataFrame:
    return islands(views, "user_id", "t", gap, "session").groupBy("user_id", "session").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("events"), F.round(F.sum("duration"), 4).alias("watched"))


def binges(views: DataFrame, gap: int = 1800) -> DataFrame:
    """Runs of at least two short gaps that a long gap closes; a run at the end isn't counted."""
    runs = islands(views, "user_id", "t", gap, "run").groupBy("user_id", "run").agg(F.count("*").alias("n"))
    last = F.max("run").over(W.partitionBy("user_id"))
    return runs.withColumn("last", last).where("n >= 3 AND run < last").groupBy("user_id").agg(F.count("*").alias("binges"), F.max("n").alias("longest"))


def uptime(df: DataFrame, key: str, order: str, up: F.Column, now: F.Column) -> DataFrame:
    """Share of time in an up state; a record holds until the next one, the last until `now`. 0 without time."""
    w = W.partitionBy(key).orderBy(order, "event_id")
    held = F.coalesce(F.lead(order).over(w), now) - F.col(order)
    return df.withColumn("held", held).groupBy(key).agg(F.round(F.coalesce(F.try_divide(100.0 * F.sum(F.when(up, F.col("held")).otherwise(0)), F.sum("held")), F.lit(0.0)), 6).alias("uptime_pct"))


def transitions(df: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Rows at which the status differs from the one before."""
    w = W.partitionBy(key).orderBy(order, "event_id")
    return df.withColumn("previous", F.lag(status).over(w)).where(F.col("previous").isNull() | (F.col("previous") != F.col(status)))


def top_per_group(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def seasonal(df: DataFrame, key: str, order: str, value: str, period: int) -> DataFrame:
    """Trend (centred mean of 2 * (period // 2) + 1 rows, the overall mean at the edges), phase mean and residual."""
    w = W.partitionBy(key).orderBy(order)
    half = period // 2
    c = w.rowsBetween(-half, half)
    whole = W.partitionBy(key)
    out = df.withColumn("i", F.row_number().over(w) - 1)
    trend = F.when(F.count(value).over(c) == 2 * half + 1, F.avg(value).over(c)).otherwise(F.avg(value).over(whole))
    out = out.withColumn("trend", trend).withColumn("phase", F.col("i") % period)
    out = out.withColumn("season", F.avg(F.col(value) - F.col("trend")).over(W.partitionBy(key, "phase")))
    return out.withColumn("residual", F.col(value) - F.col("trend") - F.col("season"))


def seasonal_anomalies(df: DataFrame, key: str, order: str, value: str, period: int, sigmas: float) -> DataFrame:
    """Rows of a decomposition whose residual lies more than `sigmas` deviations from its mean; none for a series without spread."""
    whole = W.partitionBy(key)
    r = seasonal(df, key, order, value, period).withColumn("_m", F.avg("residual").over(whole)).withColumn("_s", F.stddev_pop("residual").over(whole))
    return r.where((F.col("_s") >= 1.1920929e-07) & (F.abs(F.col("residual") - F.col("_m")) > sigmas * F.col("_s"))).drop("_m", "_s")


def seasonal_forecast(df: DataFrame, key: str, order: str, value: str, period: int, ahead: int) -> DataFrame:
    """(key, step, forecast): the mean trend of the last `period` rows and the phase's season, for `ahead` steps from 0."""
    r = seasonal(df, key, order, value, period)
    n = F.max("i").over(W.partitionBy(key)) + 1
    sized = r.withColumn("_n", n)
    last = sized.groupBy(key).agg(F.avg(F.when(F.col("i") >= F.col("_n") - period, F.col("trend"))).alias("_trend"), F.max("_n").alias("_n"))
    phases = r.select(key, "phase", "season").distinct()
    steps = last.select(key, "_trend", F.explode(F.sequence(F.lit(0), F.lit(ahead - 1))).alias("step"), ((F.col("_n") + F.col("step")) % period).alias("phase")) if ahead else None
    if steps is None:
        return r.limit(0).select(key, F.lit(0).cast("long").alias("step"), F.col("trend").alias("forecast"))
    return steps.join(phases, [key, "phase"]).select(key, F.col("step").cast("long").alias("step"), (F.col("_trend") + F.col("season")).alias("forecast"))


def merge_consecutive(df: DataFrame, key: str, start: str, end: str, text: str, gap: int = 500) -> DataFrame:
    """Segments of a key joined where the next one begins less than `gap` after the end of the one before.

    The joined segment ends where its last one does; texts are joined by a space, unless nothing is there yet.
    """
    w = W.partitionBy(key).orderBy(start, end, text)
    new = F.greatest(F.col(start) - F.lag(end).over(w), F.lit(0)) >= gap
    runs = df.withColumn("_new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    parts = F.sort_array(F.collect_list(F.struct(F.col(start), F.col(end), F.coalesce(text, F.lit("")).alias("_t"))))
    joined = F.aggregate(F.transform("_parts", lambda p: p["_t"]), F.lit(""), lambda acc, t: F.when(acc == "", t).otherwise(F.concat(acc, F.lit(" "), t)))
    return runs.groupBy(key, "_run").agg(parts.alias("_parts")).select(key, F.col("_parts")[0][start].alias(start), F.element_at("_parts", -1)[end].alias(end), joined.alias(text), F.size("_parts").cast("long").alias("segments"))


def timecode_breaks(df: DataFrame, key: str, frame: str, timecode: str) -> DataFrame:
    """Rows that follow the frame before but not its timecode by one; (key, frame)."""
    w = W.partitionBy(key).orderBy(frame)
    broken = (F.col(frame) == F.lag(frame).over(w) + 1) & (F.col(timecode) != F.lag(timecode).over(w) + 1)
    return df.withColumn("_broken", broken).where("_broken").select(key, frame)


def autocorrelation(df: DataFrame, key: str, order: str, value: str, lags: int) -> DataFrame:
    """(key, lag, r): the sum of products of a series and itself `lag` rows later, for lags 0 to `lags` - 1 below its length."""
    w = W.partitionBy(key).orderBy(order)
    v = F.col(value)
    products = df.select(key, *[(v * F.lead(value, k).over(w) if k else v * v).alias(f"_{k}") for k in range(lags)])
    sums = products.groupBy(key).agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in range(lags)])
    return sums.select(key, F.posexplode(F.array(*[f"_{k}" for k in range(lags)])).alias("lag", "r")).where("r IS NOT NULL").select(key, F.col("lag").cast("long").alias("lag"), "r")


def capacity_window(df: DataFrame, key: str, order: list, capacity: int) -> DataFrame:
    """The last `capacity` rows of each key: what a ring buffer of that size holds."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where(F.col("_rank") <= capacity).drop("_rank")


def interleave(df: DataFrame, source: str, rank: str) -> DataFrame:
    """Ranked lists taken in turns: all firsts by source, then all seconds, with a new `position` from 1.

    The position is the number of rows with a lesser rank, and of those of the same rank from sources before.
    """
    below = df.groupBy(rank).agg(F.count("*").alias("_n"))
    # one row a rank: as long as the longest list
    before = below.withColumn("_before", F.sum("_n").over(W.orderBy(rank)) - F.col("_n")).drop("_n")
    return df.join(before, rank).withColumn("position", (F.col("_before") + F.row_number().over(W.partitionBy(rank).orderBy(source))).cast("long")).drop("_before")
