"""Streaming operators over events (user_id, kind, ts, value): sessions, buckets, deduplication, z-scores."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions closed by inactivity; rows later than the watermark are dropped when streaming."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("watched"))
    return s.select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "events", "watched")


def buckets(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start_ts"), "kind", "n", "total")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def z_scores(events: DataFrame, window: int = 20) -> DataFrame:
    """(kind, event_id, z) in event order of each batch; state holds the last `window` values of a kind."""

    def score(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values: list[Any] = list(state.get[0]) if state.exists else []
        rows = pd.concat(parts).sort_values(["ts", "event_id"])
        out = []
        for event_id, v in zip(rows.event_id, rows.value, strict=True):
            values = (values + [float(v)])[-window:]
            s = pd.Series(values)
            std = s.std(ddof=0)
            out.append((key[0], event_id, float((v - s.mean()) / std) if len(values) >= 2 and std > 1e-9 else None))
        state.update((values,))
        yield pd.DataFrame(out, columns=["kind", "event_id", "z"])

    return events.groupBy("kind").applyInPandasWithState(score, "kind string, event_id long, z double", "values array<double>", "append", GroupStateTimeout.NoTimeout)


# fixed values: event kinds that count as critical
CRITICAL = ("error",)


def critical(events: DataFrame, kinds: tuple[str, ...] = CRITICAL) -> DataFrame:
    return events.where(F.col("kind").isin(*kinds))


def flow_statistics(packets: DataFrame, size: str = "1 minute", late: str = LATE) -> DataFrame:
    """Loss rate, mean jitter and bit rate of packets (flow, ts, sent, lost, jitter_ms, bytes) by window; 0 where nothing was sent."""
    grouped = packets.withWatermark("ts", late).groupBy("flow", F.window("ts", size).alias("w")).agg(F.sum("sent").alias("sent"), F.sum("lost").alias("lost"), F.avg("jitter_ms").alias("jitter_ms"), F.sum("bytes").alias("bytes"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return grouped.select("flow", F.col("w.start").alias("start_ts"), F.coalesce(F.try_divide(F.col("lost"), F.col("sent")), F.lit(0.0)).alias("loss_rate"), F.coalesce("jitter_ms", F.lit(0.0)).alias("jitter_ms"), (F.col("bytes") * 8.0 / seconds).alias("bps"))
