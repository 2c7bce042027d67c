"""Sliding quotas: only accepted submissions count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame

from reelquarry.operators.folds import ordered_fold


def sliding_quota(df: DataFrame, key: str, order: list[str], time: str, id_col: str, most: int, window: int) -> DataFrame:
    """(key, id, within, allowed, retry_after): whether each submission fits `most` accepted ones in the last `window`.

    `within` are the accepted ones still in the window (its far end included) before the row. A refused row is told
    when the oldest of them leaves; it does not count itself. The state is `most` times at most.
    """

    def fold(k: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        held: deque[int] = deque()
        for t, own in rows:
            while held and held[0] < t - window:
                held.popleft()
            fits = len(held) < most
            yield (k[0], own, len(held), fits, None if fits else held[0] + window - t)
            if fits:
                held.append(t)

    return ordered_fold(df, [key], order, [time, id_col], f"{key} long, {id_col} long, within long, allowed boolean, retry_after long", fold)
