"""FNV-1a hashes, the two-lane content id, Adler-32, hash rings and variant assignment: Arrow-batched, vectorised over rows."""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: FNV-1a 64-bit prime and offset, and the offset of the content id's second lane
PRIME, OFFSET, OFFSET_B = 0x100000001B3, 0xCBF29CE484222325, 0xAF63DC4C8601EC8C
# workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: Points in 0 to 1 that variant assignment tells apart.
SHARES = 10_000


def fnv1a_many(raws: list[bytes], offset: int = OFFSET) -> np.ndarray:
    """FNV-1a of each byte string; all rows advance together, the longest to the end."""
    order = np.argsort([-len(r) for r in raws], kind="stable")
    sizes = np.array([len(raws[i]) for i in order], np.int64)
    flat = np.frombuffer(b"".join(raws[i] for i in order), np.uint8)
    starts = np.concatenate(([0], sizes.cumsum()[:-1])) if len(raws) else sizes
    h = np.full(len(raws), offset, np.uint64)
    live = len(raws)
    for i in range(int(sizes[0]) if len(raws) else 0):
        while sizes[live - 1] <= i:
            live -= 1
        h[:live] = (h[:live] ^ flat[starts[:live] + i]) * np.uint64(PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a(text: Column) -> Column:
    """16 hexadecimal digits of the FNV-1a hash of a text's UTF-8 bytes; null for null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        hashes = fnv1a_many([(v or "").encode() for v in values])
        return pd.Series([None if v is None else f"{h:016x}" for v, h in zip(values, hashes.tolist(), strict=True)], dtype=object)

    return run(text)


def session_fingerprint(ip: Column, agent: Column, lang: Column) -> Column:
    """FNV-1a of the three parts with a byte 255 between them, as 16 hexadecimal digits."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        hashes = fnv1a_many([b"\xff".join((v or "").encode() for v in row) for row in zip(a, b, c, strict=True)])
        return pd.Series([f"{h:016x}" for h in hashes.tolist()], dtype=object)

    return run(ip, agent, lang)


def content_id(text: Column) -> Column:
    """32 hexadecimal digits: FNV-1a of the bytes at even places and, from the second offset, of those at odd places, each little-endian."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        raws = [(v or "").encode() for v in values]
        lanes = [fnv1a_many([r[k::2] for r in raws], o) for k, o in ((0, OFFSET), (1, OFFSET_B))]
        return pd.Series([x.tobytes().hex() + y.tobytes().hex() for x, y in zip(lanes[0].astype("<u8"), lanes[1].astype("<u8"), strict=True)], dtype=object)

    return run(text)


def adler32(text: Column) -> Column:
    """Adler-32 of the UTF-8 bytes as eight hexadecimal digits."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([f"{zlib.adler32((v or '').encode()):08x}" for v in values], dtype=object)

    return run(text)


def ring(nodes: dict[str, int], per_weight: int) -> tuple[np.ndarray, list[str]]:
    """Sorted points of a hash ring and their nodes; a node of weight w has w * per_weight points. A later node takes an equal point."""
    names = [(node, f"{node}-{i}".encode()) for node, weight in nodes.items() for i in range(weight * per_weight)]
    points = dict(zip(fnv1a_many([k for _, k in names]).tolist(), [n for n, _ in names], strict=True))
    return np.array(sorted(points), np.uint64), [points[p] for p in sorted(points)]


def ring_node(key: Column, nodes: dict[str, int], per_weight: int) -> Column:
    """The node of the first ring point at or after the key's hash, of the first point if there is none; null on an empty ring."""
    points, owners = ring(nodes, per_weight)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        if not owners:
            return pd.Series([None] * len(values), dtype=object)
        at = np.searchsorted(points, fnv1a_many([(v or "").encode() for v in values])) % len(owners)
        return pd.Series([owners[i] for i in at], dtype=object)

    return run(key)


def variant(user: Column, experiment: str, split: list[float]) -> Column:
    """Index of the variant: the hash of "user:experiment" modulo 10,000 against the running split; the last one takes rounding."""
    bounds = np.cumsum(split)

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        t = (fnv1a_many([f"{v}:{experiment}".encode() for v in values]) % np.uint64(SHARES)).astype(np.float64) / SHARES
        return pd.Series(np.minimum(np.searchsorted(bounds, t, side="right"), len(split) - 1).astype(np.int64))

    return run(user.cast("string"))
