"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over seven bytes cuts a text where its top bits are zero, so that a cut depends on
nearby bytes only. Each chunk gives one of 64 characters. A fingerprint is
`block:signature:signature_at_twice_the_block`; the block grows with the text, so signatures stay
near 32 to 64 characters. Fingerprints are compared by insert/delete edit distance, and only at equal
block sizes, which two fingerprints share if their blocks differ by a factor of two at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquarry.llm.common import documents, prepare, shuffle_partitions, slices

WINDOW = 7
TARGET_CHUNKS = 64
MIN_BITS = 2
#: Two signatures must share a run of this many characters to count as alike at all.
MIN_RUN = 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _rolling(buf: np.ndarray) -> np.ndarray:
    """Mixed hash of the seven bytes that end at each position (uint32, wrapping)."""
    wide = buf.astype(np.uint32)
    h = wide.copy()
    factor = 1
    for j in range(1, WINDOW):
        factor = factor * 0x01000193 & 0xFFFFFFFF
        h[j:] += wide[:-j] * np.uint32(factor)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    h ^= h >> np.uint32(15)
    return h


def fingerprints(texts: Sequence[bytes]) -> list[str]:
    """Fingerprints of whole texts, computed together; an empty text gives empty signatures."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    bits = np.full(len(texts), MIN_BITS, np.int64)
    big = lens > TARGET_CHUNKS << MIN_BITS
    bits[big] = np.ceil(np.log2(lens[big] / TARGET_CHUNKS)).astype(np.int64)
    gap = bytes(WINDOW)
    hashed = _rolling(np.frombuffer(gap.join([b"", *texts]), np.uint8))
    # the gaps between texts keep windows from reaching into the text before
    keep = np.ones(len(hashed), bool)
    starts = np.cumsum(lens + WINDOW) - lens
    for j in range(1, WINDOW + 1):
        keep[starts - j] = False
    h = hashed[keep]
    ends = np.cumsum(lens)
    last = np.zeros(len(h), bool)
    last[ends[lens > 0] - 1] = True
    signatures = []
    for more in (0, 1):
        cut = (h >> np.repeat((32 - bits - more).astype(np.uint32), lens)) == 0
        at = np.flatnonzero(cut | last)
        if len(at):
            sums = np.add.reduceat(h, np.concatenate(([0], at[:-1] + 1)), dtype=np.uint32)
            chars = ALPHABET[(sums * np.uint32(0x9E3779B1)) >> np.uint32(26)].tobytes().decode()
        else:
            chars = ""
        bounds = np.searchsorted(at, ends, side="left").tolist()
        signatures.append([chars[a:b] for a, b in zip([0, *bounds[:-1]], bounds, strict=True)] if bounds else [])
    return [f"{1 << b}:{x}:{y}" for b, x, y in zip(bits.tolist(), *signatures, strict=True)]


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        if m := masks.get(c):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    if len(a) < MIN_RUN or len(b) < MIN_RUN:
        return 0.0
    runs = {a[i : i + MIN_RUN] for i in range(len(a) - MIN_RUN + 1)}
    if not any(b[i : i + MIN_RUN] in runs for i in range(len(b) - MIN_RUN + 1)):
        return 0.0
    # insertions and deletions cost 1 each, so the distance is len(a) + len(b) - 2 * common
    return 2 * _common_subsequence(a, b) / (len(a) + len(b))


def likeness(x: str | None, y: str | None) -> float | None:
    """0 to 1; 1 for equal fingerprints, 0 where block sizes aren't compatible, null if one is null."""
    if x is None or y is None:
        return None
    if x == y:
        return 1.0
    (p, a1, a2), (q, b1, b2) = x.split(":"), y.split(":")
    m, n = int(p), int(q)
    if m == n:
        return max(_alike(a1, b1), _alike(a2, b2))
    if m == 2 * n:
        return _alike(a1, b2)
    if n == 2 * m:
        return _alike(a2, b1)
    return 0.0


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of `text`; null text counts as empty. Other columns pass unchanged."""
    prepare(df.sparkSession)

    @F.pandas_udf("string")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints([(t or "").encode() for t in texts]), dtype=object)

    return df.withColumn(out, fp(F.col(text)))


def likeness_column(a, b):
    """Column of likenesses of two fingerprint columns."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(a, b)


def _bounds(docs: DataFrame, pieces: int) -> np.ndarray:
    """Ids that cut the table into about equal ranges; each is an id of the table. A driver-sized list."""
    found = docs.agg(
        F.min("doc_id").alias("lo"),
        F.percentile_approx("doc_id", [i / pieces for i in range(1, pieces)] or [0.5], max(10_000, 10 * pieces)).alias("cuts"),
    ).first()
    return np.array(sorted({found.lo, *found.cuts}) if found.lo is not None else [0], np.int64)


def with_successor(docs: DataFrame, compute, schema: str, pieces: int | None = None) -> DataFrame:
    """Runs `compute` over rows in ascending doc_id, each with its successor; the last row's is the first row.

    Ids are cut into ranges at ids of the table. The row that opens a range is also sent, marked, to
    the range before it (the first row to the last range), so that one shuffle brings every row
    together with its successor and no task sees more than its range. Null ids come first; rows of
    one id are ordered by text.
    """
    spark = docs.sparkSession
    pieces = pieces or 4 * shuffle_partitions(spark)
    bounds = _bounds(docs, pieces)
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series) -> pd.Series:
        cuts, null = shared.value, ids.isna().to_numpy()
        values = ids.fillna(int(cuts[0])).to_numpy(np.int64)
        own = np.searchsorted(cuts, values, side="right") - 1
        first = (cuts[own] == values) | null
        return pd.Series([[2 * a, 2 * ((a - 1) % len(cuts)) + 1] if f else [2 * a] for a, f in zip(own.tolist(), first.tolist(), strict=True)])

    laid = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("slot", F.explode(ranges("doc_id")))
        .select((F.col("slot") / 2).cast("int").alias("piece"), (F.col("slot") % 2).alias("ahead"), "doc_id", "text")
        .repartition(shuffle_partitions(spark), "piece")
        .sortWithinPartitions("piece", "ahead", "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in slices(batches, 3, 2 << 20):
            rows = held + list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            pairs = [(a[2], a[3], b[3]) for a, b in zip(rows, rows[1:], strict=False) if not a[1]]
            if any(a[0] != b[0] for a, b in zip(rows, rows[1:], strict=False) if not a[1]):
                raise RuntimeError("a range lacks the row that follows it")
            held = rows[-1:]
            if pairs:
                yield from compute(pairs)
        if held and not held[0][1]:
            raise RuntimeError("a range lacks the row that follows it")

    return laid.mapInArrow(run, schema)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(pairs: list[tuple]) -> Iterator[pa.RecordBatch]:
    edited = []
    for _, text, following in pairs:
        half = len(text) // 2
        edited.append((text[: len(text) - half] + following[:half]).encode())
    own = fingerprints([t.encode() for _, t, _ in pairs])
    # within a slice the successor's fingerprint is the next row's own one
    after = [*own[1:], fingerprints([pairs[-1][2].encode()])[0]]
    for i in range(len(pairs) - 1):
        if pairs[i][2] is not pairs[i + 1][1] and pairs[i][2] != pairs[i + 1][1]:
            after[i] = fingerprints([pairs[i][2].encode()])[0]
    changed = fingerprints(edited)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _, _ in pairs], pa.int64()),
            pa.array([len(t) for _, t, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array(own),
            pa.array(changed),
            pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
        ],
        names=[c.split()[0] for c in _SCHEMA.split(", ")],
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text, with their likeness.

    Null text counts as empty. Null doc_id sorts first. An empty table gives no rows; of a single
    row the successor is the row itself.
    """
    prepare(spark)
    return with_successor(documents(spark, sf_dir), _edit, _SCHEMA)
