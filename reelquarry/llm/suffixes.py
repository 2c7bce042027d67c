"""Suffix-array dedup: bytes covered by long strings that occur more than once.

1. Every window of `length` bytes is owned by one anchor: the k-gram of least hash in it (leftmost on
   ties). Equal windows own equal anchors at equal distances, so repeats can only be found among
   windows whose anchors have the same hash. Anchors are about 2 / (length - k + 2) of the bytes.
   A first pass counts them in a table of fixed size, which tells hot anchors from others.
2. A hot anchor has its windows cut into short ranges of distance; all windows of a range share
   length - width + 1 bytes, and their hash makes the range an anchor of its own, so that different
   surroundings go to different tasks. What is hot is a share of all records, so the ranges are no
   larger part of a larger corpus. Anchors that occur once are dropped; of ranges that a task sees
   more than once it sends one to be compared. The others send the text that their windows cover;
   equal records of ranges are joined before the shuffle: a task sends one of them, and the repeated
   spans of all.
3. A task sorts the window starts of its records as suffixes, within equal anchor and distance.
   Suffixes are compared by their common extension, which binary search finds on prefix polynomial
   hashes in logarithmic time; the sort is a bottom-up mergesort that merges all runs at once.
   Neighbours with a common extension of `length` are repeats; their bytes are compared to verify it.
   A group beyond LARGE bytes goes by in parts, from each of which one record per distinct window stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquarry.llm.common import documents, join_classes, materialize, prepare, shuffle_partitions, slices, sum_tables

LENGTH = 400
#: Anchor k-grams are this share of the window.
GRAM_SHARE = 0.25
#: Bytes of records that are sorted together.
SORT_BYTES = 1 << 20
#: Records of an anchor from which its windows are cut into ranges of an eighth of the length, and of a 64th;
#: each at least such a part of all records.
HOT, HOTTER = 1 << 12, 1 << 16
HOT_PART, HOTTER_PART = 1 << 13, 1 << 8
#: Slots of the count table (a power of two), and the parts in which it is summed. Its size doesn't depend on the data.
SLOT_BITS, CHUNKS = 18, 16
#: Bytes of one group's records that are held at once.
LARGE = 16 << 20
#: Ranges of hot anchors that a task remembers to tell and join equal ones; then it starts anew.
JOINED = 200_000
#: Positions of one text that are handled together; longer texts are read in overlapping stretches.
STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    got = _TABLES.get(base)
    if got is None or len(got) < n:
        got = _TABLES[base] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1 << 16), base, np.uint64))))
    return got


_SCATTER = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), np.uint64)


class PrefixHashes:
    """Polynomial prefix hashes of a buffer; the hash of any substring in constant time."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), n + 1)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(_SCATTER[buf] * _powers(_BASE, n + 1)[:n])))

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(texts: list[bytes], length: int, gram: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, position, first start, last start) of each text's anchors; the starts are those of the windows it owns."""
    out = []
    none = (np.zeros(0, np.int64),) * 4
    wide = length - gram + 1
    for text in texts:
        if len(text) < length:
            out.append(none)
            continue
        parts = []
        for at in range(0, len(text) - length + 1, STRETCH):
            buf = np.frombuffer(text, np.uint8, min(len(text) - at, STRETCH + length - 1), at)
            grams = _mixed(PrefixHashes(buf).of(np.arange(len(buf) - gram + 1), gram))
            place = np.arange(len(grams), dtype=np.uint64)
            # the position in the low bits makes the leftmost of equal hashes the least
            low = _sliding_min((grams >> np.uint64(21) << np.uint64(21)) | place, wide)
            own = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
            first = np.flatnonzero(np.diff(own, prepend=-1))
            last = np.append(first[1:], len(own)) - 1
            pos = own[first]
            parts.append((grams[pos].view(np.int64), pos + at, first + at, last + at))
        out.append(tuple(np.concatenate(c) for c in zip(*parts, strict=True)))
    return out


#: `place` packs the anchor's position, its distance to the first start, and the number of further starts.
_ANCHORS = "hash long, t1 long, t2 long, place long"


def _text_id(text: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_SKETCH = "kind int, key long, t1 long, t2 long, n long, chunk int, counts binary"


def _fields(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _sketch(length: int, gram: int):
    """(key, text) -> the digest and size of each text (kind 0) and the task's anchor counts by slot (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SLOT_BITS, np.int64), set()
        for batch in slices(batches, 1, 1 << 20):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            ids, fresh, m = [_text_id(t) for t in texts], [], len(texts)
            for t, tid in zip(texts, ids, strict=True):
                if len(t) >= length and tid not in seen:
                    seen.add(tid)
                    fresh.append(t)
            for hashes, *_ in anchors(fresh, length, gram):
                counts += np.bincount((hashes.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(counts))
            columns = [pa.array([0] * m, pa.int32()), batch.column(0), *(pa.array([i[k] for i in ids], pa.int64()) for k in (0, 1)), pa.array(list(map(len, texts)), pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=_fields(_SKETCH))
        parts = np.minimum(counts, 0xFFFFFFFF).astype("<u4").reshape(CHUNKS, -1)
        kept = [i for i in range(CHUNKS) if parts[i].any()]
        m = len(kept)
        columns = [pa.array([1] * m, pa.int32()), *(pa.nulls(m, pa.int64()) for _ in range(4)), pa.array(kept, pa.int32()), pa.array([parts[i].tobytes() for i in kept], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=_fields(_SKETCH))

    return run


def _heat_levels(sketch: DataFrame, hot: int, hotter: int) -> np.ndarray:
    """0, 1 or 2 for each slot; the counts are summed by the executors and come as a table of fixed size."""
    table = np.zeros((CHUNKS, (1 << SLOT_BITS) // CHUNKS), np.int64)
    for r in sum_tables(sketch.where("kind = 1"), "<u4", CHUNKS):
        table[r.chunk] = np.frombuffer(r.sums, "<i8")
    every = int(table.sum())
    hot = max(hot, every // HOT_PART)
    return ((table > hot).astype(np.uint8) + (table > max(hotter, every // HOTTER_PART, hot))).ravel()


def _core_hashes(texts: list[bytes], owner: np.ndarray, pos: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Hashes of `size` bytes from `start` of the owner's text; they lie within `length` of `pos`. Long texts go by in stretches."""
    out = np.zeros(len(owner), np.uint64)
    lens = np.array([len(t) for t in texts], np.int64)
    used = np.zeros(len(texts), bool)
    used[owner] = True
    few = np.flatnonzero(used & (lens <= STRETCH))
    base = np.zeros(len(texts), np.int64)
    base[few] = np.cumsum(lens[few]) - lens[few]
    at = np.flatnonzero(lens[owner] <= STRETCH)
    if len(at):
        out[at] = PrefixHashes(np.frombuffer(b"".join(texts[i] for i in few.tolist()), np.uint8)).of(base[owner[at]] + start[at], size[at])
    for i in np.flatnonzero(used & (lens > STRETCH)).tolist():
        for low in range(0, len(texts[i]), STRETCH):
            at = np.flatnonzero((owner == i) & (pos >= low) & (pos < low + STRETCH))
            if len(at):
                begin = max(0, low - length)
                out[at] = PrefixHashes(np.frombuffer(texts[i][begin : low + STRETCH + length], np.uint8)).of(start[at] - begin, size[at])
    return out


def _ranges(texts: list[bytes], owner: np.ndarray, level: np.ndarray, hashes: np.ndarray, pos: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, place) of the ranges of hot anchors; the hash is that of the bytes that all windows of a range have."""
    width = np.where(level > 1, max(1, length // 64), max(1, length // 8))
    near, far = pos - last, pos - first
    count = far // width - near // width + 1
    of = np.repeat(np.arange(len(pos)), count)
    r = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + (near // width)[of]
    w, at = width[of], pos[of]
    begin, end = at - np.minimum(far[of], r * w + w - 1), at - np.maximum(near[of], r * w)
    core = _core_hashes(texts, owner[of], at, at - r * w, length - w + 1, length)
    key = _mixed(_mixed(core ^ hashes.view(np.uint64)[of]) + r.astype(np.uint64))
    return key.view(np.int64), owner[of], (at << 32) | ((at - begin) << 16) | (end - begin)


#: The two low bits of an anchor's hash: it is a range of a hot anchor, and it is known to occur more than once.
_RANGE, _KNOWN = 1, 2


def _scan(length: int, gram: int, levels):
    """Anchors of each distinct text of a task, those that are hot as ranges.

    A range met again in the task is sent as known to repeat, and so is the one that it met first; the others must still meet by hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        met: dict[int, tuple | None] = {}
        heat = levels.value.astype(np.int64)

        def emit(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_fields(_ANCHORS))

        for batch in slices(batches, 0, 1 << 20):
            fresh = []
            for t in ((t or "").encode() for t in batch.column(0).to_pylist()):
                if len(t) >= length and (tid := _text_id(t)) not in seen:
                    seen.add(tid)
                    fresh.append((t, tid))
            texts = [t for t, _ in fresh]
            found = anchors(texts, length, gram)
            sizes = [len(f[0]) for f in found]
            if not sum(sizes):
                continue
            ids = np.array([tid for _, tid in fresh], np.int64)
            owner = np.repeat(np.arange(len(fresh)), sizes)
            hashes, pos, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
            level = heat[(hashes.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
            cold, hot = np.flatnonzero(level == 0), np.flatnonzero(level)
            place = (pos << 32) | ((pos - first) << 16) | (last - first)
            yield emit([hashes[cold] & -4, *(ids[owner[cold], k] for k in (0, 1)), place[cold]])
            if not len(hot):
                continue
            keys, of, places = _ranges(texts, owner[hot], level[hot], hashes[hot], pos[hot], first[hot], last[hot], length)
            rows = []
            for key, i, where in zip(((keys & -4) | _RANGE).tolist(), of.tolist(), places.tolist(), strict=True):
                row = (*fresh[i][1], where)
                if key not in met:
                    if len(met) >= JOINED:
                        met.clear()
                    met[key] = row
                    rows.append((key, *row))
                    continue
                if (one := met[key]) is not None:
                    rows.append((key | _KNOWN, *one))
                    met[key] = None
                rows.append((key | _KNOWN, *row))
            yield emit(list(zip(*rows, strict=True)))

    return run


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by all columns -> the distinct rows that are known to repeat or whose hash more than one of them has. The last row waits for the next."""
    held, sent = None, False
    names = _fields(_ANCHORS)

    def emit(rows: list[np.ndarray], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
        if chosen.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[chosen]) for c in rows], names=names)

    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(([h], c)) for h, c in zip(held, rows, strict=True)]
        fresh = np.ones(len(rows[0]), bool)
        fresh[1:] = np.any([c[1:] != c[:-1] for c in rows], axis=0)
        rows = [c[fresh] for c in rows]
        same = rows[0][1:] == rows[0][:-1]
        common = np.append(same, False) | (rows[0] & _KNOWN > 0)
        common[1:] |= same
        send = common.copy()
        if held is not None and sent:
            send[0] = False
        if len(send) == 1 and not common[0]:
            held = [c[-1] for c in rows]
            continue
        held, sent = [c[-1] for c in rows], bool(common[-1])
        yield from emit(rows, send)


class SuffixSorter:
    """Sorts suffixes of a buffer within buckets, up to `limit` bytes, by hash-compared common extensions."""

    def __init__(self, buf: np.ndarray, limit: int):
        self.buf, self.limit = buf, limit
        self.hashes = PrefixHashes(np.concatenate((buf, np.zeros(limit, np.uint8))))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of suffix pairs, at most `limit`."""
        low = np.zeros(len(a), np.int64)
        whole = self.hashes.of(a, self.limit) == self.hashes.of(b, self.limit)
        low[whole] = self.limit
        at = np.flatnonzero(~whole)
        x, y = a[at], b[at]
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.limit - 1, np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.hashes.of(x, mid) == self.hashes.of(y, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        low[at] = lo
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix a sorts before, with or after suffix b (equal for `limit` bytes: with)."""
        reach = self.extension(a, b)
        out = np.zeros(len(a), np.int8)
        d = np.flatnonzero(reach < self.limit)
        out[d] = np.sign(self.buf[a[d] + reach[d]].astype(np.int16) - self.buf[b[d] + reach[d]])
        return out

    def sort(self, suffix: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Order of the suffixes: by bucket, then by text. `bucket` must be sorted already."""
        n = len(suffix)
        order = np.arange(n)
        first = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1 if n else 0))
        size = np.diff(np.append(first, n))
        start, many = np.repeat(first, size), np.repeat(size, size)
        rank = np.arange(n) - start
        run = 1
        while (live := np.flatnonzero(many > run)).size:
            # every element finds its place in the sibling run by binary search; both places give its rank
            r = rank[live]
            block = r // (2 * run) * (2 * run)
            right = (r % (2 * run)) >= run
            lo = start[live] + np.where(right, block, block + run)
            end = np.minimum(lo + run, start[live] + many[live])
            left = lo.copy()
            hi = np.maximum(end, lo)
            own = suffix[order[live]]
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                c = self.before(suffix[order[mid]], own[open_])
                # equal suffixes: those of the left run come first
                less = (c < 0) | ((c == 0) & right[open_])
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
            place = start[live] + block + (r - block - right * run) + (lo - left)
            order[place] = order[live]
            run *= 2
        return order


def _repeats(records: list[tuple], length: int) -> list[tuple]:
    """records (hash, t1, t2, first, last, pos, text) with distinct texts by hash -> (t1, t2, start, end) of repeated bytes."""
    buf = np.frombuffer(b"".join(r[6] for r in records), np.uint8)
    sizes = np.array([len(r[6]) for r in records], np.int64)
    base = np.concatenate(([0], sizes.cumsum()[:-1]))
    count = np.array([r[4] - r[3] + 1 for r in records], np.int64)
    owner = np.repeat(np.arange(len(records)), count)
    step = np.arange(int(count.sum())) - np.repeat(np.concatenate(([0], count.cumsum()[:-1])), count)
    group = np.unique(np.array([r[0] for r in records], np.int64), return_inverse=True)[1]
    distance = np.array([r[5] - r[3] for r in records], np.int64)[owner] - step
    bucket = group[owner] * (2 * length) + distance
    order = np.argsort(bucket, kind="stable")
    bucket, owner, step = bucket[order], owner[order], step[order]
    suffix = base[owner] + step
    sorter = SuffixSorter(buf, length)
    # equal windows have equal hashes: a hash that is alone in its bucket repeats nothing and needs no place in the order
    whole = sorter.hashes.of(suffix, length)
    by = np.lexsort((whole, bucket))
    alike = (bucket[by][1:] == bucket[by][:-1]) & (whole[by][1:] == whole[by][:-1])
    twin = np.zeros(len(by), bool)
    twin[1:] = alike
    first = np.flatnonzero(~twin & np.append(alike, False))
    if not len(first):
        return []
    # two windows of each hash enter the sort; the others are compared with the first byte by byte
    head = np.zeros(len(by), np.int64)
    head[first] = first
    head = np.maximum.accumulate(head)
    pair = np.sort(np.concatenate((by[first], by[first + 1])))
    order = pair[sorter.sort(suffix[pair], bucket[pair])]
    x, y = order[:-1], order[1:]
    near = bucket[x] == bucket[y]
    x, y = x[near], y[near]
    near = sorter.extension(suffix[x], suffix[y]) == length
    x, y = x[near], y[near]
    rest = np.flatnonzero(twin)
    rest = rest[~np.isin(by[rest], pair)]
    x, y = np.concatenate((x, by[head[rest]])), np.concatenate((y, by[rest]))
    good = _verified(buf, suffix[x], suffix[y], owner[x], owner[y], length)
    repeated = np.zeros(len(suffix), bool)
    repeated[x[good]] = repeated[y[good]] = True
    if not good.all():
        # a collision of hashes: windows left without a proven partner are compared with all of their bucket and hash
        lost = set(bucket[y[~good]].tolist())
        for at in (np.flatnonzero(bucket == v) for v in lost):
            seen: dict[bytes, list[int]] = {}
            for i in at.tolist():
                seen.setdefault(buf[suffix[i] : suffix[i] + length].tobytes(), []).append(i)
            for same in seen.values():
                if len(same) > 1:
                    repeated[same] = True
    marked = np.zeros(len(buf) + 1, np.int32)
    np.add.at(marked, suffix[repeated], 1)
    np.add.at(marked, suffix[repeated] + length, -1)
    covered = np.concatenate(([0], (marked.cumsum() > 0)[:-1].astype(np.int8), [0]))
    covered_edges = np.diff(covered)
    out = []
    starts, ends = np.flatnonzero(covered_edges == 1), np.flatnonzero(covered_edges == -1)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        i = int(np.searchsorted(base, a, side="right")) - 1
        while a < b:
            r, stop = records[i], min(b, int(base[i] + sizes[i]))
            out.append((r[1], r[2], int(a - base[i] + r[3]), int(stop - base[i] + r[3])))
            a, i = stop, i + 1
    return out


def _verified(buf: np.ndarray, a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Whether window pairs are equal byte by byte; stretches of one record pair are compared at once."""
    if not len(a):
        return np.zeros(0, bool)
    order = np.lexsort((a, a - b, right, left))
    x, y = a[order], b[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1]) | (np.diff(x - y) != 0) | (np.diff(x) > length)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(x)) - 1
    good = np.ones(len(x), bool)
    raw = memoryview(buf.tobytes())
    for f, e in zip(first.tolist(), last.tolist(), strict=True):
        size = int(x[e] - x[f]) + length
        if raw[x[f] : x[f] + size] != raw[y[f] : y[f] + size]:
            for i in range(f, e + 1):
                good[i] = raw[x[i] : x[i] + length] == raw[y[i] : y[i] + length]
    out = np.zeros(len(x), bool)
    out[order] = good
    return out


_RECORDS = "hash long, t1 long, t2 long, pos long, first long, last long, covered binary"


def _cut(length: int):
    """(t1, t2, text, anchors) -> records; a row whose text isn't the one of that digest gives none.

    A record without `covered` stands for bytes that are known to be repeated.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[bytes, tuple | None] = {}
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            types = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=_fields(_RECORDS))

        for batch in slices(batches, 2, 1 << 20):
            for t1, t2, text, held in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = (text or "").encode()
                if _text_id(raw) != (t1, t2):
                    continue
                # a range may have been sent twice, as known and not
                for h, place in {(anchor["hash"] & ~_KNOWN, anchor["place"]) for anchor in held}:
                    pos, far = place >> 32, place >> 16 & 65535
                    first, last = pos - far, pos - far + (place & 65535)
                    covered = raw[first : last + length]
                    if h & _RANGE:
                        whole = h.to_bytes(8, "little", signed=True) + far.to_bytes(4, "little") + hashlib.blake2b(covered, digest_size=16).digest()
                        if whole in joined:
                            if (known := joined[whole]) is not None:
                                out.append(known)
                                joined[whole] = None
                            out.append((t1, t1, t2, 0, first, last, None))
                            continue
                        if len(joined) >= JOINED:
                            joined.clear()
                        joined[whole] = (t1, t1, t2, 0, first, last, None)
                    out.append((h, t1, t2, pos, first, last, covered))
                if len(out) > 4000:
                    yield rows()
                    out.clear()
        if out:
            yield rows()

    return run


_SPANS = "t1 long, t2 long, start long, stop long"


def _one_each(records: list[tuple], length: int) -> list[tuple]:
    """Records of one group, fewer of them, that still hold every distinct window and distance of all."""
    sizes = np.array([len(r[6]) for r in records], np.int64)
    base = np.concatenate(([0], sizes.cumsum()[:-1]))
    count = np.array([r[4] - r[3] + 1 for r in records], np.int64)
    owner = np.repeat(np.arange(len(records)), count)
    step = np.arange(int(count.sum())) - np.repeat(np.concatenate(([0], count.cumsum()[:-1])), count)
    whole = PrefixHashes(np.frombuffer(b"".join(r[6] for r in records), np.uint8)).of(base[owner] + step, length)
    distance = np.array([r[5] - r[3] for r in records], np.int64)[owner] - step
    first = np.unique(np.stack([whole.view(np.int64), distance]), axis=1, return_index=True)[1]
    return [records[i] for i in np.unique(owner[first]).tolist()]


def _sorted_groups(length: int, large: int):
    """Records sorted by (hash, text) -> repeated spans. Small groups are sorted together; one above `large` bytes in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=_fields(_SPANS))

        held: list[tuple] = []
        size, own, bound, known, group = 0, 0, large, [], None
        for batch in batches:
            for h, t1, t2, pos, first, last, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None:
                    known.append((t1, t2, first, last + length))
                    continue
                if h != group:
                    if size >= SORT_BYTES:
                        yield from emit(known + _repeats(held, length))
                        held, size, known = [], 0, []
                    group, own, bound = h, 0, large
                elif own > bound:
                    others = [r for r in held if r[0] != h]
                    yield from emit(known + _repeats(held, length))
                    held, known = _one_each(held[len(others) :], length), []
                    size = own = sum(len(r[6]) for r in held)
                    # what stays may not shrink: the next part is as large as it
                    bound = max(large, 2 * own)
                if held and held[-1][0] == h and held[-1][6] == text and held[-1][5] - held[-1][3] == pos - first:
                    # the same text around the same anchor: all windows of both repeat
                    p = held[-1]
                    known += [(t1, t2, first, last + length), (p[1], p[2], p[3], p[4] + length)] if held[-1][7:] == () else [(t1, t2, first, last + length)]
                    held[-1] = (*p[:7], True)
                    continue
                held.append((h, t1, t2, first, last, pos, text))
                size += len(text)
                own += len(text)
            if len(known) > 50_000:
                yield from emit(known)
                known = []
        yield from emit(known + (_repeats(held, length) if held else []))

    return run


def _key(docs: DataFrame) -> F.Column:
    """A number that finds a row again: of its id, or of its text where the id is null. Texts found by it are checked by digest."""
    return F.when(docs["doc_id"].isNotNull(), F.xxhash64(docs["doc_id"])).otherwise(F.xxhash64(docs["text"]))


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, hotter: int = HOTTER, large: int = LARGE) -> DataFrame:
    """`length` is at most 65535. (key, text, further columns) -> (key, t1, t2, copies, spans): repeated bytes of each text that has any, or has copies.

    `spans` are start and stop offsets, sorted, possibly overlapping; (t1, t2) is the text's digest. The further
    columns go with the texts to where they are cut, so that a join of `docs` by key reuses that shuffle.
    """
    spark = docs.sparkSession
    prepare(spark)
    gram = max(4, int(length * GRAM_SHARE))
    parts = shuffle_partitions(spark)
    sketch = materialize(docs.select("key", "text").mapInArrow(_sketch(length, gram), _SKETCH), "digests", "kind")
    levels = spark.sparkContext.broadcast(_heat_levels(sketch, hot, hotter))
    members = sketch.where(f"kind = 0 AND n >= {length}").select("key", "t1", "t2")
    classes = members.groupBy("t1", "t2").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))

    # what is known to repeat need not meet: it is dealt by its texts
    found = docs.select("text").mapInArrow(_scan(length, gram, levels), _ANCHORS)
    dealt = found.repartition(parts, "hash", F.when(F.col("hash").bitwiseAND(_KNOWN) > 0, F.col("t1")).otherwise(0))
    common = dealt.sortWithinPartitions("hash", "t1", "t2", "place").mapInArrow(_repeated_anchors, _ANCHORS)
    held = common.groupBy("t1", "t2").agg(F.collect_list(F.struct("hash", "place")).alias("anchors"))
    sources = held.join(classes, ["t1", "t2"]).select("rep", "t1", "t2", "anchors")
    # all columns are used, or the optimizer drops some and the two shuffles of the texts differ
    further = [c for c, kind in docs.dtypes if c not in ("key", "text") and not any(x in kind for x in ("map<", "variant"))]
    cut = sources.hint("merge").join(docs, F.col("rep") == F.col("key")).select("t1", "t2", "text", "anchors", F.xxhash64("key", *further)).mapInArrow(_cut(length), _RECORDS)
    spans = cut.repartition(parts, "hash").sortWithinPartitions("hash", "covered", "t1", "t2", "first").mapInArrow(_sorted_groups(length, large), _SPANS)
    merged = spans.groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    # of a text with copies every byte goes: its spans are not needed
    whole = classes.join(merged, ["t1", "t2"], "left").select("t1", "t2", "copies", F.when(F.col("copies") == 1, F.col("spans")).alias("spans")).where("copies > 1 OR spans IS NOT NULL")
    total = sketch.where("kind = 0").count()
    return join_classes(members, whole, ["t1", "t2"], classes, total).where("copies IS NOT NULL")


def _cut_spans(raw: bytes, copies: int, spans: list[dict] | None) -> tuple[list[bytes], int, int]:
    """(kept pieces, removed bytes, maximal removed runs)."""
    if copies > 1:
        return [], len(raw), 1
    kept, at, runs, removed = [], 0, 0, 0
    stop = -1
    for s in spans if spans is not None else ():
        a, b = s["start"], s["stop"]
        if a > stop:
            runs += 1
            kept.append(raw[at:a])
            removed += b - a
        elif b > stop:
            removed += b - stop
        stop = max(stop, b)
        at = stop
    kept.append(raw[at:])
    return kept, removed, runs


_RESULT = "kept binary, kept_text string, n_bytes long, n_removed long, n_spans long"


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, hotter: int = HOTTER, large: int = LARGE) -> DataFrame:
    """Appends `kept` (binary), `kept_text`, `n_bytes`, `n_removed` and `n_spans` to documents; other columns pass unchanged.

    Every byte covered by a `length`-byte string that also starts elsewhere, in the same or another row,
    is removed; strings are judged on the input. `kept_text` is `kept` without what is left of characters
    that were cut. Null text counts as empty; its kept_text is empty too. Rows with equal text count as
    copies of each other, whatever their ids, null ids included. Input columns with a result's name are replaced.
    """
    names = {c: "text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns) if c not in _fields(_RESULT)}
    docs = docs.select(_key(docs).alias("key"), "text", *[F.col(c).alias(n) for c, n in names.items() if c != "text"])
    spans = repeated_spans(docs, length, hot, hotter, large)
    grouped = spans.groupBy("key").agg(F.collect_set(F.struct("t1", "t2", "copies", "spans")).alias("found"))
    joined = docs.join(grouped.hint("merge"), "key", "left")

    @F.pandas_udf(_RESULT)
    def apply(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for text, options in zip(texts, found, strict=True):
            raw = (text or "").encode()
            own = None
            if options is not None and len(options):
                tid = _text_id(raw)
                own = next((o for o in options if (o["t1"], o["t2"]) == tid), None)
            kept, removed, runs = _cut_spans(raw, own["copies"], own["spans"]) if own else ([raw], 0, 0)
            rows.append((b"".join(kept), "".join([k.decode(errors="ignore") for k in kept]), len(raw), removed, runs))
        return pd.DataFrame(rows, columns=_fields(_RESULT))

    return joined.withColumn("cut", apply("text", "found")).select(*[F.col(n).alias(c) for c, n in names.items()], "cut.*")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 400-byte strings, as digests and as text."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("kept_text").alias("text"))
