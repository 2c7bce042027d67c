"""N-gram Jaccard join: all documents whose shingle sets are alike, as exact components.

1. One pass gives each document's set size and 128-bit set digest; documents with equal sets form a
   class, and only classes go on.
2. Sets of a size group are cut into parts by the hashes of their tokens, into more parts than two alike
   sets of the group can differ in tokens: some parts of theirs are equal. Classes meet by the digest of a
   part of two tokens or more, and the shared parts of each pair are counted; a part of many classes counts
   as proof enough. A set with too few such parts is cut in other ways also, and at last meets others of
   its kind by a prefix of its tokens. A part holds several tokens whatever the size of the corpus, so chance meetings stay rare.
   Classes that meet often enough, with compatible sizes, are clustered.
3. The sets of a cluster are sent to one task, where a signature tree's dual traversal finds the exact
   components. Clusters above a fixed number of tokens are cut by size class and salt into parts, with
   some sets of each class in all of its parts. That joins most of a family of copies into one component;
   then every part of what lies outside it meets the parts that can hold its links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquarry.llm.common import documents, join_classes, materialize, prepare, shuffle_partitions, slices, split_by_ids
from reelquarry.llm.graph import connected_components
from reelquarry.llm.signature_tree import SignatureTree

#: A size group reaches so far above the one before it.
GROUP = 1.3
#: Shares of the parts that may differ, of which one is added to them: the least that leaves parts of two tokens to share.
SPARE = np.arange(0, 1.05, 0.05)
#: Ways of cutting; a set that one leaves with too few parts of two tokens is cut the next way also.
WAYS = 4
#: Classes of a part up to which its pairs are counted.
FEW = 8
MANY = 1 << 20
#: Tokens of a cluster that one task takes whole.
CLUSTER_TOKENS = 4_000_000
#: Sets of each size class of a larger cluster to which all its sets are compared first.
PIVOTS = 8
#: Bytes up to which a word is told by a polynomial modulo 2**64; in longer ones such hashes can be made to collide.
SHORT_WORD = 64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, 0x9E3779B97F4A7C15 | 1, np.uint64))
    return _POWERS


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of `width` words, ASCII letters in lower case, for each text.

    A text with fewer words gives the hash of its whole sequence; one without words gives no hash.
    """
    buf = np.frombuffer(b"".join(t.lower() + b" " for t in texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    solid = ~_SPACE[buf]
    edge = np.diff(solid.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    empty = np.zeros(0, np.uint64)
    if not len(starts):
        return [empty] * len(texts)
    lens = stops - starts
    first = np.concatenate(([0], lens.cumsum()[:-1]))
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    letters = (buf[solid].astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()))[place]
    words = _mix(np.add.reduceat(letters, first) + lens.astype(np.uint64))
    for i in np.flatnonzero(lens > SHORT_WORD).tolist():
        words[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : stops[i]].tobytes(), digest_size=8).digest(), "little")
    bounds = np.searchsorted(starts, ends).tolist()
    odd = _powers(64)[1 : width + 1]
    rolled = words[: max(len(words) - width + 1, 0)] * odd[0]
    for k in range(1, width):
        rolled = rolled + words[k : k + len(rolled)] * odd[k]
    rolled = _mix(rolled + np.uint64(width))
    out, a = [], 0
    for b in bounds:
        m = b - a
        if m >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif m:
            out.append(_mix((words[a:b] * odd[:m]).sum(keepdims=True) + np.uint64(m)))
        else:
            out.append(empty)
        a = b
    return out


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_SKETCH = "doc_id long, n long, s1 long, s2 long"


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            sets = shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()], width)
            sums = [_digest(s) for s in sets]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in ([len(s) for s in sets], [d[0] for d in sums], [d[1] for d in sums]))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SKETCH.split(", ")])

    return run


def _groups(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(greatest size, most tokens in which two alike sets differ, parts) of each size group."""
    top, tops = max(1, -(-num // (den - num))), []
    while top < 1 << 40:
        top = max(top + 1, int(top * GROUP))
        tops.append(top)
    tops = np.array(tops, np.int64)
    differ = 2 * tops * (den - num) // (den + num)
    counts = differ + 1 + (differ * SPARE[:, None]).astype(np.int64)
    mean = tops / counts
    small = counts * (1 + mean) * np.exp(-mean)
    room = counts - small - differ - 2 * np.sqrt(small)
    enough = room >= 1
    which = np.where(enough.any(0), enough.argmax(0), room.argmax(0))
    return tops, differ, counts[which, np.arange(len(tops))]


def parts_of(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, index of the set, least) of the parts by which alike sets of different content meet.

    If two sets are alike, they share `least` of their digests, the greater one of both, or more. A set meets
    those of its size group, and those of the groups above that can hold a greater partner.
    """
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    sizes = np.array([len(s) for s in sets], np.int64)
    # the most tokens in which a partner differs; without any, only equal sets are alike
    own = sizes * (den - num) // num
    chosen = np.flatnonzero(own > 0)
    if den == num or not len(chosen):
        return none
    tops, differ, counts = _groups(num, den)
    low, high = np.searchsorted(tops, sizes), np.searchsorted(tops, sizes * den // num)
    out = []

    for way in range(WAYS):
        n = sizes[chosen]
        tokens, owner = np.concatenate([sets[i] for i in chosen.tolist()]), np.repeat(np.arange(len(chosen)), n)
        mixed = _mix(tokens)
        if way:
            tokens = _mix(tokens + np.uint64(way))
            order = np.lexsort((tokens, owner))
            tokens, mixed = tokens[order], mixed[order]
        scarce = np.zeros(len(chosen), bool)
        for step in range(int((high - low)[chosen].max()) + 1):
            group, here = low[chosen] + step, (low + step <= high)[chosen]
            # hashes are sorted: a part is a run of them
            part = ((tokens >> np.uint64(32)) * counts[group][owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            fresh = np.ones(len(tokens), bool)
            fresh[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
            start = np.flatnonzero(fresh)
            big = (np.diff(np.append(start, len(tokens))) > 1) & here[owner[start]]
            sums, start = np.add.reduceat(mixed, start)[big], start[big]
            least = np.bincount(owner[start], minlength=len(chosen)) - np.minimum(own[chosen], differ[group])
            scarce |= here & (least < 1)
            place = np.uint64(way << 60) + (group[owner[start]].astype(np.uint64) << np.uint64(40)) + part[start].astype(np.uint64)
            out.append((_mix(sums + _mix(place)), chosen[owner[start]], np.maximum(least, 1)[owner[start]]))
        # two such sets may have no other equal part
        chosen = chosen[scarce]
        if not len(chosen):
            break
    for i in chosen.tolist():
        # no way serves: alike sets share a token of their prefixes
        tokens = sets[i][: sizes[i] - -(-num * int(sizes[i]) // den) + 1]
        out.append((_mix(tokens + np.uint64(0xA5A5A5A5)), np.full(len(tokens), i), np.ones(len(tokens), np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


#: `size` packs the set's size and the least number of shared parts, so that it sorts by size.
_LEAST_BITS = 24


def _keys(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches, 0, 1 << 20):
            fresh, ids = [], []
            for tokens in shingle_sets([(t or "").encode() for t in batch.column(0).to_pylist()], width):
                if len(tokens) and (d := _digest(tokens)) not in seen:
                    seen.add(d)
                    fresh.append(tokens)
                    ids.append(d[0])
            digests, index, least = parts_of(fresh, num, den)
            if len(digests):
                sizes = np.array([len(s) for s in fresh], np.int64)[index]
                packed = sizes << _LEAST_BITS | np.minimum(least, (1 << _LEAST_BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64)), pa.array(np.array(ids, np.int64)[index]), pa.array(packed)], names=["token", "sid", "size"])

    return run


def _meetings(num: int, den: int):
    """Sorted (token, size, sid) records -> (a, b, shared, least): pairs of classes, the tokens they share here and the number they need.

    A token is the digest of a part. The pairs of one of more than FEW classes are not listed: neighbours in size order stand for
    them, joined up to a forest, with a count that no need exceeds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def rows(a: np.ndarray, b: np.ndarray, shared: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, shared, least)], names=["a", "b", "shared", "least"])

        def chain(n: np.ndarray, sid: np.ndarray, fit: np.ndarray) -> None:
            at = np.flatnonzero(fit)
            for a, b in set(zip(sid[at].tolist(), sid[at + 1].tolist(), strict=True)):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)

        def blocks(token: np.ndarray, size: np.ndarray, sid: np.ndarray, crowded: int | None) -> Iterator[pa.RecordBatch]:
            n, need = size >> _LEAST_BITS, size & (1 << _LEAST_BITS) - 1
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            block = np.diff(np.append(start, len(token)))
            many = np.repeat(block > FEW, block)
            if crowded is not None:
                many |= token == crowded
            fits = den * n[:-1] >= num * n[1:]
            # neighbours in size order: if they don't fit, nothing across them does
            chain(n, sid, (token[1:] == token[:-1]) & many[1:] & fits)
            for d in range(1, FEW):
                if d >= len(token):
                    break
                at = np.flatnonzero((token[d:] == token[:-d]) & ~many[d:] & (den * n[:-d] >= num * n[d:]))
                if len(at):
                    x, y = np.minimum(sid[at], sid[at + d]), np.maximum(sid[at], sid[at + d])
                    pair, where, count = np.unique(np.stack([x, y], 1), axis=0, return_index=True, return_counts=True)
                    yield rows(pair[:, 0], pair[:, 1], count, np.maximum(need[at], need[at + d])[where])

        held, crowded = [np.zeros(0, np.int64)] * 3, None
        for batch in batches:
            new = [batch.column(i).to_numpy().astype(np.int64) for i in range(3)]
            token, size, sid = (np.concatenate(c) for c in zip(held, new, strict=True))
            fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (sid[1:] != sid[:-1]) | (size[1:] != size[:-1])))
            token, size, sid = token[fresh], size[fresh], sid[fresh]
            last = int(np.searchsorted(token, token[-1])) if len(token) else 0
            if len(token) - last > FEW or (len(token) and token[-1] == crowded):
                # the last block may go on; its last row stands for it
                yield from blocks(token, size, sid, crowded)
                crowded, last = int(token[-1]), len(token) - 1
            elif last:
                yield from blocks(token[:last], size[:last], sid[:last], crowded)
            held = [token[last:], size[last:], sid[last:]]
        if len(held[0]):
            yield from blocks(*held, crowded)
        pairs = np.array([(x, find(x)) for x in list(parent) if find(x) != x], np.int64).reshape(-1, 2)
        yield rows(pairs.min(1), pairs.max(1), np.full(len(pairs), MANY), np.ones(len(pairs)))

    return run


_CELL = "cell string, side int, doc_id long, s1 long, s2 long, tokens binary"


def _sets(width: int):
    """(cells, doc_id, s1, s2, text) -> the set in each of its cells; other rows of the id are left out by the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4, 1 << 20):
            sets = shingle_sets([(t or "").encode() for t in batch.column(4).to_pylist()], width)
            rows = []
            for cells, doc_id, s1, s2, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), sets, strict=True):
                if _digest(tokens) == (s1, s2):
                    raw = tokens.tobytes()
                    rows += [(c["cell"], c["side"], doc_id, s1, s2, raw) for c in cells]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["cell", "side", "doc_id", "s1", "s2", "tokens"])

    return run


def _cells(num: int, den: int):
    """Rows sorted by cell, side and class -> (s1 of a linked class, least s1 and least doc_id of its group within the cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, keys, sides, sets = None, [], [], [], []
        out: list[tuple[int, int, int]] = []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["a", "b", "least"])

        def close() -> None:
            if len(set(keys)) < 2:
                return
            tag = sides if len(set(sides)) > 1 else None
            for group in SignatureTree(sets, num, den, tag).join():
                if len(group) > 1:
                    node, least = min(keys[i][0] for i in group), min(ids[i] for i in group)
                    out.extend((keys[i][0], node, least) for i in group)

        for batch in batches:
            for c, side, doc_id, s1, s2, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != cell:
                    close()
                    cell, ids, keys, sides, sets = c, [], [], [], []
                if (s1, s2) in keys[-1:] and side == sides[-1]:
                    continue
                ids.append(doc_id)
                keys.append((s1, s2))
                sides.append(side)
                sets.append(np.frombuffer(raw, np.uint64))
            if len(out) > 50_000:
                yield rows()
                out.clear()
        close()
        yield rows()

    return run


def _up_to(k):
    return F.sequence(F.lit(0), k - 1)


def _each(k, of, *args):
    """of(0, *args), ..., of(k - 1, *args) as an array; none for a null k."""
    return F.when(k.isNotNull(), F.transform(_up_to(F.coalesce(k, F.lit(1))), lambda j: of(j, *args))).otherwise(F.array())


def _cell(side, *names):
    return F.struct(F.concat_ws(":", *[n.cast("string") for n in names]).alias("cell"), side.cast("int").alias("side"))


def _assign_cells(members: DataFrame, num: int, den: int, limit: int) -> DataFrame:
    """members (cluster, doc_id, n, s1, s2) -> the same with band, large and `cells`: array of (cell, side).

    A cluster of at most `limit` tokens is one cell. A larger one is cut into size classes (bands) whose
    neighbours hold all partners, and a band into salted parts of about `limit`. A document goes to its
    part; PIVOTS documents of each band go to all parts of theirs and the neighbouring bands, so that what
    is alike through them is known for one component, whatever its size, without comparing part with part.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num)))).cast("int")
    members = members.withColumn("band", band)
    # a digest is as good as a draw
    drawn = members.groupBy("cluster", "band", F.pmod(F.xxhash64("s1"), F.lit(PIVOTS)).alias("slot")).agg(F.sum("n").alias("w"), F.min("s1").alias("pivot"))
    weight = drawn.groupBy("cluster", "band").agg(F.sum("w").alias("w"), F.collect_list("pivot").alias("pivots"))
    entry = F.struct("band", F.struct(F.ceil(F.col("w") / limit).cast("int").alias("k"), "pivots"))
    total = weight.groupBy("cluster").agg(F.sum("w").alias("total"), F.map_from_entries(F.collect_list(entry)).alias("parts"))
    placed = members.join(total, "cluster")
    c, b = F.col("cluster"), F.col("band")
    own = F.col("parts")[b]
    salt = F.pmod(F.xxhash64("doc_id"), own["k"]).cast("int")
    everywhere = F.concat(*[_each(F.try_element_at("parts", b + step)["k"], lambda j, to: _cell(F.lit(0), c, to, j), b + step) for step in (-1, 0, 1)])
    whole = F.array(_cell(F.lit(0), c))
    cut = F.when(F.array_contains(own["pivots"], F.col("s1")), everywhere).otherwise(F.array(_cell(F.lit(0), c, b, salt)))
    return placed.withColumn("cells", F.when(F.col("total") <= limit, whole).otherwise(cut)).withColumn("large", F.col("total") > limit).drop("parts", "total")


def _remaining_cells(members: DataFrame, groups: DataFrame, limit: int, total: int) -> DataFrame:
    """members of large clusters with `band`, groups (node, component) of their s1 so far -> `cells` for the pairs that are left.

    The heaviest component of a cluster needs no comparison within itself: its parts meet only the parts
    of the rest, and these each other. The data grow with the tokens of a cluster times the parts of its
    rest: a family of copies, however large, is not squared; a cluster without a main component is.
    """
    named = members.join(groups.hint("merge"), F.col("s1") == F.col("node"), "left").withColumn("label", F.coalesce("component", "s1")).drop("node", "component")
    named = materialize(named, "labels")
    sums = named.groupBy("cluster", "label").agg(F.sum("n").alias("w"))
    main = sums.groupBy("cluster").agg(F.max_by("label", F.struct("w", "label")).alias("main"))
    sizes = named.groupBy("cluster").agg(F.count("*").alias("copies"))
    marked = materialize(join_classes(named, main, ["cluster"], sizes, total).withColumn("rest", F.col("label") != F.col("main")).drop("label", "main"), "marked")
    weight = marked.groupBy("cluster", "band", "rest").agg(F.ceil(F.sum("n") / limit).cast("int").alias("k"))
    entries = F.struct("band", "k")
    parts = weight.groupBy("cluster").agg(*[F.map_from_entries(F.collect_list(F.when(keep, entries))).alias(name) for name, keep in (("rests", F.col("rest")), ("mains", ~F.col("rest")))])
    placed = join_classes(marked, parts, ["cluster"], sizes, total)
    c, b = F.col("cluster"), F.col("band")
    own = F.when(F.col("rest"), F.col("rests")[b]).otherwise(F.col("mains")[b])
    salt = F.pmod(F.xxhash64("doc_id"), own).cast("int")
    rests, mains = ({step: F.try_element_at(name, b + step) for step in (-1, 0, 1)} for name in ("rests", "mains"))
    # within one part every pair counts; of two parts, pairs across only
    same = F.transform(_up_to(own), lambda j: _cell(F.when(j == salt, 0).otherwise((salt > j).cast("int")), c, b, F.least(salt, j), b, F.greatest(salt, j)))
    upper = _each(rests[1], lambda j: _cell(F.lit(0), c, b, salt, b + 1, j))
    lower = _each(rests[-1], lambda j: _cell(F.lit(1), c, b - 1, j, b, salt))
    to_main = [_each(mains[step], lambda j, to: _cell(F.lit(0), c, F.lit("main"), b, salt, to, j), b + step) for step in (-1, 0, 1)]
    to_rest = [_each(rests[step], lambda j, of: _cell(F.lit(1), c, F.lit("main"), of, j, b, salt), b + step) for step in (-1, 0, 1)]
    cells = F.when(F.col("rest"), F.concat(same, upper, lower, *to_main)).otherwise(F.concat(*to_rest))
    return placed.withColumn("cells", cells).where(F.size("cells") > 0).drop("rests", "mains", "rest")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, limit: int = CLUSTER_TOKENS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id: components under links with den * |A & B| >= num * |A | B|.

    Null or wordless texts have empty sets and link with nothing. Rows without an id link with nothing
    and have no component. Repeated rows give repeated rows; rows of one id with different texts are
    separate members under that id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = shuffle_partitions(spark)
    rows = materialize(docs.mapInArrow(_sketch(width), _SKETCH), "sketch")
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies")).where("rep IS NOT NULL")

    records = docs.select("text").mapInArrow(_keys(width, num, den), "token long, sid long, size long")
    meetings = records.repartition(parts, "token").sortWithinPartitions("token", "size", "sid").select("token", "size", "sid").mapInArrow(_meetings(num, den), "a long, b long, shared long, least long")
    edges = meetings.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least")).where("shared >= least").select("a", "b")
    clusters = connected_components(edges)

    members = classes.join(clusters, classes.s1 == clusters.node).select(F.col("component").alias("cluster"), F.col("rep").alias("doc_id"), "n", "s1", "s2")
    placed = materialize(_assign_cells(members, num, den, limit), "cells")

    def compared(cells: DataFrame) -> DataFrame:
        # the join is hinted so that it has one shape at every size
        sets = cells.select("cells", "doc_id", "s1", "s2").hint("merge").join(split_by_ids(docs, cells)[0], "doc_id").select("cells", "doc_id", "s1", "s2", "text").mapInArrow(_sets(width), _CELL)
        linked = sets.repartition(parts, "cell").sortWithinPartitions("cell", "side", "s1", "s2").mapInArrow(_cells(num, den), "a long, b long, least long")
        return materialize(linked, "links")

    links, count = compared(placed), rows.count()
    if placed.where("large").limit(1).count():
        large = placed.where("large").drop("cells", "large")
        links = links.union(compared(materialize(_remaining_cells(large, connected_components(links.select("a", "b")), limit, count), "cells")))
        groups = connected_components(links.select("a", "b"))
        least = groups.join(links.groupBy("a").agg(F.min("least").alias("least")), F.col("node") == F.col("a")).groupBy("component").agg(F.min("least").alias("least"))
        found = groups.join(least, "component").select(F.col("node").alias("s1"), F.col("least").alias("component"))
    else:
        # every document lies in one cell, so its group there is its component
        found = links.groupBy(F.col("a").alias("s1")).agg(F.min("least").alias("component"))
    resolved = classes.join(found, "s1", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    return (
        join_classes(rows, resolved, ["s1", "s2"], classes, count)
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard similarity of at least 0.85 of their 4-word shingles."""
    return near_duplicates(documents(spark, sf_dir), 4, 85, 100)
