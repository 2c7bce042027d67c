"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap; each chunk is pre-tokenised whole and independently, in
parallel within a task (the pattern library frees the interpreter lock while it matches), and its
pre-tokens are kept. A chunk other than the first may begin inside a pre-token, so its first
boundaries can be wrong; from the first boundary that it has in common with the chunk before, both
agree, because the pattern's next match depends only on the text from there on. There the lists of
pre-tokens are stitched: what the later chunk has before that point is dropped. Where an overlap holds
no common boundary, as in a very long run of letters, the earlier chunk is read on until there is one.
The stitched pre-tokens are then encoded by rank merges, each separately, and decoding concatenates
the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from reelquarry.llm.common import documents, prepare, slices

CHUNK = 1 << 13
OVERLAP = 1 << 9
#: Characters by which a chunk's own last matches may lack right context.
MARGIN = 64
#: Entries of the memo of encoded pre-tokens; at that size a new one begins, and the full one is kept for another turn.
MEMO = 200_000
NO_RANK = 1 << 62


class ByteBPE:
    """Encoder over a rank file (base64 token, rank); `pattern` splits text into pre-tokens."""

    def __init__(self, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.chunk, self.overlap = chunk, overlap
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _merge(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) > 256:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        # the rank of each part joined with the next; a merge changes two of them
        joined = [get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
        while joined and (best := min(joined)) < NO_RANK:
            i = joined.index(best)
            parts[i] += parts.pop(i + 1)
            del joined[i]
            if i < len(joined):
                joined[i] = get(parts[i] + parts[i + 1], NO_RANK)
            if i:
                joined[i - 1] = get(parts[i - 1] + parts[i], NO_RANK)
        ranks = self.ranks
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges with a heap and a linked list: no quadratic time for long runs."""
        import heapq

        n, ranks = len(piece), self.ranks
        part = [piece[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or part[i] is not a or part[j] is not b:
                continue
            part[i], part[j] = a + b, b""
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for p in (left[i], i):
                if p >= 0 and right[p] >= 0 and (r := ranks.get(part[p] + part[right[p]])) is not None:
                    heapq.heappush(heap, (r, p, part[p], part[right[p]]))
        out, i = [], 0
        while i >= 0:
            out.append(ranks[part[i]])
            i = right[i]
        return out

    def _read(self, text: str, start: int, end: int) -> tuple[list[str], list[int]]:
        """Pre-tokens from `start` that can't change with what follows `end`, and where each of them ends.

        The last ones are left out if they reach into the margin or end behind white space: the pattern
        looks ahead there, so a piece that ended at one would be split otherwise without the text that follows.
        """
        stop = min(len(text), end + MARGIN)
        found = self.pattern.findall(text, start, stop, concurrent=True)
        ends = list(accumulate(map(len, found), initial=start))[1:]
        if (ends[-1] if ends else start) != stop:
            raise ValueError("the pattern leaves characters out")
        if stop < len(text):
            keep = len(ends)
            while keep and (ends[keep - 1] > end or text[ends[keep - 1] - 1].isspace()):
                keep -= 1
            del found[keep:], ends[keep:]
        return found, ends

    def pretokens(self, text: str, pool: ThreadPoolExecutor | None = None) -> list[str]:
        """The pattern's matches over the whole text, from chunks that were read on their own."""
        if len(text) <= self.chunk + self.overlap:
            return self.pattern.findall(text)
        starts = list(range(0, len(text), self.chunk))
        if len(text) - starts[-1] <= self.overlap + MARGIN:
            starts.pop()

        def chunk(at: int) -> tuple[list[str], list[int]]:
            last = at == starts[-1]
            return self._read(text, at, len(text) if last else at + self.chunk + self.overlap)

        chunks = pool.map(chunk, starts) if pool else map(chunk, starts)
        pieces: list[list[str]] = []
        tokens, ends = next(chunks)
        origin = 0
        for at, (later, their) in zip(starts[1:], chunks, strict=True):
            common, reach = self._common(text, ends, their, at), self.overlap
            while common is None and their and (ends[-1] if ends else origin) < their[-1]:
                # no boundary in common yet: the true reading goes on
                reach *= 2
                more, further = self._read(text, ends[-1] if ends else origin, min(len(text), at + reach))
                tokens, ends = tokens + more, ends + further
                common = self._common(text, ends, their, at)
            if common is None:
                # the true reading has gone past this chunk
                continue
            own, other = common
            pieces.append(tokens[: own + 1])
            tokens, ends, origin = later[other + 1 :], their[other + 1 :], their[other]
        last = ends[-1] if ends else origin
        if last < len(text):
            tokens = tokens + self._read(text, last, len(text))[0]
        pieces.append(tokens)
        return list(chain.from_iterable(pieces))

    @staticmethod
    def _common(text: str, ends: list[int], their: list[int], at: int) -> tuple[int, int] | None:
        """Where two readings have their first boundary behind `at` in common that does not end in white space."""
        first = bisect_left(ends, at)
        own = {e: i for i, e in enumerate(ends[first:], first)}
        for j, e in enumerate(their):
            if e in own and not text[e - 1].isspace():
                return own[e], j
        return None

    def encode_bytes(self, text: str, pool: ThreadPoolExecutor | None = None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers (the order of bytes that workers have)."""
        found = self.pretokens(text, pool)
        try:
            return b"".join([self.memo[t] for t in found])
        except KeyError:
            if len(self.memo) > MEMO:
                self.before, self.memo = self.memo, {}
            memo, before = self.memo, self.before
            for t in found:
                if t not in memo:
                    memo[t] = before.get(t) or array("I", self._merge(t.encode())).tobytes()
            return b"".join([memo[t] for t in found])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder per worker process."""
    return ByteBPE(path, pattern)


_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> token count and digests, with the ids as an array if `keep_ids`.

    Null text counts as empty; repeated rows are encoded each; a row is handled on its own, so no shuffle.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        with ThreadPoolExecutor(2) as pool:
            for batch in slices(batches, 1, 2 << 20):
                counts, sums, backs, ids = [], [], [], []
                for text in batch.column(1).to_pylist():
                    raw = bpe.encode_bytes(text or "", pool)
                    found = np.frombuffer(raw, "<u4")
                    counts.append(len(found))
                    sums.append(hashlib.sha256(raw).hexdigest())
                    backs.append(hashlib.sha256(bpe.decode(found.tolist())).hexdigest())
                    if keep_ids:
                        ids.append(found.astype(np.int64))
                columns = [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA + (", ids array<long>" if keep_ids else ""))


def op5_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token counts and digests of every whole document's ids and of the bytes decoded from them."""
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
