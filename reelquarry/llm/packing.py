"""Packing of token sequences: best-fit decreasing.

Documents longer than a window are first cut into full windows. The rest are placed in decreasing
length, each into the tightest open window that holds it, which a segment tree indexed by remaining
capacity finds in logarithmic time. Every task packs the documents of its own input partition, so
nothing is shuffled and no task holds more than its partition's lengths; window ids carry the
partition's number in their upper bits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from reelquarry.llm.common import documents, prepare, slices

WINDOW = 4096
END_ID = 2
MEMO = 400_000
#: New words that the library encodes as one text.
TOGETHER = 4096
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Multiset of open windows by remaining capacity; finds the smallest capacity of at least a length."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, bin_id: int) -> None:
        self.open[capacity].append(bin_id)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) of the tightest open window, or None."""
        count, i = self.count, length + self.size
        if not count[i]:
            # up to the first node whose right sibling holds a window, then down to its leftmost leaf
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        bin_id = self.open[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, bin_id


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """(window, offset) of each length, in the given order; lengths are 1 to `window`."""
    where, offset = [0] * len(lengths), [0] * len(lengths)
    tree, used = CapacityTree(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found:
            capacity, bin_id = found
        else:
            capacity, bin_id, used = window, used, used + 1
        where[i], offset[i] = bin_id, window - capacity
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], bin_id)
    return where, offset


#: Code points of the texts that the memo serves; case and class of their letters don't depend on context or the Unicode version.
PLAIN = (0x0, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)


def splitter(pattern: str):
    """The splitter for texts of PLAIN letters in lower case: the standard engine, whose classes list those letters, is twice as fast."""
    outside = re.sub(r"\[[^\]]*\]", "", pattern)
    if "\\" in outside or set(re.findall(r"\\.\{?\w?\}?", pattern)) - {r"\p{L}", r"\p{N}", r"\s"}:
        return regex.compile(pattern)
    letters = sorted({x for a, b in PLAIN for c in range(a, b + 1) for x in chr(c) + chr(c).lower()})
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        known = regex.compile(kind)
        pattern = pattern.replace(kind, "".join(re.escape(c) for c in letters if known.fullmatch(c)))
    return re.compile(pattern)


class WordTokenizer:
    """The ids of a `tokenizers` file without special tokens, by a memo over the words of its own splitter.

    The memo serves files whose normaliser is NFC, white space and lower case and whose words are
    encoded independently; others go to the library whole.
    """

    def __init__(self, path: str):
        import json
        import os

        # a task has one core
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        # words are encoded without regard to added tokens; a text that holds one goes to the library as it is
        self.library, self.whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"].lower() for t in spec.get("added_tokens") or []]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and len(split) == 1 and split[0]["behavior"] == "Removed" and split[0]["invert"]
        self.words = splitter(split[0]["pattern"]["Regex"]) if self.by_word else None
        # three of the plain letters have a lower case or composition of several letters
        self.rare = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in PLAIN) + "]|[İŉǰ]")
        #: Separators that Python takes for white space.
        self.odd = regex.compile("[\x1c-\x1f]")
        self.memo: dict[str, bytes] = {}
        vocabulary, suffix = self.library.get_vocab(), spec["model"].get("end_of_word_suffix") or ""
        self.by_word = self.by_word and bool(suffix)
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; words that are new go to the library in one batch."""
        memo, found = self.memo, []
        for text in texts:
            low = text.lower()
            if not self.by_word or any(t in low for t in self.added) or self.odd.search(text) or (not text.isascii() and self.rare.search(text)):
                found.append(None)
            else:
                # the letters that remain are composed already, so NFC changes nothing
                found.append(self.words.findall(low))
        if len(memo) > MEMO:
            memo.clear()
        new = list({w for words in found if words for w in words}.difference(memo))
        for at in range(0, len(new), TOGETHER):
            self._learn(new[at : at + TOGETHER])
        whole = (np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if f is None else b"".join([memo[w] for w in f]) for t, f in zip(texts, found, strict=True))
        return list(whole)

    def _learn(self, words: list[str]) -> None:
        """Encodes words as one text; a space between two splits them, and a word's last id alone has the end-of-word suffix."""
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        stops = np.flatnonzero(self.closes[ids]) + 1
        if len(stops) == len(words) and stops[-1] == len(ids):
            raw, a = ids.tobytes(), 0
            for w, b in zip(words, (4 * stops).tolist(), strict=True):
                self.memo[w] = raw[a:b]
                a = b
        else:
            for w in words:
                self.memo[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_bytes(self, text: str) -> bytes:
        return self.encode_many([text])[0]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> one row per piece: where it lies in its document and in which window.

    Null text counts as empty and gives the end id alone. Repeated rows are packed each; pieces of equal
    length are placed in the order of the input partition. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_many
        rows: list[tuple] = []
        for batch in slices(batches, 1, 2 << 20):
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                raw += tail
                n = len(raw) // 4
                for at in range(0, n, window):
                    piece = raw[4 * at : 4 * (at + window)]
                    rows.append((doc_id, at, len(piece) // 4, zlib.crc32(piece), n))
        if not rows:
            return
        where, offset = best_fit_decreasing([r[2] for r in rows], window)
        base = TaskContext.get().partitionId() << 32
        table = [np.array(c, dtype=object) if i == 0 else np.array(c, np.int64) for i, c in enumerate(zip(*rows, strict=True))]
        table += [np.array(where, np.int64) + base, np.array(offset, np.int64)]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000], pa.int64()) for c in table], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents packed into windows of 4096 tokens; one row per piece."""
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), path or public_tokenizers.path("word_bpe_49k.json"))
