"""Signature trees over token sets, and the exact similarity components found by dual traversal.

A node holds the OR of its members' token bitmaps, the range of their set sizes, and the most tokens
that one of its members hides behind another's bit. Two sets under nodes X and Y share at most
popcount(X & Y) + hidden tokens, and no more than either's size; a node pair whose bound is too small
for the least overlap that any of its pairs needs is pruned with all that is below it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 8
FANOUT = 8


def needed(a: int, b: int, num: int, den: int) -> int:
    """Least intersection with den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (den + num))


@dataclass
class _Level:
    start: np.ndarray
    end: np.ndarray
    bits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    hidden: np.ndarray


class SignatureTree:
    """`sets` are sorted arrays of distinct uint64 tokens; `tag` tells the two sides of a join apart, if given."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int, tag: list[int] | None = None):
        self.num, self.den, self.tag = num, den, tag
        sizes = np.array([len(s) for s in sets], np.int64)
        # neighbours in the order: alike in size, then by least token
        band = np.floor(np.log(np.maximum(sizes, 1)) / np.log(den / num) / 2).astype(np.int64)
        self.order = np.lexsort((np.array([s[0] if len(s) else 0 for s in sets], np.uint64), band))
        self.sets, self.sizes = [sets[i] for i in self.order], sizes[self.order]
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []
        self.levels = [self._documents()]
        while len(self.levels[-1].start) > 1:
            self.levels.append(self._above(self.levels[-1], LEAF if len(self.levels) == 1 else FANOUT))

    def _documents(self) -> _Level:
        n = len(self.sets)
        width = 1 << max(6, int(2 * max(int(self.sizes.max()), 1) - 1).bit_length())
        bits = np.zeros((n, width // 64), np.uint64)
        row = np.repeat(np.arange(n), self.sizes)
        at = (np.concatenate(self.sets) if n else np.zeros(0, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - width.bit_length() + 1)
        np.bitwise_or.at(bits, (row, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
        hidden = self.sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        index = np.arange(n)
        return _Level(index, index + 1, bits, self.sizes, self.sizes, hidden)

    @staticmethod
    def _above(below: _Level, fanout: int) -> _Level:
        cut = np.arange(0, len(below.start), fanout)
        last = np.append(cut[1:], len(below.start)) - 1
        return _Level(cut, last + 1, np.bitwise_or.reduceat(below.bits, cut), np.minimum.reduceat(below.low, cut), np.maximum.reduceat(below.high, cut), np.maximum.reduceat(below.hidden, cut))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _try(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a == b:
            return
        x, y = self.sets[i], self.sets[j]
        common = len(x) + len(y) - len(np.union1d(x, y))
        if common >= needed(len(x), len(y), self.num, self.den):
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def _pairs(self, level: int, i: int, js: np.ndarray) -> np.ndarray:
        """Those of the nodes `js` that may hold a partner of something under node `i`."""
        v = self.levels[level]
        low = np.minimum(v.low[i], v.low[js])
        fits = (self.den * np.minimum(v.high[i], v.high[js]) >= self.num * np.maximum(v.low[i], v.low[js])) | (low == 0)
        js = js[fits]
        most = np.bitwise_count(v.bits[js] & v.bits[i]).sum(1, dtype=np.int64) + np.minimum(v.hidden[js], v.hidden[i])
        most = np.minimum(most, np.minimum(v.high[js], v.high[i]))
        need = -(-self.num * (v.low[js] + v.low[i]) // (self.den + self.num))
        return js[most >= need]

    def join(self) -> list[list[int]]:
        """Groups (of indices into the given sets) that links connect; every link is proven or already implied."""
        n = len(self.sets)
        for i in range(n - 1):
            if self.tag is None or self.tag[self.order[i]] != self.tag[self.order[i + 1]]:
                self._try(i, i + 1)
        top = len(self.levels) - 1
        stack = [(top, 0, np.zeros(1, np.int64))]
        while stack:
            level, i, js = stack.pop()
            js = self._pairs(level, i, js)
            if not len(js):
                continue
            if level == 0:
                own = self.tag[self.order[i]] if self.tag is not None else None
                for j in js.tolist():
                    if j > i and (own is None or own != self.tag[self.order[j]]):
                        self._try(i, j)
                continue
            v = self.levels[level]
            if level <= 2 and self.tag is None and self._settled(level, i, js):
                continue
            below = np.concatenate([np.arange(v.start[j], v.end[j]) for j in js.tolist()])
            stack.extend((level - 1, c, below[below >= c]) for c in range(int(v.start[i]), int(v.end[i])))
        groups: dict[int, list[int]] = {}
        for i in range(n):
            groups.setdefault(self.find(i), []).append(int(self.order[i]))
        return list(groups.values())

    def _members(self, level: int, i: int) -> range:
        a, b = i, i + 1
        for v in self.levels[level:0:-1]:
            a, b = int(v.start[a]), int(v.end[b - 1])
        return range(a, b)

    def _settled(self, level: int, i: int, js: np.ndarray) -> bool:
        roots = {self.find(d) for d in self._members(level, i)}
        return len(roots) == 1 and all(self.find(d) in roots for j in js.tolist() for d in self._members(level, j))
