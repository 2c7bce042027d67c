"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features: densities of a weighted lexicon (also after undoing look-alike characters), hits near
second-person words, capitals, punctuation, obfuscated words, repeated letters and length. Lexicon,
trees and calibration are fitted on a sample of at most `sample` labelled rows, taken in the order of
a hash of the id; the bound is a parameter. Scoring reads every whole text in place, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquarry.llm.common import discard, documents, materialize, prepare, slices

#: Most labelled rows used to fit.
SAMPLE = 12_000
#: Most words of the learned lexicon, and what a word needs to enter it.
LEXICON, MIN_RATIO, MIN_LOG_ODDS, MIN_DOCS = 256, 20.0, 2.5, 3
#: Lengths of the word beginnings that the lexicon also holds, so that it catches inflected and compound words.
STEMS = (4, 5, 6)
# fixed values: second-person words of the languages at hand
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros".split())
# fixed values: look-alike characters
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
FEATURES = ("lexicon_density", "lexicon_hits", "top_weight", "distinct_hits", "hidden_hits", "second_person", "near_second_person", "capital_letters", "capital_words", "exclamations", "questions", "symbols", "digits", "obfuscated", "repeats", "log_words")
#: Characters between a hit and a second-person word that count as near.
NEAR = 30
_STRIP = "\"'.,;:!?()[]{}<>|*_-…“”«»¡¿#%&$"
# look-alike characters inside a word; hyphens and dots alone don't hide anything
_MIXED = re.compile(r"[^\W\d_]+[0-9@$!*_.\-][\w@$!*.\-]*[^\W\d_]")
_JOINED = re.compile(r"[^\W\d_]+(?:[.\-_!]+[^\W\d_]+)*")
_CAPITALS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_RUN = re.compile(r"([a-z])\1\1")


def words_of(text: str) -> list[str]:
    """Lower-case words without surrounding punctuation."""
    return [w for w in (x.strip(_STRIP) for x in text.lower().split()) if w]


def entries_of(word: str) -> list[str]:
    """The lexicon entries that a word can match: itself and its beginnings, marked by an asterisk."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


class Featurizer:
    """Features of a text from one pass of an automaton over lexicon and second-person words, and a few scans."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for entry, weight in lexicon.items():
            found.setdefault(entry.rstrip("*"), []).append((weight, entry.endswith("*")))
        for word in SECOND_PERSON:
            found.setdefault(word, []).append((0.0, False))
        for word, uses in found.items():
            self.automaton.add_word(word, (len(word), uses))
        self.automaton.make_automaton()

    def _weight(self, word: str) -> float:
        return max(self.lexicon.get(e, 0.0) for e in entries_of(word))

    def features(self, text: str) -> list[float]:
        low = text.lower()
        hits: dict[int, float] = {}
        second = []
        for end, (size, uses) in self.automaton.iter(low):
            start = end - size + 1
            if start and low[start - 1].isalpha():
                continue
            closed = end + 1 == len(low) or not low[end + 1].isalpha()
            for weight, stem in uses:
                if stem or closed:
                    if weight:
                        hits[start] = max(hits.get(start, 0.0), weight)
                    else:
                        second.append(start)
        mixed = [m for m in _MIXED.findall(low) if not _JOINED.fullmatch(m)]
        hidden = [w for w in (self._weight(m.translate(LOOKALIKES).strip(_STRIP)) for m in mixed) if w]
        at = np.array(sorted(hits))
        near = 0
        if len(at) and second:
            near = int(sum(np.abs(np.array(second) - i).min() <= NEAR for i in at))
        n = max(len(text.split()), 1)
        counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        size = max(int(counts.sum()), 1)
        weights = [*hits.values(), *hidden]
        return [
            sum(weights) / n,
            float(len(weights)),
            max(weights, default=0.0),
            float(len({low[i : i + 6] for i in hits})),
            float(len(hidden)),
            len(second) / n,
            float(near),
            float(counts[65:91].sum()) / size,
            len(_CAPITALS.findall(text)) / n,
            float(counts[33]) / n,
            float(counts[63]) / n,
            float(counts[[35, 36, 37, 38, 42, 64, 95, 126]].sum()) / size,
            float(counts[48:58].sum()) / size,
            len(mixed) / n,
            len(_RUN.findall(low)) / n,
            float(np.log1p(n)),
        ]


@dataclass
class BoostedTrees:
    """Binary logistic boosting with histogram splits; trees of fixed depth in array form."""

    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    min_leaf: float = 5.0
    l2: float = 1.0
    base: float = 0.0
    edges: list = field(default_factory=list)
    nodes: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        rate = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(rate / (1 - rate)))
        # values between quantiles; sparse counts keep an edge above zero of their own
        self.edges = [np.unique(np.quantile(c[c > c.min()], np.linspace(0, 1, self.bins)) if (c > c.min()).any() else c[:1]) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        cells = self.bins + 1
        flat = binned + np.arange(width) * cells
        score = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            at = np.zeros(n, np.int64)
            feature, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1)
            binned_cut = np.zeros(2**self.depth - 1, np.int64)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                key = ((at - first)[:, None] * (width * cells) + flat).ravel()
                sums = [np.bincount(key, np.repeat(v, width), many * width * cells).reshape(many, width, cells) for v in (g, h)]
                gl, hl = (s.cumsum(2)[:, :, :-1] for s in sums)
                gt, ht = (s.sum(2)[:, :, None] for s in sums)
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                gain[(hl < self.min_leaf / 10) | (ht - hl < self.min_leaf / 10)] = 0
                best = gain.reshape(many, -1).argmax(1)
                for j, b in enumerate(best.tolist()):
                    f, c = divmod(b, cells - 1)
                    if gain[j, f, c] > 1e-9 and c < len(self.edges[f]):
                        feature[first + j], cut[first + j], binned_cut[first + j] = f, self.edges[f][c], c
                f = feature[at]
                right = (f >= 0) & (binned[np.arange(n), f] > binned_cut[at])
                at = 2 * at + 1 + right
            leaf = at - (2**self.depth - 1)
            gs, hs = (np.bincount(leaf, v, 2**self.depth) for v in (g, h))
            value = -self.rate * gs / (hs + self.l2)
            score += value[leaf]
            self.nodes.append((feature, cut, value))
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = 2 * at + 1 + ((f >= 0) & (x[rows, f] >= cut[at]))
            score += value[at - (2**self.depth - 1)]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the increasing fit by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # positives, rows, least and greatest score
    for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([t, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t1, n1, _, hi = blocks.pop()
            blocks[-1][0] += t1
            blocks[-1][1] += n1
            blocks[-1][3] = hi
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    # half an example towards the middle keeps ends off 0 and 1
    ps = np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in (0, 1)])
    return xs, np.maximum.accumulate(ps)


@dataclass
class ToxicityModel:
    lexicon: dict
    trees: BoostedTrees | None
    knots: tuple | None
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.trees.decision(x), *self.knots), 0, 1)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found[label].update({e for w in set(words_of(text or "")) for e in entries_of(w)})
    words = list(found[0].keys() | found[1].keys())
    for at in range(0, len(words), 100_000):
        part = words[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([found[0][w] for w in part], pa.int64()), pa.array([found[1][w] for w in part], pa.int64())], names=["word", "clean", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fits on labelled rows outside the held-out fold (crc32 of the id modulo 5 is 0), at most `sample` of them.

    Rows without id or label are left out; of repeated ids the greater label holds. Without rows of
    both labels the model gives the smoothed share of label 1. A quarter of the rows, by their ids, is
    kept for the calibration: neither the lexicon nor the trees see it.
    """
    spark = docs.sparkSession
    prepare(spark)
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(fold(F.col("doc_id"), 5) != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # at most `sample` rows of two numbers are broadcast
    held = stored = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(4)) == 3).alias("calibrates")), "toxicity")
    sides = {r.toxic for r in held.where("NOT calibrates").select("toxic").distinct().collect()}, held.where("calibrates").limit(1).count()
    if len(sides[0]) < 2 or not sides[1]:
        # too few rows to keep some apart
        held = held.withColumn("calibrates", F.lit(False))
    learned = held.where("NOT calibrates")
    totals = {r.toxic: r.n for r in learned.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    prior = (toxic + 0.5) / (clean + toxic + 1)
    if not clean or not toxic:
        return ToxicityModel({}, None, None, prior)
    counts = learned.mapInArrow(_word_counts, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    t, c, n = F.col("t").cast("double"), F.col("c").cast("double"), clean + toxic
    odds = F.log((t + 0.5) / (toxic + 1.0)) - F.log((c + 0.5) / (clean + 1.0))
    # twice the log-likelihood ratio of "the word depends on the label"
    cells = ((t, toxic, t + c), (c, clean, t + c), (toxic - t, toxic, n - t - c), (clean - c, clean, n - t - c))
    ratio = sum(F.when(x > 0, 2 * x * F.log(x * float(n) / (side * total))).otherwise(0.0) for x, side, total in cells)
    lexicon = {
        r.word: float(r.w)
        for r in counts.where(f"t >= {MIN_DOCS}").withColumn("w", odds).withColumn("g", ratio)
        .where(f"g >= {MIN_RATIO} AND w >= {MIN_LOG_ODDS}").orderBy(F.desc("g"), "word").limit(LEXICON).collect()
    }

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Featurizer(lexicon)
        for batch in slices(batches, 1):
            x = [made.features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2), batch.column(3)], names=["doc_id", "x", "toxic", "calibrates"])

    got = held.mapInArrow(rows, "doc_id long, x array<double>, toxic int, calibrates boolean").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    discard(stored)
    x, y = np.array(got.x.tolist()), got.toxic.to_numpy(np.float64)
    calibrate = got.calibrates.to_numpy(bool)
    trees = BoostedTrees().fit(x[~calibrate], y[~calibrate])
    at = calibrate if calibrate.any() else ~calibrate
    return ToxicityModel(lexicon, trees, isotonic(trees.decision(x[at]), y[at]), prior)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Appends `toxicity` (0 to 1) to documents, in place of an input column of that name; null text counts as empty. Other columns pass unchanged."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = Featurizer(shared.value.lexicon)
        for texts in parts:
            x = np.array([made.features(t or "") for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(shared.value.score(x), dtype="float64")

    return docs.withColumn("toxicity", score("text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated toxicity score of every document; an empty table gives no rows."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
