"""Language ID: inference of a mixture of languages for each document.

Every language has a distribution of hashed character n-grams (one to three, word edges included). A
word's likelihood under a language is the tempered product over its n-grams. Expectation-maximisation
estimates each document's language proportions over its words; the set of languages is chosen by the
likelihood less a penalty for each language. The likelihood of a text's n-grams against the average of
the fitted texts tells texts that are in none of the languages. The model is fitted on a sample of at most `sample` rows
in the order of a hash of the id; the bound is a parameter. Prediction reads every whole text in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquarry.llm.common import discard, documents, materialize, prepare, slices
from reelquarry.llm.toxicity import fold

#: Most rows used to fit.
SAMPLE = 6_000
SLOTS = 1 << 16
LONGEST = 3
#: Overlapping n-grams aren't independent; their log-likelihoods count by this factor.
TEMPER = 0.4
#: A word's likelihood in any language is at least this share of its best.
FLOOR = 1e-4
STEPS = 12
UNKNOWN = "und"
#: N-grams at the average likelihood that are added to a text's own, so that a few words don't tell it from all languages.
PRIOR_GRAMS = 50
#: A text in no language lies so far below the worst of the fitted texts, in logarithms for each n-gram.
FIT_MARGIN = 1.0
#: Characters that are inferred together.
SLICE_CHARS = 400_000


_ALPHA: list[np.ndarray] = []


def _alpha() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def word_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slots by n and position, word segment starts, whether a word has letters, text of each word).

    Words stand between white space; an n-gram may hold the space before or after its word but no
    other. Positions without an n-gram have the slot SLOTS.
    """
    joined = " " + " ".join(texts).lower() + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    gap = (code == 32) | ((code >= 9) & (code <= 13)) | (code == 160)
    code = np.where(gap, 32, code)
    n = len(code)
    slots = np.full((LONGEST, n), SLOTS, np.int32)
    h = np.zeros(n, np.uint64)
    inner = np.zeros(n, bool)
    for k in range(LONGEST):
        m = n - k
        h = (h[:m] * np.uint64(0x100000001B3) + code[k:].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if k:
            # the character that was last is inside now
            inner = (inner[:m] | gap[k - 1 : k - 1 + m]) if k > 1 else np.zeros(m, bool)
            fine = ~inner & ~(gap[:m] & gap[k:])
        else:
            fine = ~gap
        slots[k, :m][fine] = (h[fine] >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int32)
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    letters = np.zeros(0, bool)
    if len(starts):
        letters = np.add.reduceat(_alpha()[code].astype(np.int32), starts) > 0
    # lower case can change a text's length, so the ends are those of the lowered texts
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    return slots, starts, letters, np.searchsorted(ends, starts, side="right")


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches, 0, 1 << 20):
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text or "")
        for lang, texts in by_lang.items():
            counts = np.bincount(word_grams(texts)[0].ravel(), minlength=SLOTS + 1)[:SLOTS]
            totals[lang] = totals.get(lang, 0) + counts
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at])], names=["lang", "slot", "n"])


@dataclass
class LanguageModel:
    langs: list[str]
    #: Log-probability of each slot, by language.
    logp: np.ndarray
    #: Average log-probability of an n-gram in the fitted texts, and a bound below which the fit of none of them lies.
    average: float = 0.0
    least_fit: float = -np.inf


def _fits(raw: np.ndarray, grams: np.ndarray, average: float) -> np.ndarray:
    return (raw - average * grams) / (grams + PRIOR_GRAMS)


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fits on rows with a language outside the held-out fold (crc32 of the id modulo 4 is 2)."""
    spark = docs.sparkSession
    prepare(spark)
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(fold(F.col("doc_id"), 4) != 2)
    order = F.xxhash64("doc_id")
    # the hash below which about `sample` rows lie; ids only are sorted, texts stay where they are
    last = usable.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = usable.where(order <= F.lit(last)).select("text", "lang") if last is not None else usable.select("text", "lang").limit(0)
    chosen = materialize(chosen, "language")
    counts = chosen.mapInArrow(_gram_counts, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts.lang.unique())
    table = np.zeros((len(langs), SLOTS))
    for i, lang in enumerate(langs):
        own = counts[counts.lang == lang]
        table[i, own.slot.to_numpy(np.int64)] = own.n.to_numpy()
    total = table.sum(0)
    share = (total + 0.5) / (total.sum() + 0.5 * SLOTS) if len(langs) else total
    # smoothed towards the share over all languages
    strength = 200.0 * share * SLOTS**0.5
    table = table + strength
    model = LanguageModel(langs, np.log(table / table.sum(1, keepdims=True)) if len(langs) else table)

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = MixtureInference(model)
        for batch in batches:
            raw, grams = mixture.likelihoods(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(grams)], names=["raw", "grams"])

    # one row for each row of the sample
    seen = chosen.mapInArrow(likelihoods, "raw double, grams long").where("grams > 0").toPandas()
    discard(chosen)
    if len(seen):
        raw, grams = seen.raw.to_numpy(), seen.grams.to_numpy()
        model.average = float(raw.sum() / grams.sum())
        model.least_fit = float(_fits(raw, grams, model.average).min() - FIT_MARGIN)
    return model


class MixtureInference:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.table = np.zeros((SLOTS + 1, max(len(model.langs), 1)), np.float32)
        if model.langs:
            self.table[:SLOTS] = TEMPER * model.logp.T

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the words with letters: likelihoods relative to each one's best language, its log-likelihood there, n-grams, text."""
        slots, starts, letters, owner = word_grams(texts)
        if not letters.any():
            return np.zeros((0, self.table.shape[1]), np.float32), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = self.table[slots[0]]
        for row in slots[1:]:
            total += self.table[row]
        score = np.add.reduceat(total, starts)[letters]
        top = score.max(1, keepdims=True)
        score -= top
        grams = np.add.reduceat((slots < SLOTS).sum(0), starts)[letters]
        return np.maximum(np.exp(score), FLOOR), top[:, 0].astype(np.float64) / TEMPER, grams, owner[letters]

    def likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood, n-grams) of each text's words with letters, each word in its best language."""
        raw, grams = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for first, last in self._slices(texts):
            _, best, count, owner = self._words([x or "" for x in texts[first:last]])
            np.add.at(raw, owner + first, best)
            np.add.at(grams, owner + first, count)
        return raw, grams

    @staticmethod
    def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """Bounds of runs of texts with about SLICE_CHARS characters."""
        first = held = 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= SLICE_CHARS or i + 1 == len(texts):
                yield first, i + 1
                first, held = i + 1, 0

    @staticmethod
    def _em(like: np.ndarray, doc: np.ndarray, starts: np.ndarray, sizes: np.ndarray, theta: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, log-likelihood) by document; zero proportions stay zero."""
        for _ in range(steps):
            weighted = like * theta[doc]
            weighted /= weighted.sum(1, keepdims=True)
            theta = (np.add.reduceat(weighted, starts) / sizes[:, None]).astype(np.float32)
        mixed = (like * theta[doc]).sum(1)
        return theta, np.add.reduceat(np.log(np.maximum(mixed, 1e-30)), starts)

    def infer(self, texts: list[str | None]) -> list[tuple[str, float, int, float]]:
        """(dominant language, its proportion, number of languages in the set, fit) for each text."""
        out: list = [(UNKNOWN, 0.0, 0, 0.0)] * len(texts)
        if not self.model.langs:
            return out
        for first, last in self._slices(texts):
            like, best, grams, owner = self._words([x or "" for x in texts[first:last]])
            if len(like):
                self._infer(like, owner, best, grams, first, out)
        return out

    def _infer(self, like: np.ndarray, owner: np.ndarray, raw: np.ndarray, grams: np.ndarray, first: int, out: list) -> None:
        langs = self.model.langs
        present, sizes = np.unique(owner, return_counts=True)
        group = (present + first).tolist()
        starts = np.concatenate(([0], sizes.cumsum()[:-1]))
        doc = np.repeat(np.arange(len(group)), sizes)
        fit = _fits(np.add.reduceat(raw, starts), np.add.reduceat(grams, starts), self.model.average)
        uniform = np.full((len(group), len(langs)), 1 / len(langs), np.float32)
        theta, best = self._em(like, doc, starts, sizes, uniform, STEPS)
        penalty = 2.0 + 0.5 * np.log(sizes)
        order = np.argsort(-theta, axis=1)
        logs = np.log(like)
        single = np.add.reduceat(logs[np.arange(len(doc)), order[doc, 0]], starts)
        chosen = np.zeros_like(theta)
        chosen[np.arange(len(group)), order[:, 0]] = 1
        count = np.ones(len(group), np.int64)
        value = single - penalty
        # a set of two or more can't beat one language unless the full mixture does with two penalties
        open_ = np.flatnonzero(best - 2 * penalty > value)
        for size in range(2, len(langs) + 1):
            if not len(open_):
                break
            rows = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in open_])
            local = np.repeat(np.arange(len(open_)), sizes[open_])
            first = np.concatenate(([0], sizes[open_].cumsum()[:-1]))
            begin = np.zeros((len(open_), len(langs)), np.float32)
            np.put_along_axis(begin, order[open_, :size], 1 / size, 1)
            found, ll = self._em(like[rows], local, first, sizes[open_], begin, STEPS)
            better = ll - size * penalty[open_] > value[open_]
            won = open_[better]
            value[won] = (ll - size * penalty[open_])[better]
            chosen[won], count[won] = found[better], size
            open_ = open_[best[open_] - (size + 1) * penalty[open_] > value[open_]]
        top = chosen.argmax(1)
        for row, i in enumerate(group):
            out[i] = (langs[top[row]], float(min(1.0, chosen[row, top[row]])), int(count[row]), float(fit[row]))


RESULT = ("lang_pred", "lang_share", "lang_count", "lang_fit")


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Appends lang_pred, lang_share (its proportion, 0 to 1), lang_count and lang_fit. Other columns pass unchanged.

    lang_fit is how much likelier the n-grams are than those of the fitted texts on average (in logarithms, each
    word in its best language); a text below the model's `least_fit` is in none of its languages. A null text, or
    one without letters, gets `und`, 0, 0 and 0. Input columns with a result's name are replaced.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_share double, lang_count long, lang_fit double")
    def infer(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        mixture = MixtureInference(shared.value)
        for texts in parts:
            yield pd.DataFrame(mixture.infer(texts.tolist()), columns=list(RESULT))

    row = [F.col(c) for c in docs.columns if c not in RESULT]
    return docs.select(F.struct(*row).alias("row"), infer("text").alias("language")).select("row.*", "language.*")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominant language of every document, with its share and the size of its language set."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_share").alias("score"), F.col("lang_count").alias("n_languages"))
