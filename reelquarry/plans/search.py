"""Search queries as a small syntax tree, compiled to a column.

Terms and phrases are tested against the set of a text's words: `search` splits each text once, whatever the
size of the tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquarry.functions.text import tokens


class Query:
    pass


@dataclass(frozen=True)
class Term(Query):
    """A whole word."""

    text: str


@dataclass(frozen=True)
class Phrase(Query):
    """All of some words; next to each other and in order if `adjacent`."""

    words: tuple[str, ...]
    adjacent: bool = False


@dataclass(frozen=True)
class Substring(Query):
    text: str


@dataclass(frozen=True)
class Field(Query):
    name: str
    value: object


@dataclass(frozen=True)
class Range(Query):
    """Inclusive bounds; None leaves an end open."""

    name: str
    low: object = None
    high: object = None


@dataclass(frozen=True)
class Fuzzy(Query):
    name: str
    text: str
    distance: int = 2


class _Many(Query):
    def __init__(self, *parts: Query):
        self.parts = parts


class And(_Many):
    pass


class Or(_Many):
    pass


@dataclass(frozen=True)
class Not(Query):
    part: Query


def compile_query(q: Query, text: str | Column) -> Column:
    """The predicate of a query over a text; an empty And holds for all rows, an empty Or for none. A null text has no words."""
    text = F.col(text) if isinstance(text, str) else text
    # the words are bound once, as the only element of an array
    return F.exists(F.array(tokens(F.coalesce(text, F.lit("")))), lambda words: _holds(q, text, words))


def search(df: DataFrame, q: Query, text: str) -> DataFrame:
    return df.where(compile_query(q, text))


def _holds(q: Query, text: Column, words: Column) -> Column:
    match q:
        case Term(t):
            return F.array_contains(words, t.lower())
        case Phrase(parts, adjacent):
            out = F.lit(True)
            for p in parts:
                out = out & F.array_contains(words, p.lower())
            if not adjacent:
                return out
            # words hold no space, so the joined sequence can only be found at word bounds
            return out & F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(" " + " ".join(parts).lower() + " "))
        case Substring(t):
            return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(t.lower()))
        case Field(name, value):
            return F.col(name).eqNullSafe(F.lit(value))
        case Range(name, low, high):
            return F.coalesce((F.lit(True) if low is None else F.col(name) >= low) & (F.lit(True) if high is None else F.col(name) <= high), F.lit(False))
        case Fuzzy(name, t, distance):
            return F.coalesce(F.levenshtein(F.lower(name), F.lit(t.lower())) <= distance, F.lit(False))
        case Not(part):
            return ~_holds(part, text, words)
        case And():
            out = F.lit(True)
            for p in q.parts:
                out = out & _holds(p, text, words)
            return out
        case Or():
            out = F.lit(False)
            for p in q.parts:
                out = out | _holds(p, text, words)
            return out
    raise TypeError(f"not a query: {q!r}")


def any_column(columns: list[str], needle: str) -> Column:
    """Whether one of the columns holds the text, whatever its case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return out


def all_terms(columns: list[str], query: str) -> Column:
    """Whether every word of the query is held by one of the columns; an empty query holds for all."""
    out = F.lit(True)
    for term in query.split():
        out = out & any_column(columns, term)
    return out


def rating_predicate(rating: str, exact: int | None = None, least: int | None = None, most: int | None = None) -> Column:
    """Rating tests that are given; an unrated row passes none of them."""
    out = F.lit(True)
    for bound, test in ((exact, lambda b: F.col(rating) == b), (least, lambda b: F.col(rating) >= b), (most, lambda b: F.col(rating) <= b)):
        if bound is not None:
            out = out & F.coalesce(test(bound), F.lit(False))
    return out


class ClipQuery:
    """Builds parameterised SQL over clips: conditions in the order given, newest clips first."""

    def __init__(self, table: str = "clips"):
        self.table, self.conditions, self.args = table, [], {}

    def _with(self, text: str, value: object) -> ClipQuery:
        self.args[f"p{len(self.args)}"] = value
        self.conditions.append(text.format(f":p{len(self.args) - 1}"))
        return self

    def name(self, part: str) -> ClipQuery:
        return self._with("name LIKE {}", f"%{part}%")

    def rating(self, value: int) -> ClipQuery:
        return self._with("rating = {}", value)

    def least_rating(self, value: int) -> ClipQuery:
        return self._with("rating >= {}", value)

    def favorite(self, value: bool) -> ClipQuery:
        return self._with("is_favorite = {}", value)

    def rejected(self, value: bool) -> ClipQuery:
        return self._with("is_rejected = {}", value)

    def sql(self) -> str:
        where = f" WHERE {' AND '.join(self.conditions)}" if self.conditions else ""
        return f"SELECT * FROM {self.table}{where} ORDER BY created_at DESC"
