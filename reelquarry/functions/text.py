"""Text expressions: tokens, stems, fuzzy similarity, cache keys, relevance weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the suffixes that a stem loses, in order
SUFFIXES = ("ing", "ed", "ly", "s", "es", "ies")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def stem(word: Column) -> Column:
    """Each suffix goes in turn if the word is longer than it by more than two."""
    out = F.lower(word)
    for s in SUFFIXES:
        out = F.when(out.endswith(s) & (F.length(out) > len(s) + 2), F.substring(out, F.lit(1), F.length(out) - len(s))).otherwise(out)
    return out


def similarity_bytes(a: Column, b: Column) -> Column:
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.octet_length(a), F.octet_length(b))), F.lit(1.0))


def similarity_chars(a: Column, b: Column) -> Column:
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(1.0))


def cache_key(url: Column) -> Column:
    """No fragment, lower case, sorted query parameters; one trailing slash goes, unless it is the root of a host."""
    plain = F.lower(F.substring_index(url, "#", 1))
    path = F.substring_index(plain, "?", 1)
    scheme = F.instr(path, "://")
    root = F.when(scheme > 0, F.substring(path, scheme + 3, F.length(path)).rlike("^[^/]*/$")).otherwise(path == "/")
    path = F.when(path.endswith("/") & ~root, F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    query = F.when(F.instr(plain, "?") > 0, F.substring(plain, F.instr(plain, "?") + 1, F.length(plain)))
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.when(F.coalesce(ordered, F.lit("")) == "", path).otherwise(F.concat(path, F.lit("?"), ordered))


def bm25_idf(docs: Column, df: Column) -> Column:
    return F.log((docs - df + 0.5) / (df + 0.5) + 1)


def bm25_term(tf: Column, idf: Column, length: Column, average: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def tf_idf(tf: Column, length: Column, docs: Column, df: Column) -> Column:
    return tf / length * F.log(docs / df + 1)


def log_tf_idf(tf: Column, docs: Column, df: Column) -> Column:
    return (1 + F.log(tf.cast("double"))) * F.greatest(F.log(docs / df), F.lit(0.0))


def timecode(frames: Column, fps: int, drop: bool = False) -> Column:
    """HH:MM:SS:FF; with `drop` at 30 or 60 frames the dropped numbers are left out and the last mark is a semicolon."""
    mark = ":"
    if drop and fps in (30, 60):
        mark, lost = ";", fps // 15
        d, m = F.floor(frames / (fps * 600 - lost * 9)), frames % (fps * 600 - lost * 9)
        frames = frames + lost * 9 * d + F.when(m < lost, 0).otherwise(lost * F.floor((m - lost) / (fps * 60 - lost)))
    s = F.floor(frames / fps)
    return F.format_string(f"%02d:%02d:%02d{mark}%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, frames % fps)


def parse_timecode(text: Column, fps: int, drop: bool = False) -> Column:
    """Frames of a timecode; null unless it has four numbers in their ranges."""
    p = F.transform(F.split(text, "[:;]"), lambda x: x.try_cast("long"))
    h, m, s, f = (F.get(p, F.lit(i)) for i in range(4))
    frames = ((h * 60 + m) * 60 + s) * fps + f
    if drop and fps in (30, 60):
        frames = frames - fps // 15 * ((h * 60 + m) - F.floor((h * 60 + m) / 10))
    return F.when((F.size(p) == 4) & (f < fps) & (s < 60) & (m < 60), frames)


def token_offsets(text: Column) -> Column:
    """Array of (token, start) in characters: runs of letters, digits and underscores, in lower case."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    # each token is looked for behind the one before
    found = F.aggregate(
        words,
        F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<token:string,start:int>>").alias("out")),
        lambda acc, w: F.struct(
            (F.position(w, low, acc["at"] + 1) - 1 + F.length(w)).cast("int").alias("at"),
            F.array_append(acc["out"], F.struct(w.alias("token"), (F.position(w, low, acc["at"] + 1) - 1).cast("int").alias("start"))).alias("out"),
        ),
    )
    return found["out"]
