"""Subtitles, edit lists, text differences, playlists, metadata: operators over cues, events and entries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelquarry.operators.folds import ordered_fold

MERGES = ("prefer_first", "prefer_last", "keep_all", "drop_on_conflict")


def merge_tracks(cues: DataFrame, asset: str, strategy: str) -> DataFrame:
    """Cues (asset, track, start, end, id) of all tracks in one -> (asset, id, track, start, end, conflicted).

    Tracks come in order, cues of a track by start, end and id. A cue that overlaps kept ones is dropped
    (prefer_first, drop_on_conflict), takes their place (prefer_last) or stays with a mark (keep_all). The state
    is an asset's kept cues. Cues with a null are left out.
    """
    if strategy not in MERGES:
        raise ValueError(f"unknown strategy {strategy!r}")

    def fold(k: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        from bisect import bisect_left, insort

        # kept cues by start; `reach` is the longest of them, which bounds how far back an overlap can begin
        kept: list[tuple] = []
        reach = 0
        for track, start, end, own in rows:
            low, high = bisect_left(kept, (start - reach,)), bisect_left(kept, (end,))
            met = [c for c in kept[low:high] if c[0] < end and c[1] > start]
            if met and strategy in ("prefer_first", "drop_on_conflict"):
                continue
            if met and strategy == "prefer_last":
                for c in met:
                    kept.remove(c)
            insort(kept, (start, end, own, track, bool(met) and strategy == "keep_all"))
            reach = max(reach, end - start)
        for start, end, own, track, conflicted in kept:
            yield (k[0], own, track, start, end, conflicted)

    known = cues.select(asset, "track", "start", "end", "id").dropna()
    return ordered_fold(known, [asset], ["track", "start", "end", "id"], ["track", "start", "end", "id"], f"{asset} {dict(cues.dtypes)[asset]}, id long, track long, start long, end long, conflicted boolean", fold)


def gap_statistics(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, avg_gap, total_gap): the mean of all steps from an end to the next start, negative ones too, and the sum of the positive ones."""
    w = W.partitionBy(key).orderBy(start, end)
    gap = F.lead(start).over(w) - F.col(end)
    return spans.withColumn("_gap", gap).groupBy(key).agg(F.coalesce(F.avg("_gap"), F.lit(0.0)).alias("avg_gap"), F.coalesce(F.sum(F.greatest("_gap", F.lit(0))), F.lit(0)).cast("long").alias("total_gap"))


def change_list(old: DataFrame, new: DataFrame, number: str, fields: list[str], name: str) -> DataFrame:
    """(kind, old_number, new_number, description) of edit events that were added, removed or modified."""
    a = old.select(F.col(number).alias("_n"), F.col(name).alias("_a"), F.struct(*fields).alias("_old"))
    b = new.select(F.col(number).alias("_n"), F.col(name).alias("_b"), F.struct(*fields).alias("_new"))
    kind = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    both = a.join(b, "_n", "full").withColumn("kind", kind).where("kind IS NOT NULL")
    changed = F.concat_ws(", ", *[F.when(~F.col(f"_old.{f}").eqNullSafe(F.col(f"_new.{f}")), F.lit(f)) for f in fields])
    text = F.when(F.col("kind") == "modified", F.format_string("Event %d modified: %s", "_n", changed)).otherwise(F.format_string("Event %d %s (reel: %s)", "_n", "kind", F.coalesce("_a", "_b")))
    return both.select("kind", F.when(F.col("kind") != "added", F.col("_n")).alias("old_number"), F.when(F.col("kind") != "removed", F.col("_n")).alias("new_number"), text.alias("description"))


def diff_lines(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """(kind, line) of the longest-common-subsequence difference; of equal choices an added line comes first."""
    common = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i in range(len(old) - 1, -1, -1):
        for j in range(len(new) - 1, -1, -1):
            common[i][j] = common[i + 1][j + 1] + 1 if old[i] == new[j] else max(common[i + 1][j], common[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(old) or j < len(new):
        if i < len(old) and j < len(new) and old[i] == new[j]:
            out.append(("unchanged", old[i]))
            i, j = i + 1, j + 1
        elif j < len(new) and (i == len(old) or common[i][j + 1] >= common[i + 1][j]):
            out.append(("added", new[j]))
            j += 1
        else:
            out.append(("removed", old[i]))
            i += 1
    return out


def text_diff(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, place, kind, line) for each row's two texts, line by line; null texts count as empty. Time and memory grow with the product of their lines."""
    compare = diff_lines

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(k, n, *line) for k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n, line in enumerate(compare((a or "").splitlines(), (b or "").splitlines()))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string()), strict=True)], names=[key, "place", "kind", "line"])

    return df.select(key, old, new).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, place long, kind string, line string")


def smart_playlist(items: DataFrame, value: str, bounds: list[tuple[float, float]], order: list, most: int) -> DataFrame:
    """The first `most` items, in the given order, whose value lies within all bounds."""
    fits = F.lit(True)
    for low, high in bounds:
        fits = fits & F.col(value).between(low, high)
    return items.where(fits).orderBy(*order).limit(most)


def find_cues(cues: DataFrame, text: str, query: str) -> DataFrame:
    """Cues that hold the query, whatever its case; an empty query finds none."""
    return cues.where(F.contains(F.lower(text), F.lit(query.lower()))) if query else cues.limit(0)


def find_entries(entries: DataFrame, query: str, texts: list[str], tags: str | None = None) -> DataFrame:
    """Entries with the query in one of their texts or tags, whatever its case; an empty query finds all."""
    if not query:
        return entries
    q = F.lit(query.lower())
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.coalesce(F.contains(F.lower(t), q), F.lit(False))
    if tags:
        hit = hit | F.coalesce(F.exists(tags, lambda t: F.contains(F.lower(t), q)), F.lit(False))
    return entries.where(hit)


def field_matches(fields: Column, key: str, value: str) -> Column:
    """Whether a map has the key and its value holds `value`, whatever its case."""
    return F.coalesce(F.contains(F.lower(F.try_element_at(fields, F.lit(key))), F.lit(value.lower())), F.lit(False))


def any_field_matches(path: Column, fields: Column, query: str) -> Column:
    """Whether the path or a value of the map holds the query; all do if it is empty."""
    q = F.lit(query.lower())
    return F.contains(F.lower(path), q) | F.exists(F.map_values(fields), lambda v: F.contains(F.lower(v), q)) if query else F.lit(True)


def inherited(parent: Column, child: Column) -> Column:
    """The parent's map with the child's values over it."""
    kept = F.map_filter(parent, lambda k, _: ~F.array_contains(F.map_keys(child), k))
    return F.map_concat(kept, child)


def with_fields(fields: Column, updates: dict[str, str]) -> Column:
    """A map with some values set; nothing changes without updates."""
    return inherited(fields, F.create_map(*[F.lit(x) for pair in updates.items() for x in pair])) if updates else fields


# fixed values: tag names of two audio formats
ID3_TO_VORBIS = {
    "TIT2": "TITLE",
    "TPE1": "ARTIST",
    "TALB": "ALBUM",
    "TPE2": "ALBUMARTIST",
    "TCON": "GENRE",
    "TDRC": "DATE",
    "TYER": "DATE",
    "COMM": "COMMENT",
    "TCOM": "COMPOSER",
    "TPE3": "CONDUCTOR",
    "TEXT": "LYRICIST",
    "TCOP": "COPYRIGHT",
    "TPUB": "PUBLISHER",
    "TSRC": "ISRC",
    "TSSE": "ENCODER",
    "TLAN": "LANGUAGE",
}


def converted_fields(fields: Column, names: dict[str, str]) -> Column:
    """A map under the other format's names; fields without a counterpart go, of two with the same name the first by key stays."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    pairs = F.array_sort(F.filter(F.map_entries(fields), lambda e: F.map_contains_key(known, e["key"])))
    named = F.transform(pairs, lambda e: F.struct(F.element_at(known, e["key"]).alias("key"), e["value"].alias("value")))
    first = F.aggregate(named, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, e: F.when(F.exists(acc, lambda x: x["key"] == e["key"]), acc).otherwise(F.array_append(acc, e)))
    return F.map_from_entries(first)


def tag_rules(items: DataFrame, hint: str, rules: list[tuple[str, str, str, float]]) -> DataFrame:
    """Items with (tag, tag_type, confidence) for each rule (keyword, tag, type, confidence) whose keyword the hint holds."""
    fired = F.array(*[F.when(F.contains(F.lower(hint), F.lit(k.lower())), F.struct(F.lit(t).alias("tag"), F.lit(kind).alias("tag_type"), F.lit(c).alias("confidence"))) for k, t, kind, c in rules])
    return items.withColumn("_tag", F.explode(F.array_compact(fired))).select("*", "_tag.*").drop("_tag")


def chain_valid(events: DataFrame, key: str, order: list[str], action: str, time: str) -> DataFrame:
    """(key, valid): whether a chain begins with Created and its times never fall."""
    w = W.partitionBy(key).orderBy(*order)
    good = F.when(F.row_number().over(w) == 1, F.col(action) == "Created").otherwise(F.col(time) >= F.lag(time).over(w))
    return events.withColumn("_good", good).groupBy(key).agg(F.bool_and("_good").alias("valid"))


def next_ready(jobs: DataFrame, completed: DataFrame, order: str) -> DataFrame:
    """Jobs (job, depends_on, dispatched) that may run now, in order: not dispatched, and without an open dependency."""
    done = completed.select(F.col("job").alias("depends_on")).distinct().withColumn("_done", F.lit(True))
    open_ = jobs.where(~F.col("dispatched")).join(done, "depends_on", "left")
    return open_.where("depends_on IS NULL OR _done").drop("_done").orderBy(order)


def folder_totals(paths: DataFrame, path: str) -> DataFrame:
    """(folder, depth, assets): assets in every folder and below it; the root is the empty name."""
    parts = F.split(F.regexp_replace(path, "^/+", ""), "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder"), n.alias("depth")))
    return paths.select(F.explode(folders).alias("f")).groupBy("f.folder", "f.depth").agg(F.count("*").alias("assets")).select("folder", F.col("depth").cast("long").alias("depth"), "assets")


def share_deviation(rows: DataFrame, category: str, target: dict[str, float]) -> DataFrame:
    """One row: the sum of differences between target shares and the categories' shares of all rows."""
    counts = rows.agg(F.count(category).alias("n"), *[F.count_if(F.col(category) == c).alias(f"_{i}") for i, c in enumerate(target)])
    gap = sum((F.abs(F.lit(t) - F.coalesce(F.try_divide(F.col(f"_{i}"), F.col("n")), F.lit(0.0))) for i, t in enumerate(target.values())), F.lit(0.0))
    return counts.select(gap.alias("deviation"))
