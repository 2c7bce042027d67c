"""Documents as ordered lines: playlists, programme guides, edit lists, as-run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquarry.sources.files import edl_line

# fixed values: media types and formats of playlists
PLAYLISTS = {"m3u": "audio/x-mpegurl", "m3u8": "application/vnd.apple.mpegurl", "xspf": "application/xspf+xml", "pls": "audio/x-scpls"}


def _document(df: DataFrame, place: str, body: Column, head: list[str], foot: list[Column]) -> DataFrame:
    """(part, place, line): head lines, a body row for each entry (which may hold line breaks), foot lines, in this order."""
    one = df.sparkSession.range(1)
    at = F.lit(0).cast("long")
    top = one.select(F.lit(0).alias("part"), F.posexplode(F.array(*map(F.lit, head))).alias("place", "line")).select("part", F.col("place").cast("long").alias("place"), "line")
    middle = df.select(F.lit(1).alias("part"), F.col(place).cast("long").alias("place"), body.alias("line"))
    out = top.union(middle)
    if foot:
        out = out.union(df.agg(F.count("*").alias("n")).select(F.lit(2).alias("part"), at.alias("place"), F.concat_ws("\n", *foot).alias("line")))
    return out


def write_document(lines: DataFrame, path: str) -> None:
    """Writes the lines in order; parts in name order make up the document."""
    lines.repartitionByRange("part", "place").sortWithinPartitions("part", "place").select("line").write.mode("overwrite").text(path)


def playlist(entries: DataFrame, kind: str) -> DataFrame:
    """Lines of a playlist of entries (place from 1, uri, title, artist, duration_s); null titles and durations as the format has it."""
    uri, label = F.col("uri"), F.coalesce("title", "uri")
    seconds = F.coalesce(F.col("duration_s").cast("long"), F.lit(-1)).cast("string")
    plain = F.concat(F.lit("#EXTINF:"), seconds, F.lit(","), label, F.lit("\n"), uri)
    n = F.col("place").cast("string")
    if kind == "m3u":
        return _document(entries, "place", plain, ["#EXTM3U"], [])
    if kind == "m3u8":
        tagged = F.concat(F.lit("#EXTINF:"), seconds, F.lit(',artist="'), F.col("artist"), F.lit('" tvg-name="'), label, F.lit('"\n'), uri)
        return _document(entries, "place", F.coalesce(tagged, plain), ["#EXTM3U", "# Encoding: UTF-8"], [])
    if kind == "pls":
        body = F.concat_ws("\n", F.concat(F.lit("File"), n, F.lit("="), uri), F.concat(F.lit("Title"), n, F.lit("="), F.col("title")), F.concat(F.lit("Length"), n, F.lit("="), F.col("duration_s").cast("long").cast("string")))
        return _document(entries, "place", body, ["[playlist]"], [F.concat(F.lit("NumberOfEntries="), F.col("n").cast("string")), F.lit("Version=2")])
    if kind == "xspf":
        fields = [("location", uri), ("title", F.col("title")), ("creator", F.col("artist")), ("duration", (F.col("duration_s") * 1000).cast("long").cast("string"))]
        body = F.concat_ws("\n", F.lit("    <track>"), *[F.concat(F.lit(f"      <{t}>"), escaped(c), F.lit(f"</{t}>")) for t, c in fields], F.lit("    </track>"))
        return _document(entries, "place", body, ['<?xml version="1.0" encoding="UTF-8"?>', '<playlist version="1" xmlns="http://xspf.org/ns/0/">', "  <trackList>"], [F.lit("  </trackList>"), F.lit("</playlist>")])
    raise ValueError(f"unknown playlist {kind!r}")


def escaped(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def guide(programmes: DataFrame) -> DataFrame:
    """Lines of an XMLTV guide of programmes (place, channel, start, stop, lang, title, desc, season, episode); channels come first."""

    def element(tag: str, c: Column) -> Column:
        return F.concat(F.lit(f"    <{tag} lang=\""), escaped(F.coalesce("lang", F.lit("en"))), F.lit('">'), escaped(c), F.lit(f"</{tag}>"))

    def stamp(c: str) -> Column:
        return F.concat(F.date_format(c, "yyyyMMddHHmmss"), F.lit(" +0000"))

    number = F.when(
        F.col("season").isNotNull() & F.col("episode").isNotNull(),
        F.concat(F.format_string('    <episode-num system="onscreen">S%02dE%02d</episode-num>\n', "season", "episode"), F.format_string('    <episode-num system="xmltv_ns">%d.%d.0/1</episode-num>', F.col("season") - 1, F.col("episode") - 1)),
    )
    opening = F.concat(F.lit('  <programme start="'), stamp("start"), F.lit('" stop="'), stamp("stop"), F.lit('" channel="'), escaped(F.col("channel")), F.lit('">'))
    body = F.concat_ws("\n", opening, element("title", F.col("title")), F.when(F.col("desc").isNotNull(), element("desc", F.col("desc"))), number, F.lit("  </programme>"))
    lines = _document(programmes, "place", body, ['<?xml version="1.0" encoding="UTF-8"?>', '<!DOCTYPE tv SYSTEM "xmltv.dtd">', "<tv>"], [F.lit("</tv>")])
    # channels stand between the head and the programmes, in order of their names
    lines = lines.withColumn("part", F.when(F.col("part") == 0, 0).otherwise(F.col("part") + 1)).withColumn("name", F.lit(""))
    own = programmes.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("place"), F.concat(F.lit('  <channel id="'), escaped(F.col("channel")), F.lit('">\n    <display-name>'), escaped(F.col("channel")), F.lit("</display-name>\n  </channel>")).alias("line"), F.col("channel").alias("name")).distinct()
    return lines.union(own)


def write_guide(lines: DataFrame, path: str) -> None:
    lines.repartitionByRange("part", "name", "place").sortWithinPartitions("part", "name", "place").select("line").write.mode("overwrite").text(path)


def edit_list(events: DataFrame, title: str, fps: int = 25) -> DataFrame:
    """Lines of an edit decision list of events (number, reel, source_in, source_out)."""
    return _document(events, "number", edl_line(F.col("number"), F.col("reel"), F.col("source_in"), F.col("source_out"), fps), [f"TITLE: {title}", "FCM: NON-DROP FRAME"], [])


def as_run(entries: DataFrame) -> DataFrame:
    """The columns of an as-run log from entries (id, scheduled_start, actual_start, scheduled_s, actual_s, title, content_id, channel, completed, error)."""
    late = F.unix_timestamp("actual_start") - F.unix_timestamp("scheduled_start")
    return entries.select(
        F.col("id").alias("ID"),
        F.date_format("scheduled_start", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("Scheduled Start"),
        F.date_format("actual_start", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("Actual Start"),
        F.col("title").alias("Title"),
        F.col("content_id").alias("Content ID"),
        F.col("channel").alias("Channel"),
        F.col("completed").alias("Completed"),
        F.coalesce("error", F.lit("")).alias("Error"),
        late.alias("Time Variance (s)"),
        F.abs(F.col("actual_s") - F.col("scheduled_s")).alias("Duration Variance (s)"),
    )
