"""Scans, imports, exports and streams over temporary folders."""

from pyspark.sql import functions as F

from reelquarry.sources import exports as X
from reelquarry.sources import files as S
from reelquarry.streaming import events as E


def lines(spark, path):
    return [r.value for p in sorted(x for x in __import__("os").listdir(path) if x.startswith("part")) for r in spark.read.text(f"{path}/{p}").collect()]


def test_scan_filter_and_import(spark, tmp_path):
    media = tmp_path / "in"
    (media / "sub").mkdir(parents=True)
    for name, size in (("a.MP4", 10), ("b.wav", 200), ("c.txt", 5), ("sub/d.mkv", 50)):
        (media / name).write_bytes(b"x" * size)
    found = S.scan_media(spark, str(media))
    assert sorted((r.extension, r.length) for r in found.collect()) == [("mkv", 50), ("mp4", 10), ("wav", 200)] and "content" not in found.columns
    assert [r.length for r in found.where(S.file_filter(least=20, most=100)).collect()] == [50]
    assert [r.length for r in S.scan_media(spark, str(media), glob="*.wav", recursive=False).collect()] == [200]
    assert found.where(S.file_filter(since="2001-01-01")).count() == 3 and found.where(S.file_filter(extensions=("wav",))).count() == 1
    assert S.import_clips(spark, str(media), str(tmp_path / "clips")).count() == 3
    (media / "e.mp3").write_bytes(b"y")
    again = S.import_clips(spark, str(media), str(tmp_path / "clips"))
    assert sorted(r.name for r in again.collect()) == ["a", "b", "d", "e"]


def test_watched_files_are_drained_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"1")
    seen = []
    for _ in range(2):
        S.drain(S.watch_folder(spark, str(tmp_path / "in")), lambda df, n: seen.extend(r.path[-5:] for r in df.select("path").collect()), str(tmp_path / "state")).awaitTermination(60)
    assert seen == ["a.bin"]


def test_table_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id long, t string")
    for kind in ("csv", "json", "parquet"):
        S.export(df, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2 and spark.read.json(str(tmp_path / "json")).where("id = 1").first().t == "a,b"
    S.export_lines(df, str(tmp_path / "lines"), ["id"], F.format_string("%d", "id"))
    assert lines(spark, str(tmp_path / "lines")) == ["1", "2"]


def test_playlists(spark, tmp_path):
    e = spark.createDataFrame([(1, "a.mp4", "A & B", "x", 61.9), (2, "b.mp4", None, None, None)], "place long, uri string, title string, artist string, duration_s double")
    got = {}
    for kind in X.PLAYLISTS:
        X.write_document(X.playlist(e, kind), str(tmp_path / kind))
        got[kind] = lines(spark, str(tmp_path / kind))
    assert got["m3u"] == ["#EXTM3U", "#EXTINF:61,A & B", "a.mp4", "#EXTINF:-1,b.mp4", "b.mp4"]
    assert got["m3u8"][2:4] == ['#EXTINF:61,artist="x" tvg-name="A & B"', "a.mp4"]
    assert got["pls"] == ["[playlist]", "File1=a.mp4", "Title1=A & B", "Length1=61", "File2=b.mp4", "NumberOfEntries=2", "Version=2"]
    assert "      <title>A &amp; B</title>" in got["xspf"] and got["xspf"][-1] == "</playlist>" and "      <duration>61900</duration>" in got["xspf"]


def test_guide_edit_list_and_as_run(spark, tmp_path):
    p = spark.createDataFrame([(1, "z<1", 0, 60, "en", "T", None, 2, 3), (2, "a", 60, 90, None, "U", "d", None, None)], "place long, channel string, s long, e long, lang string, title string, desc string, season int, episode int")
    p = p.withColumn("start", F.timestamp_seconds("s")).withColumn("stop", F.timestamp_seconds("e"))
    X.write_guide(X.guide(p), str(tmp_path / "tv"))
    got = lines(spark, str(tmp_path / "tv"))
    assert got[2] == "<tv>" and got[3] == '  <channel id="a">' and got[6] == '  <channel id="z&lt;1">' and got[-1] == "</tv>"
    assert '  <programme start="19700101000000 +0000" stop="19700101000100 +0000" channel="z&lt;1">' in got and '    <episode-num system="onscreen">S02E03</episode-num>' in got
    ev = spark.createDataFrame([(1, "R1", 0, 50)], "number long, reel string, source_in long, source_out long")
    X.write_document(X.edit_list(ev, "cut"), str(tmp_path / "edl"))
    assert lines(spark, str(tmp_path / "edl")) == ["TITLE: cut", "FCM: NON-DROP FRAME", "001  R1       V     C        00:00:00:00 00:00:02:00"]
    run = p.select(F.col("place").alias("id"), F.col("start").alias("scheduled_start"), F.col("stop").alias("actual_start"), F.lit(10).alias("scheduled_s"), F.lit(7).alias("actual_s"), "title", F.lit("c").alias("content_id"), "channel", F.lit(True).alias("completed"), F.lit(None).cast("string").alias("error"))
    row = X.as_run(run).orderBy("ID").first()
    assert row["Time Variance (s)"] == 60 and row["Duration Variance (s)"] == 3 and row["Error"] == "" and row["Scheduled Start"] == "1970-01-01T00:00:00Z"


def test_streams(spark, tmp_path):
    src = spark.range(40).select((F.col("id") % 30).alias("event_id"), F.lit("view").alias("kind"), F.timestamp_seconds(F.col("id") % 30 * 10 + 1_000_000).alias("ts"), (F.col("id") % 30 % 4).cast("double").alias("value"))
    src.write.parquet(str(tmp_path / "in"))

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(90)
        return spark.table(name).collect()

    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    assert sorted(r.event_id for r in run(E.distinct_events(stream), "distinct_rows")) == list(range(30))
    scored = run(E.z_scores(E.critical(stream, ("view",)).where("event_id < 10"), 5), "scored")
    assert len(scored) >= 10 and all(r.z is None or abs(r.z) < 3 for r in scored)


def test_flow_statistics(spark):
    df = spark.createDataFrame([("a", 0, 10, 1, 2.0, 100), ("a", 30, 10, 1, 4.0, 50), ("b", 0, 0, 0, None, 0)], "flow string, t long, sent long, lost long, jitter_ms double, bytes long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.flow: (r.loss_rate, r.jitter_ms, r.bps) for r in E.flow_statistics(df).collect()}
    assert got == {"a": (0.1, 3.0, 20.0), "b": (0.0, 0.0, 0.0)}
