"""Sources and sinks: media scans, filters, watch folders, ordered text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: file extensions of media
MEDIA = ("mp4", "mkv", "webm", "mov", "ogg", "flac", "wav", "mp3", "ts", "jpg", "png")


def scan_media(spark: SparkSession, path: str, extensions: tuple[str, ...] = MEDIA, content: bool = False, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length and extension of media files of a folder, by name pattern if given; bytes only on demand."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = files.withColumn("extension", ext).where(F.col("extension").isin(*extensions))
    return out if content else out.drop("content")


def file_filter(least: int | None = None, most: int | None = None, extensions: tuple[str, ...] | None = None, since: str | None = None) -> Column:
    """Predicate over scanned files; bounds are inclusive, missing ones are open."""
    out = F.lit(True)
    if least is not None:
        out = out & (F.col("length") >= least)
    if most is not None:
        out = out & (F.col("length") <= most)
    if extensions:
        out = out & F.col("extension").isin(*extensions)
    if since:
        out = out & (F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    return out


def watch_folder(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of new files in a folder, so many at a time."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(path)


def export(df: DataFrame, path: str, kind: str) -> None:
    """Writes a table as csv (with header), json, xml or parquet."""
    writer = df.write.mode("overwrite")
    match kind:
        case "csv":
            writer.option("header", True).csv(path)
        case "json":
            writer.json(path)
        case "xml":
            writer.option("rowTag", "programme").option("rootTag", "tv").xml(path)
        case "parquet":
            writer.parquet(path)
        case _:
            raise ValueError(f"unknown kind {kind!r}")


def export_lines(df: DataFrame, path: str, order: list[str], line: Column) -> None:
    """Ordered text export: range-partitioned and sorted, so that files in name order hold the lines in order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")).write.mode("overwrite").text(path)


def edl_line(number: Column, reel: Column, src_in: Column, src_out: Column, fps: int = 25) -> Column:
    from reelquarry.functions.text import timecode

    return F.format_string("%03d  %-8s V     C        %s %s", number, reel, timecode(src_in, fps), timecode(src_out, fps))


def import_clips(spark: SparkSession, path: str, into: str, extensions: tuple[str, ...] = MEDIA) -> DataFrame:
    """Adds the media files of a folder to a clip table (file_path, name, extension, size, created_at); files that it has already are left out."""
    found = scan_media(spark, path, extensions)
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", "")
    clips = found.select(F.col("path").alias("file_path"), name.alias("name"), "extension", F.col("length").alias("size"), F.col("modificationTime").alias("created_at"))
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(into)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        clips = clips.join(spark.read.parquet(into).select("file_path"), "file_path", "left_anti")
    clips.write.mode("append").parquet(into)
    return spark.read.parquet(into)


def drain(stream: DataFrame, handle, checkpoint: str):
    """Hands all that has arrived to `handle(batch, number)` in micro-batches, then ends; the checkpoint keeps what was handed over."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def namespaces(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW NAMESPACES")
