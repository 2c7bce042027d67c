"""Helpers that the training-data operators share: shared storage, batches and worker set-up."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
_OWN_DIR: dict[str, str] = {}


#: Python workers are reused: these make them give freed memory back instead of keeping it from task to task.
WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> None:
    """Sets up the environment of Python workers, and lets them import this package from a source tree."""
    env = spark.sparkContext.environment
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`).

    Only a local master may go without the setting; it then gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="reelquarry-")
        spark.sparkContext.setCheckpointDir(_OWN_DIR[app])
    return _OWN_DIR[app]


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_base(spark)}/reelquarry/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Writes `df` to the shared folder and reads it back, which cuts its lineage."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table that `materialize` returned, once nothing reads it any more."""
    _delete(df.sparkSession, df.stored_at)


def discard_all(spark: SparkSession) -> None:
    """Deletes all that these operators have written to the shared folder; for when their results have been read or saved."""
    _delete(spark, f"{shared_base(spark)}/reelquarry")


#: Rows of a class from which its rows do not meet in one task, and classes of that many rows at most.
CROWD, CROWDS = 1 << 10, 1 << 16


def join_classes(rows: DataFrame, table: DataFrame, keys: list[str], classes: DataFrame, total: int) -> DataFrame:
    """rows.join(table, keys, "left") for a `table` with one row a class, however many rows a class has.

    `classes` has the keys and `copies`, `total` is the number of rows. Classes with more than CROWD rows and
    more than one in CROWDS of all rows number CROWDS at most: their rows of the table are broadcast.
    """
    crowds = classes.where(F.col("copies") > max(CROWD, total // CROWDS)).select(*keys)
    marked = rows.join(F.broadcast(crowds.withColumn("_crowd", F.lit(True))), keys, "left")
    few = marked.where("_crowd IS NULL").drop("_crowd").join(table.hint("merge"), keys, "left")
    many = marked.where("_crowd").drop("_crowd").join(F.broadcast(table.join(F.broadcast(crowds), keys, "left_semi")), keys, "left")
    return few.unionByName(many)


#: Bits of the table that tells which ids may be of interest; its size doesn't depend on the data.
ID_BITS = 24


def split_by_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` whose doc_id is one of `ids`, with a few others, and the rest; told by a bit table of fixed size, without a shuffle."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))
    bit = F.expr("shiftleft(1L, cast(_slot & 63 AS int))")
    words = ids.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    placed = docs.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6))
    some = placed.join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    rest = placed.join(F.broadcast(words), "_word", "left").where(F.coalesce(F.col("_bits").bitwiseAND(bit), F.lit(0)) == 0)
    return some.select(*docs.columns), rest.select(*docs.columns)


#: Parts in which the tables of one chunk are summed before they meet.
SUM_PARTS = 64


def sum_tables(rows: DataFrame, dtype: str, chunks: int) -> list:
    """Rows (chunk, sums) of the tables (chunk int, counts binary of `dtype`) summed by chunk, as 64-bit integers.

    Every task of the scan sent a table: they are summed in parts first, so that no task reads all of a chunk.
    """

    def total(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            sums: dict = {}
            for batch in batches:
                for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    part = np.frombuffer(raw, kind).astype("<i8")
                    sums[chunk] = sums[chunk] + part if chunk in sums else part
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "sums"])

        return run

    schema = "chunk int, sums binary"
    partial = rows.select("chunk", "counts").repartition(shuffle_partitions(rows.sparkSession), "chunk", F.pmod(F.xxhash64("counts"), F.lit(SUM_PARTS))).mapInArrow(total(dtype), schema)
    return partial.repartition(min(chunks, shuffle_partitions(rows.sparkSession)), "chunk").mapInArrow(total("<i8"), schema).collect()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that `column` (string or binary) holds about `max_bytes` in each, one row at least."""
    for batch in batches:
        total = batch.column(column).nbytes
        step = max(1, int(batch.num_rows * max_bytes / max(total, 1)))
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            if step > 1 and piece.column(column).nbytes > 4 * max_bytes:
                for i in range(piece.num_rows):
                    yield piece.slice(i, 1)
            else:
                yield piece


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
