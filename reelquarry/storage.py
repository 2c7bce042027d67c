"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession

_OWN: set[str] = set()
#: Rows that a task of a large shuffle holds: what is to be sorted or aggregated by one task doesn't grow with the input.
TASK_ROWS = 1 << 19


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, which survives lost executors and cuts the lineage.

    It goes to `spark.checkpoint.dir`; only a local master may go without that setting and gets a temporary folder.
    """
    spark: SparkSession = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN.add(app)
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="reelquarry-"))
    return df.checkpoint()


def tasks_for(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int | None:
    """Partitions of about `each` rows, or None if the session's number of partitions does."""
    parts = -(-rows // each)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, parts: int | None, *keys: str | Column) -> DataFrame:
    """`df` dealt by keys over that many partitions, or over the session's."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)
