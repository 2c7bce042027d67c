"""Driver tables, and the media entities that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquarry.storage import dealt, tasks_for


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View events: item_id, user_id, t (epoch seconds), duration, kind, event_id."""
    return load(spark, sf_dir, "events").select(
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        "user_id",
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"),
        F.col("value").alias("duration"),
        F.col("event_type").alias("kind"),
        "event_id",
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating 1 to 5), one row each: line items of a customer's orders. Large tables are dealt over more tasks, not larger ones."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = tasks_for(spark, lines.count())
    if parts:
        lines, orders = dealt(lines, parts, "l_orderkey"), dealt(orders, parts, "o_orderkey")
    rated = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (1 + F.col("l_linenumber") % 5).cast("double").alias("rating"))
    return (dealt(rated, parts, "user_id", "item_id") if parts else rated).groupBy("user_id", "item_id").agg(F.max("rating").alias("rating"))


#: The same entities for DuckDB, to be put after WITH.
VIEWS_SQL = """views AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, user_id,
  CAST(floor(epoch(ts)) AS BIGINT) AS t, value AS duration, event_type AS kind, event_id FROM events)"""
RATINGS_SQL = """ratings AS (SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(max(1 + l_linenumber % 5) AS DOUBLE) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
