"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquarry.llm.common import discard, materialize

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node long, component long), the least node of each component.

    Every round keeps the components and brings nodes nearer to their least one, so the number of
    rounds grows with the logarithm of the longest path. Each round is written to the shared folder.
    Nodes without an edge, and rows with a null, are left out.
    """
    known = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    known = materialize(known, "components")
    state = _state(known)
    for _ in range(MAX_ROUNDS):
        # large star: greater neighbours move to the least neighbour
        both = known.union(known.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        grown = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself move to the least one
        least = grown.groupBy("u").agg(F.min("v").alias("m"))
        moved = grown.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, known = known, materialize(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        discard(before)
        last, state = state, _state(known)
        if state == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return known.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(known.select("v", "v").distinct())
