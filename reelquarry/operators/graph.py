"""Graph operators on (src, dst) edge tables: levels, ancestry, reachability, cycles."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquarry.storage import checkpoint

# Joins of the walks are hinted as merge joins: a broadcast would send nodes or edges to the driver at every step.

#: Steps after which the rows found so far are put into one frame, so that plans stay short.
TOGETHER = 16


class CycleError(ValueError):
    pass


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the longest path from a node without predecessors. A cycle raises CycleError.

    Peels the nodes whose open predecessors are gone, one level at a time.
    """
    left_nodes, left_edges = checkpoint(nodes.select("node").distinct()), checkpoint(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    out = None
    for level in count():
        ready = checkpoint(left_nodes.join(left_edges.select(F.col("dst").alias("node")).distinct().hint("merge"), "node", "left_anti"))
        if ready.isEmpty():
            break
        found = ready.select("node", F.lit(level).cast("long").alias("level"))
        out = found if out is None else out.union(found)
        if level % TOGETHER == TOGETHER - 1:
            out = checkpoint(out.repartition("node"))
        left_nodes = checkpoint(left_nodes.join(ready.hint("merge"), "node", "left_anti"))
        left_edges = checkpoint(left_edges.join(ready.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti"))
    if not left_nodes.isEmpty():
        raise CycleError("the graph has a cycle")
    return out if out is not None else left_nodes.select("node", F.lit(0).cast("long").alias("level"))


def has_cycle(nodes: DataFrame, edges: DataFrame) -> bool:
    try:
        topological_levels(nodes, edges)
    except CycleError:
        return True
    return False


def ancestors(seeds: DataFrame, edges: DataFrame, depth_limit: int | None = None) -> DataFrame:
    """(node, ancestor, depth) from each seed against the edges, itself at depth 0; cycles end at repeats.

    Walks until nothing new is found, or for `depth_limit` steps if one is given.
    """
    frontier = seeds.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    out = frontier
    edges = checkpoint(edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst")))
    for step_no in count() if depth_limit is None else range(depth_limit):
        step = frontier.join(edges.hint("merge"), F.col("ancestor") == F.col("_dst")).select("node", F.col("_src").alias("ancestor"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = checkpoint(step.join(out.select("node", "ancestor").hint("merge"), ["node", "ancestor"], "left_anti").select("node", "ancestor", "depth"))
        if frontier.isEmpty():
            return out
        out = out.union(frontier)
        if step_no % TOGETHER == TOGETHER - 1:
            out = checkpoint(out.repartition("node", "ancestor"))
    return out


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct nodes that the seeds reach, themselves included."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return ancestors(seeds, back).select(F.col("ancestor").alias("node")).distinct()


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("node").join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def neighbours(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).union(edges.select("dst", "src")).distinct()


def best_children(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, child, weight): of each node the child of greatest weight, the greatest id on ties. weights (node, weight)."""
    w = weights.select(F.col("node").alias("child"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    known = edges.select(F.col("src").alias("node"), F.col("dst").alias("child")).distinct().join(w, "child", "left")
    best = F.max_by(F.struct("child", "weight"), F.struct(F.coalesce("weight", F.lit(0.0)), "child"))
    return known.groupBy("node").agg(best.alias("b")).select("node", "b.child", F.coalesce("b.weight", F.lit(0.0)).alias("weight"))


def hot_path(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(step, node) from the root of greatest weight down the heaviest children; a node seen before ends the walk.

    Every step is one lookup in the table of best children.
    """
    spark = edges.sparkSession
    sources = edges.select(F.col("src").alias("node")).distinct()
    start = roots(sources, edges).join(weights, "node", "left").orderBy(F.desc_nulls_last("weight"), F.desc("node")).limit(1).first()
    if start is None:
        return spark.createDataFrame([], f"step long, node {dict(sources.dtypes)['node']}")
    best, path = checkpoint(best_children(edges, weights)), [start.node]
    while (step := best.where(F.col("node") == path[-1]).first()) is not None and step.child not in path:
        path.append(step.child)
    return spark.createDataFrame(list(enumerate(path)), f"step long, node {dict(sources.dtypes)['node']}")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node's links (src, dst) lead to; nodes without a link are left out.

    Large and small stars in turns: greater neighbours move to the least one, then smaller ones and the node do. Each
    round is checkpointed; the number of rounds grows with the logarithm of the longest path.
    """
    known = checkpoint(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    size = None
    while True:
        both = known.union(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        grown = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = grown.groupBy("u").agg(F.min("v").alias("m"))
        known = checkpoint(grown.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct())
        state = tuple(known.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == size:
            return known.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(known.select("v", "v").distinct())
        size = state
