"""Connected components of a bipartite graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import materialize, release

MAX_ROUNDS = 200


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of the left side of a bipartite graph; component is the smallest left node that
    can be reached. edges: two columns of one type each; nulls link nothing, repeated edges count once.

    Minimum labels go from left nodes to right nodes and back; then every label jumps to its own label's label, and the
    edges are rewritten to the labels and made distinct, so long chains shrink by a constant factor a round and hot
    nodes lose their edges. Each round ends in a written table, so lineage stays short and lost executors cost little.
    Only one number a round reaches the driver.
    """
    now = materialize(edges.select(F.col(left).alias("l"), F.col(right).alias("r")).dropna().distinct())
    mapping = materialize(now.select(F.col("l").alias("node"), F.col("l").alias("component")).distinct())
    for _ in range(MAX_ROUNDS):
        least = now.groupBy("r").agg(F.min("l").alias("m"))
        # the smallest label among a node's right neighbours' smallest, and that label's own: only what changes
        step = now.join(least, "r").groupBy("l").agg(F.min("m").alias("m")).where(F.col("m") < F.col("l"))
        jump = step.select(F.col("l").alias("m"), F.col("m").alias("m2"))
        moved = materialize(step.join(jump, "m", "left").select("l", F.coalesce("m2", "m").alias("m")))
        if moved.isEmpty():
            release(moved)
            break
        after = now.join(moved, "l", "left").select(F.coalesce("m", "l").alias("l"), "r").distinct()
        # a right node with one left neighbour joins nothing any more
        alone = after.groupBy("r").agg(F.count("*").alias("n")).where("n > 1").select("r")
        after = materialize(after.join(alone, "r", "left_semi"))
        composed = mapping.join(moved.select(F.col("l").alias("component"), "m"), "component", "left")
        composed = materialize(composed.select("node", F.coalesce("m", "component").alias("component")))
        for old in (now, mapping, moved):
            release(old)
        now, mapping = after, composed
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    release(now)
    return mapping
