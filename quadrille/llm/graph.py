"""Connected components on edge tables, by alternating large-star and small-star contraction.

Both steps need a minimum per vertex, which Spark combines before the shuffle, and one join back,
whose hot keys adaptive execution splits; no neighbourhood is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.shared import Scratch

EDGES_A_FILE = 50_000


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """edges: (hi, lo), hi > lo. Each vertex's neighbours (smaller ones only, unless both) go to its least one."""
    arcs = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if both:
        arcs = arcs.unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = arcs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = arcs.join(least, "u")
    if both:
        out = joined.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.where("hi > lo").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60, limit: int | None = None) -> DataFrame:
    """(id, component) of every vertex with an edge; component: the least id reachable. Loops and repeated edges are harmless.

    limit: a bound of the number of edges, where one is known. Without edges there are no rows.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct(), f"{name}-0", limit)
    state, n = None, now.count()
    for i in range(1, rounds + 1):
        # neither star makes more edges than it reads and vertices there are
        step = scratch.save(_star(_star(now, True), False), f"{name}-{i}", 4 * n, EDGES_A_FILE)
        seen = step.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        n = seen[0]
        scratch.drop(f"{name}-{i - 1}")
        now = step
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
