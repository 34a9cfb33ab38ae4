"""Connected components of an edge table by alternating star contractions.

Every round is grouping and joining on node ids: *large star* hangs every
larger neighbour of a node on the smallest node it knows, *small star* hangs
the smaller neighbours (and the node) on their minimum.  The edge set turns
into one star per component after about log(n) rounds.  Minima are map-side
aggregates, so a hub with a third of all edges is one partial row per task;
rows are joined back to the written minima table (broadcast only within a
checked size, else a shuffle join whose skewed partitions Spark can split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import broadcast_within, save
from riskframe.sources.io import release_tables


def _state(edges: DataFrame) -> tuple:
    """Count and an order-free checksum of the edge set."""
    h = F.xxhash64("lo", "hi")
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"),
                  F.sum(F.shiftrightunsigned(h, 40)).alias("s")).first()
    return r["n"], r["x"], r["s"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another node;
    ``component`` is the smallest node id reachable.  Nodes without edges are
    their own component and are not returned.  Null ends and loops are ignored."""
    lo, hi = F.least(F.col(a), F.col(b)).alias("lo"), F.greatest(F.col(a), F.col(b)).alias("hi")
    e = save(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(lo, hi).distinct(), "cc-edges")
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
        # large star: v > u hangs on m(u)
        big = save(both.where("v > u").join(broadcast_within(least), "u")
                   .select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct(), "cc-large")
        release_tables(least)
        # small star: every hi and its smaller neighbours hang on their minimum
        least = save(big.groupBy("hi").agg(F.min("lo").alias("m")), "cc-min")
        hung = big.join(broadcast_within(least), "hi")
        e2 = save(hung.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo <> hi")
                  .unionByName(least.select(F.col("m").alias("lo"), "hi")).distinct(), "cc-edges")
        new = _state(e2)
        release_tables(e, big, least)               # the next round reads its own edges only
        e, done, state = e2, new == state, new
        if done:
            break
    else:
        raise RuntimeError("connected components did not converge")
    roots = e.select(F.col("lo").alias("node")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
