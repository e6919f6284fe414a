"""Connected components of an undirected graph given as an edge table.

Randomised contraction: in each round every vertex points at the neighbour
(or itself) with the smallest hash of that round, edges are rewritten to the
targets, and loops vanish. The expected number of vertices falls by a constant
factor a round whatever the graph's shape, so long chains and large stars need
logarithmically many rounds, each a partially aggregated minimum and two
equi-joins that adaptive execution can split when one vertex is hot.
Rounds go on until no edge is left; the round tables are then composed
backwards, and the component id is the smallest vertex id of its members.
A round's edges are deleted once the next round's are stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.plans.durable import cut, drop

def _targets(edges: DataFrame, turn: int) -> DataFrame:
    """For each vertex the vertex it points at: the one of least hash in its closed neighbourhood."""
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))
    both = edges.select("a", order("b").alias("best")).unionByName(edges.select(F.col("b").alias("a"), order("a").alias("best")))
    return both.groupBy("a").agg(F.min("best").alias("best")).select("a", F.least("best", order("a"))["v"].alias("r"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex that an edge names.

    Nulls: an edge with a null end is ignored. Loops keep their vertex as a
    component of its own unless other edges join it. Repeated and reversed
    edges count once. An empty edge table gives an empty result.
    """
    pair = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    known = cut(pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    loops = known.where("a = b").select("a")
    live, stored = known.where("a <> b"), None
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        to = cut(_targets(live, len(rounds)))
        rounds.append(to)
        moved = live.join(to.withColumnRenamed("r", "ra"), "a").drop("a")
        moved = moved.join(to.select(F.col("a").alias("b"), F.col("r").alias("rb")), "b")
        live = cut(moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if stored is not None:
            drop(stored)
        stored = live
    if not rounds:
        return loops.select(F.col("a").alias("vertex"), F.col("a").alias("component"))
    label = rounds[-1]
    for to in reversed(rounds[:-1]):
        last = label.select(F.col("a").alias("r"), F.col("r").alias("root"))
        label = to.join(last, "r", "left").select("a", F.coalesce("root", "r").alias("r"))
    label = cut(label)
    drop(stored, *rounds)
    least = cut(label.groupBy("r").agg(F.min("a").alias("component")))  # stored, so that the join can split a large component
    found = label.join(least, "r").select(F.col("a").alias("vertex"), "component")
    if loops.isEmpty():
        return found
    alone = loops.join(label.select("a"), "a", "left_anti")
    return found.unionByName(alone.select(F.col("a").alias("vertex"), F.col("a").alias("component")))
