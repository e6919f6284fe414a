"""The detector ladder: components, communities, personalised PageRank, and their merger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.normalize import FLAG_AT, per_entity, suspiciousness
from claimloom.operators import blocks, leiden
from claimloom.operators.connected import connected_components
from claimloom.operators.graph import ENTITY, MAX_DEGREE, pruned
from claimloom.plans.durable import cut

MIN_RING = 3
# The score of a component ring, and the proximity above which a claim is reported.
COMPONENT_SCORE, PROXIMITY = 0.9, 0.05
DAMPING = 0.85
#: PageRank: residual by the largest score at which rounds end, rounds that would be an error.
TOLERANCE, MAX_ROUNDS = 1e-11, 150
RESOLUTION = 1.2
WINDOW_DAYS = 14


def claim_components(of: DataFrame) -> DataFrame:
    """(claim_id, component) of claims that share entities of `of`, directly or not; component: the least claim id.

    An entity links each of its claims to its least claim, so there are no
    more links than edges, whatever the degrees.
    """
    hub = cut(of.groupBy(*ENTITY).agg(F.min("claim_id").alias("hub"), F.max("claim_id").alias("last")).where("hub <> last"))
    star = of.join(hub, ENTITY).where("claim_id <> hub").select("claim_id", "hub")
    found = connected_components(star, "claim_id", "hub").toDF("claim_id", "component")
    claims = of.select("claim_id").distinct()
    return claims.join(found, "claim_id", "left").select("claim_id", F.coalesce("component", "claim_id").alias("component"))


def rings(of: DataFrame, limits: dict[str, int] = MAX_DEGREE, least: int = MIN_RING) -> DataFrame:
    """(claim_id, ring_id, ring_size): components of the pruned graph with `least` claims or more.

    Edges are stored with what components need, as these read them three
    times. What one claim alone has links nothing and is left out before.
    """
    kept = pruned(of, limits).where(F.col("degree") > 1) if least > 1 else pruned(of, limits)
    found = cut(claim_components(cut(kept.select("claim_id", *ENTITY))))
    size = cut(found.groupBy("component").agg(F.count("*").alias("ring_size")).where(F.col("ring_size") >= least))
    return found.join(size, "component").select("claim_id", F.concat(F.lit("kcore-"), F.col("component").cast("string")).alias("ring_id"), "ring_size")


def burstiness(dated: DataFrame, group: list[str], date: str = "incident_date") -> DataFrame:
    """(*group, burstiness): the largest share of a group's dates in a window of 14 days after one of them.

    Dates are counted by day first, so the window sorts at most one row a day
    and group. Null dates don't count; fewer than two dates: 0.
    """
    days = dated.groupBy(*group, date).agg(F.count(date).alias("n"))
    ahead = Window.partitionBy(*group).orderBy(F.unix_date(date)).rangeBetween(0, WINDOW_DAYS)
    # null dates stay, as a row that counts nothing and is in no window but its own, so that no group has to be joined back
    seen = days.withColumn("w", F.sum("n").over(ahead)).groupBy(*group).agg(F.max("w").alias("w"), F.sum("n").alias("all"))
    return seen.select(*group, F.when(F.col("all") >= 2, F.col("w") / F.col("all")).otherwise(0.0).alias("burstiness"))


def _ids(of: DataFrame) -> DataFrame:
    """Edges with one string id for a claim and one for an entity."""
    return of.select(F.concat(F.lit("c"), F.col("claim_id").cast("string")).alias("c"), F.concat_ws(":", F.lit("e"), *ENTITY).alias("e"), "weight", "claim_id")


def both_ways(of: DataFrame) -> DataFrame:
    """(v, o, weight): each edge from either end."""
    ids = _ids(of)
    return ids.select(F.col("c").alias("v"), F.col("e").alias("o"), "weight").unionByName(ids.select(F.col("e").alias("v"), F.col("c").alias("o"), "weight"))


def communities(of: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """(id, community): modularity communities of the whole weighted graph at `resolution`; ids as in `_ids`.

    Levels of moving, refining and merging, see `leiden`. Every community is
    connected and named after its least member; no vertex would gain by moving
    to another. Reruns on as many blocks give the same communities.
    """
    found = leiden.communities(cut(_ids(of).select("c", "e", "weight")), resolution)
    names = cut(found.groupBy("label").agg(F.min("id").alias("community")))
    return found.join(names, "label").select("id", "community")


def modularity(of: DataFrame, member_of: DataFrame, resolution: float = RESOLUTION) -> float:
    """Weighted modularity of a partition of the graph, at a resolution."""
    base = _ids(of).join(member_of.select(F.col("id").alias("c"), F.col("community").alias("mc")), "c").join(member_of.select(F.col("id").alias("e"), F.col("community").alias("me")), "e")
    inside, total = base.agg(F.sum(F.when(F.col("mc") == F.col("me"), F.col("weight")).otherwise(0.0)), F.sum("weight")).first()
    masses = base.select(F.col("mc").alias("m"), "weight").unionByName(base.select(F.col("me").alias("m"), "weight")).groupBy("m").agg(F.sum("weight").alias("k"))
    spread = masses.agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / total - resolution * spread / (2 * total) ** 2 if total else 0.0


def community_faults(of: DataFrame, member_of: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """(rule, broken): how often a partition breaks what communities promise.

    Every vertex has one community; a community is connected; no vertex gains
    by moving to another; modularity isn't below that of single vertices.
    """
    base = cut(_ids(of).select("c", "e", "weight"))
    both = cut(both_ways(of))
    total = base.agg(F.sum("weight")).first()[0] or 1.0
    k = both.groupBy("v").agg(F.sum("weight").alias("k"))
    placed = cut(member_of.select(F.col("id").alias("v"), F.col("community").alias("m")).join(k, "v"))
    mass = cut(placed.groupBy("m").agg(F.sum("k").alias("mass")))
    to = both.join(placed.select(F.col("v").alias("o"), "m"), "o").groupBy("v", "m").agg(F.sum("weight").alias("w"))
    own = placed.join(mass, "m").join(to, ["v", "m"], "left").select("v", F.col("m").alias("own"), "k", (F.coalesce("w", F.lit(0.0)) - resolution * F.col("k") * (F.col("mass") - F.col("k")) / (2 * total)).alias("stay"))
    moves = to.join(mass, "m").join(own, "v").where("m <> own")
    gains = moves.where(F.col("w") - resolution * F.col("k") * F.col("mass") / (2 * total) > F.col("stay") + 1e-8).select("v").distinct()
    inside = base.join(placed.select(F.col("v").alias("c"), F.col("m").alias("mc")), "c").join(placed.select(F.col("v").alias("e"), F.col("m").alias("me")), "e").where("mc = me")
    parts = connected_components(inside, "c", "e").toDF("v", "part")
    apart = placed.join(parts, "v", "left").groupBy("m").agg(F.count_distinct(F.coalesce("part", "v")).alias("n")).where("n > 1")
    alone = -resolution * (placed.agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0) / (2 * total) ** 2
    vertices = base.select("c").union(base.select("e")).distinct()
    broken = {
        "vertices without one community": vertices.count() - member_of.select("id").distinct().count() + member_of.count() - member_of.select("id").distinct().count(),
        "communities in several parts": apart.count(),
        "single moves that gain": gains.count(),
        "modularity below that of single vertices": int(modularity(of, member_of, resolution) < alone),
    }
    return of.sparkSession.createDataFrame(list(broken.items()), "rule string, broken long")


def community_verdicts(of: DataFrame, member_of: DataFrame, least: int = MIN_RING) -> DataFrame:
    """(claim_id, ring_id, ring_size, score) of communities with `least` claims or more."""
    claims = of.groupBy("claim_id").agg(F.first("incident_date").alias("incident_date")).withColumn("id", F.concat(F.lit("c"), F.col("claim_id").cast("string")))
    placed = cut(claims.join(member_of, "id").select("claim_id", "incident_date", "community"))
    size = placed.groupBy("community").agg(F.count("*").alias("ring_size"), F.min("claim_id").alias("first_id")).where(F.col("ring_size") >= least)
    entities = member_of.where("id like 'e:%'").groupBy("community").agg(F.count("*").alias("entities"))
    scored = size.join(entities, "community", "left").join(burstiness(placed, ["community"]), "community")
    scored = scored.select("community", "ring_size", F.concat(F.lit("comm-"), F.col("first_id").cast("string")).alias("ring_id"), suspiciousness(per_entity(F.col("ring_size"), F.coalesce("entities", F.lit(0))), F.col("burstiness")).alias("score"))
    return placed.join(scored, "community").select("claim_id", "ring_id", "ring_size", "score")


def pagerank(of: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(claim_id, score) of claims that aren't seeds: personalised PageRank over weighted edges, by the largest score of any vertex.

    The restart is uniform over `seeds` (claim_id). Claims and entities of one
    edge are eliminated: what is left is a linear system over shared entities
    whose eigenvalues lie between 1 - damping^2 and 1, as the graph is
    undirected, and Chebyshev iteration solves it with a third of the error
    left after each round (power iteration: 0.85). Rounds go on until the
    largest residual is below `tolerance` times the largest of their scores,
    `MAX_ROUNDS` would be an error, not a result. A round is two supersteps of
    `blocks`. Empty without seeds.
    """
    start = cut(of.join(seeds.select("claim_id").distinct(), "claim_id", "left_semi").select("claim_id").distinct())
    return blocks.pagerank(of, start, ENTITY, damping, tolerance, MAX_ROUNDS)


def verdicts(of: DataFrame, component_rings: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(claim_id, fraud_score, rung, ring_id, ring_size) for every claim of the graph.

    A claim has its component ring's score or its community's (`found`, see
    `community_verdicts`), whichever is higher, components first at a tie.
    Claims from the flag threshold on seed PageRank, which gives those without
    a verdict their proximity if it is above `PROXIMITY`; all others have 0.
    """
    sure = component_rings.select("claim_id", F.lit(COMPONENT_SCORE).alias("fraud_score"), F.lit("k_core").alias("rung"), "ring_id", "ring_size")
    if found is not None:
        both = sure.unionByName(found.select("claim_id", F.col("score").alias("fraud_score"), F.lit("leiden").alias("rung"), "ring_id", "ring_size"))
        best = F.max_by(F.struct("fraud_score", "rung", "ring_id", "ring_size"), F.struct("fraud_score", F.col("rung") == "k_core"))
        sure = both.groupBy("claim_id").agg(best.alias("b")).select("claim_id", "b.*")
    sure = cut(sure)
    near = pagerank(of, sure.where(F.col("fraud_score") >= FLAG_AT))
    near = near.join(sure.select("claim_id"), "claim_id", "left_anti").where(F.col("score") > PROXIMITY)
    near = near.select("claim_id", F.round("score", 4).alias("fraud_score"), F.lit("ppr").alias("rung"), F.lit(None).cast("string").alias("ring_id"), F.lit(None).cast("long").alias("ring_size"))
    known = sure.unionByName(near)
    claims = of.select("claim_id").distinct()
    return claims.join(known, "claim_id", "left").select("claim_id", F.coalesce("fraud_score", F.lit(0.0)).alias("fraud_score"), F.coalesce("rung", F.lit("none")).alias("rung"), "ring_id", "ring_size")


def detect(of: DataFrame) -> DataFrame:
    """The whole ladder over an edge table."""
    return verdicts(of, rings(of), community_verdicts(of, communities(of)))


def ring_members(found: DataFrame) -> DataFrame:
    """(ring_id, members, first_claim, last_claim) of every ring; member lists stay rows of `found`."""
    return found.where("ring_id is not null").groupBy("ring_id").agg(F.count("*").alias("members"), F.min("claim_id").alias("first_claim"), F.max("claim_id").alias("last_claim"))


def flagged(score: Column) -> Column:
    return score >= FLAG_AT
