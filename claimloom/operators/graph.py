"""The bipartite claim-entity graph as an edge table; claims are never joined to claims."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.normalize import idf_weight
from claimloom.operators.entities import links
from claimloom.plans.durable import cut

ENTITY = ["entity_type", "canonical_value"]
# The degree beyond which an entity links too many claims to say anything.
MAX_DEGREE = {"PHONE": 50, "ADDRESS": 1, "SHOP": 50}
OTHER_MAX_DEGREE = 50


def edges(claims: DataFrame, as_of: datetime.date | str | None = None) -> DataFrame:
    """(claim_id, entity_type, canonical_value, claim_amount double, incident_date, degree, weight).

    With `as_of` only claims up to that day exist, and degrees count these
    alone. Degrees are pre-aggregated, stored and joined back: a join of
    rows with a stored table can split an entity with a third of all claims.
    Links are stored as well, so that claims are made and normalised once.
    """
    if as_of is not None:
        claims = claims.where(F.col("incident_date") <= F.lit(str(as_of)).cast("date"))
    linked = cut(links(claims.withColumn("claim_amount", F.col("claim_amount").cast("double")), "claim_amount", "incident_date").select("claim_id", *ENTITY, "claim_amount", "incident_date"))
    degree = cut(linked.groupBy(*ENTITY).agg(F.count("*").alias("degree")))
    return linked.join(degree, ENTITY).select("claim_id", *ENTITY, "claim_amount", "incident_date", "degree", idf_weight(F.col("degree")).alias("weight"))


def vertices(of: DataFrame) -> DataFrame:
    """(kind, name, degree): claims and entities that have an edge."""
    claims = of.groupBy(F.col("claim_id").cast("string").alias("name")).agg(F.count("*").alias("degree")).select(F.lit("claim").alias("kind"), "name", "degree")
    others = of.groupBy(*ENTITY).agg(F.count("*").alias("degree")).select(F.lit("entity").alias("kind"), F.concat_ws(":", *ENTITY).alias("name"), "degree")
    return claims.unionByName(others)


def pruned(of: DataFrame, limits: dict[str, int] = MAX_DEGREE, other: int = OTHER_MAX_DEGREE) -> DataFrame:
    """Edges of entities whose degree is within the limit of their type."""
    limit = F.lit(other)
    for kind, most in limits.items():
        limit = F.when(F.col("entity_type") == kind, most).otherwise(limit)
    return of.where(F.col("degree") <= limit)


def neighbours(of: DataFrame) -> DataFrame:
    """(claim_id, other_id, entity_type, canonical_value) for claims that share an entity; bound degrees before."""
    other = of.select(F.col("claim_id").alias("other_id"), *ENTITY)
    return of.select("claim_id", *ENTITY).join(other, ENTITY).where("claim_id <> other_id").select("claim_id", "other_id", *ENTITY)
