"""Entity resolution: claims to links, links to entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import normalize

#: Type, role and raw column of each kind of link.
KINDS = (
    ("PHONE", "CLAIMANT_PHONE", "claimant_phone", normalize.phone),
    ("ADDRESS", "CLAIMANT_ADDRESS", "claimant_address", normalize.address),
    ("SHOP", "REPAIR_SHOP", "repair_shop_name", normalize.shop),
)


def links(claims: DataFrame, *carried: str) -> DataFrame:
    """(claim_id, entity_type, canonical_value, role, raw_value, *carried columns): two or three rows a claim, in one pass.

    A blank shop gives no link; a phone that can't be read gives none either
    (see `bad_phones`). An address or shop may have an empty canonical value.
    """
    one = [F.struct(F.lit(t).alias("entity_type"), f(F.col(c)).alias("canonical_value"), F.lit(r).alias("role"), F.col(c).alias("raw_value")) for t, r, c, f in KINDS]
    each = claims.select("claim_id", *carried, F.explode(F.array(*one)).alias("l")).select("claim_id", "l.*", *carried)
    return each.where("canonical_value is not null and not (entity_type = 'SHOP' and trim(raw_value) = '')")


def bad_phones(claims: DataFrame) -> DataFrame:
    """Claims whose phone has no canonical form, set aside instead of failing the batch."""
    return claims.where(normalize.phone(F.col("claimant_phone")).isNull()).select("claim_id", "claimant_phone")


def entities(all_links: DataFrame, seen: str | None = None) -> DataFrame:
    """(entity_id, entity_type, canonical_value, claim_count, first_seen), one row an entity; ids follow from type and value.

    first_seen: the least value of the column `seen`, now if there is none.
    """
    first = F.min(seen) if seen else F.current_timestamp()
    counted = all_links.groupBy("entity_type", "canonical_value").agg(F.count("*").alias("claim_count"), first.alias("first_seen"))
    return counted.select(entity_id().alias("entity_id"), "entity_type", "canonical_value", "claim_count", "first_seen")


def entity_id():
    return F.sha2(F.concat_ws("\x1f", "entity_type", "canonical_value"), 256)


def upserted(old: DataFrame, new_links: DataFrame, seen: str | None = None) -> DataFrame:
    """Entities after more links: known ones count up and keep their first_seen, others are inserted."""
    new = entities(new_links, seen).drop("entity_id").withColumn("late", F.lit(1))
    both = old.select("entity_type", "canonical_value", "claim_count", "first_seen", F.lit(0).alias("late")).unionByName(new)
    counted = both.groupBy("entity_type", "canonical_value").agg(F.sum("claim_count").alias("claim_count"), F.min_by("first_seen", "late").alias("first_seen"))
    return counted.select(entity_id().alias("entity_id"), "entity_type", "canonical_value", "claim_count", "first_seen")


def backlog(claims: DataFrame, linked: DataFrame) -> DataFrame:
    """Claims that have no link yet."""
    return claims.join(linked.select("claim_id").distinct(), "claim_id", "left_anti")


def resolve_backlog(claims: DataFrame, linked: DataFrame) -> DataFrame:
    """Links of all claims that have none; run again on the union it gives nothing."""
    return links(backlog(claims, linked))


def find_entity(found: DataFrame, entity_type: str, canonical_value: str) -> DataFrame:
    return found.where((F.col("entity_type") == entity_type) & (F.col("canonical_value") == canonical_value))


def claims_for_entity(claims: DataFrame, all_links: DataFrame, entity_type: str, canonical_value: str) -> DataFrame:
    """Claims linked to one entity; none if there is no such entity."""
    return claims.join(find_entity(all_links, entity_type, canonical_value), "claim_id", "left_semi")
