"""Degrees and component rings kept up to date by what is new, instead of being made anew.

The state is a few keyed tables in parts by bucket: links by entity and by
claim, degrees, each claim's group, each group's members, size and least
claim. A batch of claims reads the buckets of what it touches and writes a
part to each table; a key's newest row counts. A manifest, put in place when
all parts are written, makes the batch count; a batch that fails before leaves
nothing that is read, and one that is repeated adds nothing.

New links join groups: the smaller ones take the name of the largest, so a
claim moves a logarithmic number of times. Links also vanish, when an entity
grows beyond its degree limit: groups that it held together are taken apart,
and their claims are joined anew by the links that are left. An entity within
the limit has few claims, so what a batch reads is bounded by its own size and
that of the groups it takes apart or makes smaller.
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from claimloom.operators.connected import connected_components
from claimloom.operators.detect import MIN_RING
from claimloom.operators.entities import links
from claimloom.operators.graph import ENTITY, MAX_DEGREE, OTHER_MAX_DEGREE
from claimloom.operators.versions import Conflict, Manifests
from claimloom.plans.durable import cut, drop

#: The key that each table is bucketed by, and whether a key's newest row replaces the others.
_TABLES = {"by_entity": (ENTITY, False), "by_claim": (["claim_id"], False), "degree": (ENTITY, True), "label": (["claim_id"], True), "member": (["label"], False), "group": (["label"], True)}


#: Links of a bucket, about, and buckets at most.
BUCKET, MOST_BUCKETS = 50_000, 10_000


def buckets_for(links_expected: int) -> int:
    """Buckets for a network that is to hold so many links; a network keeps the number that it began with."""
    return max(1, min(MOST_BUCKETS, -(-links_expected // BUCKET)))


@dataclasses.dataclass
class Network(Manifests):
    """The network in the folder `path`, which all executors share."""

    limits: dict[str, int] = dataclasses.field(default_factory=lambda: dict(MAX_DEGREE))
    other_limit: int = OTHER_MAX_DEGREE
    buckets: int = 64
    most_parts: int = 16

    def _at(self) -> tuple[int, dict]:
        version = self.version()
        return version, self._manifest(version) if version else {"parts": {t: [] for t in _TABLES}, "buckets": self.buckets, "schemas": {}}

    @staticmethod
    def _bucket(key: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def _write(self, state: dict, table: str, rows: DataFrame, number: int) -> None:
        """A part of `table`, added to `state`."""
        name = f"{table}-{uuid.uuid4().hex}"
        rows = rows.withColumn("__n", F.lit(number))
        state["schemas"][table] = rows.schema.json()
        rows.withColumn("__bucket", self._bucket(_TABLES[table][0], state["buckets"])).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        state["parts"][table] = [*state["parts"][table], name]

    def _stored(self, state: dict, table: str, of: DataFrame | None = None) -> DataFrame | None:
        """Rows of `table` that count: all, or those with a key of `of`, of which only the buckets are read. None if there is none yet."""
        key, replaces = _TABLES[table]
        if not state["parts"][table]:
            return None
        schema = StructType.fromJson(json.loads(state["schemas"][table]))
        names = [c for c in schema.fieldNames() if c != "__n"]
        keys = None if of is None else cut(of.select(*key).distinct())
        touched = None if of is None else [r[0] for r in keys.select(self._bucket(key, state["buckets"])).distinct().collect()]  # no more than there are buckets
        found = None
        for part in state["parts"][table]:
            one = self.spark.read.schema(StructType([*schema.fields]).add("__bucket", IntegerType())).parquet(f"{self.path}/{part}")
            one = one if touched is None else one.where(F.col("__bucket").isin(touched))
            found = one.drop("__bucket") if found is None else found.unionByName(one.drop("__bucket"))
        if keys is not None:
            found = found.join(keys, key, "left_semi")
        if not replaces:
            return found.select(*names)
        rest = [c for c in names if c not in key]
        return found.groupBy(*key).agg(F.max_by(F.struct(*rest), "__n").alias("__row")).select(*key, "__row.*").select(*names)

    def _limit(self) -> Column:
        out = F.lit(self.other_limit)
        for kind, most in self.limits.items():
            out = F.when(F.col("entity_type") == kind, most).otherwise(out)
        return out

    def _members(self, state: dict, labels: DataFrame) -> DataFrame:
        """(claim_id, label) of the claims that are in these groups now."""
        once = cut(self._stored(state, "member", labels).select("claim_id", "label"))
        return once.join(self._stored(state, "label", once), ["claim_id", "label"])

    def add(self, claims: DataFrame) -> int:
        """Take a batch in; returns the network's version. Links that are known already count once."""
        version, state = self._at()
        number, first = version + 1, version == 0
        fresh = links(claims).select("claim_id", *ENTITY).distinct()
        if not first:
            fresh = cut(fresh)
            fresh = fresh.join(self._stored(state, "by_claim", fresh), ["claim_id", *ENTITY], "left_anti")
        fresh = cut(fresh)
        delta = cut(fresh.groupBy(*ENTITY).agg(F.count("*").alias("more")))
        known = self.spark.createDataFrame([], delta.select(*ENTITY, F.col("more").alias("degree")).schema) if first else self._stored(state, "degree", delta)
        before = F.coalesce(F.col("degree"), F.lit(0))
        degree = cut(delta.join(known, ENTITY, "left").select(*ENTITY, before.alias("before"), (before + F.col("more")).alias("degree"), self._limit().alias("limit")))
        live = degree.where("degree <= limit").select(*ENTITY)
        unlabelled = lambda rows: rows.select("claim_id").withColumn("label", F.lit(None).cast("string"))
        if first:
            edges = cut(fresh.join(live, ENTITY, "left_semi"))
            loose, taken, held = unlabelled(fresh.limit(0)), None, unlabelled(edges.distinct()).distinct()
        else:
            # the claims that touched entities have had, of those that were within the limit
            within = degree.where("before > 0 and before <= limit")
            old = cut(self._stored(state, "by_entity", within).select("claim_id", *ENTITY))
            gone = old.join(degree.where("before > 1 and before <= limit and degree > limit").select(*ENTITY), ENTITY, "left_semi")
            taken = cut(self._stored(state, "label", gone).where("label is not null").select("label").distinct())
            loose = cut(self._members(state, taken).select("claim_id"))
            theirs = cut(self._stored(state, "by_claim", loose).select("claim_id", *ENTITY))
            # a degree of this batch replaces the stored one
            stored = self._stored(state, "degree", theirs).join(degree.select(*ENTITY), ENTITY, "left_anti").where(F.col("degree") <= self._limit()).select(*ENTITY)
            left = theirs.join(cut(stored.unionByName(live)), ENTITY, "left_semi")
            edges = cut(fresh.unionByName(old).join(live, ENTITY, "left_semi").unionByName(left).distinct())
            current = self._stored(state, "label", edges).join(taken, "label", "left_anti").select("claim_id", "label")
            held = edges.select("claim_id").distinct().join(current, "claim_id", "left").select("claim_id", "label")
        held = cut(held)
        # a group takes part as one vertex, any other claim by itself
        vertex = F.when(F.col("label").isNotNull(), F.concat(F.lit("l"), "label")).otherwise(F.concat(F.lit("c"), F.col("claim_id").cast("string")))
        ends = cut(edges.join(held.withColumn("v", vertex), "claim_id").select("v", *ENTITY).distinct())
        hub = cut(ends.groupBy(*ENTITY).agg(F.min("v").alias("hub"), F.max("v").alias("last")).where("hub <> last"))
        found = connected_components(ends.join(hub, ENTITY).where("v <> hub").select("v", "hub"), "v", "hub").toDF("v", "component")
        kept = held.where("label is not null").select("label").distinct()
        sizes = None if first else self._stored(state, "group", kept)
        alone = held.where("label is null").select(vertex.alias("v"), F.lit(None).cast("string").alias("label"), F.lit(1).cast("long").alias("size"), F.col("claim_id").alias("least"), "claim_id")
        parts = alone if sizes is None else alone.unionByName(sizes.select(F.concat(F.lit("l"), "label").alias("v"), "label", "size", "least", F.lit(None).cast(alone.schema["claim_id"].dataType).alias("claim_id")))
        joined = cut(parts.join(found, "v"))
        best = F.max_by("label", F.when(F.col("label").isNotNull(), F.struct("size", "label")))
        made = cut(joined.groupBy("component").agg(best.alias("old"), F.sum("size").alias("size"), F.min("least").alias("least")))
        made = made.withColumn("to", F.coalesce("old", F.concat(F.lit(f"{number}-"), F.col("least").cast("string"))))
        moved = cut(joined.join(made.select("component", "to"), "component").where("label is null or label <> to").select("label", "claim_id", "to"))
        placed = moved.where("label is null").select("claim_id", F.col("to").alias("label"))
        empty = moved.where("label is not null").select("label")
        if not first:
            carried = self._members(state, empty).join(moved.where("label is not null").select("label", "to"), "label").select("claim_id", F.col("to").alias("label"))
            placed = placed.unionByName(carried)
            empty = empty.unionByName(taken)
        placed = cut(placed)
        single = unlabelled(loose.join(placed.select("claim_id"), "claim_id", "left_anti"))
        groups = made.select(F.col("to").alias("label"), "size", "least")
        groups = groups.unionByName(empty.select("label", F.lit(0).cast("long").alias("size"), F.lit(None).cast(groups.schema["least"].dataType).alias("least")))
        after = {"parts": dict(state["parts"]), "schemas": dict(state["schemas"]), "buckets": state["buckets"]}
        for table, rows in (("by_entity", fresh), ("by_claim", fresh), ("degree", degree.select(*ENTITY, "degree")), ("label", placed.unionByName(single)), ("member", placed.select("label", "claim_id")), ("group", groups)):
            self._write(after, table, rows, number)
        self._merge(after, number)
        if not self._put(number, after):
            raise Conflict("another batch was taken in meanwhile; add this one again")
        drop(fresh, delta, degree, edges, held, ends, hub, joined, moved, placed)
        return number

    def _merge(self, state: dict, number: int) -> None:
        """Tables with too many parts get one part of the rows that count."""
        for table in _TABLES:
            if len(state["parts"][table]) > self.most_parts:
                whole = self._stored(state, table)
                state["parts"][table] = []
                self._write(state, table, cut(whole), number)

    def degrees(self) -> DataFrame:
        """(entity_type, canonical_value, degree)."""
        return self._stored(self._at()[1], "degree")

    def rings(self, least: int = MIN_RING) -> DataFrame:
        """(claim_id, ring_id, ring_size): what `detect.rings` gives of all claims so far."""
        state = self._at()[1]
        groups = cut(self._stored(state, "group").where(F.col("size") >= least))
        found = self._stored(state, "label").join(groups, "label")
        return found.select("claim_id", F.concat(F.lit("kcore-"), F.col("least").cast("string")).alias("ring_id"), F.col("size").alias("ring_size"))
