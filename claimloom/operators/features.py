"""Sixteen features a claim: three of the claim alone, thirteen of the graph around it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.normalize import FLAG_AT
from claimloom.operators.blocks import grouped
from claimloom.operators.detect import WINDOW_DAYS, communities, community_verdicts, pagerank, rings
from claimloom.operators.graph import ENTITY, MAX_DEGREE, pruned
from claimloom.plans.durable import cut

# The names and order of the features.
TABULAR = ["claim_amount", "day_of_week", "is_weekend"]
GRAPH = [
    "entity_degree_min", "entity_degree_mean", "entity_degree_max", "idf_weighted_degree", "one_hop_entity_count", "two_hop_claim_count",
    "claimants_per_entity_1hop", "claimants_per_entity_2hop", "burstiness_2hop", "component_size", "leiden_community_size", "leiden_suspiciousness", "ppr_score",
]
ALL = TABULAR + GRAPH
#: Days and counts that lists of a cell hold on a side, claims that are worked at once.
CELL, CHUNK = 4_000_000, 2000


def tabular(claims: DataFrame) -> DataFrame:
    """Amount, weekday (Monday 0) and weekend of each claim; nulls count as 0."""
    day = F.coalesce(F.weekday("incident_date"), F.lit(0))
    return claims.select("claim_id", F.coalesce(F.col("claim_amount").cast("double"), F.lit(0.0)).alias("claim_amount"), day.cast("double").alias("day_of_week"), (day >= 5).cast("double").alias("is_weekend"))


def one_hop(of: DataFrame) -> DataFrame:
    """Degrees and weights of the entities of each claim."""
    d = F.col("degree")
    return of.groupBy("claim_id").agg(
        F.min(d).cast("double").alias("entity_degree_min"),
        F.avg(d).alias("entity_degree_mean"),
        F.max(d).cast("double").alias("entity_degree_max"),
        F.sum("weight").alias("idf_weighted_degree"),
        F.count("*").cast("double").alias("one_hop_entity_count"),
    )


def own(of: DataFrame) -> DataFrame:
    """What claims and their own entities tell: `tabular` and `one_hop` of every claim in the edge table."""
    claims = of.groupBy("claim_id").agg(F.first("claim_amount").alias("claim_amount"), F.first("incident_date").alias("incident_date"))
    return tabular(claims).join(one_hop(of), "claim_id")


def _combinations(kept: DataFrame) -> DataFrame:
    """(claim_id, date, key, sign, lone) for each combination of a claim's entities that have other claims: three entities make seven.

    A combination is kept by 128 bits of hash; the sign is that of its term in
    the union's size, less what combinations share.
    """
    sets = kept.where("degree > 1").groupBy("claim_id").agg(F.array_sort(F.collect_set(F.struct(*ENTITY))).alias("es"), F.first("incident_date").alias("date"))
    some = F.expr("explode(transform(sequence(1L, shiftleft(1L, size(es)) - 1), i -> filter(es, (e, k) -> bit_get(i, k) = 1)))")
    key = F.struct(F.xxhash64(F.lit(1), "s").alias("h"), F.xxhash64(F.lit(2), "s").alias("g")).alias("key")
    odd = F.size("s") % 2 == 1
    return sets.select("claim_id", F.unix_date("date").alias("date"), some.alias("s")).select("claim_id", "date", key, F.when(odd, 1).otherwise(-1).alias("sign"), (F.size("s") == 1).alias("lone"))


def _bursts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Burstiness of each claim of a cell. A cell's days by key come before its claims."""
    cell, known = None, {}
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        for at in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(cells)) + 1):
            if not len(at):
                continue
            if cells[at[0]] != cell:
                cell, known = cells[at[0]], {}
            part = batch.slice(at[0], len(at))
            days = part.filter(pa.compute.is_null(part.column("claim_id")))
            for key, found in zip(_keys(days, "a"), _lists(days.column("days")), strict=True):
                known[key] = found
            claims = part.filter(pa.compute.is_valid(part.column("claim_id")))
            for start in range(0, len(claims), CHUNK):
                yield _burst(claims.slice(start, CHUNK), known)


def _keys(batch: pa.RecordBatch, c: str) -> list:
    column = batch.column(c)
    h, g = (column.field(x).fill_null(0).to_numpy() for x in ("h", "g"))
    return list(zip(h.tolist(), g.tolist(), strict=True))


def _lists(column: pa.Array) -> list[np.ndarray]:
    """(2, n) of days and counts for each row of a list column."""
    ends = column.offsets.to_numpy()
    values = np.array([column.values.field(x).to_numpy(zero_copy_only=False) for x in (0, 1)], np.int64)
    return [values[:, i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _burst(claims: pa.RecordBatch, known: dict) -> pa.RecordBatch:
    rows, parts = [np.arange(len(claims))], [np.array([claims.column(c).fill_null(0).to_numpy() for c in ("date", "own")], np.int64)]
    parts[0][1][claims.column("date").is_null().to_numpy(zero_copy_only=False)] = 0
    rest = _lists(claims.column("days"))
    parts += rest
    rows.append(np.repeat(rows[0], [x.shape[1] for x in rest]))
    for c in ("a", "b"):
        there = claims.column(c).is_valid().to_numpy(zero_copy_only=False)
        found = [known[key] for key, is_ in zip(_keys(claims, c), there.tolist(), strict=True) if is_]
        parts += found
        rows.append(np.repeat(np.flatnonzero(there), [x.shape[1] for x in found]))
    row, (day, n) = np.concatenate(rows), np.concatenate(parts, axis=1)
    (row, day), (n,), _ = grouped([row, day], n)
    row, day, n = (x[n > 0] for x in (row, day, n))
    width = day.max(initial=0) - day.min(initial=0) + WINDOW_DAYS + 1
    at = row * width + day - day.min(initial=0)
    before = np.concatenate([[0], np.cumsum(n)])
    inside = before[np.searchsorted(at, at + WINDOW_DAYS, "right")] - before[:-1]
    most, whole = np.zeros(len(claims), np.int64), np.bincount(row, n, len(claims))
    np.maximum.at(most, row, inside)
    burst = np.where(whole >= 2, most / np.maximum(whole, 1), 0.0)
    return pa.record_batch([claims.column("claim_id"), claims.column("n"), pa.array(burst)], names=["claim_id", "two_hop_claim_count", "burstiness_2hop"])


def two_hop(of: DataFrame, limits: dict[str, int] | None = MAX_DEGREE) -> DataFrame:
    """Distinct other claims over a claim's entities, and the burstiness of all their dates; over entities within `limits`, or over all.

    No pair of claims is made: the size of a union is the sum over
    combinations of its claim's entities, with their signs, and so is its
    number of dates a day. A claim's two longest lists of days meet it in a
    cell of a grid, where each list goes to as many cells as a side has; other
    lists, which tend to be short, go with the claim.
    """
    session, kind = of.sparkSession, dict(of.dtypes)["claim_id"]
    made = cut(_combinations(of if limits is None else pruned(of, limits)))
    days = made.groupBy("key", "date").agg(F.count("*").alias("n"))
    listed = F.collect_list(F.when(F.col("date").isNotNull(), F.struct("date", F.col("n").cast("int").alias("n"))))
    lists = cut(days.groupBy("key").agg(F.sum("n").alias("n"), listed.alias("days")).where("n > 1"))
    sizes = cut(lists.select("key", "n", F.size("days").alias("length")))
    side = max(math.ceil((4 * session.sparkContext.defaultParallelism) ** 0.5), -(-(sizes.agg(F.sum("length")).first()[0] or 0) // CELL))
    term = F.struct((~F.col("lone")).alias("several"), (-F.col("length")).alias("length"), "key", "sign", "n")
    terms = cut(made.join(sizes, "key").groupBy("claim_id").agg(F.array_sort(F.collect_list(term)).alias("terms")))
    claims = of.groupBy("claim_id").agg(F.unix_date(F.first("incident_date")).alias("date")).join(terms, "claim_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast(terms.schema["terms"].dataType)))
    apart = lambda i: F.when(~F.get("terms", F.lit(i))["several"], F.get("terms", F.lit(i))["key"])
    total = lambda of_: F.aggregate("terms", F.lit(0).cast("long"), lambda a, x: a + of_(x))
    seat = lambda c: F.pmod(F.coalesce(F.xxhash64(c), F.xxhash64("claim_id")), F.lit(side))
    claims = claims.select("claim_id", "date", "terms", apart(0).alias("a"), apart(1).alias("b"), (1 - total(lambda x: x["sign"].cast("long"))).alias("own"), total(lambda x: x["sign"] * x["n"]).alias("n"))
    claims = cut(claims.withColumn("n", (F.col("n") + F.col("own") - 1).cast("double")).withColumn("cell", seat("a") * side + seat("b")))
    other = claims.select("claim_id", F.explode(F.filter("terms", lambda x: ~(x["key"].eqNullSafe(F.col("a")) | x["key"].eqNullSafe(F.col("b"))))).alias("t"))
    signed = F.transform("days", lambda d: F.struct(d["date"].alias("date"), (d["n"] * F.col("t.sign")).alias("n")))
    other = cut(other.join(lists, F.col("t.key") == lists["key"]).groupBy("claim_id").agg(F.flatten(F.collect_list(signed)).alias("days")))
    none = F.array().cast(other.schema["days"].dataType)
    claims_by_cell = claims.join(other, "claim_id", "left").select("cell", "claim_id", "date", "own", "n", "a", "b", F.coalesce("days", none).alias("days"))
    used = claims.select("cell", F.col("a").alias("key")).union(claims.select("cell", "b")).where("key is not null").distinct()
    null = lambda c: F.lit(None).cast(claims_by_cell.schema[c].dataType).alias(c)
    lists_by_cell = used.join(lists.select("key", "days"), "key").select("cell", null("claim_id"), null("date"), null("own"), null("n"), F.col("key").alias("a"), null("b"), F.col("days").cast(other.schema["days"].dataType).alias("days"))
    dealt = lists_by_cell.unionByName(claims_by_cell).repartition(side * side, "cell").sortWithinPartitions("cell", F.col("claim_id").isNotNull())
    return dealt.mapInArrow(_bursts, f"claim_id {kind}, two_hop_claim_count double, burstiness_2hop double")


def features(of: DataFrame, components: DataFrame | None = None, found: DataFrame | None = None, limits: dict[str, int] | None = MAX_DEGREE) -> DataFrame:
    """(claim_id, *ALL) of every claim in the edge table; claims without an edge have none.

    `components` and `found` are the graph's rings and community verdicts where they are known, `limits` those of `two_hop`.
    """
    components = cut(rings(of)) if components is None else components
    found = cut(community_verdicts(of, communities(of))) if found is None else found
    seeds = components.select("claim_id").unionByName(found.where(F.col("score") >= FLAG_AT).select("claim_id"))
    near = pagerank(of, seeds)
    wide = own(of).join(two_hop(of, limits), "claim_id")
    wide = wide.join(components.select("claim_id", F.col("ring_size").alias("cs")), "claim_id", "left")
    wide = wide.join(found.select("claim_id", F.col("ring_size").alias("ls"), F.col("score").alias("lv")), "claim_id", "left")
    wide = wide.join(near.withColumnRenamed("score", "pr"), "claim_id", "left")
    wide = wide.withColumns(
        {
            "claimants_per_entity_1hop": 1 / F.col("one_hop_entity_count"),
            "claimants_per_entity_2hop": (F.col("two_hop_claim_count") + 1) / F.col("one_hop_entity_count"),
            "component_size": F.coalesce("cs", F.lit(1)).cast("double"),
            "leiden_community_size": F.coalesce("ls", F.lit(1)).cast("double"),
            "leiden_suspiciousness": F.coalesce("lv", F.lit(0.0)),
            "ppr_score": F.coalesce("pr", F.lit(0.0)),
        }
    )
    return wide.select("claim_id", *ALL)


def features_of_claim(all_features: DataFrame, claim_id) -> DataFrame:
    return all_features.where(F.col("claim_id") == F.lit(claim_id))
