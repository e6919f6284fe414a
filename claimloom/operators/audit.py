"""The hash-chained audit log: canonical form, append, verify.

Appending to one claim's chain is sequential by nature; chains of different
claims are independent. Rows are sorted by claim and time inside partitions
and hashed as they stream by, so no chain is held in memory. Everything but
the link itself is serialised in the JVM beforehand. Verification is parallel
in every event: it compares each with the one before by an equi-join on
(claim, number).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

GENESIS = "0" * 64
KEY = ["claim_id", "seq"]


def _text(name: str, value: Column) -> Column:
    """`"name":value` in JSON, null written out."""
    whole = F.to_json(F.struct(value.cast("string").alias(name)), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def instant(at: Column) -> Column:
    """ISO time in UTC to the millisecond; without a fraction if it has none."""
    at = F.date_trunc("MILLISECOND", at)
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    ms = F.date_format(at, "SSS")
    return F.concat(whole, F.when(ms == "000", "").otherwise(F.concat(F.lit("."), ms)), F.lit("Z"))


def canonical_json(raw: Column) -> Column:
    """JSON text with the keys of every level sorted and no spaces; null for null and for what isn't JSON (see `malformed`)."""
    return F.to_json(F.try_parse_json(raw))


def malformed(events: DataFrame) -> DataFrame:
    """Events whose explanation isn't JSON, to be set aside before a batch is appended."""
    return events.where(F.col("explanation_json").isNotNull() & F.try_parse_json("explanation_json").isNull())


def _parts() -> tuple[Column, Column, Column]:
    """What stands before the link, between link and number, and after, keys in order."""
    c = F.col
    score = F.col("fraud_score").cast("decimal(5,4)").cast("string")
    explanation = F.concat(F.lit('"explanationJson":'), F.coalesce(canonical_json(c("explanation_json")), F.lit("null")))
    before = F.concat_ws(",", _text("actorId", c("actor_id")), _text("actorRole", c("actor_role")), _text("claimId", c("claim_id")), _text("eventType", c("event_type")), explanation, _text("fraudScore", score), _text("fromStatus", c("from_status")), _text("modelVersion", c("model_version")), _text("occurredAt", instant(c("occurred_at"))))
    return F.concat(F.lit("{"), before, F.lit(",")), F.concat(_text("reason", c("reason")), F.lit(","), _text("ringId", c("ring_id")), F.lit(",")), F.concat(F.lit(","), _text("toStatus", c("to_status")), F.lit("}"))


def parts_around_status() -> tuple[Column, Column, Column, Column]:
    """What stands around eventType, fromStatus, prevHash and seq, for whoever decides on these event by event."""
    c = F.col
    explanation = F.concat(F.lit('"explanationJson":'), F.coalesce(canonical_json(c("explanation_json")), F.lit("null")))
    score = c("fraud_score").cast("decimal(5,4)").cast("string")
    return (
        F.concat_ws(",", _text("actorId", c("actor_id")), _text("actorRole", c("actor_role")), _text("claimId", c("claim_id"))),
        F.concat_ws(",", explanation, _text("fraudScore", score)),
        F.concat_ws(",", _text("modelVersion", c("model_version")), _text("occurredAt", instant(c("occurred_at")))),
        F.concat_ws(",", _text("reason", c("reason")), _text("ringId", c("ring_id"))),
    )


def canonical(prev: Column, seq: Column) -> Column:
    """The canonical JSON of an event whose chain place is given."""
    before, between, after = _parts()
    return F.concat(before, F.lit('"prevHash":"'), prev, F.lit('",'), between, F.lit('"seq":'), seq.cast("string"), after)


def event_hash(prev: Column, seq: Column) -> Column:
    return F.sha2(F.concat(prev, canonical(prev, seq)), 256)


def append(events: DataFrame, last: DataFrame | None = None, order: tuple[str, ...] = ("occurred_at",)) -> DataFrame:
    """`events` with seq, prev_hash and hash, continuing the chains whose ends `last` has (claim_id, seq, hash).

    Events of a claim are chained by `order`; rows equal in it are ordered by
    their content. Times are cut to the millisecond.
    """
    before, between, after = _parts()
    rows = events.withColumn("occurred_at", F.date_trunc("MILLISECOND", "occurred_at")).withColumns({"__a": before, "__b": between, "__c": after})
    if last is None:
        rows = rows.withColumns({"__seq": F.lit(0), "__hash": F.lit(GENESIS)})
    else:
        ends = last.select("claim_id", F.col("seq").alias("__seq"), F.col("hash").alias("__hash"))
        rows = rows.join(ends, "claim_id", "left").withColumns({"__seq": F.coalesce("__seq", F.lit(0)), "__hash": F.coalesce("__hash", F.lit(GENESIS))})
    rows = rows.repartition("claim_id").sortWithinPartitions("claim_id", *order, "__a", "__b", "__c")
    kept = [f for f in events.schema.fields]
    out = StructType([*kept, StructField("seq", IntegerType()), StructField("prev_hash", StringType()), StructField("hash", StringType())])
    names = [f.name for f in kept]

    def step(batches):
        claim, seq, prev, first = None, 0, "", True
        for batch in batches:
            made: tuple[list, list, list] = ([], [], [])
            columns = [batch.column(n).to_pylist() for n in ("claim_id", "__a", "__b", "__c", "__seq", "__hash")]
            for c, a, b, z, start, end in zip(*columns, strict=True):
                if first or c != claim:
                    claim, seq, prev, first = c, start, end, False
                seq += 1
                digest = hashlib.sha256(f'{prev}{a}"prevHash":"{prev}",{b}"seq":{seq}{z}'.encode()).hexdigest()
                for held, value in zip(made, (seq, prev, digest), strict=True):
                    held.append(value)
                prev = digest
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(made[0], pa.int32()), pa.array(made[1], pa.string()), pa.array(made[2], pa.string())], [*names, "seq", "prev_hash", "hash"])

    return rows.mapInArrow(step, out)


def verify(chain: DataFrame) -> DataFrame:
    """(claim_id, events, valid): whether each link fits the event before it and each hash its event.

    Missing last events can't be noticed; a claim without events has no row.
    """
    previous = chain.select("claim_id", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("__prev"))
    joined = chain.join(previous, KEY, "left")
    expected = F.when(F.col("seq") == 1, F.lit(GENESIS)).otherwise(F.col("__prev"))
    good = F.coalesce((F.col("prev_hash") == expected) & (F.col("hash") == event_hash(F.col("prev_hash"), F.col("seq"))), F.lit(False))
    found = joined.select("claim_id", "seq", good.alias("good"))
    return found.groupBy("claim_id").agg(F.count("*").alias("events"), (F.bool_and("good") & (F.count("*") == F.count_distinct("seq"))).alias("valid"))


def altered(before: DataFrame, after: DataFrame) -> DataFrame:
    """(claim_id, seq, problem) of events in `before` that `after` has changed or lost; empty if it has only been appended to.

    The guard of a store that can't refuse updates itself: check it before a
    new version takes the old one's place.
    """
    names = [c for c in before.columns if c not in KEY]
    digest = lambda rows, name: rows.select(*KEY, F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256).alias(name))
    joined = digest(before, "__old").join(digest(after, "__new"), KEY, "left")
    problem = F.when(F.col("__new").isNull(), "deleted").when(F.col("__new") != F.col("__old"), "changed")
    return joined.select(*KEY, problem.alias("problem")).where("problem is not null")


def history(chain: DataFrame, claim_id) -> DataFrame:
    return chain.where(F.col("claim_id") == F.lit(claim_id)).orderBy("seq")


def latest(chain: DataFrame) -> DataFrame:
    """The last event of each claim."""
    rest = [c for c in chain.columns if c != "claim_id"]
    return chain.groupBy("claim_id").agg(F.max_by(F.struct(*rest), "seq").alias("e")).select("claim_id", "e.*")


def scored_before(chain: DataFrame) -> DataFrame:
    """(claim_id, model_version) that have a score event."""
    return chain.where("event_type = 'FRAUD_SCORED'").select("claim_id", "model_version").distinct()
