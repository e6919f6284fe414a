"""The claim workflow: who may move a claim where, applied to whole tables of requests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import audit
from claimloom.operators.entities import links
from claimloom.functions import normalize

# The transitions and the roles that may make them.
TRANSITIONS = (
    ("SUBMITTED", "UNDER_REVIEW", "ADJUSTER"),
    ("SUBMITTED", "UNDER_REVIEW", "SYSTEM"),
    ("SUBMITTED", "FLAGGED", "SYSTEM"),
    ("UNDER_REVIEW", "FLAGGED", "ADJUSTER"),
    ("UNDER_REVIEW", "APPROVED", "ADJUSTER"),
    ("UNDER_REVIEW", "DENIED", "ADJUSTER"),
    ("FLAGGED", "UNDER_REVIEW", "INVESTIGATOR"),
    ("FLAGGED", "DENIED", "INVESTIGATOR"),
    ("FLAGGED", "APPROVED", "INVESTIGATOR"),
)
NEEDS_REASON = ("FLAGGED", "APPROVED")
SCORING_ACTOR = "scoring-service"
STATUSES = ("SUBMITTED", "UNDER_REVIEW", "FLAGGED", "APPROVED", "DENIED")


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "from_status string, to_status string, role string")


def checked(requests: DataFrame) -> DataFrame:
    """`requests` (from_status, to_status, role, reason, ...) with outcome: 409, 403, 400 or 200, in this order of checks."""
    rules = F.broadcast(transitions(requests.sparkSession).groupBy("from_status", "to_status").agg(F.collect_set("role").alias("__roles")))
    found = requests.join(rules, ["from_status", "to_status"], "left")
    needs = (F.col("from_status") == NEEDS_REASON[0]) & (F.col("to_status") == NEEDS_REASON[1]) & F.coalesce(F.trim("reason") == "", F.lit(True))
    outcome = F.when(F.col("__roles").isNull(), 409).when(~F.coalesce(F.array_contains("__roles", F.col("role")), F.lit(False)), 403).when(needs, 400).otherwise(200)
    return found.select(*requests.columns, outcome.alias("outcome"))


def folded(claims: DataFrame, requests: DataFrame, order: tuple[str, ...] = ("requested_at",)) -> DataFrame:
    """Requests (claim_id, to_status, role, reason, ...) applied to (claim_id, status, version) one after another.

    Returns `requests` with from_status, outcome, status and version after
    each. A refused request (404 unknown claim, 409, 403, 400) changes
    nothing; an accepted one counts the version up. Requests of a claim go by
    `order`, equal ones by their content, as a stream through one sort, so a
    claim's requests are never held together.
    """
    known = claims.select("claim_id", F.col("status").alias("__status"), F.col("version").cast("long").alias("__version"))
    rest = [c for c in requests.columns if c not in order and c != "claim_id"]
    rows = requests.join(known, "claim_id", "left").repartition("claim_id").sortWithinPartitions("claim_id", *order, *rest)
    allowed: dict[tuple[str, str], set[str]] = {}
    for a, b, role in TRANSITIONS:
        allowed.setdefault((a, b), set()).add(role)
    new = [("from_status", pa.string()), ("outcome", pa.int32()), ("status", pa.string()), ("version", pa.int64())]

    def outcome(status, to, role, reason):
        if status is None:
            return 404
        if (status, to) not in allowed:
            return 409
        if role not in allowed[status, to]:
            return 403
        return 400 if (status, to) == NEEDS_REASON and not (reason or "").strip() else 200

    names = requests.columns

    def step(batches):
        claim, status, version, first = None, None, None, True
        for batch in batches:
            made: list[tuple] = []
            for c, to, role, reason, start, number in zip(*[batch.column(batch.schema.names.index(n)).to_pylist() for n in ("claim_id", "to_status", "role", "reason", "__status", "__version")], strict=True):
                if first or c != claim:
                    claim, status, version, first = c, start, number, False
                found, before = outcome(status, to, role, reason), status
                if found == 200:
                    status, version = to, (version or 0) + 1
                made.append((before, found, status, version))
            columns = list(zip(*made, strict=True)) if made else [()] * 4
            kept = [batch.column(batch.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(list(v), t) for v, (_, t) in zip(columns, new, strict=True)]], [*names, *[n for n, _ in new]])

    types = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields], "from_status string, outcome int, status string, version long"])
    return rows.mapInArrow(step, types)


def transition_events(requests: DataFrame) -> DataFrame:
    """Audit events of the requests that pass; a flag overridden is HUMAN_OVERRIDE, else STATUS_CHANGED."""
    ok = checked(requests).where("outcome = 200")
    kind = F.when((F.col("from_status") == NEEDS_REASON[0]) & (F.col("to_status") == NEEDS_REASON[1]), "HUMAN_OVERRIDE").otherwise("STATUS_CHANGED")
    return event_rows(ok, event_type=kind, to_status=F.col("to_status"), actor_id=F.col("actor_id"), actor_role=F.col("role"), reason=F.col("reason"))


def event_rows(rows: DataFrame, **given) -> DataFrame:
    """Rows of the audit table without chain columns: from `given`, else from a column of that name, else null."""
    types = {"event_type": "string", "from_status": "string", "to_status": "string", "actor_id": "string", "actor_role": "string", "reason": "string", "fraud_score": "decimal(5,4)", "ring_id": "string", "explanation_json": "string", "model_version": "string", "occurred_at": "timestamp"}
    value = lambda n: given[n] if n in given else F.col(n) if n in rows.columns else F.lit(None)
    return rows.select("claim_id", *[value(n).cast(t).alias(n) for n, t in types.items()])


def apply_scores(claims: DataFrame, scores: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """One row for each claim and model not scored before: from_status, to_status, and what the event needs.

    FLAG leads to FLAGGED, any other hint to UNDER_REVIEW, but only from where
    SYSTEM may go; a late score is recorded and moves nothing. Scores of
    unknown claims are left out, repeated ones count once.
    """
    fresh = scores.dropDuplicates(["claim_id", "model_version"])
    if chain is not None:
        fresh = fresh.join(audit.scored_before(chain), ["claim_id", "model_version"], "left_anti")
    joined = fresh.join(claims.select("claim_id", F.col("status").alias("from_status")), "claim_id")
    target = F.when(F.col("decision_hint") == "FLAG", "FLAGGED").otherwise("UNDER_REVIEW")
    may = F.lit(False)
    for a, b, role in TRANSITIONS:
        if role == "SYSTEM":
            may = may | ((F.col("from_status") == a) & (target == b))
    return joined.withColumn("to_status", F.when(may, target).otherwise(F.col("from_status")))


def score_events(applied: DataFrame) -> DataFrame:
    return event_rows(applied, event_type=F.lit("FRAUD_SCORED"), actor_id=F.lit(SCORING_ACTOR), actor_role=F.lit("SYSTEM"))


def narrative_events(told: DataFrame) -> DataFrame:
    """NARRATIVE_GENERATED events of (claim_id, status, narrative, grounded, model_version, actor_id, actor_role, occurred_at); status stays."""
    text = F.to_json(F.struct("narrative", "grounded"))
    return event_rows(told, event_type=F.lit("NARRATIVE_GENERATED"), from_status=F.col("status"), to_status=F.col("status"), explanation_json=text)


def validated(rows: DataFrame) -> DataFrame:
    """`rows` with problems: the names of the fields that make a claim unacceptable."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    wrong = {c: blank(c) for c in ("claimant_name", "policy_number", "claimant_phone", "claimant_address")}
    wrong["claim_amount"] = F.coalesce(F.col("claim_amount") <= 0, F.lit(True))
    wrong["incident_date"] = F.col("incident_date").isNull()
    return rows.withColumn("problems", F.filter(F.array(*[F.when(w, c) for c, w in sorted(wrong.items())]), lambda x: x.isNotNull()))


def create_claims(rows: DataFrame) -> dict[str, DataFrame]:
    """The step that takes new claims in: claims, links, audit events and outbox rows of the acceptable, and the rejected."""
    judged = validated(rows)
    bad = (F.size("problems") > 0) | normalize.phone(F.col("claimant_phone")).isNull()
    good = judged.where(~bad).drop("problems").withColumns({"status": F.lit("SUBMITTED"), "created_at": F.current_timestamp()})
    events = event_rows(good, event_type=F.lit("CLAIM_CREATED"), to_status=F.lit("SUBMITTED"), actor_id=F.lit("api"), actor_role=F.lit("SYSTEM"), occurred_at=F.col("created_at"))
    outbox = good.select(F.sha2(F.concat(F.lit("claim.submitted:"), F.col("claim_id").cast("string")), 256).alias("id"), F.col("claim_id").alias("aggregate_id"), F.lit("claim.submitted").alias("topic"), F.to_json(F.struct(F.col("claim_id").cast("string").alias("claim_id"))).alias("payload"), "created_at", F.lit(None).cast("timestamp").alias("sent_at"))
    return {"claims": good, "links": links(good), "events": audit.append(events), "outbox": outbox, "rejected": judged.where(bad)}
