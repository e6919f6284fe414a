"""One keyed state for all that happens to a claim: people's requests and scores in one stream.

A claim's state is what the claims table says to begin with: status, version,
the head of its audit chain and the models that have scored it. Each event is
judged by the status of its time, so a score that comes after a person's
decision is recorded and moves nothing. The chain goes on from the head in the
state; no history is read.

Spark hands over each key by itself, and a Python worker asks for each state by
itself, which costs milliseconds a key. So claims are kept by bucket, some
hundred of them a key at ten million claims.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from claimloom.operators import audit, workflow

EVENTS = "claim_id string, at timestamp, kind string, model_version string, decision_hint string, fraud_score decimal(5,4), ring_id string, explanation_json string, to_status string, role string, actor_id string, reason string"
JUDGED = "claim_id string, kind string, occurred_at timestamp, outcome int, event_type string, from_status string, to_status string, actor_id string, actor_role string, reason string, fraud_score decimal(5,4), ring_id string, explanation_json string, model_version string, version long, seq int, prev_hash string, hash string"
#: What is kept of a claim.
HELD = "claim_id: string, status: string, version: bigint, seq: int, hash: string, scored: array<string>"
#: Keys that claims are dealt out to; a batch reads and writes the whole buckets of its claims. A stream keeps the number that it began with.
BUCKETS = 1 << 16
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scores_as_events(scores: DataFrame) -> DataFrame:
    """Scores (claim_id, at, model_version, decision_hint, ...) as events of kind SCORE."""
    return _events(scores, kind=F.lit("SCORE"), role=F.lit("SYSTEM"), actor_id=F.lit(workflow.SCORING_ACTOR))


def requests_as_events(requests: DataFrame) -> DataFrame:
    """Requests (claim_id, at, to_status, role, actor_id, reason) as events of kind REQUEST."""
    return _events(requests, kind=F.lit("REQUEST"))


def _events(rows: DataFrame, **given) -> DataFrame:
    fields = [x.split() for x in EVENTS.replace("(5,4)", "(5;4)").split(", ")]
    value = lambda n: given[n] if n in given else F.col(n) if n in rows.columns else F.lit(None)
    return rows.select(*[value(n).cast(t.replace(";", ",")).alias(n) for n, t in fields])


class ClaimProcessor(StatefulProcessor):
    """Judges the events of a bucket's claims, each claim's one after another, and chains those that count."""

    def init(self, handle) -> None:
        self.held = handle.getValueState("claims", f"claims array<struct<{HELD}>>")
        self.allowed: dict[tuple[str, str], set[str]] = {}
        for a, b, role in workflow.TRANSITIONS:
            self.allowed.setdefault((a, b), set()).add(role)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.held.update(([(c["claim_id"], c["status"], c["version"] or 0, c["seq"] or 0, c["hash"] or audit.GENESIS, list(c["scored"] or [])) for c in initialState.claims],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.held.get()
        claims = {c[0]: tuple(c[1:]) for c in held[0]} if held is not None else {}
        events: dict[str, list[Row]] = {}
        for e in rows:
            events.setdefault(e.claim_id, []).append(e)
        changed = False
        for claim, of in events.items():
            before = claims.get(claim)
            after, judged = self._folded(before, of)
            yield from judged
            if after != before:
                claims[claim], changed = after, True
        if changed:
            self.held.update(([(claim, *state) for claim, state in claims.items()],))

    def _folded(self, state: tuple | None, events: list) -> tuple[tuple | None, list[Row]]:
        """A claim's state after a batch's events, and these as judged."""
        status, version, seq, head, scored = state if state is not None else (None, 0, 0, audit.GENESIS, [])
        scored, out = list(scored), []
        # a batch's events of one claim, by time and then by content
        for e in sorted(events, key=lambda e: (e.at is None, e.at, e.kind, e.model_version or "", e.to_status or "", e.part_a, e.part_c)):
            outcome, to = self._judged(e, status, scored)
            kind = None
            if outcome == 200:
                override = (status, to) == workflow.NEEDS_REASON
                kind = "FRAUD_SCORED" if e.kind == "SCORE" else "HUMAN_OVERRIDE" if override else "STATUS_CHANGED"
                seq, prev = seq + 1, head
                head = hashlib.sha256(f'{prev}{{{e.part_a},"eventType":"{kind}",{e.part_b},"fromStatus":"{status}",{e.part_c},"prevHash":"{prev}",{e.part_d},"seq":{seq},"toStatus":"{to}"}}'.encode()).hexdigest()
                version += e.kind == "REQUEST" or to != status
                out.append(self._row(e, outcome, kind, status, to, version, seq, prev, head))
                status = to
            else:
                out.append(self._row(e, outcome, kind, status, to, version, None, None, None))
        return state if status is None else (status, version, seq, head, scored), out

    def _judged(self, e, status: str | None, scored: list[str]) -> tuple[int, str | None]:
        """404 unknown claim, 208 a model's score again, 409, 403, 400 or 200; and where the claim goes."""
        if status is None:
            return 404, None
        if e.kind == "SCORE":
            if e.model_version in scored:
                return 208, status
            scored.append(e.model_version)
            to = "FLAGGED" if e.decision_hint == "FLAG" else "UNDER_REVIEW"
            return 200, to if "SYSTEM" in self.allowed.get((status, to), ()) else status
        roles = self.allowed.get((status, e.to_status))
        if roles is None:
            return 409, e.to_status
        if e.role not in roles:
            return 403, e.to_status
        if (status, e.to_status) == workflow.NEEDS_REASON and not (e.reason or "").strip():
            return 400, e.to_status
        return 200, e.to_status

    @staticmethod
    def _row(e, outcome, kind, status, to, version, seq, prev, head) -> Row:
        return Row(claim_id=e.claim_id, kind=e.kind, occurred_at=e.at, outcome=outcome, event_type=kind, from_status=status, to_status=to, actor_id=e.actor_id, actor_role=e.role, reason=e.reason, fraud_score=e.fraud_score, ring_id=e.ring_id, explanation_json=e.explanation_json, model_version=e.model_version, version=version, seq=seq, prev_hash=prev, hash=head)

    def close(self) -> None:
        pass


def initial_states(claims: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """What the stream starts from: (claim_id, status, version, seq, hash, scored) of claims (claim_id, status, version) and their audit chains."""
    rows = claims.select(F.col("claim_id").cast("string").alias("claim_id"), "status", F.col("version").cast("long").alias("version"))
    none = {"seq": F.lit(None).cast("int"), "hash": F.lit(None).cast("string"), "scored": F.lit(None).cast("array<string>")}
    if chain is None:
        return rows.withColumns(none)
    models = F.collect_set(F.when(F.col("event_type") == "FRAUD_SCORED", F.col("model_version")))
    heads = chain.groupBy(F.col("claim_id").cast("string").alias("claim_id")).agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"), models.alias("scored"))
    return rows.join(heads, "claim_id", "left")


def judged(events: DataFrame, states: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of `events` (see `EVENTS`) judged by each claim's state; `states` is where new streams begin.

    Every event comes out with its outcome; those of outcome 200 are events of
    the audit chain with seq, prev_hash and hash. Order: by time among the
    events of a claim that come in one batch, else as they come. Needs the
    RocksDB state store, which `started` sets.
    """
    a, b, c, d = audit.parts_around_status()
    whole = events.withColumn("at", F.date_trunc("MILLISECOND", "at"))
    named = whole.withColumns({"occurred_at": F.col("at"), "actor_role": F.col("role")})
    bucket = F.pmod(F.xxhash64("claim_id"), F.lit(buckets)).cast("int").alias("bucket")
    rows = named.select(bucket, *whole.columns, a.alias("part_a"), b.alias("part_b"), c.alias("part_c"), d.alias("part_d"))
    held = states.groupBy(bucket).agg(F.collect_list(F.struct(*[x.split(":")[0] for x in HELD.split(", ")])).alias("claims"))
    return rows.groupBy("bucket").transformWithState(ClaimProcessor(), JUDGED, "Append", "None", held.groupBy("bucket"))


def started(stream: DataFrame, sink_path: str, checkpoint: str):
    """Starts writing a judged stream as Parquet, with its state in RocksDB."""
    spark: SparkSession = stream.sparkSession
    name, old = "spark.sql.streaming.stateStore.providerClass", None
    old = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink_path)
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)
