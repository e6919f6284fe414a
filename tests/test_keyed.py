import datetime
import random

from claimloom.operators import audit, workflow
from claimloom.streaming import keyed

T = datetime.datetime(2026, 1, 1, 8)


def _events(n=120):
    r = random.Random(4)
    rows = []
    for i in range(n):
        at, claim = T + datetime.timedelta(minutes=i), f"c{r.randrange(12)}"
        if r.random() < 0.4:
            rows.append((claim, at, "SCORE", r.choice(["m1", "m2", "m3"]), r.choice(["FLAG", "REVIEW"]), None, None, None, "SYSTEM", workflow.SCORING_ACTOR))
        else:
            rows.append((claim, at, "REQUEST", None, None, r.choice(workflow.STATUSES), r.choice([None, " ", "because"]), '{"b":1,"a":"é"}', r.choice(["ADJUSTER", "INVESTIGATOR"]), "p\"x"))
    return rows


def _fold(rows, start):
    """Status by status, in order of time."""
    status, scored, out = dict(start), set(), []
    for claim, _, kind, model, hint, to, reason, _, role, _ in sorted(rows, key=lambda x: x[1]):
        now = status.get(claim)
        if now is None:
            out.append((claim, 404, None))
        elif kind == "SCORE":
            if (claim, model) in scored:
                out.append((claim, 208, now))
                continue
            scored.add((claim, model))
            to = "FLAGGED" if hint == "FLAG" else "UNDER_REVIEW"
            status[claim] = to if (now, to, "SYSTEM") in workflow.TRANSITIONS else now
            out.append((claim, 200, status[claim]))
        else:
            pairs = {x[:2] for x in workflow.TRANSITIONS}
            bad = 409 if (now, to) not in pairs else 403 if (now, to, role) not in workflow.TRANSITIONS else 400 if (now, to) == workflow.NEEDS_REASON and not (reason or "").strip() else 200
            if bad == 200:
                status[claim] = to
            out.append((claim, bad, to))
    return out, status


def test_stream_equals_fold_over_restarts(spark, tmp_path):
    rows, folder = _events(), str(tmp_path)
    start = {f"c{i}": "SUBMITTED" if i % 4 else "APPROVED" for i in range(11)}  # c11 is unknown
    states = keyed.initial_states(spark.createDataFrame([(c, s, 3) for c, s in start.items()], "claim_id string, status string, version int"))
    named = "claim_id string, at timestamp, kind string, model_version string, decision_hint string, to_status string, reason string, explanation_json string, role string, actor_id string"
    for part in (rows[:70], rows[70:]):
        frame = spark.createDataFrame(part, named).repartition(5)
        keyed._events(frame).write.mode("append").parquet(f"{folder}/in")
        stream = keyed.judged(spark.readStream.schema(keyed.EVENTS).parquet(f"{folder}/in"), states)
        keyed.started(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    want, status = _fold(rows, start)
    got = [(r.claim_id, r.outcome, r.to_status) for r in found.orderBy("occurred_at").collect()]
    assert got == want
    chain = found.where("outcome = 200").drop("kind", "outcome", "version")
    assert {r.valid for r in audit.verify(chain).collect()} == {True}
    last = {r.claim_id: r.to_status for r in audit.latest(chain).collect()}
    assert all(status[c] == s for c, s in last.items()) and len(last) > 8


def test_state_continues_a_chain(spark, tmp_path):
    folder = str(tmp_path)
    first = workflow.event_rows(spark.createDataFrame([("c1", T)], "claim_id string, occurred_at timestamp"), event_type=keyed.F.lit("FRAUD_SCORED"), model_version=keyed.F.lit("m1"))
    chain = audit.append(first)
    states = keyed.initial_states(spark.createDataFrame([("c1", "SUBMITTED", 1)], "claim_id string, status string, version int"), chain)
    scores = spark.createDataFrame([("c1", T, "m1", "FLAG"), ("c1", T, "m2", "FLAG")], "claim_id string, at timestamp, model_version string, decision_hint string")
    keyed.scores_as_events(scores).write.parquet(f"{folder}/in")
    keyed.started(keyed.judged(spark.readStream.schema(keyed.EVENTS).parquet(f"{folder}/in"), states), f"{folder}/out", f"{folder}/state").awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    assert sorted((r.model_version, r.outcome, r.seq) for r in found.collect()) == [("m1", 208, None), ("m2", 200, 2)]
    whole = chain.unionByName(found.where("outcome = 200").select(*chain.columns))
    assert [(r.events, r.valid) for r in audit.verify(whole).collect()] == [(2, True)]


def test_claims_of_a_bucket_share_a_key(spark, tmp_path):
    """Spark hands over a key at a time, which costs more than a claim's events do: a bucket's claims come together, and stay apart."""
    rows, folder = _events(200), str(tmp_path)
    start = {f"c{i}": "SUBMITTED" for i in range(11)}
    states = keyed.initial_states(spark.createDataFrame([(c, s, 0) for c, s in start.items()], "claim_id string, status string, version int"))
    named = "claim_id string, at timestamp, kind string, model_version string, decision_hint string, to_status string, reason string, explanation_json string, role string, actor_id string"
    for part in (rows[:90], rows[90:]):
        keyed._events(spark.createDataFrame(part, named).repartition(3)).write.mode("append").parquet(f"{folder}/in")
        stream = keyed.judged(spark.readStream.schema(keyed.EVENTS).parquet(f"{folder}/in"), states, buckets=2)
        keyed.started(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    assert [(r.claim_id, r.outcome, r.to_status) for r in found.orderBy("occurred_at").collect()] == _fold(rows, start)[0]
    assert {r.valid for r in audit.verify(found.where("outcome = 200").drop("kind", "outcome", "version")).collect()} == {True}
    kept = spark.read.format("statestore").option("stateVarName", "claims").load(f"{folder}/state")
    assert kept.count() <= 2
