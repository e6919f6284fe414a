import datetime

import pytest
from pyspark.sql import functions as F

from claimloom.operators import audit, workflow
from claimloom.plans.durable import cut


@pytest.fixture(scope="module")
def chain(spark):
    at = datetime.datetime(2026, 1, 1, 12, 0, 0, 123456)
    rows = [(c, f"E{i}", "0.5" if i % 2 else None, '{  "zebra" : 1,\n"apple":  [1,2,3] }' if i == 1 else None, at + datetime.timedelta(seconds=i)) for c in range(1, 4) for i in range(c)]
    events = spark.createDataFrame(rows, "claim_id long, event_type string, s string, explanation_json string, occurred_at timestamp").withColumn("fraud_score", F.col("s").cast("decimal(5,4)")).drop("s")
    return cut(audit.append(workflow.event_rows(events, actor_role=F.lit("SYSTEM"))))


def _valid(rows):
    return {r.claim_id: (r.events, r.valid) for r in audit.verify(rows).collect()}


def test_chain_is_valid_and_numbered(chain):
    assert _valid(chain) == {1: (1, True), 2: (2, True), 3: (3, True)}
    first = chain.where("claim_id = 3 and seq = 1").first()
    assert first.prev_hash == audit.GENESIS and first.occurred_at.microsecond == 123000
    assert [r.seq for r in audit.history(chain, 3).collect()] == [1, 2, 3]
    assert {r.claim_id: r.seq for r in audit.latest(chain).collect()} == {1: 1, 2: 2, 3: 3}


def test_tampering(chain):
    three = F.col("claim_id") == 3
    edited = chain.withColumn("event_type", F.when(three & (F.col("seq") == 2), "X").otherwise(F.col("event_type")))
    assert not _valid(edited)[3][1] and _valid(edited)[2][1]
    assert not _valid(chain.where(~(three & (F.col("seq") == 2))))[3][1]
    swapped = chain.withColumn("seq", F.when(three & (F.col("seq") == 2), 3).when(three & (F.col("seq") == 3), 2).otherwise(F.col("seq")))
    assert not _valid(swapped)[3][1]
    assert _valid(chain.where(~(three & (F.col("seq") == 3))))[3] == (2, True)  # a missing end can't be noticed
    assert not _valid(chain.unionByName(chain.where("claim_id = 1")))[1][1]


def test_json_spacing_and_order_do_not_matter(chain):
    spaced = chain.withColumn("explanation_json", F.when(F.col("explanation_json").isNotNull(), '{"apple":[1, 2, 3],"zebra":1}'))
    assert all(v for _, v in _valid(spaced).values())


def test_appending_continues_chains(spark, chain):
    more = workflow.event_rows(spark.createDataFrame([(3, "LATE", datetime.datetime(2027, 1, 1))], "claim_id long, event_type string, occurred_at timestamp"), actor_role=F.lit("SYSTEM"))
    longer = chain.unionByName(audit.append(more, audit.latest(chain)))
    assert _valid(longer)[3] == (4, True)


def test_canonical_json(spark):
    got = spark.range(1).select(audit.canonical_json(F.lit('{"b":null, "a":{"d":1,"c":"x"}}')).alias("j")).first().j
    assert got == '{"a":{"c":"x","d":1},"b":null}'
    both = spark.createDataFrame([("2026-01-01 00:00:00",), ("2026-01-01 00:00:00.5",)], "t string").select(audit.instant(F.col("t").cast("timestamp")).alias("t")).collect()
    assert [r.t for r in both] == ["2026-01-01T00:00:00Z", "2026-01-01T00:00:00.500Z"]


def test_transitions(spark):
    rows = [("SUBMITTED", "UNDER_REVIEW", "ADJUSTER", None, 200), ("SUBMITTED", "APPROVED", "ADJUSTER", None, 409), ("FLAGGED", "UNDER_REVIEW", "INVESTIGATOR", None, 200), ("FLAGGED", "UNDER_REVIEW", "ADJUSTER", None, 403), ("FLAGGED", "APPROVED", "INVESTIGATOR", " ", 400), ("FLAGGED", "APPROVED", "INVESTIGATOR", "ok", 200), (None, None, None, None, 409)]
    got = workflow.checked(spark.createDataFrame(rows, "from_status string, to_status string, role string, reason string, want int"))
    assert all(r.outcome == r.want for r in got.collect()) and got.count() == len(rows)


def test_scores_apply_once_and_late_ones_move_nothing(spark):
    claims = spark.createDataFrame([(1, "SUBMITTED"), (2, "APPROVED"), (3, "SUBMITTED"), (4, "SUBMITTED")], "claim_id long, status string")
    scores = spark.createDataFrame([(1, "m", "FLAG"), (1, "m", "FLAG"), (2, "m", "FLAG"), (3, "m", "CLEAR"), (4, "m", "FLAG"), (9, "m", "FLAG")], "claim_id long, model_version string, decision_hint string")
    done = spark.createDataFrame([(4, "m", "FRAUD_SCORED")], "claim_id long, model_version string, event_type string")
    got = {r.claim_id: r.to_status for r in workflow.apply_scores(claims, scores, done).collect()}
    assert got == {1: "FLAGGED", 2: "APPROVED", 3: "UNDER_REVIEW"}


def test_validation(spark):
    rows = spark.createDataFrame([("a", "p", 1.0, "2026-01-01", "9876500011", "x", None), (" ", None, 0.0, None, "", "y", None)], "claimant_name string, policy_number string, claim_amount double, d string, claimant_phone string, claimant_address string, repair_shop_name string").withColumn("incident_date", F.col("d").cast("date"))
    got = [r.problems for r in workflow.validated(rows).collect()]
    assert got == [[], ["claim_amount", "claimant_name", "claimant_phone", "incident_date", "policy_number"]]
