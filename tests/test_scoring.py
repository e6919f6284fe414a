import datetime
import json

import pandas as pd
import pytest

from claimloom.operators import audit, detect, explain, features, graph, scoring, training, workflow
from claimloom.plans import registry
from claimloom.plans.durable import cut
from claimloom.sources import generator

D = datetime.date


@pytest.fixture(scope="module")
def claims(spark):
    rows = [(r * 10 + i, "A", "POL-1", 100.0 + i, D(2026, 1, 1) + datetime.timedelta(days=20 * r + i), f"98765{r:05d}", f"{r * 10 + i} A Road", None) for r in range(9) for i in range(4)]
    rows += [(1000 + i, "A", "POL-1", 500.0 + i % 9, D(2026, 1, 1) + datetime.timedelta(days=2 * i), str(9000000000 + i), f"{i} B Street", "Busy Garage" if i % 4 else None) for i in range(100)]
    frame = spark.createDataFrame(rows, "claim_id long, claimant_name string, policy_number string, claim_amount double, incident_date date, claimant_phone string, claimant_address string, repair_shop_name string")
    return cut(frame)


@pytest.fixture(scope="module")
def trained(spark, claims):
    truth = claims.where("claim_id < 1000").selectExpr("claim_id", "concat('r', int(claim_id / 10)) as ring_id")
    rows = cut(training.split(training.labelled(training.as_of_dataset(claims, "2026-04-15", "2026-05-20"), truth), "2026-04-15", "2026-05-20"))
    late = truth.where("claim_id >= 70").select("ring_id").distinct()
    return rows, *training.ablation(rows, truth, late, trees=5)


def test_as_of_features_see_no_later_claim(spark, claims, trained):
    rows = {r.claim_id: r for r in trained[0].collect()}
    assert len(rows) == 136
    early = features.features(cut(graph.edges(claims.where("incident_date <= '2026-04-15'"))))
    for r in early.collect():
        assert all(abs(rows[r.claim_id][c] - r[c]) < 1e-9 for c in features.ALL)
    assert {rows[i].component_size for i in range(4)} == {4.0}
    whole = {r.claim_id: r.entity_degree_max for r in features.features(cut(graph.edges(claims))).collect()}
    assert rows[1001].entity_degree_max < whole[1001]  # the shop's later claims aren't there


def test_reports_and_classifier(spark, trained, tmp_path):
    _, report, classifier = trained
    assert set(report) == {"tabular", "graph", "calibrated"} and report["graph"]["auprc"] >= report["tabular"]["auprc"]
    assert all("held_out" in r for r in report.values())
    training.write_report(spark, report, str(tmp_path / "report"))
    assert training.read_report(spark, str(tmp_path / "report"))["graph"]["auprc"] == report["graph"]["auprc"]
    assert classifier.metadata["model_version"] == "boosted-5"
    sample = training.contribution_samples(classifier.model, trained[0]).collect()
    assert [(r.claim_id, r["rank"]) for r in sample] == [(c, k) for c in (0, 1, 2) for k in (1, 2, 3)]


def test_model_scores_end_to_end(spark, claims, trained):
    scorer = scoring.Scorer(lambda: claims, trained[2])
    assert scorer.refresh() == 136
    got = {r.claim_id: r for r in scorer.batch([1, 5000, 1001, 2]).collect()}
    assert list(got) == [1, 1001, 2]
    one = got[1]
    kinds = [e.type for e in one.explanation.evidence]
    assert kinds == sorted(kinds, reverse=True) and kinds.count("FEATURE_CONTRIBUTION") == 5
    strongest = [abs(e.shap_value) for e in one.explanation.evidence if e.type == "FEATURE_CONTRIBUTION"]
    assert strongest == sorted(strongest, reverse=True)
    assert one.ring_id == "kcore-0" and one.rung == "model" and one.explanation.summary.startswith("Fraud probability ")
    assert one.fraud_score > got[1001].fraud_score and one.explanation.thresholds.flag_at == trained[2].metadata["flag_threshold"]
    for ids in ([], list(range(1001))):
        with pytest.raises(ValueError):
            scorer.batch(ids)


def test_rules_stand_in_for_a_missing_model(spark, claims):
    scorer = scoring.Scorer(lambda: claims)
    found = scorer.batch([1, 1001]).collect()
    assert [r.rung for r in found] == ["k_core", found[1].rung] and scorer.scores is not None
    assert scoring.Scorer(lambda: claims.where("claim_id = 1").withColumn("claimant_phone", claims.claimant_name)).refresh() == 1


def test_narrative_report(spark, claims):
    of = cut(graph.edges(claims))
    scores = cut(explain.claim_scores(of, detect.verdicts(of, detect.rings(of))))
    texts = lambda p: pd.Series([None if "[claim 1]" in t else "A ring." for t in p])
    r = explain.narrative_report(scores, texts, "small", count=100).first()
    assert r.sample_size == 36 and abs(r.grounded_rate - 35 / 36) < 1e-9 and abs(r.fallback_rate - 1 / 36) < 1e-9 and r.p95 >= r.median > 0
    assert explain.narrative_report(scores.limit(0), texts, "small").first().sample_size == 0


@pytest.mark.parametrize("content, want", [('{"narrative": " a ring "}', "a ring"), ('{"narrative": null}', None), ('{"narrative": 3}', None), ('{"narrative": ["x"]}', None), ("{}", None), ("[1]", None), ("not json", None), ('{"narrative": "  "}', None), ('{"narrative": "' + "x" * 5000 + '"}', None)])
def test_generator_answers(content, want):
    assert generator.parsed(json.dumps({"message": {"content": content}}).encode()) == want
    assert generator.parsed(b"\xff") is None and generator.parsed(b"3") is None and generator.parsed(b'{"message": null}') is None


def test_generator_without_a_server():
    assert generator.http_generator("http://127.0.0.1:9/none", "m", 0.2)(pd.Series(["x", "y"])).tolist() == [None, None]


def test_requests_fold_one_after_another(spark):
    claims = spark.createDataFrame([("a", "SUBMITTED", 0), ("b", "FLAGGED", 4)], "claim_id string, status string, version int")
    asked = [("a", 1, "UNDER_REVIEW", "ADJUSTER", None), ("a", 2, "FLAGGED", "ADJUSTER", None), ("a", 3, "APPROVED", "INVESTIGATOR", " "), ("a", 4, "APPROVED", "INVESTIGATOR", "ok"), ("a", 5, "DENIED", "INVESTIGATOR", None), ("b", 1, "DENIED", "ADJUSTER", None), ("b", 2, "DENIED", "INVESTIGATOR", None), ("c", 1, "FLAGGED", "SYSTEM", None)]
    rows = spark.createDataFrame(asked, "claim_id string, requested_at int, to_status string, role string, reason string").repartition(3)
    got = sorted((r.claim_id, r.requested_at, r.outcome, r.status, r.version) for r in workflow.folded(claims, rows).collect() if r.claim_id != "c")
    assert got == [("a", 1, 200, "UNDER_REVIEW", 1), ("a", 2, 200, "FLAGGED", 2), ("a", 3, 400, "FLAGGED", 2), ("a", 4, 200, "APPROVED", 3), ("a", 5, 409, "APPROVED", 3), ("b", 1, 403, "FLAGGED", 4), ("b", 2, 200, "DENIED", 5)]
    assert [r.outcome for r in workflow.folded(claims, rows).where("claim_id = 'c'").collect()] == [404]
    assert workflow.folded(claims, rows.limit(0)).count() == 0


def test_narratives_are_recorded(spark, claims):
    of = cut(graph.edges(claims))
    told = explain.narratives(explain.claim_scores(of, detect.verdicts(of, detect.rings(of))).where("claim_id < 3"))
    rows = told.selectExpr("claim_id", "'FLAGGED' as status", "narrative", "grounded", "model_version", "'ann' as actor_id", "'INVESTIGATOR' as actor_role", "timestamp'2026-01-01 10:00:00' as occurred_at")
    events = cut(audit.append(workflow.narrative_events(rows)))
    one = events.where("claim_id = 1").first()
    assert events.count() == 3 and (one.event_type, one.from_status, one.to_status, one.actor_id) == ("NARRATIVE_GENERATED", "FLAGGED", "FLAGGED", "ann")
    assert json.loads(one.explanation_json)["grounded"] is True and {r.valid for r in audit.verify(events).collect()} == {True}


def test_altered_events_are_named(spark):
    rows = spark.createDataFrame([("a", f"2026-01-0{i} 10:00:00", "X") for i in range(1, 4)], "claim_id string, at string, event_type string").selectExpr("claim_id", "cast(at as timestamp) as occurred_at", "event_type")
    chain = cut(audit.append(workflow.event_rows(rows)))
    more = audit.append(workflow.event_rows(rows), audit.latest(chain).select("claim_id", "seq", "hash"))
    assert audit.altered(chain, chain.unionByName(more)).count() == 0
    assert [tuple(r) for r in audit.altered(chain, chain.where("seq <> 2")).collect()] == [("a", 2, "deleted")]
    assert {tuple(r) for r in audit.altered(chain, chain.replace("X", "Y", ["event_type"])).collect()} == {("a", i, "changed") for i in (1, 2, 3)}


def test_as_of_one_hop_makes_no_communities(spark, claims, monkeypatch):
    """The query whose SQL states a claim's own entities needs no communities: what it asks of each graph is made alone, and equals the whole features."""
    monkeypatch.setattr(features, "communities", None)
    monkeypatch.setattr(registry, "_claims", lambda spark, folder: claims)
    found = {r.claim_id: r for r in registry.as_of_features_onehop(spark, "").collect()}
    assert len(found) == claims.count() and found[1].entity_degree_max == 4.0
