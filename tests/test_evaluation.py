import itertools
import math
import random

import numpy as np
import pytest

from claimloom.operators import metrics, training


def _scored(spark, n=400):
    r = random.Random(8)
    rows = [(i, round(r.random(), 2), int(r.random() < 0.2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "claim_id long, score double, label int")


def test_average_precision(spark):
    rows, frame = _scored(spark)
    total, area = sum(y for *_, y in rows), 0.0
    for s in sorted({x for _, x, _ in rows}, reverse=True):
        tp, k = sum(y for _, x, y in rows if x >= s), sum(x >= s for _, x, _ in rows)
        area += sum(y for _, x, y in rows if x == s) / total * tp / k
    assert abs(metrics.average_precision(frame).first().average_precision - area) < 1e-12
    assert metrics.average_precision(frame.limit(0)).first().average_precision == 0


def test_thresholds(spark):
    rows, frame = _scored(spark)

    def counts(t):
        return sum(y for _, x, y in rows if x >= t), sum(1 - y for _, x, y in rows if x >= t), sum(y for _, x, y in rows if x < t)

    grid = [i / 100 for i in range(1, 100)]
    f1 = {t: 2 * tp / (2 * tp + fp + fn) for t in grid for tp, fp, fn in [counts(t)]}
    best = metrics.best_threshold(frame).first()
    assert best.threshold == min(t for t in grid if abs(f1[t] - max(f1.values())) < 1e-12) and abs(best.f1 - max(f1.values())) < 1e-9
    assert metrics.review_threshold(frame).first().threshold == max(t for t in grid if counts(t)[0] >= 0.95 * sum(counts(t)[::2]))
    got = {r.t: (r.tp, r.fp, r.fn) for r in metrics.grid(frame).collect()}
    assert got == {t: counts(t) for t in grid}


def test_at_k_and_order_statistics(spark):
    rows, frame = _scored(spark)
    ranked = sorted(rows, key=lambda x: (-x[1], x[0]))
    for r in metrics.at_k(frame, (50, 1000)).collect():
        hits = sum(y for *_, y in ranked[: r.k])
        assert r.hits == hits and r.precision == hits / min(r.k, 400)
    values = sorted(x for _, x, _ in rows)
    got = metrics.order_statistics(frame, "score").first()
    assert got.median == values[200] and got.p95 == values[380] and got.n == 400


def test_ring_recall(spark):
    truth = spark.createDataFrame([(i, "r1") for i in range(4)] + [(i, "r2") for i in range(4, 9)], "claim_id long, ring_id string")
    found = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (4, "z"), (5, None)], "claim_id long, ring_id string")
    got = {r.ring_id: (r.members, r.detected, r.votes, r.recovered) for r in metrics.ring_recall(truth, found).collect()}
    assert got == {"r1": (4, "x", 2, True), "r2": (5, "z", 1, False)}


def _value(tree, x, present):
    def go(node):
        f = tree["feature"][node]
        if f < 0:
            return tree["value"][node]
        a, b = tree["left"][node], tree["right"][node]
        if f in present:
            return go(a if x[f] <= tree["threshold"][node] else b)
        return (tree["cover"][a] * go(a) + tree["cover"][b] * go(b)) / tree["cover"][node]

    return go(0)


def test_tree_shap_equals_all_subsets():
    tree = {
        "feature": np.array([0, 1, -1, -1, 2, -1, 0, -1, -1]),
        "threshold": np.array([0.5, 1.0, 0, 0, 2.0, 0, 0.8, 0, 0]),
        "left": np.array([1, 2, -1, -1, 5, -1, 7, -1, -1]),
        "right": np.array([4, 3, -1, -1, 6, -1, 8, -1, -1]),
        "value": np.array([0, 0, 1.0, 3.0, 0, -2.0, 0, 5.0, 7.0]),
        "cover": np.array([100.0, 60, 20, 40, 40, 10, 30, 12, 18]),
    }
    for x in ([0.2, 0.0, 9.0], [0.7, 5.0, 1.0], [0.7, 0.0, 3.0], [0.9, 2.0, 3.0]):
        x = np.array(x)
        want = np.zeros(3)
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            for k in range(3):
                for s in itertools.combinations(rest, k):
                    weight = math.factorial(k) * math.factorial(2 - k) / math.factorial(3)
                    want[f] += weight * (_value(tree, x, {*s, f}) - _value(tree, x, set(s)))
        assert np.allclose(training.tree_shap(tree, np.array([x, x + 0.1]))[0], want)


@pytest.fixture(scope="module")
def fitted(spark):
    r = random.Random(5)
    rows = []
    for i in range(600):
        a, b = r.random(), r.random()
        rows.append((i, a, b, int(a + 0.3 * r.random() > 0.9)))
    frame = spark.createDataFrame(rows, "claim_id long, a double, b double, label int").cache()
    model = training.train(frame.where("claim_id < 400"), {"model": ["a", "b"]}, trees=3, depth=3)["model"]
    return frame, model, training.calibrate(model, frame.where("claim_id >= 400"))


def test_model_ranks_calibrates_and_explains(spark, fitted, tmp_path):
    frame, model, fit = fitted
    scored = training.calibrated_scores(model, fit, frame.where("claim_id >= 400"))
    assert metrics.average_precision(scored).first().average_precision > 0.6
    top = training.contributions(model, frame.limit(20), 2).collect()
    assert len(top) == 40 and sum(r.feature == "a" for r in top if r.rank == 1) > 15
    saved = training.Classifier(model, fit, {"model_version": "t"})
    saved.save(spark, str(tmp_path / "m"))
    again = training.Classifier.load(spark, str(tmp_path / "m"))
    assert again.metadata == {"model_version": "t"} and training.Classifier.load(spark, str(tmp_path / "none")) is None
    assert len(again.model.trees) == 3
    rescored = training.calibrated_scores(again.model, again.calibrator, frame.where("claim_id >= 400"))
    assert sorted(map(str, rescored.collect())) == sorted(map(str, scored.collect()))


def test_splits_and_weights(spark):
    rows = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 0), ("2026-01-03", 0)], "d string, label int").selectExpr("cast(d as date) as incident_date", "label")
    assert [r.split for r in training.split(rows, "2026-01-01", "2026-01-02").orderBy("incident_date").collect()] == ["train", "val", "test"]
    assert training.class_weight(rows) == 2.0 and training.class_weight(rows.where("label = 0")) == 1.0
