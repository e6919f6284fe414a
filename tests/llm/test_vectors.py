import numpy as np
import pytest

from claimloom.llm import vectors


def _rows():
    r = np.random.default_rng(5)
    rows = []
    for g in range(40):
        base = r.standard_normal(16)
        for _ in range(int(r.integers(1, 9))):
            rows.append((base + r.standard_normal(16) * r.choice([0.0, 0.05, 0.2])).astype(np.float32).tolist())
    rows += [None, [], [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [3.0] * 8, [1.0] * 8, rows[0], [1e-30] * 16, [1e30] * 16]
    return [(i * 2, v) for i, v in enumerate(rows)] + [(None, rows[0]), (0, rows[0])]


def _brute(rows):
    n = len(rows)
    unit = []
    for _, v in rows:
        x = np.array(v, np.float32).astype(float) if v and None not in v else np.zeros(0)
        ok = len(x) and np.isfinite(x).all() and x.any()
        unit.append(x / abs(x).max() / np.linalg.norm(x / abs(x).max()) if ok else None)
    link = [[i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9 for j in range(n)] for i in range(n)]
    seen, out = set(), [None] * n
    for i in range(n):
        if i in seen:
            continue
        group, front = {i}, [i]
        while front:
            x = front.pop()
            for y in range(n):
                if link[x][y] and y not in group:
                    group.add(y)
                    front.append(y)
        seen |= group
        ids = [rows[x][0] for x in group if rows[x][0] is not None]
        for x in group:
            out[x] = (rows[x][0], sum(link[x]), min(ids) if ids else None)
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = _rows()
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, row int")
    got = [(r.vec_id, r.n_links, r.component) for r in vectors.linked_vectors(frame, recall=0.9999999).collect()]
    key = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted(got, key=key) == sorted(_brute(rows), key=key)


def test_recall_and_no_false_links(spark):
    r = np.random.default_rng(6)
    a = r.standard_normal((400, 64))
    b = a + r.standard_normal((400, 64)) * 0.45  # cosines around 0.91
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    unit = np.concatenate([a, b])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.9) & ~np.eye(800, dtype=bool)).sum(axis=1)
    got = {x.vec_id: x.n_links for x in vectors.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] <= want[i] for i in range(800))
    assert sum(got.values()) >= 0.95 * want.sum()


def test_plan_and_empty(spark):
    for n in (10, 10**5, 10**8):
        signs, tables = vectors.plan(n)
        assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** signs) ** tables >= 0.98
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.linked_vectors(empty).count() == 0


def test_equal_vectors_are_collapsed(spark):
    rows = spark.range(100_000).selectExpr("id as vec_id", "array(1.0f, 2.0f, cast(if(id % 50000 = 7, 2.9, 3.0) as float), 0.5f) as embedding")
    found = vectors.linked_vectors(rows)
    assert [tuple(r) for r in found.groupBy("n_links", "component").count().collect()] == [(99_999, 0, 100_000)]
