import random

import duckdb

from claimloom.llm import mixing


def _rows():
    r = random.Random(4)
    rows = []
    for i in range(300):
        source = r.choice(["b", "b", "b", "b", "a", "c", "d", None, "Ω", "tiny"] if i % 50 else ["tiny"])
        rows.append((i, " ".join("w" for _ in range(r.randint(0, 40))), source))
    return rows + [(1000, None, "a"), (1001, "", "empty"), (None, "x y", "a"), (7, rows[7][1], rows[7][2]), (2000, "w " * 5000, "b")]


def _waterfill(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) - sum(target.values())
    return target


def test_targets_and_taken(spark):
    rows = _rows()
    docs = spark.createDataFrame([(*r, 9.5) for r in rows], "doc_id long, text string, source string, target double")
    found = mixing.mix(docs).collect()
    sizes, taken, target = {}, {}, {}
    of = {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
        of[d] = s
    for r in found:
        s = of[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[s]
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
    want = _waterfill(sizes)
    assert all(abs(want[s] - target[s]) < 1e-6 for s in want)
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in want)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_sql_agrees(spark):
    import pandas as pd

    rows = _rows()
    spark.createDataFrame(rows, "doc_id long, text string, source string").createOrReplaceTempView("documents")
    got = sorted((str(r.doc_id), r.size, r.taken, round(r.target, 6), round(r.position, 9) if r.position is not None else -1) for r in mixing.mix(spark.table("documents")).collect())
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con.register("documents", documents)
    want = sorted((str(a), b, c, round(d, 6), round(e, 9) if e is not None else -1) for a, b, c, d, e in con.sql(f"SELECT doc_id, size, taken, target, position FROM ({mixing.ORACLE}) x").fetchall())
    assert got == want


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    for knots in mixing.SCHEDULES:
        shares = [i / 20 for i in range(20)]
        frame = spark.createDataFrame([(s,) for s in shares], "s double")
        got = [r.t for r in frame.orderBy("s").select(mixing.invert_demand(F.col("s"), knots).alias("t")).collect()]

        def area(t, knots=knots):
            total = 0
            for (a, x), (b, y) in zip(knots, knots[1:], strict=False):
                e = min(t, b)
                if e > a:
                    total += (e - a) * (x + (x + (y - x) * (e - a) / (b - a))) / 2
            return total

        assert all(abs(area(t) / area(1) - s) < 1e-9 for s, t in zip(shares, got, strict=True))


def test_documents_and_empty(spark):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string, source string")
    kept = mixing.mixed_documents(docs.withColumn("size", docs.doc_id))
    taken = mixing.mix(docs).where("taken > 0").count()
    clash = docs.selectExpr("*", "source as key", "source as Taken", "source as skey", "source as bucket")
    assert mixing.mixed_documents(clash).count() == taken
    assert kept.count() == taken
    places = [r.position for r in kept.select("position").collect()]
    assert places == sorted(places)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_every_copy_has_a_position(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(r.randint(1, 30))), "big" if i < 300 else "small") for i in range(330)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert any(r.copies > 1 for r in found)
    for r in found:
        if r.taken:
            assert r.copies == len(r.positions) == -(-r.taken // r.size) and r.position == r.positions[0]
            assert r.positions == sorted(set(r.positions)) and r.positions[-1] <= 1
    # the small source, turn 1, follows its schedule (0.5 at the start, 1.5 at the end) over the whole of training
    copies = mixing.mixed_copies(docs).collect()
    assert [r.position for r in copies] == sorted(r.position for r in copies)
    own = [r for r in copies if r.source == "small"]
    demand = sum(r.taken for r in own)
    assert len(own) > 30 and abs(demand - own[0].target) <= 0.5
    for t in (0.25, 0.5, 0.75):
        want = demand * (0.5 * t + 0.5 * t * t)
        assert abs(sum(r.taken for r in own if r.position < t) - want) <= 30
    assert max(r.position for r in own) > 0.9 and all(0 < r.taken <= r.size for r in own)
    by_query = {}
    for r in copies:
        by_query[r.doc_id] = by_query.get(r.doc_id, 0) + r.taken
    assert by_query == {r.doc_id: r.taken for r in found if r.taken}
