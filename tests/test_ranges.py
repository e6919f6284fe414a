import random

from claimloom.operators import metrics
from claimloom.operators.ranges import ranked, running_sums


def test_running_sums_and_ranks(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(100), None if r.random() < 0.1 else r.randrange(5)) for i in range(500)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "k long, x long, y long")
    got = {g.k: (g.sx, g.sy) for g in running_sums(frame, "k", {"sx": "x", "sy": "y"}).collect()}
    back = {g.k: g.sx for g in running_sums(frame, "k", {"sx": "x"}, descending=True).collect()}
    rows.sort()
    for i in range(500):
        assert got[i] == (sum(x for _, x, _ in rows[: i + 1]), sum(y or 0 for *_, y in rows[: i + 1])) and back[i] == sum(x for _, x, _ in rows[i:])
    assert {g.k: g.n for g in ranked(frame, "k", "n").collect()} == {i: i + 1 for i in range(500)}
    assert running_sums(frame.limit(0), "k", {"sx": "x"}).count() == 0


def test_no_task_sees_all_rows(spark):
    """Plans hold no window over one partition of data-sized input."""
    frame = spark.range(2000).selectExpr("id as claim_id", "id / 2000 as score", "int(id % 7 = 0) as label")
    for found in (metrics.average_precision(frame), metrics.lift(frame), metrics.at_k(frame), metrics.order_statistics(frame, "score")):
        for line in found._jdf.queryExecution().executedPlan().toString().splitlines():
            if "Window [" in line:  # one row a range is all that may meet in one task
                assert "__part" in line, line


def test_at_k_takes_ties_by_key(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0.1, 0.5, 0.5, 0.9]), r.randrange(2)) for i in range(300)]
    frame = spark.createDataFrame(rows, "claim_id long, score double, label int")
    order = sorted(rows, key=lambda x: (-x[1], x[0]))
    got = {x.k: x.hits for x in metrics.at_k(frame, (1, 7, 50, 75, 120, 299, 300, 1000)).collect()}
    assert got == {k: sum(y for *_, y in order[:k]) for k in got} and len(got) == 8
    assert metrics.at_k(frame.limit(0)).count() == 0
