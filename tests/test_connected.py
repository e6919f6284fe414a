import random

from claimloom.operators import connected


def _brute(edges):
    home = {}

    def find(x):
        home.setdefault(x, x)
        while home[x] != x:
            x = home[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        home[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(home)}


def test_matches_union_find(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(40)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(90)]
    edges += [(5000, 5000), (3, 3), (7, 6), (6, 7)]
    rows = [*edges, (None, 4), (9, None)]
    found = connected.connected_components(spark.createDataFrame(rows, "a long, b long"))
    assert {x.vertex: x.component for x in found.collect()} == _brute(edges)


def test_strings_and_empty(spark):
    frame = spark.createDataFrame([("p", "q"), ("q", "o"), ("x", "y")], "a string, b string")
    assert {x.vertex: x.component for x in connected.connected_components(frame).collect()} == {"p": "o", "q": "o", "o": "o", "x": "x", "y": "x"}
    assert connected.connected_components(frame.limit(0)).count() == 0
    loops = spark.createDataFrame([("p", "p"), ("q", "q"), ("p", "p")], "a string, b string")
    assert {x.vertex: x.component for x in connected.connected_components(loops).collect()} == {"p": "p", "q": "q"}


def test_former_rounds_are_deleted(spark):
    import os

    from claimloom.plans.durable import shared_dir

    count = lambda: len(os.listdir(shared_dir(spark)))
    chain = spark.range(400).selectExpr("id as a", "id + 1 as b")
    before = count()
    assert connected.connected_components(chain).select("component").distinct().count() == 1
    assert count() - before <= 3  # edges, labels and their least; none of the rounds
