import random

from claimloom.llm import simhash


def _brute(rows):
    home = {d: d for d, _ in rows}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for i, (d, f) in enumerate(rows):
        for e, g in rows[:i]:
            if bin((f ^ g) & (2**64 - 1)).count("1") <= 2 and find(d) != find(e):
                a, b = sorted((find(d), find(e)))
                home[b] = a
    return {d: find(d) for d, _ in rows}


def _texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = ["", None, "one", "One two", "one TWO three"]
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.choice([4, 30, 400]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            copy[r.randrange(len(copy))] = r.choice(words)
            texts.append("\t".join(copy))
    return texts


def test_components_equal_brute_force(spark):
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(_texts())], "doc_id long, text string")
    got = {r.doc_id: (r.fp, r.component) for r in simhash.simhash_components(docs).collect()}
    want = _brute(sorted((d, f) for d, (f, _) in got.items()))
    assert {d: c for d, (_, c) in got.items()} == want
    assert got[0][0] == 0 and got[3][0] == 0 and got[0][1] == got[3][1] == 0


def test_crowded_cells_lose_no_link(spark, monkeypatch):
    r = random.Random(7)
    centre, fps = r.getrandbits(64), set()
    while len(fps) < 400:
        x = centre
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        fps.add(x - 2**64 if x >= 2**63 else x)
    monkeypatch.setattr(simhash, "CELL_LIMIT", 4)
    rows = [(f, f) for f in fps]
    for segments in (16, 32):
        edges = simhash._links(spark.createDataFrame([(f,) for f in fps], "fp long"), segments)
        got = {x.vertex: x.component for x in simhash.connected_components(edges).collect()}
        assert {f: got.get(f, f) for f in fps} == _brute(sorted(rows))


def test_native_hash_agrees(spark):
    from pyspark.sql import functions as F

    text = "Ärger mit drei"
    h = spark.range(1).select(F.xxhash64(F.lit("Ärger mit drei".replace("A", "a"))).alias("h")).first().h
    assert simhash.fingerprint(text.encode()) != 0
    import xxhash

    assert xxhash.xxh64_intdigest(text.encode(), 42) == h % 2**64


def test_keep_one_and_edges(spark):
    rows = [(1, "a b c d", "x"), (2, "a b c d", "y"), (2, "other words go here", "z"), (None, "a b c d", "n"), (None, "lonely text with no id", "n"), (None, "lonely text with no id", "m"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.keep_one(docs)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in kept.collect()) == [(-1, "lonely text with no id"), (1, "a b c d"), (2, "other words go here"), (4, "")]
    clash = docs.selectExpr("doc_id", "text", "fp as root", "fp as component", "fp as least", "map('a', fp) as vertex").unionAll(docs.selectExpr("doc_id", "text", "fp", "fp", "fp", "map('a', fp)"))
    again = simhash.keep_one(clash)
    assert again.columns == clash.columns and again.count() == 4
    empty = docs.limit(0)
    assert simhash.simhash_components(empty).count() == 0 and simhash.keep_one(empty).count() == 0
