import random
import re

from claimloom.llm import decontaminate


def _brute(docs, items, size=5, threshold=0.8):
    def grams(text):
        w = re.findall(r"\w+", text.lower())
        return w, {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    out = set()
    for d, text in docs:
        w, have = grams(text or "")
        for k, item in items:
            words, want = grams(item or "")
            if not words or not w:
                continue
            if len(words) < size:
                have_k = {tuple(w[i : i + len(words)]) for i in range(len(w) - len(words) + 1)}
                shared = len(want & have_k)
            else:
                shared = len(want & have)
            if shared >= threshold * len(want) - 1e-9:
                out.add((d, k, shared, len(want)))
    return out


def _tables(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 5, 8, 20, 60])))) for i in range(30)]
    items += [(100, None), (101, "..."), (items[4][0], items[4][1])]
    docs = []
    for d in range(120):
        text = [r.choice(words) for _ in range(r.choice([0, 4, 50, 900]))]
        if d % 3 == 0:
            w = r.choice(items[:30])[1].split()
            lost = r.randint(0, 3)
            if lost and len(w) > 6:
                w[r.randrange(len(w))] = "changed"
            at = r.randint(0, len(text))
            text[at:at] = [x.upper() + "##" for x in w]
        docs.append((d, " ".join(text)))
    docs += [(500, None), (500, docs[0][1]), (None, docs[3][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = _tables(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "y")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontaminate.contained_items(d, i).collect()}
    want = _brute(docs, items)
    assert got == want and len(want) > 20
    kept = {r.doc_id for r in decontaminate.without_items(d, i).collect()}
    assert kept == {x for x, _ in docs} - {x[0] for x in want} | ({500} if (500, None) in docs else set())


def test_slices_give_the_same(spark, monkeypatch):
    docs, items = _tables(spark)
    monkeypatch.setattr(decontaminate, "INDEX_LIMIT", 200)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontaminate.contained_items(d, i).collect()} == _brute(docs, items)


def test_empty(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(d, i).count() == 0 and decontaminate.without_items(d, i).count() == 1
    assert decontaminate.contained_items(d.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
