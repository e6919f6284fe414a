import random

import corpus_pipeline
from claimloom.llm import similar, simhash


def _texts():
    r = random.Random(11)
    texts = ["", None, "one two", "One  TWO"]
    for _ in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.choice([1, 2, 3, 5, 8])):
                copy[r.randrange(len(copy))] = f"x{r.randrange(3000)}"
            texts.append(" ".join(copy))
    chain = [f"c{i}" for i in range(150)]  # a sliding window: neighbours are similar, the ends aren't
    return texts + [" ".join(chain[i : i + 60]) for i in range(0, 90, 5)]


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _brute(texts):
    home = list(range(len(texts)))
    sets = [_shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 and home[i] != home[j]:
                low, high = sorted((home[i], home[j]))
                home = [low if h == high else h for h in home]
    return home


def test_components_equal_brute_force(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(texts)], "doc_id long, text string, k string")
    got = {r.doc_id: r.component for r in similar.similar_components(docs, "k").collect()}
    want = _brute(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_stage_drops_near_copies_that_two_bits_miss(spark):
    texts = _texts()
    want = _brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted(set(want))
    assert len({r.component for r in simhash.simhash_components(docs).collect()}) > len(kept)


def test_parities_never_exceed_the_shingles_apart():
    sets = [similar.shingle_hashes((t or "").encode()) for t in _texts()]
    bits = lambda h: int.from_bytes(similar.parities(h).tobytes(), "little")
    for i, x in enumerate(sets):
        for y in sets[:i]:
            assert (bits(x) ^ bits(y)).bit_count() <= len(set(x.tolist()) ^ set(y.tolist()))


def test_simhash_links_near_copies_that_share_no_cell(spark, monkeypatch):
    monkeypatch.setattr(similar, "cells", lambda h: h.sum(keepdims=True))  # different texts share none
    r = random.Random(3)
    base = [f"w{r.randrange(3000)}" for _ in range(9000)]
    texts = [" ".join(base), " ".join([*base[:-1], "end"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]


def test_a_crowd_of_near_copies_is_joined_in_few_pairs(spark, monkeypatch):
    r, asked, verified = random.Random(4), [], similar._verified
    base, texts = [f"w{r.randrange(3000)}" for _ in range(150)], []
    for i in range(240):
        copy = list(base)
        for _ in range(1 + i % 6):
            copy[r.randrange(len(copy))] = f"x{r.randrange(3000)}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(similar, "_verified", lambda pairs, *given: asked.append(pairs.count()) or verified(pairs, *given))
    docs = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(texts)], "doc_id long, text string, k string")
    got = {x.doc_id: x.component for x in similar.similar_components(docs, "k").collect()}
    assert [got[i] for i in range(len(texts))] == _brute(texts)
    assert sum(asked) < 10 * len(texts)
