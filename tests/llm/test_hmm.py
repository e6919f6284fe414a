import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from claimloom.llm import hmm


def _texts():
    r = random.Random(6)
    parts = {0: ["the", "of", "and", "thing", "other"], 1: ["le", "de", "que", "eau", "ment"]}
    rows = []
    for i in range(150):
        k = r.randrange(2)
        rows.append((i, " ".join(r.choice(parts[k]) if r.random() < 0.9 else f"rare{r.randrange(400)}" for _ in range(r.randint(1, 40)))))
    return rows + [(150, None), (151, ""), (152, "The\tOF\nund " + "the of " * 700), (None, "the of"), (7, rows[7][1])]


def _tok(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def _key(r):
    return -1 if r.doc_id is None else r.doc_id


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hmm"))
    spark.createDataFrame(_texts(), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def result(spark, folder):
    old, hmm.TRAVELLING = hmm.TRAVELLING, 40  # so that most rare words are joined
    try:
        return hmm.op8_hmm(spark, folder).collect()
    finally:
        hmm.TRAVELLING = old


def test_base_and_counts_equal_brute_force(result):
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    seen = Counter(w for d, t in _texts() if not out(d) for w in _tok(t))
    n, v = sum(seen.values()), len(seen)
    want = sorted((-1 if d is None else d, out(d), len(_tok(t)), sum(seen[w] > 0 for w in _tok(t)), n, round(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in _tok(t)), 6)) for d, t in _texts())
    assert sorted((_key(r), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in result) == want


def test_model_beats_the_base_on_held_out_texts(result):
    held = [r for r in result if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_neither_the_way_of_a_word_nor_reruns_change_scores(spark, folder, result):
    again = hmm.op8_hmm(spark, folder).collect()
    a, b = (sorted((_key(r), r.n_known, r.base_score, r.score) for r in x) for x in (result, again))
    assert np.allclose(np.array(a), np.array(b), rtol=1e-9, atol=1e-6)
    third = hmm.op8_hmm(spark, folder).collect()
    assert sorted((_key(r), r.score) for r in third) == sorted((_key(r), r.score) for r in again)


def _small(states=3):
    """A model over five symbols."""
    m = hmm.Model(np.array([0.3, 0.3, 0.1, 0.2, 0.1]), states)
    m.move = np.array([[0.5, 0.3, 0.2], [0.1, 0.8, 0.1], [0.3, 0.3, 0.4]])
    m.start = np.array([0.5, 0.2, 0.3])
    return m


def _paths(m, ids):
    """Likelihood and expected emissions, moves and starts, summed over all paths."""
    emit, move, start, whole = np.zeros_like(m.emit), np.zeros_like(m.move), np.zeros(len(m.start)), 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(ids)):
        p = m.start[path[0]] * m.emit[ids[0], path[0]]
        for t in range(1, len(ids)):
            p *= m.move[path[t - 1], path[t]] * m.emit[ids[t], path[t]]
        whole += p
        start[path[0]] += p
        for t, k in enumerate(path):
            emit[ids[t], k] += p
            if t:
                move[path[t - 1], k] += p
    return whole, emit / whole, move / whole, start / whole


def _expected(m, texts):
    sums, emit = hmm.Expected(m), np.zeros_like(m.emit)
    ids = np.concatenate(texts)
    for at, gamma in sums.of(ids, np.array([len(x) for x in texts])):
        np.add.at(emit, ids[at], gamma)
    return emit, sums.move, sums.start


@pytest.mark.parametrize("piece", [2, 3, 1024])
def test_recursions_equal_sums_over_paths(monkeypatch, piece):
    monkeypatch.setattr(hmm, "PIECE", piece)
    m = _small()
    texts = [np.array(x) for x in ([2], [1, 2, 4, 3, 0, 0, 1], [0, 1], [4, 4, 4, 3])]
    found = [_paths(m, x) for x in texts]
    got = hmm.log_likelihoods(m.emit[np.concatenate(texts)], np.array([len(x) for x in texts]), m.start, m.move)
    assert np.allclose(got, [math.log(x[0]) for x in found])
    for have, i in zip(_expected(m, texts), (1, 2, 3), strict=True):
        assert np.allclose(have, sum(x[i] for x in found), rtol=1e-4, atol=1e-5)


def test_long_texts_count_whole_in_bounded_blocks(monkeypatch):
    m, r = _small(), np.random.default_rng(2)
    texts = [r.integers(0, 5, n) for n in (5000, 3, 700, 1)]
    want = _expected(m, texts)
    monkeypatch.setattr(hmm, "PIECE", 16)
    monkeypatch.setattr(hmm, "_TOKENS", 100)
    for a, b in zip(_expected(m, texts), want, strict=True):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-3)


def test_tokens_of_long_texts_come_in_lists_of_bounded_length(monkeypatch):
    monkeypatch.setattr(hmm, "_CHUNK", 10)
    for text in ("", "a", "abc def\tghi  jkl mno pqr stu\n", "x" * 50, "x" * 50 + " y", " " * 40):
        parts = list(hmm.tokens(text.encode()))
        assert [w for p in parts for w in p] == _tok(text)
    assert len(list(hmm.tokens(b"ab " * 100))) > 20


def test_symbols_follow_from_the_word_alone(monkeypatch):
    r = random.Random(4)
    words = ["".join(r.choice("abcdéß漢") for _ in range(r.randint(1, 12))) for _ in range(300)]
    alone = {w: int(hmm.symbols_of(w.encode())[0]) for w in words}
    assert len(set(alone.values())) > 0.95 * len(set(words))
    text = "\t\n ".join(w.upper() if w.isascii() else w for w in words).encode() + b" "
    want = [alone[w] for w in words] + [0]
    assert hmm.symbols_of(text).tolist() == want
    raw = [w.encode() for w in words]
    assert hmm._symbols_of_words([*raw[:5], hmm.END, *raw[5:]]).tolist() == [*want[:5], 0, *want[5:-1]]
    assert hmm._symbols_of_words(raw).tolist() == want[:-1] and hmm._symbols_of_words([hmm.END]).tolist() == [0]
    monkeypatch.setattr(hmm, "_CHUNK", 30)
    monkeypatch.setattr(hmm, "_POWERS", [])
    assert hmm.symbols_of(text).tolist() == want
    long = "y" * 31 + " " + "x" * 200
    assert hmm.symbols_of(f"a b {long}".encode()).tolist() == [hmm.symbols_of(w.encode())[0] for w in ("a", "b", *long.split())] + [0]
    assert hmm.symbols_of(b"").tolist() == [0] and hmm.symbols_of(b"  \n").tolist() == [0]


@pytest.mark.filterwarnings("ignore:the model still moved")
def test_fit_equals_plain_baum_welch_and_unties_all_words(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("a b c d e f".split() if i % 2 else "f g h i j a".split()) for _ in range(r.randint(1, 12))) for i in range(300)]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = hmm.fit(train, states=2, settled=0, passes=6)
    seen = Counter(w for t in texts for w in _tok(t))
    counts = np.ones(hmm.CLASSES)
    for w in seen:
        counts[hmm.symbols_of(w)[0]] += seen[w]
    m = hmm.Model(counts / counts.sum(), 2)
    ids = [hmm.symbols_of(t.encode()) for t in texts]
    for _ in range(6):
        m.updated(*_expected(m, ids))
    words = {w: np.zeros(2) for w in seen}
    sums = hmm.Expected(m)
    flat = [w for t in texts for w in _tok(t)]
    for at, gamma in sums.of(np.concatenate(ids), np.array([len(x) for x in ids])):
        for i, g in zip(at, gamma, strict=True):
            words[flat[i]] += g
    assert np.allclose(got.move, m.move, atol=1e-4) and np.allclose(got.start, m.start, atol=1e-4)
    rows = {x.word: x for x in got.words.collect()}
    assert {w.decode() for w in seen} == set(rows)
    for w, c in words.items():
        x = rows[w.decode()]
        assert x.n == seen[w] and np.allclose(np.array([x.c0, x.c1]) / 2**20, c, atol=1e-2)
    known = np.array([[x.n, x.c0 / 2**20, x.c1 / 2**20] for x in rows.values()] + [[0, 0, 0]])
    base, emit = got.emissions(known[:, 0], known[:, 1:])
    assert np.allclose(emit.sum(axis=0), 1, atol=1e-6) and abs(base.sum() - 1) < 1e-9


def test_kept_columns_may_clash(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20).selectExpr("doc_id", "text", "text as Score", "1 as __row", "'x' as word")
    language = hmm.fit(docs.select("text"))
    out = hmm.score(docs, language, ["doc_id", "Score", "__row", "word"])
    assert out.columns == ["doc_id", "__row", "word", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and out.count() == 20


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert hmm.op8_hmm(spark, str(tmp_path)).count() == 0
