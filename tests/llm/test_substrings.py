import hashlib
import random

import numpy as np
import pytest

from claimloom.llm import substrings


def _brute(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, words in split:
        for at in range(len(words) - window + 1):
            w, place = tuple(words[at : at + window]), (key(i), at)
            first[w] = min(first.get(w, place), place)
    out = []
    for i, words in split:
        gone = set()
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < (key(i), at):
                gone.update(range(at, at + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), kept.decode()))
    return sorted(out, key=str)


def _rows(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["ab", "c", "Öl", "d e", "x" * 300, "the", "of"])
    prose = lambda n: " ".join(word() + str(r.randrange(6)) for _ in range(n))
    passage, line, hot = prose(60), prose(12), prose(45)
    texts = []
    for i in range(120):
        parts = [prose(r.randint(0, 30))]
        for _ in range(r.randint(0, 4)):
            parts += [r.choice([passage, line, hot, hot[: r.randint(1, len(hot))], prose(20), "w " * r.randint(0, 70), "p q r " * 15])]
            parts.append(prose(r.randint(0, 9)))
        texts.append(r.choice([" ", "\n", "\t\v", "\f \r"]).join(parts))
    texts += [texts[3], texts[3] + " end", "", None, "one", texts[5].replace("the", "The"), hot, hot + " " + hot]
    r.shuffle(texts)
    return [(i * 3 % 1000, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("window", "chunk"), [(20, 1 << 20), (20, 150), (5, 40), (1, 30), (2, 1 << 20)])
def test_like_brute_force(spark, window, chunk):
    rows = _rows(window + chunk)
    docs = spark.createDataFrame([(*r, "a", 7) for r in rows], "doc_id long, text string, id string, sub int").repartition(5)
    got = substrings.remove_repeats(docs, window=window, chunk_words=chunk).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == _brute(rows, window)
    for r in got:
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed
        assert all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_repeated_and_null_ids(spark):
    rows = _rows(1)
    rows += [rows[9], (rows[12][0], rows[13][1]), (None, rows[14][1]), (None, rows[15][1]), (None, None), (-5, rows[16][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == _brute(rows, 20)


def test_long_text_empty_table_and_digest(spark, tmp_path):
    r = random.Random(2)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(200_000))
    rows = [(2, long), (1, " ".join(long.split()[150_000:150_100])), (3, "u" * 1_000_000 + " " + long[:9000]), (4, "u" * 1_000_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in substrings.op11_substrings(spark, str(tmp_path)).collect()}
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in _brute(rows, 20)}
    assert {i: (x.n_words, x.n_removed, x.kept_sha256) for i, x in got.items()} == want and got[2].n_removed == 100
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(none).count() == 0


def test_word_hashes_do_not_depend_on_neighbours():
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "bb", "é", "z" * r.randint(200, 300)]) for _ in range(r.randint(0, 50))).encode() for _ in range(50)] + [b"", b" \n", b"q " * 300_000]
    for text, found in zip(texts, substrings.word_hashes(texts), strict=True):
        words = text.split()
        assert len(found) == len(words)
        alone = {w: substrings.word_hashes([w])[0][0] for w in set(words)}
        assert np.array_equal(found, np.array([alone[w] for w in words], np.uint64))
