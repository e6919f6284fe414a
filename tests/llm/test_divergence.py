import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimloom.llm import divergence


def _brute(rows, top=200, least=3):
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, holders = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = pattern.findall((text or "").translate(lower))
        count[lang or "", source or ""].update(found)
        holders[lang or ""].update(set(found))
    out = []
    for lang, held in holders.items():
        kept = sorted(t for t in held if held[t] >= least)
        own = {s: {t: c[t] for t in kept} for (g, s), c in count.items() if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        order = lambda xs: sorted(xs, key=lambda x: (-x[1], x[0].encode()))
        for s in own:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", i, v, k) for k, (i, v) in enumerate(order(pairs), 1)]
            out += [(lang, s, "term", i, v, k) for k, (i, v) in enumerate(order(terms)[:top], 1)]
    return sorted(out)


def _rows():
    r = random.Random(6)
    words = ["the", "The", "of", "straße", "ÜBER", "übrig", "don't", "a1b2", "x_y", "日本", "o p", "zz"] + [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = []
    for _ in range(260):
        source = r.choice(["hot", "hot", "hot", "b", "c", "d", "é", None, "", "z"])
        bias = r.sample(words, 8) if source != "hot" else words[:20]
        rows.append((" ".join(r.choice(bias + words) for _ in range(r.randint(0, 40))), r.choice(["en", "en", "de", None]), source))
    rows += [(None, "en", "b"), ("", "fr", "only"), ("..", "fr", "two"), ("unique words here", "it", "x"), ("others there", "it", "y")]
    return rows + rows[:5] + [("the " * 3000, "en", "d")]


@pytest.mark.parametrize(("seats", "block", "per_slice", "top"), [(8, 1 << 22, 1 << 20, 200), (3, 1 << 22, 17, 4), (2, 40, 1 << 20, 5), (1, 1 << 22, 9, 3)])
def test_like_brute_force(spark, seats, block, per_slice, top):
    rows = _rows()
    docs = spark.createDataFrame([(*x, 1, "y") for x in rows], "text string, lang string, source string, term int, item string").repartition(3)
    got = divergence.audit(docs, seats=seats, block=block, per_slice=per_slice, top=top).collect()
    assert sorted(map(tuple, got)) == _brute(rows, top)


def test_every_pair_meets_once(spark):
    for seats in (1, 2, 3, 4, 7, 8):
        rows = [("en", 0, f"s{i}", i % seats, 0, 0, 0, divergence._packed(np.zeros(0, np.int64), np.zeros(0, np.int64)), [], []) for i in range(9)]
        met = divergence.rotate(spark.createDataFrame(rows, divergence._PACKET), seats)
        pairs = [(r.source, r.item) for r in met.collect()]
        assert len(pairs) == len(set(pairs)) == 72


def test_shares_are_exact():
    r = random.Random(1)
    for _ in range(2000):
        total = r.randint(1, 9 * 10**13)
        count = r.randint(0, total)
        assert int(divergence.shares(np.array([count]), total + 1)[0]) == 1 + 10**9 * (count + 1) // (total + 1)


def test_empty_table_and_long_text(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(none).count() == 0
    rows = [("word " * 400_000 + "x" * 600_000 + " end", "en", "a"), ("word end", "en", "b"), ("word end", "en", "b")]
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert sorted(map(tuple, got)) == _brute(rows)
