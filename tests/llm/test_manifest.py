import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from claimloom.llm import manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def _h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes, fan):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def _way(tree, at, fan):
    for level in tree[:-1]:
        begin = at // fan * fan
        yield at - begin, [x for i, x in enumerate(level[begin : begin + fan], begin) if i != at]
        at //= fan


def _brute(rows, fan):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, bytes.fromhex(_leaf(row)), row))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = _tree([x[2].hex() for x in by[s]], fan)
    top = _tree([trees[s][-1][0] for s in names], fan)
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(by[s]):
            steps = [*_way(trees[s], at, fan), *_way(top, k, fan)]
            used = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                used = (*row[:4], row[4].replace("\n", ""))
            folded = _leaf(used)
            for place, others in steps:
                folded = _h("".join([*others[:place], folded, *others[place:]]))
            root = top[-1][0]
            out.append((row[0], leaf.hex(), trees[s][-1][0], root, _h("".join(x for _, o in steps for x in o)), folded, folded == root))
    return sorted(out, key=str)


def _rows(n, sources):
    r = random.Random(n)
    rows = []
    for i in range(n):
        text = r.choice([None, "", "a\nb", "plain", "é\r\nü\n", "\n", "x" * 5000 + "\n"])
        rows.append((i * 7 % 1009 - 5, r.choice(sources), r.choice(["en", None, ""]), r.choice([None, len(text or "")]), text))
    return rows


def _found(spark, rows, fan=3, depth=manifest.DEPTH):
    docs = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, source string, lang string, n_chars long, text string, id int, tree string").repartition(5)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return sorted(map(tuple, manifest.manifest(docs, COLUMNS, tampered=even, fan=fan, depth=depth).collect()), key=str)


@pytest.mark.parametrize(("fan", "depth"), [(3, 7), (3, 1), (2, 2), (5, 1)])
def test_like_brute_force(spark, fan, depth):
    rows = _rows(170, ["hot"] * 6 + ["b", "é", "", None, "Z", "a", "aa"]) + [(5000, "lone", "en", 1, "x\ny"), (None, "hot", "en", 1, "no\nid"), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (rows[4][0], rows[4][1], "xx", 0, "other")]
    assert _found(spark, rows, fan, depth) == _brute(rows, fan)


def test_many_sources(spark):
    rows = _rows(60, [f"s{i}" for i in range(40)])
    assert _found(spark, rows, 3, 1) == _brute(rows, 3)


def test_single_row_and_empty_table(spark):
    assert _found(spark, [(8, "a", "en", 3, "a\nb")]) == _brute([(8, "a", "en", 3, "a\nb")], 3)
    assert _found(spark, []) == []


def test_blocks_fit_into_the_tree():
    r = random.Random(1)
    for n in (1, 2, 3, 4, 9, 10, 26, 27, 28, 100):
        digests = [r.randbytes(32) for _ in range(n)]
        root, paths = manifest.traverse(digests, manifest.levels(n))
        assert root.hex() == _tree([d.hex() for d in digests], 3)[-1][0]
        for i, (d, p) in enumerate(zip(digests, paths, strict=True)):
            assert manifest.fold(d, p) == root
            steps = [(place, [o.hex() for o in others]) for place, others in manifest.siblings(p)]
            assert steps == list(_way(_tree([x.hex() for x in digests], 3), i, 3))
