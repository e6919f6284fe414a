"""Near-duplicates by exact Jaccard similarity of word shingles.

Candidates are found twice. First by SimHash and its segment-popcount cells,
as in `simhash`: texts whose fingerprints differ in two bits or fewer. At a
similarity of 0.8 fingerprints lie about ten bits apart and up to twenty,
where unrelated vectors of segment popcounts are as close, so these cells
can't find all. What they leave apart is found by banded MinHash: a document
has `BANDS` cells, each the digest of `ROWS` minima, and two documents that
share a cell are candidates. A pair of similarity s shares none with
probability (1 - s^ROWS)^BANDS, 3 in a million at 0.8.

Every candidate is verified by its exact shingle sets. A cell's members are
first compared with its least member, which joins a large group of copies in
linear time; then, where they are still apart, with about `PARTNERS` of them,
with an eighth of them, and last every member outside the cell's largest
component with all of other components. Each round knows the links of those
before, so a member that any partner has linked meets no more of them. Parity
sketches rule pairs out first: shingles are dealt to `PARITIES` buckets, and
documents have at least as many shingles apart as buckets whose counts differ
in parity. So each candidate is verified, ruled out by a proven bound, or
joined already, and none is skipped.
Documents with the same shingles stand for each other, and a text leaves its
row only if it is a candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import simhash
from claimloom.llm.arrow import map_columns, raw_texts
from claimloom.operators.connected import connected_components
from claimloom.plans.durable import cut

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
PARITIES = 1024
#: Members of an open cell that all others are compared with at once, about; in a cell of no more, all.
PARTNERS = 16
_BLOCK = 512
_ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = np.random.default_rng(43).integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_FOLD = np.random.default_rng(44).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of `shingle` words; of the whole text if it has fewer."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[i:j]) for i, j in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def cells(hashes: np.ndarray) -> np.ndarray:
    """The cells of a document with these shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        x = (hashes[at : at + _BLOCK, None] ^ _TURN) * _ODD
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64) ^ np.arange(BANDS, dtype=np.uint64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """The parity of each bucket's count, packed into longs."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.bool_), bitorder="little").view(np.int64)


def _marked(docs: DataFrame, id_col: str, text_col: str, key: str, shingle: int) -> DataFrame:
    """(id_col, key, fp long, n long, sim long, cells and parities array<long>) for every row; fp is a digest of the shingle set, 0 if that is empty, sim its SimHash."""
    rows = docs.select(F.col(id_col), F.col(key), F.col(text_col).alias("text"))

    def step(batches):
        for batch in batches:
            fps, sizes, sims, found, odd = [], [], [], [], []
            for raw in raw_texts(batch.column(2)):
                h = shingle_hashes(raw, shingle)
                fps.append(xxhash.xxh3_64_intdigest(h.tobytes()) if len(h) else 0)
                sizes.append(len(h))
                sims.append(simhash.majority(h) if len(h) else 0)
                odd.append(parities(h))
                found.append(cells(h).view(np.int64) if len(h) else np.zeros(0, np.int64))
            made = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sims, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], [id_col, key, "fp", "n", "sim", "cells", "parities"])

    kinds = dict(rows.dtypes)
    return map_columns(rows, step, f"`{id_col}` {kinds[id_col]}, `{key}` {kinds[key]}, fp long, n long, sim long, cells array<long>, parities array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, key: str, shingle: int) -> DataFrame:
    """(fp, shingles array<long>) for each row of `wanted` (fp, key)."""
    rows = docs.select(key, F.col(text_col).alias("text")).join(wanted, key).select("fp", "text")

    def step(batches):
        for batch in batches:
            made = [shingle_hashes(raw, shingle).view(np.int64) for raw in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["fp", "shingles"])

    return map_columns(rows, step, "fp long, shingles array<long>").groupBy("fp").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    both = pairs.join(sets.selectExpr("fp as b", "shingles as y"), "b").join(sets.selectExpr("fp as a", "shingles as x"), "a")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("sum"))
    return cut(shared.where(F.col("shared") >= similarity * (F.col("sum") - F.col("shared")) - 1e-9).select("a", "b"))


def _near(groups: DataFrame) -> DataFrame:
    """Candidates (a, b) by SimHash: texts of one fingerprint with the least of them, and these where fingerprints are within two bits."""
    first = cut(groups.groupBy("sim").agg(F.min("fp").alias("a")))  # stored, as a join with a bare table can split a common fingerprint
    same = groups.join(first, "sim").where("a <> fp").select("a", F.col("fp").alias("b"))
    linked = simhash.links(first.select(F.col("sim").alias("fp"))).toDF("x", "y")
    other = linked.join(first.toDF("x", "a"), "x").join(first.toDF("y", "b"), "y").select("a", "b")
    return same.unionByName(other)


def _labels(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("vertex").alias("fp"), F.col("component").alias("root"))


def similar_components(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id_col, key, fp, component, root) for every row of `docs`; component is the least id of the group, root the group's own id.

    Two documents are linked if the Jaccard similarity of their sets of
    `shingle` words is at least `similarity`, and links are followed. `key`
    names a column that tells texts apart.

    Null text: as the empty text; texts without a word are copies of each
    other. Null id: kept as a row, and never the component of a group that has
    another id. Repeated rows: repeated in the result. Empty table: empty.
    """
    close = lambda m, n: F.least(m, n) >= similarity * F.greatest(m, n) - 1e-9
    marked = cut(_marked(docs, id_col, text_col, key, shingle))
    one = F.min(F.struct(key, "n", "sim", "cells", "parities"))
    groups = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least"), one.alias("one")).select("fp", "least", "one.*"))
    dealt = groups.select("fp", "n", F.explode("cells").alias("cell"))
    hubs = dealt.groupBy("cell").agg(F.min(F.struct("fp", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    hubs = cut(hubs)  # stored, as a join with a bare table can split a crowded cell
    members = cut(dealt.join(hubs.select("cell", "m", F.col("hub.fp").alias("hub"), F.col("hub.n").alias("hub_n")), "cell"))
    near = cut(_near(groups))
    wanted = members.select("fp").unionByName(near.selectExpr("explode(array(a, b)) as fp")).distinct()
    sets = cut(_sets(docs, groups.select("fp", key).join(wanted, "fp"), text_col, key, shingle))
    links = _verified(near, sets, similarity)

    label = _labels(links)
    away = members.where((F.col("fp") != F.col("hub")) & close(F.col("n"), F.col("hub_n"))).join(label, "fp", "left").join(label.toDF("hub", "hub_root"), "hub", "left")
    first = away.where(F.coalesce("root", "fp") != F.coalesce("hub_root", "hub")).select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    links = links.unionByName(_verified(first, sets, similarity))
    longs = range(PARITIES // 64)
    sketches = groups.select("fp", *[F.col("parities")[i].alias(f"p{i}") for i in longs])
    apart = F.expr(" + ".join(f"bit_count(p{i} ^ q{i})" for i in longs))
    most = (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("other_n")) + 1e-6  # shingles that similar documents may have apart
    drawn = lambda k: F.pmod(F.xxhash64("fp"), F.col("m")) < k
    stray = F.col("root") != F.col("main")
    for partner in (drawn(PARTNERS), drawn(F.col("m") / 8), stray):
        placed = cut(members.join(_labels(links), "fp", "left").select("cell", "fp", "n", "m", F.coalesce("root", "fp").alias("root")))
        sizes = placed.groupBy("cell", "root").agg(F.count("*").alias("c"))
        main = cut(sizes.groupBy("cell").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots"))
        placed = cut(placed.join(main, "cell").join(sketches, "fp"))
        other = placed.where(partner).selectExpr("cell as other_cell", "fp as other", "n as other_n", "root as other_root", *[f"p{i} as q{i}" for i in longs])
        fresh = (F.col("root") != F.col("other_root")) & close(F.col("n"), F.col("other_n"))
        if partner is stray:  # of two strays each pair comes once
            fresh &= ~stray | (F.col("fp") < F.col("other"))
        joined = placed.join(other, (F.col("cell") == F.col("other_cell")) & fresh & (apart <= most))
        pairs = joined.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()
        links = links.unionByName(_verified(pairs, sets, similarity))

    rooted = groups.select("fp", "least").join(_labels(links), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component")))
    label = cut(rooted.join(named, "root").select("fp", "component", "root"))
    return marked.select(id_col, key, "fp").join(label, "fp").select(id_col, key, "fp", "component", "root")
