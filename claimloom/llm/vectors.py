"""Embedding near-duplicates by random-hyperplane sign hashing.

Every table hashes a vector to the signs of its products with that table's
random hyperplanes; vectors that share all signs of a table share one of its
cells. The number of signs follows the number of vectors, so that a cell holds
about `CELL` unrelated ones, and the number of tables follows from it, so that
a pair at the threshold meets with probability `RECALL` (closer pairs: nearer
to 1). Members of a cell are verified by exact cosines in double precision, as
matrix products of blocks; cells of more than `BLOCK` vectors are dealt out as
pairs of blocks, so no task holds a whole hot cell. Equal vectors are collapsed
first: one stands for all, and their links among themselves are counted in
closed form. A pair that meets in several tables counts in the first. What leaves a block is one count for each
vector and a spanning forest of the links, never the pairs themselves, and
components come from distributed contraction of those forests.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.connected import connected_components
from claimloom.plans.durable import cut
from claimloom.sources.tables import table

THRESHOLD = 0.9
#: Chance that a pair just at the threshold meets in some table.
RECALL = 0.98
#: Unrelated vectors that share a cell, about.
CELL = 400
#: Members of one block; two blocks at most are in a task's hands at once.
BLOCK = 1024
#: Least and most signs of a table.
SIGNS = (4, 24)
SEED = 9


def plan(count: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(signs of a table, tables) for so many vectors."""
    signs = min(SIGNS[1], max(SIGNS[0], math.ceil(math.log2(max(1, count) / CELL))))
    meet = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length, in double precision; no row is zero."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_size(column: pa.Array):
    """(places, rows) of the vectors of each length; those that link with nothing are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        rows = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)  # null components come as NaN
        good = np.isfinite(rows).all(axis=1) & rows.any(axis=1)
        yield at[good], rows[good]


def _signed(vectors: DataFrame, signs: int, tables: int, width: str) -> DataFrame:
    """(row, id, size, raw, keys): the vector in binary, and one key a table; null for those that link with nothing."""
    kind = dict(vectors.dtypes)["id"]
    planes: dict[int, np.ndarray] = {}

    def step(batches):
        for batch in batches:
            n = batch.num_rows
            sizes, held, keys = np.zeros(n, np.int32), [None] * n, [None] * n
            for at, rows in _by_size(batch.column(2)):
                size = rows.shape[1]
                if size not in planes:
                    planes[size] = np.random.default_rng([SEED, size]).standard_normal((size, signs * tables))
                bits = (_unit(rows) @ planes[size] >= 0).reshape(len(at), tables, signs)
                made = (bits @ (1 << np.arange(signs))).astype(np.int32)
                sizes[at] = size
                for i, row, key in zip(at.tolist(), rows.astype(width), made, strict=True):
                    held[i], keys[i] = row.tobytes(), key
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(held, pa.binary()), pa.array(keys, pa.list_(pa.int32()))], ["row", "id", "size", "raw", "keys"])

    return vectors.mapInArrow(step, f"row long, id {kind}, size int, raw binary, keys array<int>")


def _forest(link: np.ndarray) -> np.ndarray:
    """For each vertex of a boolean adjacency matrix the least vertex of its component."""
    n = len(link)
    label = np.arange(n)
    for root in range(n):
        if label[root] != root:
            continue
        front = np.zeros(n, bool)
        front[root] = True
        reached = front.copy()
        while front.any():
            front = link[front].any(axis=0) & ~reached
            reached |= front
        label[reached] = root
    return label


def _verify(group: pa.Table, threshold: float, width: str) -> pa.Table:
    """(row, links, other) of one block or pair of blocks: new links of each row, other rows counted as often as they stand for one, and an edge to a row of its component."""
    t, i, j, size = (group.column(c)[0].as_py() for c in ("t", "i", "j", "size"))
    rows, block, many = (group.column(c).to_numpy() for c in ("row", "b", "many"))
    order = np.argsort(rows, kind="stable")
    left, right = (order[block[order] == x] for x in (i, j))
    link = np.zeros((len(left), len(right)), bool)
    if len(left) and len(right):
        unit = _unit(np.frombuffer(b"".join(group.column("raw").to_pylist()), width).reshape(-1, size))
        link = unit[left] @ unit[right].T >= threshold
    if i == j:
        np.fill_diagonal(link, False)
    if t and link.any():
        before = np.concatenate([c.flatten().to_numpy() for c in group.column("before").chunks]).reshape(-1, t)
        for e in range(t):  # pairs that met before are counted and joined there
            link &= before[left, e][:, None] != before[right, e][None, :]
    if i == j:
        rows, whole, links = rows[left], link, link @ many[left]
    else:
        links = np.concatenate([link @ many[right], link.T @ many[left]])
        rows, n = np.concatenate([rows[left], rows[right]]), len(left)
        whole = np.zeros((len(rows), len(rows)), bool)
        whole[:n, n:], whole[n:, :n] = link, link.T
    some = np.flatnonzero(links)
    label = _forest(whole[np.ix_(some, some)])
    return pa.table({"row": pa.array(rows[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "other": pa.array(rows[some][label], pa.int64())})


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id_col, n_links, component) for every row of `vectors`.

    n_links: other rows found at a cosine of `threshold` or more; component:
    the smallest id that links reach. Vectors that are null, empty, zero or
    hold null or non-finite components, and those of different lengths, link
    with nothing. Repeated rows are vectors of their own that link with each
    other. A null id never names a component that has another id. Ties at the
    threshold link. Empty table: empty result. Other columns are not read.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    width = "f4" if single else "f8"  # vectors travel as they are; cosines are double precision either way
    value = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), value.alias("v"))
    signs, tables = plan(vectors.count(), threshold, recall)
    held = cut(_signed(rows, signs, tables, width))
    # equal vectors link with each other and with the same others: one row stands for them
    first = F.min(F.struct("row", "keys"))
    kinds = cut(held.where("raw is not null").groupBy("size", "raw").agg(first.alias("f"), F.count("*").alias("many")).select("size", "raw", "f.row", "f.keys", "many"))
    placed = kinds.select("row", "size", "raw", "many", "keys", F.posexplode("keys").alias("t", "key"))
    large = placed.groupBy("size", "t", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("size", "t", "key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    large = cut(large)
    if large.count() <= 20_000:
        large = F.broadcast(large)
    placed = placed.join(large, ["size", "t", "key"], "left").na.fill(1, ["blocks"])
    placed = placed.withColumn("b", F.pmod(F.xxhash64("row"), "blocks").cast("long"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    before = F.expr("slice(keys, 1, t)").alias("before")  # the keys of earlier tables are all that a table asks for
    placed = placed.select("row", "size", "raw", "many", before, "t", "key", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    checked = placed.groupBy("size", "t", "key", "i", "j").applyInArrow(lambda group: _verify(group, threshold, width), "row long, links long, other long")
    checked = cut(checked)
    links = checked.groupBy("row").agg(F.sum("links").alias("n_links"))
    found = connected_components(checked.where("row <> other").select("row", "other").distinct(), "row", "other").select(F.col("vertex").alias("row"), F.col("component").alias("root"))
    stood = kinds.join(links, "row", "left").join(found, "row", "left")
    stood = stood.select("size", "raw", (F.coalesce("n_links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "row").alias("root"))
    joined = held.select("row", "id", "size", "raw").join(stood, ["size", "raw"], "left")
    joined = joined.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "row").alias("root"))
    joined = cut(joined)
    named = cut(joined.groupBy("root").agg(F.min("id").alias("component")))  # stored, so that the join can split a large component
    return joined.join(named, "root").select(F.col("id").alias(id_col), "n_links", "component")


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    found = linked_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
