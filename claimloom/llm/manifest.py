"""Merkle dataset manifest: a digest of the whole table, and a proof for each row.

Rows are leaves. Each source's leaves form a tree in the order of ids, whose
runs of `FAN` nodes have a parent each; the sources' roots form another such
tree. A row's proof holds the siblings on its way to the root, so the row can
be checked without any other.

Leaves are hashed by Spark's own functions where the text is read; no text is
shuffled. Ids are ranked range by range. A tree is cut into blocks of
`FAN`^`DEPTH` neighbouring leaves, each aligned with a node of the tree. A
task descends into a block recursively; while it unwinds, a node returns its
digest and appends its siblings to the leaves below it. Block roots are the
leaves of the next traversal, distributed in turn, until one node is left, so
a source with a third of all rows is dealt out like any other. The upper part
of a proof is kept once for a block and joined to its leaves at the end.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.arrow import map_columns
from claimloom.plans.durable import cut
from claimloom.sources.tables import table

#: Nodes of a run.
FAN = 3
#: Levels of a block: 3^7 = 2187 leaves.
DEPTH = 7
_SIZE = 32


def _h(digests: list[bytes]) -> bytes:
    """sha256 of the digests' hex texts, one after the other."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def levels(nodes: int, fan: int = FAN) -> int:
    """Levels above `nodes` leaves until one node is left."""
    found = 0
    while nodes > 1:
        nodes, found = -(-nodes // fan), found + 1
    return found


def traverse(digests: list[bytes], height: int, fan: int = FAN) -> tuple[bytes, list[bytes]]:
    """Root of a block `height` levels above its leaves, and each leaf's steps to it.

    A step is the node's place in its run, the number of its siblings, and
    these from left to right.
    """
    paths = [bytearray() for _ in digests]

    def visit(begin: int, height: int) -> bytes:
        if height == 0:
            return digests[begin]
        span = fan ** (height - 1)
        starts = [at for at in range(begin, begin + fan * span, span) if at < len(digests)]
        children = [visit(at, height - 1) for at in starts]
        for place, at in enumerate(starts):
            step = bytes((place, len(children) - 1)) + b"".join(children[:place] + children[place + 1 :])
            for leaf in range(at, min(at + span, len(digests))):
                paths[leaf] += step
        return _h(children)

    return visit(0, height), [bytes(p) for p in paths]


def siblings(path: bytes) -> list[tuple[int, list[bytes]]]:
    """The steps of a path: place of the node, and its siblings."""
    out, at = [], 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        out.append((place, [path[at + 2 + i * _SIZE : at + 2 + (i + 1) * _SIZE] for i in range(n)]))
        at += 2 + n * _SIZE
    return out


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for place, others in siblings(path):
        leaf = _h([*others[:place], leaf, *others[place:]])
    return leaf


def leaf_digest(columns: list[Column]) -> Column:
    """Binary sha256 of the columns: `-` for null, else the UTF-8 byte count, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    shown = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*shown), 256))


def placed(leaves: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """`leaves` with `pos`, the place within the tree from 0, and `size`, the tree's leaves, range by range."""
    by = [F.asc_nulls_first(c) for c in (tree, *order)]
    ranged = cut(leaves.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    counted = ranged.groupBy(F.col(tree).alias("of"), F.col("part").alias("in")).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("of").orderBy("in").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counted.select("of", "in", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("of")).alias("size")))
    within = Window.partitionBy("part", tree).orderBy(*by[1:])
    numbered = ranged.withColumn("own", F.row_number().over(within) - 1)
    joined = numbered.join(offsets, F.col(tree).eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    return joined.select(*leaves.columns, (F.col("own") + F.col("before")).alias("pos"), "size")


_BLOCK = "tree string, block long, size long, leaf boolean, id long, pos long, digest binary, other binary, path binary"
_BLOCK_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_BLOCK_SCHEMA = pa.schema(list(zip([x.split()[0] for x in _BLOCK.split(", ")], _BLOCK_TYPES, strict=True)))


def _traversed(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """Nodes (tree, pos, size, id, digest, other) by blocks: each with its path to the block's root, and a row for that root."""

    def step(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        size, n = group["size"][0].as_py(), group.num_rows
        height = min(depth, levels(size, fan))
        root, paths = traverse(group["digest"].to_pylist(), height, fan)
        tree, block = group["tree"][0].as_py(), group["block"][0].as_py()
        columns = [
            pa.array([tree] * (n + 1), pa.string()),
            pa.array([block] * (n + 1), pa.int64()),
            pa.array([size] * n + [-(-size // fan**height)], pa.int64()),
            pa.array([True] * n + [False]),
            pa.array([*group["id"].to_pylist(), None], pa.int64()),
            pa.array([*group["pos"].to_pylist(), block], pa.int64()),
            pa.array([*group["digest"].to_pylist(), root], pa.binary()),
            pa.array([*group["other"].to_pylist(), None], pa.binary()),
            pa.array([*paths, None], pa.binary()),
        ]
        return pa.Table.from_arrays(columns, schema=_BLOCK_SCHEMA)

    blocks = nodes.withColumn("block", F.floor(F.col("pos") / fan**depth))
    return cut(blocks.select("tree", "block", "pos", "size", "id", "digest", "other").groupBy("tree", "block").applyInArrow(step, _BLOCK))


def _roots(found: DataFrame) -> DataFrame:
    return found.where("not leaf").select("tree", "pos", "size", "id", "digest", "other")


def _grown(nodes: DataFrame, fan: int, depth: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Whole trees over `nodes`.

    Returns the first traversal's rows, the steps above each of its blocks (tree,
    block, upper; None if one traversal was enough), and the roots (tree, digest).
    """
    found = _traversed(nodes, fan, depth)
    roots, rounds = _roots(found), []
    while roots.where("size > 1").limit(1).count():
        rounds.append(_traversed(roots, fan, depth))
        roots = _roots(rounds[-1])
    upper = None
    for later in reversed(rounds):
        steps = later.where("leaf").select("tree", F.col("pos").alias("block"), "path", F.col("block").alias("above"))
        if upper is None:
            upper = steps.select("tree", "block", F.col("path").alias("upper"))
        else:
            more = upper.select(F.col("tree").alias("of"), F.col("block").alias("above_of"), "upper")
            joined = steps.join(more, F.col("tree").eqNullSafe(F.col("of")) & (F.col("above") == F.col("above_of")))
            upper = joined.select("tree", "block", F.concat("path", "upper").alias("upper"))
    return found, None if upper is None else cut(upper), roots.select("tree", "digest")


_PROOF = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, columns: list[str], text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", tampered: Column | None = None, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(`id_col`, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each of `docs`.

    `columns` make the leaf, in their order. Where `tampered` holds, the leaf
    that is folded has a text without newlines; else it is the original. Null
    ids and the null source come first; a null text stays null. Leaves of one
    source and id go by their digests, so repeated rows stand side by side as
    leaves of their own. Texts count whole. Empty table: empty result. Other
    columns of `docs`, of whatever name, play no part.
    """
    digest = leaf_digest([F.col(c) for c in columns])
    cleaned = leaf_digest([F.translate(F.col(c), "\n", "") if c == text_col else F.col(c) for c in columns])
    other = F.when(F.coalesce(tampered, F.lit(False)), cleaned) if tampered is not None else F.lit(None).cast("binary")
    leaves = docs.select(F.col(source_col).cast("string").alias("tree"), F.col(id_col).cast("long").alias("id"), digest.alias("digest"), other.alias("other"))
    found, upper, roots = _grown(placed(leaves, "tree", ["id", "digest"]), fan, depth)

    # the sources' roots are the leaves of a tree of their own
    above = placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), "tree", ["source"])
    above = cut(above.withColumns({"id": F.col("pos"), "other": F.lit(None).cast("binary")}))
    top, more, root = _grown(above, fan, depth)
    root_digest = next((bytes(r.digest) for r in root.select("digest").take(1)), b"")
    steps = top.where("leaf").select("pos", "path", "block")
    if more is not None:
        steps = steps.join(more.select("block", F.col("upper").alias("rest")), "block").withColumn("path", F.concat("path", "rest"))
    sources = above.select("source", "pos", F.col("digest").alias("subroot")).join(steps, "pos").select("source", "subroot", F.col("path").alias("last"))

    # what is above a block is joined to the block before it is joined to leaves
    blocks = found.where("not leaf").select(F.col("tree").alias("of"), F.col("block").alias("part"))
    if upper is not None:
        known = upper.select(F.col("tree").alias("in"), F.col("block").alias("there"), "upper")
        blocks = blocks.join(known, F.col("of").eqNullSafe(F.col("in")) & (F.col("part") == F.col("there")), "left").select("of", "part", "upper")
    else:
        blocks = blocks.withColumn("upper", F.lit(None).cast("binary"))
    whole = F.concat(F.coalesce("upper", F.lit(b"")), "last")
    blocks = cut(blocks.join(sources, F.col("of").eqNullSafe(F.col("source"))).select("of", "part", "subroot", whole.alias("rest")))
    own = found.where("leaf").select("tree", "block", "id", "digest", "other", "path")
    rows = own.join(blocks, F.col("tree").eqNullSafe(F.col("of")) & (F.col("block") == F.col("part")))

    def prove(batches):
        for batch in batches:
            out = []
            for id_, digest, other, path, subroot, rest in zip(*(batch.column(c).to_pylist() for c in ("id", "digest", "other", "path", "subroot", "rest")), strict=True):
                steps = path + rest
                proof = _h([s for _, others in siblings(steps) for s in others])
                folded = fold(digest if other is None else other, steps)
                out.append((id_, digest.hex(), subroot.hex(), root_digest.hex(), proof.hex(), folded.hex(), folded == root_digest))
            if out:
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PROOF.split(", ")])

    proofs = map_columns(rows.select("id", "digest", "other", "path", "subroot", "rest"), prove, _PROOF)
    return proofs.withColumnRenamed("id", id_col)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered=even)


ORACLE = r"""
WITH RECURSIVE
rows AS (
    SELECT doc_id, source, lang, n_chars, text, replace(text, chr(10), '') AS cleaned,
        list_reduce(
            [4294967295] || flatten(list_transform(range(1, CAST(length(CAST(doc_id AS VARCHAR)) AS BIGINT) + 1),
                lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
            lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END
        ) % 2 = 1 AS tampered
    FROM documents
),
shown AS (
    SELECT doc_id, source, tampered,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(cleaned) || ':' || cleaned, '-') AS other
    FROM rows
),
leaves AS (
    SELECT doc_id, coalesce('s' || source, '') AS tree, sha256(head || body) AS leaf,
        sha256(head || CASE WHEN tampered THEN other ELSE body END) AS used,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
    FROM shown
),
nodes(tree, level, idx, digest, n) AS (
    SELECT tree, 0, CAST(pos AS BIGINT), leaf, CAST(n AS BIGINT) FROM leaves
    UNION ALL
    SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3
    FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n
),
subroots AS (
    SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
),
tops(level, idx, digest, n) AS (
    SELECT 0, CAST(pos AS BIGINT), subroot, CAST(n AS BIGINT) FROM subroots
    UNION ALL
    SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3
    FROM tops WHERE n > 1 GROUP BY level, idx // 3, n
),
beside AS (
    SELECT doc_id, 0 AS stage, level, idx, digest
    FROM leaves JOIN nodes USING (tree)
    WHERE nodes.n > 1 AND idx // 3 = pos // CAST(pow(3, level + 1) AS BIGINT) AND idx <> pos // CAST(pow(3, level) AS BIGINT)
    UNION ALL
    SELECT doc_id, 1, level, idx, digest
    FROM leaves JOIN subroots s USING (tree) JOIN tops
        ON tops.n > 1 AND idx // 3 = s.pos // CAST(pow(3, level + 1) AS BIGINT) AND idx <> s.pos // CAST(pow(3, level) AS BIGINT)
),
proofs AS (SELECT doc_id, sha256(string_agg(digest, '' ORDER BY stage, level, idx)) AS proof FROM beside GROUP BY doc_id),
folds(doc_id, tree, level, idx, digest, n) AS (
    SELECT doc_id, tree, 0, CAST(pos AS BIGINT), used, CAST(n AS BIGINT) FROM leaves
    UNION ALL
    SELECT doc_id, f.tree, f.level + 1, f.idx // 3, sha256(string_agg(CASE WHEN m.idx = f.idx THEN f.digest ELSE m.digest END, '' ORDER BY m.idx)), (f.n + 2) // 3
    FROM folds f JOIN nodes m ON m.tree = f.tree AND m.level = f.level AND m.idx // 3 = f.idx // 3
    WHERE f.n > 1 GROUP BY doc_id, f.tree, f.level, f.idx, f.n
),
tips(doc_id, level, idx, digest, n) AS (
    SELECT doc_id, 0, CAST(s.pos AS BIGINT), digest, CAST(s.n AS BIGINT) FROM folds JOIN subroots s USING (tree) WHERE folds.n = 1
    UNION ALL
    SELECT doc_id, f.level + 1, f.idx // 3, sha256(string_agg(CASE WHEN m.idx = f.idx THEN f.digest ELSE m.digest END, '' ORDER BY m.idx)), (f.n + 2) // 3
    FROM tips f JOIN tops m ON m.level = f.level AND m.idx // 3 = f.idx // 3
    WHERE f.n > 1 GROUP BY doc_id, f.level, f.idx, f.n
)
SELECT l.doc_id, leaf, subroot, r.digest AS root, coalesce(proof, sha256('')) AS proof_sha256,
    t.digest AS folded_root, t.digest = r.digest AS verified
FROM leaves l JOIN subroots USING (tree) JOIN (SELECT digest FROM tops WHERE n = 1) r ON true
JOIN tips t ON t.doc_id = l.doc_id AND t.n = 1
LEFT JOIN proofs p ON p.doc_id = l.doc_id
"""
