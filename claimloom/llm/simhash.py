"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is cut into segments and embedded as the vector of
its segments' popcounts. Flipping one bit moves one coordinate by one, so the
Manhattan distance of two vectors never exceeds the Hamming distance of their
fingerprints. Two lattice vectors at Manhattan distance two or less always
have a common lattice vector within distance one of both, so an equi-join on
"cells" (each vector and its unit neighbours) is the range join under that
bound and misses nothing. Members of a cell are then verified exactly.

Texts are read once, by one Arrow pass that returns 64 bits a document; what
is shuffled afterwards is narrow, distinct fingerprints stand for their
copies, and no step gathers a group of unbounded size: a cell with more than
`CELL_LIMIT` members is resolved by joining its members on the corners of
their exact Hamming balls instead of comparing them pairwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm import similar
from claimloom.llm.arrow import map_columns, raw_texts
from claimloom.operators.connected import connected_components
from claimloom.plans.durable import cut
from claimloom.sources.tables import table

SEED = 42
SHINGLE = 3
RADIUS = 2
#: A cell of up to this many distinct fingerprints is verified pair by pair.
CELL_LIMIT = 48
#: Up to this many distinct fingerprints 16 segments tell them apart well enough; beyond, 32.
COARSE_UP_TO = 30_000_000
_BLOCK = 65_536


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; 0 if it has no word."""
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[i:j], seed) for i, j in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, fp long, the columns in `carry`) for every row. Null and wordless texts have fingerprint 0."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), *carry)
    names = [id_col, "fp", *carry]

    def step(batches):
        for batch in batches:
            made = [fingerprint(x, shingle, seed) for x in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64()), *batch.columns[2:]], names)

    kinds = dict(rows.dtypes) | {"fp": "long"}
    return map_columns(rows, step, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def _cells(segments: int):
    """The cell of a fingerprint's vector and those of its unit neighbours, packed into longs."""
    width = 64 // segments
    room = 64 // segments if segments == 32 else 3  # bits that a coordinate takes
    mask = (1 << width) - 1
    count = lambda i: f"cast(bit_count(shiftrightunsigned(fp, {width * i}) & {mask}L) as long)"
    own = " | ".join(f"shiftleft({count(i)}, {room * i})" for i in range(segments))
    moved = lambda i, by: f"own ^ shiftleft({count(i)} ^ ({count(i)} {by} 1L), {room * i})"
    up = [f"if({count(i)} < {width}, {moved(i, '+')}, null)" for i in range(segments)]
    down = [f"if({count(i)} > 0, {moved(i, '-')}, null)" for i in range(segments)]
    return own, f"array_compact(array(own, {', '.join(up + down)}))"


def _links(fps: DataFrame, segments: int) -> DataFrame:
    """Edges (a, b) that connect exactly what fingerprints within two bits connect; `fps` is distinct."""
    own, cells = _cells(segments)
    dealt = fps.selectExpr("fp", f"{own} as own").selectExpr("fp", f"explode({cells}) as cell")
    shared = cut(dealt.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))  # stored, as a join with a bare table can split a crowded cell
    members = cut(dealt.join(shared, "cell"))
    small = members.where(F.col("n") <= CELL_LIMIT).groupBy("cell").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    near = "transform(filter(slice(fps, i + 2, size(fps)), y -> bit_count(x ^ y) <= 2), y -> struct(x as a, y as b))"
    pairs = small.select(F.explode(F.expr(f"flatten(transform(fps, (x, i) -> {near}))")).alias("p")).select("p.a", "p.b")
    crowd = members.where(F.col("n") > CELL_LIMIT).select("fp").distinct()
    flips = ", ".join(f"fp ^ shiftleft(1L, {i})" for i in range(64))
    ball = crowd.selectExpr("fp", f"explode(array(fp, {flips})) as corner")
    hub = cut(ball.groupBy("corner").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").drop("z"))
    stars = ball.join(hub, "corner").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def links(fps: DataFrame) -> DataFrame:
    """`_links` of distinct fingerprints, in as many segments as their number needs."""
    return _links(fps, 16 if fps.count() <= COARSE_UP_TO else 32)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, fp, component, root, the columns in `carry`) for every row of `docs`; root is the group's id among fingerprints.

    Two documents are linked if their fingerprints differ in two bits or
    fewer; component is the smallest id that links reach.

    Null text: as the empty text, fingerprint 0. Null id: kept as a row, and
    never the component of a group that has another id. Repeated rows:
    repeated in the result. Very long text: hashed whole, in blocks. Empty
    table: empty result. Other columns, whatever their names, are not read.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle, seed, carry))
    groups = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = connected_components(links(groups.select("fp"))).select(F.col("vertex").alias("fp"), F.col("component").alias("root"))
    rooted = groups.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component")))
    label = cut(rooted.join(named, "root").select("fp", "component", "root"))
    return marked.join(label, "fp").select(id_col, "fp", "component", "root", *carry)


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each near-duplicate group, all columns as they were.

    Groups are those of `similar_components`: by the exact similarity of
    5-word shingles, of candidates by SimHash and then by MinHash.
    The row that stays has the doc_id that names the group, or none if the
    group has no id at all. Of several rows of the group with that id those
    stay whose digest of id and text is least, and of repeated ones the first
    by the other columns, nulls first (maps and variants have no order and are
    left out). A doc_id that two groups share names each of them. Null texts
    count as empty. An empty table stays empty. Texts are shuffled once.
    """
    plain, key = docs.columns, "__simhash_key"
    own = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n"))
    keyed = docs.withColumn(key, F.md5(F.concat(own, F.lit(":"), F.coalesce("text", F.lit("")))))
    found = similar.similar_components(keyed, key)
    stays = found.where("doc_id <=> component").groupBy("root").agg(F.min(key).alias("__simhash_stays")).select("__simhash_stays")
    sortable = [c for c, kind in docs.dtypes if c != "doc_id" and "map<" not in kind and "variant" not in kind]
    first = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in sortable]))
    kept = keyed.join(stays, F.col(key) == F.col("__simhash_stays")).withColumn("__simhash_rank", first)
    return kept.where("__simhash_rank = 1").select(*[f"`{c}`" for c in plain])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and near-duplicate component."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
