"""Source divergence audit by systolic rotation.

How far do the word frequencies of a language's sources lie from each other,
and which terms set a source apart from its language? Every (language,
source) group is a sparse vector of term counts. Vectors are cut by term into
slices, so that a block never outgrows a task, and packed: term numbers as
differences, counts beside them, compressed.

In each slice of a language, `SEATS` seats form a ring. A group is dealt to a
seat and stays there, kept in the executors' memory and partitioned by seat.
Round after round the packed vectors move on by one seat, and each seat
evaluates both directions of every meeting between its own groups and those
that visit. After half a turn every two groups of the slice have met exactly
once. Rounds are jobs of their own: one copy of the packed vectors is under
way at a time, and what a round found is stored. Sums over slices end it.

Terms are ranked where a group's slice is packed: a bounded heap for each,
merged by rank afterwards.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.arrow import map_columns, raw_texts
from claimloom.llm.substrings import parts
from claimloom.plans.durable import cut
from claimloom.sources.tables import table

#: Documents of a language that a term must occur in.
LEAST_DOCUMENTS = 3
#: Terms that are reported for a group.
TOP = 200
#: Seats of a ring; half as many rounds follow the meetings within a seat.
SEATS = 8
#: Vector entries of a block (a seat of a slice), on average, and terms of a slice.
BLOCK, SLICE = 1 << 22, 1 << 20
#: Words that a task counts at once.
_AT_ONCE = 1 << 20
#: ASCII letters as lower case, other ASCII as gaps.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))
_SCALE = (10**5, 10**4)


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exact up to 9 x 10^13 words."""
    whole, rest = np.divmod((count + 1) * _SCALE[0], max(1, total))
    return 1 + whole * _SCALE[1] + rest * _SCALE[1] // max(1, total)


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents) of all whole texts."""

    def flushed(words, kinds):
        for lang, source in words:
            n, own = Counter(words[lang, source]), Counter(kinds[lang, source])
            terms = list(n)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([own[t] for t in terms], pa.int64())]
            yield pa.record_batch(columns, names=["lang", "source", "term", "n", "documents"])
        words.clear()
        kinds.clear()

    def step(batches):
        words, kinds, size = defaultdict(list), defaultdict(list), 0
        for batch in batches:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            for key, raw in zip(keys, raw_texts(batch.column("text")), strict=True):
                seen: set[bytes] = set()
                for part in parts(raw.translate(_FOLD)):
                    found = part.split()
                    words[key] += found
                    kinds[key] += set(found) - seen
                    seen.update(found)
                    size += len(found)
                    if size >= _AT_ONCE:
                        yield from flushed(words, kinds)
                        size = 0
        yield from flushed(words, kinds)

    return map_columns(docs, step, "lang string, source string, term string, n long, documents long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _packed(no: np.ndarray, n: np.ndarray) -> bytes:
    return zlib.compress(np.diff(no, prepend=0).astype(np.int32).tobytes() + n.astype(np.int64).tobytes(), 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    size = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.int32, size), dtype=np.int64), np.frombuffer(raw, np.int64, size, size * 4)


_PACKET = "lang string, slice int, source string, seat int, size long, vocabulary long, terms long, packed binary, top_no array<int>, top_value array<long>"
_PACKET_TYPES = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
_PACKET_SCHEMA = pa.schema(list(zip([x.split()[0] for x in _PACKET.split(", ")], _PACKET_TYPES, strict=True)))


def _packer(top: int):
    """Packs a group's slice and ranks its terms against the language."""

    def pack(frame: pa.Table, vector: pa.Table) -> pa.Table:
        of = frame.to_pylist()[0]
        no, n, whole = (vector[c].to_numpy() for c in ("no", "n", "total"))
        by = np.argsort(no)
        no, n, whole = no[by], n[by], whole[by]
        p, q = shares(n, of["size"] + of["vocabulary"]), shares(whole, of["lang_size"] + of["vocabulary"])
        over = np.flatnonzero(p > q)
        value = (p - q)[over] ** 2 // q[over]
        best = heapq.nsmallest(top, zip((-value).tolist(), no[over].tolist(), strict=True))
        row = {**of, "packed": _packed(no, n), "top_no": [x[1] for x in best], "top_value": [-x[0] for x in best]}
        return pa.Table.from_pylist([{f.name: row[f.name] for f in _PACKET_SCHEMA}], schema=_PACKET_SCHEMA)

    return pack


class _Group:
    """A group's vector in one slice."""

    def __init__(self, row: dict):
        self.source, self.terms = row["source"], row["terms"]
        self.no, n = _unpacked(row["packed"])
        self.p = shares(n, row["size"] + row["vocabulary"])
        self.rest = int(shares(np.zeros(1, np.int64), row["size"] + row["vocabulary"])[0])


def _apart(p: np.ndarray, q: np.ndarray) -> tuple[int, int]:
    """Sums of floor((p-q)^2 / q) and of floor((q-p)^2 / p)."""
    square = (p - q) ** 2
    return int((square // q).sum()), int((square // p).sum())


def _meet(a: _Group, b: _Group, slot: np.ndarray) -> tuple[int, int]:
    """Both directions of a meeting; slot: the place of each of a's terms in a, else -1."""
    hit = slot[b.no]
    common, mine = hit >= 0, hit[hit >= 0]
    alone = np.ones(len(a.no), bool)
    alone[mine] = False
    pairs = [(a.p[mine], b.p[common]), (a.p[alone], np.int64(b.rest)), (np.int64(a.rest), b.p[~common])]
    found = [_apart(p, q) for p, q in pairs]
    neither = a.terms - len(a.no) - len(b.no) + len(mine)
    empty = _apart(np.array([a.rest]), np.array([b.rest]))
    return tuple(sum(x[k] for x in found) + neither * empty[k] for k in (0, 1))


_MET = "lang string, source string, item string, value long"
_MET_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _meetings(residents: pa.Table, visitors: pa.Table | None) -> pa.Table:
    """All meetings of a seat: its own groups with those that visit or, without visitors, with each other."""
    if residents.num_rows == 0 or (visitors is not None and visitors.num_rows == 0):
        return _MET_SCHEMA.empty_table()
    lang, own = residents["lang"][0].as_py(), [_Group(x) for x in residents.to_pylist()]
    others = None if visitors is None else [_Group(x) for x in visitors.to_pylist()]
    slot, rows = np.full(own[0].terms, -1, np.int64), []
    for i, a in enumerate(own):
        slot[a.no] = np.arange(len(a.no))
        for b in own[i + 1 :] if others is None else others:
            there, back = _meet(a, b, slot)
            rows += [(lang, a.source, b.source, there), (lang, b.source, a.source, back)]
        slot[a.no] = -1
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MET_SCHEMA, strict=True)], schema=_MET_SCHEMA) if rows else _MET_SCHEMA.empty_table()


def rotate(packets: DataFrame, seats: int = SEATS) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of a language's groups, from packets at their seats."""
    spark, place = packets.sparkSession, ["lang", "slice", "seat"]
    home = packets.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *place).persist(StorageLevel.DISK_ONLY)
    found = [cut(home.groupBy(*place).applyInArrow(lambda own: _meetings(own, None), _MET))]
    for turn in range(1, seats // 2 + 1):
        # at the half turn of an even ring, two seats would meet twice
        going = packets.where(F.col("seat") < seats // 2) if 2 * turn == seats else packets
        visiting = going.withColumn("seat", (F.col("seat") + turn) % seats)
        found.append(cut(home.groupBy(*place).cogroup(visiting.groupBy(*place)).applyInArrow(_meetings, _MET)))
    home.unpersist()
    met = found[0]
    for more in found[1:]:
        met = met.unionByName(more)
    return met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP, seats: int = SEATS, block: int = BLOCK, per_slice: int = SLICE) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources lie from each other, and the terms that set them apart.

    Terms are runs of letters, A-Z lower-cased; a language keeps those of at
    least `least` of its documents. Part `pair` has a row for every other
    source of the language, part `term` up to `top` rows. Equal values rank
    by item, bytewise. Nulls count as empty strings: an empty text adds its
    group, an empty language or source is one of its own. A repeated row
    counts as another document. A language without kept terms has pairs of
    value 0. Empty table: empty result. Other columns play no part.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = cut(_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("documents").alias("documents")).where(F.col("documents") >= least)
    entries = counts.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    terms = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    slices = max(1, -(-entries // (seats * block)), -(-terms // per_slice))
    slice_of = F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int")
    numbered = Window.partitionBy("lang", "slice").orderBy("term")
    kept = cut(kept.select("lang", "term", "total", slice_of.alias("slice")).withColumn("no", F.row_number().over(numbered) - 1))
    vectors = cut(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]).select("lang", "slice", "source", "no", "n", "total"))

    languages = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("total").alias("lang_size"))
    sizes = vectors.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    sliced = kept.groupBy("lang", "slice").agg(F.count("*").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(languages, "lang", "left").join(sizes, ["lang", "source"], "left")
    frame = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).join(sliced, ["lang", "slice"], "left")
    frame = frame.na.fill(0).withColumn("seat", F.pmod(F.xxhash64("source"), F.lit(seats)).cast("int"))
    own = ["lang", "slice", "source"]
    packets = cut(frame.groupBy(*own).cogroup(vectors.groupBy(*own)).applyInArrow(_packer(top), _PACKET))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = rotate(packets, seats).withColumn("rank", rank)
    heaps = packets.select("lang", "slice", "source", F.explode(F.arrays_zip("top_no", "top_value")).alias("x")).select("lang", "slice", "source", F.col("x.top_no").alias("no"), F.col("x.top_value").alias("value"))
    named = heaps.join(kept.select("lang", "slice", "no", F.col("term").alias("item")), ["lang", "slice", "no"]).select("lang", "source", "item", "value")
    ranked = named.withColumn("rank", rank).where(F.col("rank") <= top)
    shown = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(shown).unionByName(ranked.withColumn("part", F.lit("term")).select(shown))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
found AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
kept AS (
    SELECT lang, term, CAST(count(*) AS HUGEINT) AS total
    FROM found GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
),
languages AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(total) AS HUGEINT) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
    SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c
    FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term
),
sizes AS (
    SELECT g.lang, g.source, CAST(coalesce(sum(c), 0) AS HUGEINT) AS n
    FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source
),
whole AS (
    SELECT s.lang, s.source, k.term, coalesce(c, 0) AS c, total,
        1 + (1000000000 * (coalesce(c, 0) + 1)) // (s.n + l.v) AS p, 1 + (1000000000 * (total + 1)) // (l.n + l.v) AS q
    FROM sizes s JOIN languages l ON s.lang = l.lang JOIN kept k ON s.lang = k.lang
    LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM whole a JOIN whole b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM whole WHERE c > 0 AND p > q
),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
