"""Substring deduplication by Rabin-Karp hashes of every window of words.

A word is removed if a window of `WINDOW` words that covers it also starts
earlier in the corpus: in a document of smaller id, or earlier in its own.

Every window has its Rabin-Karp hash, but a row for each of them would cross
the network at many times the size of the texts. So windows travel in runs:
consecutive windows that contain the same anchor, the least Rabin-Karp hash
among their stretches of `ANCHOR` words. Equal windows have equal anchors, so

1. a run whose anchor occurs once in the corpus holds no repeated window,
2. of runs equal in anchor and in the hash of all their words, all but the
   first go, and the first stands for them,
3. the windows of the remaining runs (one anchor, several surroundings) are
   counted one by one by their 128-bit hash; all but the first go.

Tasks first do this among what they hold, and send a row for an anchor (in 3,
for a window) once a chunk of words; an anchor that a chunk has seen in two
surroundings goes to 3 at once and leaves a witness. So no key has more rows
than there are chunks, however often a passage occurs. The windows removed
from a document merge into maximal intervals of words.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.arrow import map_columns, raw_texts
from claimloom.plans.durable import cut
from claimloom.sources.tables import table

WINDOW = 20
#: Words of an anchor: windows hold 11 of them, so a run has about 6 windows.
ANCHOR = 10
#: Words that are hashed at once; longer texts go in overlapping blocks.
CHUNK = 1 << 20
#: Bytes of text whose words are hashed at once, and bytes from which a word has a digest of its own.
_PART, _LONG = 1 << 18, 256
_GAP = re.compile(rb"[ \t-\r]")
_IS_GAP = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_CODES = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD))
_REGULAR, _WITNESS, _MIXED, _REPEAT = 0, 1, 2, 3
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < size:
        made, size = [], max(size, CHUNK)
        for b in (base, pow(base, -1, 1 << 64)):
            powers = np.full(size, b, np.uint64)
            powers[0] = 1
            made.append(np.cumprod(powers))
        _POWERS[base] = (made[0], made[1])
    return _POWERS[base]


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[by]
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Rabin-Karp hashes of any stretches of a row of numbers, by prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = _powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.down[begin]

    def all(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        return (self.sums[width : width + n] - self.sums[:n]) * self.down[:n]


def parts(raw: bytes) -> Iterator[bytes]:
    """A text cut at gaps; a part is longer than `_PART` only by the rest of a word."""
    at = 0
    while len(raw) - at > _PART:
        gap = _GAP.search(raw, at + _PART)
        if gap is None:
            break
        yield raw[at : gap.start()]
        at = gap.end()
    yield raw[at:]


def _hashed(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    x = np.frombuffer(part, np.uint8)
    inside = np.zeros(len(x) + 2, np.int8)
    inside[1:-1] = ~_IS_GAP[x]
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[::2], edges[1::2]
    h = _mixed(Rolling(_CODES[x], _BASES[0]).of(begin, end), 0)
    for i in np.flatnonzero(end - begin >= _LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(part[begin[i] : end[i]])
    return h, begin


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of each text's words; short texts are hashed together."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        if len(texts[at]) > _PART:
            out.append(np.concatenate([_hashed(p)[0] for p in parts(texts[at])]))
            at += 1
            continue
        to, size = at, 0
        while to < len(texts) and size + len(texts[to]) <= max(_PART, len(texts[at])):
            size += len(texts[to]) + 1
            to += 1
        found, begin = _hashed(b" ".join(texts[at:to]))
        first = np.cumsum([0, *(len(t) + 1 for t in texts[at:to])])
        cuts = np.searchsorted(begin, first)
        out += [found[i:j] for i, j in itertools.pairwise(cuts.tolist())]
        at = to
    return out


def _anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least of each `width` consecutive numbers."""
    place, value, span = np.arange(len(grams)), grams, 1
    while span < width:
        step = min(span, width - span)
        later = value[step:] < value[: len(value) - step]
        place = np.where(later, place[step:], place[: len(place) - step])
        value = np.where(later, value[step:], value[: len(value) - step])
        span += step
    return place


class _Chunk:
    """Words of several texts, or a block of one, with their owners."""

    def __init__(self, window: int):
        self.window = window
        self.words: list[np.ndarray] = []
        self.owner: list[tuple] = []  # (id, sub, number of the first word)
        self.wanted: list[np.ndarray | None] = []
        self.size = 0

    def add(self, words: np.ndarray, owner: tuple, wanted: np.ndarray | None = None) -> None:
        self.words.append(words)
        self.owner.append(owner)
        self.wanted.append(wanted)
        self.size += len(words)

    def laid_out(self) -> None:
        self.flat = np.concatenate(self.words)
        sizes = np.array([len(w) for w in self.words])
        self.ends = np.cumsum(sizes)
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.start = np.repeat(self.ends - sizes, sizes)
        ids = [(o[0] is None, o[0] or 0) for o in self.owner]
        rank = {x: i for i, x in enumerate(sorted(set(ids)))}
        self.rank = np.array([rank[x] for x in ids], np.int64)
        self.base = np.array([o[2] for o in self.owner], np.int64)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows by their start: text, number of the word in the whole text, and a number that orders windows."""
        text = self.text[at]
        number = at - self.start[at] + self.base[text]
        return text, number, (self.rank[text] << np.int64(40)) + number

    def owners(self, text: np.ndarray) -> tuple[pa.Array, pa.Array]:
        ids = pa.array([o[0] for o in self.owner], pa.int64()).take(pa.array(text))
        return ids, pa.array(np.array([o[1] for o in self.owner], np.int64)[text])


def _firsts(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting by keys, then order: the sorting, which of the sorted begin a new key, and which start no later than their key's first."""
    by = np.lexsort((order, *reversed(keys)))
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([k[by][1:] != k[by][:-1] for k in keys])
    first = order[by][np.flatnonzero(new)][np.cumsum(new) - 1]
    return by, new, order[by] <= first


_RUNS = "deal long, content long, kind int, id long, sub long, at int, n int"
_RUN_SCHEMA = pa.schema([("deal", pa.int64()), ("content", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("sub", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])


def _runs(chunk: _Chunk, anchor: int) -> Iterator[pa.RecordBatch]:
    chunk.laid_out()
    window, flat = chunk.window, chunk.flat
    if len(flat) < window:
        return
    rolling = Rolling(flat, _BASES[1])
    grams = _mixed(rolling.all(anchor), 1)
    places = _anchors(grams, window - anchor + 1)
    valid = np.arange(len(places)) + window <= chunk.ends[chunk.text[: len(places)]]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return
    held = places[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (held[1:] != held[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    at, n = starts[head], np.diff(np.append(head, len(starts)))
    deal = grams[held[head]].view(np.int64)
    content = _mixed(rolling.of(at, at + n + window - 1) + n.astype(np.uint64), 0).view(np.int64)
    text, number, order = chunk.place(at)
    by, fresh, first = _firsts(order, deal, content)
    # anchors that stand here in several surroundings
    other = np.ones(len(by), bool)
    other[1:] = deal[by][1:] != deal[by][:-1]
    group = np.cumsum(other) - 1
    several = np.bincount(group, weights=fresh)[group] > 1
    kind = np.where(first, np.where(several, _MIXED, _REGULAR), _REPEAT).astype(np.int32)
    # rows that need no comparison are dealt out evenly
    spread = _mixed(order[by].view(np.uint64) ^ content[by].view(np.uint64), 1).view(np.int64)
    dealt = np.where(kind == _REGULAR, deal[by], spread)
    ids, subs = chunk.owners(text[by])
    yield pa.record_batch([dealt, content[by], kind, ids, subs, number[by].astype(np.int32), n[by].astype(np.int32)], schema=_RUN_SCHEMA)
    witness = deal[by][several & other]
    if len(witness):
        empty = pa.nulls(len(witness), pa.int64())
        zero = np.zeros(len(witness), np.int32)
        yield pa.record_batch([witness, zero.astype(np.int64), np.full(len(witness), _WITNESS, np.int32), empty, zero.astype(np.int64), zero, zero], schema=_RUN_SCHEMA)


_WINDOWS = "h1 long, h2 long, repeat boolean, id long, sub long, at int"
_WINDOW_SCHEMA = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("repeat", pa.bool_()), ("id", pa.int64()), ("sub", pa.int64()), ("at", pa.int32())])


def _windows(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
    chunk.laid_out()
    window, flat = chunk.window, chunk.flat
    begin = chunk.ends - [len(w) for w in chunk.words]
    at = np.concatenate([b + w for b, w in zip(begin, chunk.wanted, strict=True)])
    if not len(at):
        return
    h = [_mixed(Rolling(flat, base).of(at, at + window), i).view(np.int64) for i, base in enumerate(_BASES)]
    text, number, order = chunk.place(at)
    by, _, first = _firsts(order, *h)
    ids, subs = chunk.owners(text[by])
    spread = _mixed(order[by].view(np.uint64), 1).view(np.int64)
    yield pa.record_batch([np.where(first, h[0][by], spread), h[1][by], ~first, ids, subs, number[by].astype(np.int32)], schema=_WINDOW_SCHEMA)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row and word hashes of each text of a batch."""
    rows = enumerate(raw_texts(batch.column("text")))
    while some := list(itertools.islice(rows, 64)):
        for (i, _), words in zip(some, word_hashes([t for _, t in some]), strict=True):
            yield i, words


def _chunked(batches, window: int, wanted: bool, size: int) -> Iterator[_Chunk]:
    chunk = _Chunk(window)
    for batch in batches:
        ids, subs = batch.column("id").to_pylist(), batch.column("sub").to_pylist()
        for i, words in _texts(batch):
            asked = None
            if wanted:
                runs = batch.column("runs")[i].values
                begin, n = (runs.field(c).to_numpy() for c in ("at", "n"))
                asked = np.sort(np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            for at in range(0, max(1, len(words) - window + 1), size):
                block = words[at : at + size + window - 1]
                mine = asked[np.searchsorted(asked, at) : np.searchsorted(asked, at + size)] - at if wanted else None
                if chunk.size + len(block) > size and chunk.size:
                    yield chunk
                    chunk = _Chunk(window)
                chunk.add(block, (ids[i], subs[i], at), mine)
    if chunk.size:
        yield chunk


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, sub and text: sub tells rows of one id apart, and is 0 throughout if ids are unique."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    repeated = ids.groupBy("id").count().where("count > 1").limit(1).count()
    sub = F.xxhash64(text_col) if repeated else F.lit(0).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("id"), sub.alias("sub"), F.col(text_col).alias("text"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["rid"]) & (a["sub"] == b["rsub"])


def repeated_runs(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, chunk_words: int = CHUNK) -> DataFrame:
    """(id, sub, runs): for each text with any, the runs (at, n) of windows that also start earlier; runs may overlap."""

    def runs(batches):
        for chunk in _chunked(batches, window, False, chunk_words):
            yield from _runs(chunk, anchor)

    def windows(batches):
        for chunk in _chunked(batches, window, True, chunk_words):
            yield from _windows(chunk)

    start = [F.col("id").isNull(), F.col("id"), F.col("at")]
    sent = map_columns(keyed, runs, _RUNS).repartition("deal")
    equal, anchored = Window.partitionBy("deal", "content").orderBy("kind", *start), Window.partitionBy("deal")
    judged = sent.withColumn("turn", F.rank().over(equal)).withColumns({"low": F.min("content").over(anchored), "high": F.max("content").over(anchored), "witness": F.max((F.col("kind") == _WITNESS).cast("int")).over(anchored)})
    regular = F.col("kind") == _REGULAR
    gone = (F.col("kind") == _REPEAT) | (regular & (F.col("turn") > 1))
    open_ = (F.col("kind") == _MIXED) | (regular & (F.col("turn") == 1) & ((F.col("low") != F.col("high")) | (F.col("witness") == 1)))
    found = cut(judged.where(gone | open_).select("id", "sub", "at", "n", gone.alias("gone")))
    asked = found.where("not gone").groupBy(F.col("id").alias("rid"), F.col("sub").alias("rsub")).agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    texts = keyed.join(asked, _same(keyed, asked)).select("id", "sub", "text", "runs")
    counted = map_columns(texts, windows, _WINDOWS).withColumn("turn", F.rank().over(Window.partitionBy("h1", "h2").orderBy("repeat", *start)))
    later = counted.where("repeat or turn > 1").select("id", "sub", "at", F.lit(1).alias("n"))
    every = found.where("gone").select("id", "sub", "at", "n").unionByName(later)
    return every.groupBy(F.col("id").alias("rid"), F.col("sub").alias("rsub")).agg(F.collect_list(F.struct("at", "n")).alias("runs"))


def _covered(runs, words: int, window: int) -> np.ndarray:
    """Which words the runs cover."""
    edge = np.zeros(words + 1, np.int64)
    at, n = (runs.field(c).to_numpy() for c in ("at", "n"))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n - 1 + window, -1)
    return np.cumsum(edge)[:-1] > 0


def _kept(raw: bytes, covered: np.ndarray | None) -> Iterator[bytes]:
    """The text of the words that stay, in pieces."""
    at, glue = 0, b""
    for part in parts(raw):
        words = part.split()
        stay = words if covered is None else list(itertools.compress(words, ~covered[at : at + len(words)]))
        at += len(words)
        if stay:
            yield glue + b" ".join(stay)
            glue = b" "


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False, chunk_words: int = CHUNK) -> DataFrame:
    """(`id_col`, n_words, n_removed, spans, kept): what stays of each document, a row for each of `docs`.

    `spans` are the maximal intervals (begin, end) of removed words, from 0,
    the end exclusive; `kept` is the text of the other words joined by one
    space or, with `digest`, its sha256. Null text: no words. Texts shorter
    than a window keep all. A null id comes after all others. Rows of one id
    and the same text start at the same places, so none is removed on account
    of the other; of different texts under one id, the one whose window
    starts at the lower word is earlier, whichever text it stands in. Empty
    table: empty result. Other columns of `docs`, of whatever name, play no
    part. Ids are integers.
    """
    keyed = _keyed(docs, id_col, text_col)
    runs = repeated_runs(keyed, window, min(ANCHOR, max(1, window // 2)), chunk_words)
    joined = keyed.join(runs, _same(keyed, runs), "left").select("id", "text", "runs")
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.string())])

    def step(batches):
        for batch in batches:
            ids, rows, size = batch.column("id").to_pylist(), [], 0
            for i, raw in enumerate(raw_texts(batch.column("text"))):
                words, spans, covered = sum(len(p.split()) for p in parts(raw)), [], None
                if batch.column("runs")[i].is_valid:
                    covered = _covered(batch.column("runs")[i].values, words, window)
                    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).tolist()
                    spans = [{"begin": b, "end": e} for b, e in zip(edges[::2], edges[1::2], strict=True)]
                if digest:
                    sha = hashlib.sha256()
                    for piece in _kept(raw, covered):
                        sha.update(piece)
                    kept = sha.hexdigest()
                else:
                    kept = b"".join(_kept(raw, covered)).decode()
                rows.append((ids[i], words, 0 if covered is None else int(covered.sum()), spans, kept))
                size += len(kept)
                if size > 1 << 26:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    out = map_columns(joined, step, "id long, n_words long, n_removed long, spans array<struct<begin:int,end:int>>, kept string")
    return out.withColumnRenamed("id", id_col)


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE = r"""
WITH listed AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
windows AS (
    SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS content
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM listed WHERE len(words) >= 20) x
),
later AS (
    SELECT doc_id, i
    FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS turn FROM windows) x
    WHERE turn > 1
),
gone AS (SELECT DISTINCT doc_id, i + j AS nth FROM later, (SELECT unnest(range(20)) AS j) x),
words AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS nth FROM listed),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY nth) AS kept, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, nth)
    GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM listed l LEFT JOIN kept k ON l.doc_id = k.doc_id
"""
