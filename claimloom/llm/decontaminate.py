"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short, a document may be long, so their Jaccard similarity says
little; what matters is containment: the share of the item's word shingles
that the document has. Items are partitioned by their number of distinct
shingles. An item's sketch is bottom-k MinHash: its k shingles of least hash,
where k depends on its partition. With k greater than (1 - threshold) x the
partition's largest size, a document that holds at least `threshold` of the
item must hold one of the k (were all k missing, too few would be left), so
probing documents' shingle hashes for sketch members finds every pair; none is
left to chance. Each candidate is then verified by the exact shingles.

The index over items is small next to the corpus; its size is checked. Up to
`INDEX_LIMIT` characters of items it travels to the tasks, and documents are
read once without any shuffle; beyond, items are taken in slices of that size,
one pass over the documents each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimloom.llm.arrow import map_columns
from claimloom.sources.tables import table

SHINGLE = 5
THRESHOLD = 0.8
#: Characters of item text that one pass over the documents carries.
INDEX_LIMIT = 32_000_000
#: Words a task remembers the hash of, and items it remembers the shingles of, at most.
_MEMO, _EXACT = 1_000_000, 5_000
_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores, so that punctuation hides nothing."""
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """Word to 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; of the whole sequence if it is shorter."""
    size = min(size, len(hashes))
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        out = out * _STEP + hashes[i : len(hashes) - size + 1 + i]
    return _mix(out)


def _shingles(words: list[str], size: int) -> list[tuple[str, ...]]:
    size = min(size, len(words))
    return list(zip(*(words[i : len(words) - size + 1 + i] for i in range(size)), strict=True))


class Index:
    """Sketches of items in arrays, and the items' texts; about 4 bytes a character of text.

    The exact shingles of an item are made when a document first holds one of
    its sketch, and the last `_EXACT` of them are remembered.
    """

    def __init__(self, items: list[tuple[object, str]], size: int, threshold: float):
        self.size, self.threshold = size, threshold
        self.items: list[tuple[object, str]] = []
        memo, sketch, owner = _Hashes(), [], []
        self.short: dict[int, list[int]] = {}  # items of fewer words than a shingle, by that number
        for key, text in items:
            words = words_of(text)
            if not words:
                continue
            own = np.unique(_rolled(np.array([memo[w] for w in words], np.uint64), size))
            number = len(self.items)
            self.items.append((key, text))
            if len(words) < size:
                self.short.setdefault(len(words), []).append(number)
            largest = (1 << (len(own) - 1).bit_length()) if len(own) > 1 else 1  # of the size partition: (largest / 2, largest]
            k = min(len(own), int(np.floor((1 - threshold) * largest + 1e-9)) + 1)
            sketch.append(own[:k])
            owner.append(np.full(k, number, np.int32))
        hashes = np.concatenate(sketch) if sketch else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.sketch = hashes[order]
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int32)
        self.bits = 1 << max(16, (len(hashes) * 8).bit_length())
        self.seen = np.zeros(self.bits, np.bool_)  # a first, cheap test
        self.seen[self.sketch & np.uint64(self.bits - 1)] = True

    def exact(self, number: int, made: dict[int, frozenset]) -> frozenset:
        found = made.get(number)
        if found is None:
            if len(made) >= _EXACT:
                made.clear()
            found = made[number] = frozenset(_shingles(words_of(self.items[number][1]), self.size))
        return found

    def candidates(self, hashes: np.ndarray) -> set[int]:
        hashes = hashes[self.seen[hashes & np.uint64(self.bits - 1)]]
        if not len(hashes):
            return set()
        hashes = np.unique(hashes)
        lo, hi = np.searchsorted(self.sketch, hashes, "left"), np.searchsorted(self.sketch, hashes, "right")
        return {int(x) for i, j in zip(lo, hi, strict=True) for x in self.owner[i:j]}

    def matches(self, text: str | None, memo: dict, made: dict[int, frozenset]) -> list[tuple[object, int, int]]:
        """(item, shingles shared, shingles of the item) of all items that `text` contains."""
        words = words_of(text) if text else []
        if not words or not self.items:
            return []
        hashes = np.array(list(map(memo.__getitem__, words)), np.uint64)
        found = self.candidates(_rolled(hashes, self.size))
        for length in self.short:
            if len(words) >= length:
                found |= self.candidates(_rolled(hashes, length))
        out, sets = [], {}
        for number in sorted(found):
            exact = self.exact(number, made)
            length = len(next(iter(exact)))
            if length not in sets:
                sets[length] = set(_shingles(words, length))
            shared = len(exact & sets[length])
            if shared >= self.threshold * len(exact) - 1e-9:
                out.append((self.items[number][0], shared, len(exact)))
        return out


def _indexes(items: DataFrame, item_col: str, text_col: str, size: int, threshold: float):
    """An index for each slice of the items of up to `INDEX_LIMIT` characters; the driver holds one at a time."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("k"), F.col(text_col).alias("t")).distinct()
    held, chars = [], 0
    for r in rows.sort("k", "t").toLocalIterator():  # one partition at a time
        held.append((r.k, r.t))
        chars += len(r.t)
        if chars >= INDEX_LIMIT:
            yield Index(held, size, threshold)
            held, chars = [], 0
    if held:
        yield Index(held, size, threshold)


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, item_id, shared, item_shingles, containment) for each document and item it contains.

    Words are lower-cased runs of word characters; shingles are distinct runs
    of `shingle` words; an item with fewer words has one shingle, all of it.
    Null and wordless texts contain nothing, and such items are in nothing.
    Repeated documents repeat in the result; repeated equal items count once,
    and rows of one item_id with different texts are searched each for itself.
    Empty tables give an empty result. Texts are read whole. Columns besides
    the named ones are not read.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind, item_type = dict(rows.dtypes)[id_col], items.schema[item_col].dataType
    key_type = to_arrow_type(item_type)
    schema = f"`{id_col}` {kind}, item_id {item_type.simpleString()}, shared long, item_shingles long, containment double"
    context, out = docs.sparkSession.sparkContext, None
    for index in _indexes(items, item_col, item_text_col, shingle, threshold):
        shared = context.broadcast(index)

        def step(batches, shared=shared):
            memo, made = _Hashes(), {}
            names = [id_col, "item_id", "shared", "item_shingles", "containment"]
            for batch in batches:
                at, hits = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for hit in shared.value.matches(text, memo, made):
                        at.append(i)
                        hits.append(hit)
                if at:
                    own = batch.column(0).take(pa.array(at, pa.int64()))
                    keys = pa.array([h[0] for h in hits], key_type)
                    yield pa.RecordBatch.from_arrays([own, keys, pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64()), pa.array([h[1] / h[2] for h in hits], pa.float64())], names)

        found = map_columns(rows, step, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without the documents that contain an item; all columns as they were, one pass, no shuffle.

    Documents with null, empty or wordless text contain nothing and stay, as
    do repeated rows; null and wordless items are in nothing. An empty table
    of documents stays empty, one of items leaves all documents. Columns may
    have any names.
    """
    at, context, out = docs.columns.index(text_col), docs.sparkSession.sparkContext, docs
    for index in _indexes(items, "item_id", "text", SHINGLE, THRESHOLD):
        shared = context.broadcast(index)

        def step(batches, shared=shared):
            memo, made = _Hashes(), {}
            for batch in batches:
                clean = [not shared.value.matches(t, memo, made) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(clean, pa.bool_())) for c in batch.columns], batch.schema.names)

        out = out.mapInArrow(step, docs.schema)
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item, with the item and its containment."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words are runs of letters, numbers and underscores, as `_WORD` has them.
ORACLE = r"""
WITH items AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT *, least(5, len(w)) AS s FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, text, s, array_to_string(w[i:i + s - 1], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS i FROM sized) x),
whole AS (SELECT item_id, text, count(*) AS n FROM wanted GROUP BY 1, 2),
docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
held AS (SELECT DISTINCT r, doc_id, s, array_to_string(w[i:i + s - 1], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS i FROM docs, (SELECT DISTINCT s FROM sized) z WHERE len(w) >= s) y),
hits AS (SELECT h.r, h.doc_id, i.item_id, i.text, count(*) AS shared FROM held h JOIN wanted i ON i.s = h.s AND i.shingle = h.shingle GROUP BY ALL)
SELECT h.doc_id, h.item_id, h.shared, w.n AS item_shingles, h.shared / CAST(w.n AS DOUBLE) AS containment FROM hits h JOIN whole w ON w.item_id = h.item_id AND w.text = h.text WHERE h.shared >= 0.8 * w.n - 1e-9
"""
