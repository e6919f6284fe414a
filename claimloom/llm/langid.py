"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For every bit one binary classifier over
hashed byte n-grams tells the languages with that bit set from the others; a
text's language is the codeword with the least weighted loss against all the
classifiers' outputs (loss-based decoding, Allwein, Schapire and Singer 2000).
A text whose two best codewords are about as near as each other is flagged.

Training counts n-grams of all the labelled rows: each task folds its texts
into dense tables, `HELD` languages at a time, and sends the non-zero cells on.
Counts stay in the cluster; blocks of cells are turned into classifiers' weights
there, and the driver gets cells x bits weights and languages x bits sums,
however many languages there are. Prediction is one Arrow pass without a
shuffle.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimloom.llm.arrow import map_columns
from claimloom.plans.durable import cut
from claimloom.sources.tables import table

UNDETERMINED = "und"
#: Cells of the n-gram table: the first quarter holds 2-grams, the rest 3-grams.
N_CELLS = 1 << 16
#: Added to each cell's count.
SMOOTHING = 0.5
#: Languages whose tables a task holds at once, and cells of a block of weights.
HELD, BLOCK = 64, 1024
#: Up to this many languages the code holds every way to split them in two.
EXHAUSTIVE_UP_TO = 6
#: The share of the probability mass that the nearest codeword needs, or the text is ambiguous.
CLEAR_SCORE = 0.7
#: Steepness of the logistic loss; a classifier's output is 1 on typical text of its language.
STEEPNESS = 4.0
_PIECE = 1 << 20
#: Digits, punctuation and control characters count as a space.
_AS_SPACE = bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in range(256))


def codewords(count: int) -> np.ndarray:
    """A (count, bits) table of -1 and 1; any two rows differ in many places, no column is constant."""
    if count <= EXHAUSTIVE_UP_TO:
        splits = np.arange(1, max(2, 1 << (count - 1)))  # the first language always has bit 0
        rows = (splits[None, :] >> np.arange(count)[:, None]) & 1
        return np.where(rows[::-1], 1, -1).astype(np.float64)
    bits = int(np.ceil(10 * np.log2(count)))
    best, distance = None, -1
    draw = np.random.default_rng(20)
    for _ in range(min(200, max(20, 200_000 // count**2))):
        rows = draw.choice([-1.0, 1.0], (count, bits))
        near = min((bits - rows[i] @ rows[:i].T).min() / 2 for i in range(1, count))
        if near > distance and (abs(rows.sum(0)) < count).all():
            best, distance = rows, near
    return best


def ngram_cells(text: str) -> np.ndarray:
    """The table cells of a text's 2-grams and 3-grams, repeats included."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_AS_SPACE).split()) + b" "
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = x[:-1] * np.uint32(257) + x[1:]
    three = two[:-1] * np.uint32(263) + x[2:]
    quarter = np.uint32(N_CELLS // 4)
    two = (two * np.uint32(2654435761) >> np.uint32(8)) % quarter
    three = quarter + (three * np.uint32(2246822519) >> np.uint32(8)) % np.uint32(N_CELLS - N_CELLS // 4)
    return np.concatenate([two, three]).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclasses.dataclass
class Model:
    """languages: sorted; code: (languages, bits); weights: (cells, bits) log odds; typical: mean log odds of a bit on text of its languages; trust: weights of the bits' losses."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    typical: np.ndarray
    trust: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        n = len(texts)
        known = [has_letter(t) for t in texts] if self.languages else [False] * n
        margins = np.zeros((n, self.code.shape[1]))
        for i, text in enumerate(texts):
            if known[i]:
                total, cells = np.zeros(self.code.shape[1]), 0
                for at in range(0, len(text), _PIECE):
                    found = ngram_cells(text[at : at + _PIECE])
                    if len(found) < N_CELLS // 8:
                        total += self.weights[found].sum(axis=0, dtype=np.float64)
                    else:  # what is held doesn't grow with the text
                        total += np.bincount(found, minlength=N_CELLS) @ self.weights
                    cells += len(found)
                margins[i] = total / cells / self.typical
        losses = np.logaddexp(0, -STEEPNESS * self.code[None] * margins[:, None, :]) @ self.trust  # (n, languages)
        near = np.exp(losses.min(axis=1, keepdims=True) - losses) if self.languages else np.zeros((n, 1))
        score = near.max(axis=1, initial=0) / np.maximum(near.sum(axis=1), 1e-300)
        best = losses.argmin(axis=1) if self.languages else np.zeros(n, int)
        names = [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
        score = np.where(known, score, 0.0)
        return names, score, np.array([k and s < CLEAR_SCORE for k, s in zip(known, score, strict=True)], bool)


def count_ngrams(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, cell, n) over all rows of `labelled` that have a language and a letter."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def out(tables):
        for lang, counts in tables.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["lang", "cell", "n"])

    def step(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    if lang not in tables and len(tables) >= HELD:
                        yield from out(tables)
                        tables = {}
                    counts = tables.setdefault(lang, np.zeros(N_CELLS, np.int64))
                    for at in range(0, len(text), _PIECE):
                        cells = ngram_cells(text[at : at + _PIECE])
                        if len(cells) < N_CELLS // 8:
                            np.add.at(counts, cells, 1)
                        else:
                            counts += np.bincount(cells, minlength=N_CELLS)
        yield from out(tables)

    partial = map_columns(rows, step, "lang string, cell long, n long")
    return partial.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all labelled rows; rows without a language or a letter teach nothing.

    No usable row gives a model that answers `und`; one language a model that
    always answers it. There is no limit on languages: the driver holds
    their names, codewords and mean outputs, 10 log2(languages) numbers each.
    """
    counts = cut(count_ngrams(labelled, text_col, lang_col))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((N_CELLS, 1)), np.ones(1), np.ones(1))
    code = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, np.ones((1, 1)), np.zeros((N_CELLS, 1)), np.ones(1), np.ones(1))
    count, bits = code.shape
    whole = np.array([totals[x] for x in languages]) + SMOOTHING * N_CELLS
    ones, zeros = np.maximum(code, 0), np.maximum(-code, 0)
    ones, zeros = ones / ones.sum(0), zeros / zeros.sum(0)
    place = {x: i for i, x in enumerate(languages)}

    def weighed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """The weights of a block of cells, and what the block adds to each language's mean outputs."""
        share = np.full((count, BLOCK), SMOOTHING)
        np.add.at(share, (frame["lang"].map(place).to_numpy(), frame["cell"].to_numpy() % BLOCK), frame["n"].to_numpy())
        share /= whole[:, None]
        weights = np.log(ones.T @ share) - np.log(zeros.T @ share)
        return pd.DataFrame({"block": [key[0]], "weights": [weights.T.tobytes()], "mean": [(share @ weights.T).tobytes()]})

    every = counts.sparkSession.range(N_CELLS // BLOCK).select(F.lit(languages[0]).alias("lang"), (F.col("id") * BLOCK).alias("cell"), F.lit(0).cast("long").alias("n"))  # blocks without a count have weights as well
    blocks = counts.unionByName(every).groupBy((F.col("cell") / BLOCK).cast("int").alias("block")).applyInPandas(weighed, "block int, weights binary, mean binary")
    weights, mean = np.zeros((N_CELLS, bits), np.float32), np.zeros((count, bits))
    for r in sorted(blocks.collect(), key=lambda r: r["block"]):
        at = r["block"] * BLOCK
        weights[at : at + BLOCK] = np.frombuffer(r["weights"]).reshape(BLOCK, bits)
        mean += np.frombuffer(r["mean"]).reshape(count, bits)
    expected = code * mean  # mean log odds, in the right direction, of each language's own n-grams
    trust = np.maximum(expected.min(axis=0), 1e-9)
    return Model(languages, code, weights, np.maximum(expected.mean(axis=0), 1e-9), trust * len(trust) / trust.sum())


def predict(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """`columns` of `docs` (all by default), then lang_pred, lang_score, lang_ambiguous.

    Null text and text without a letter: `und`, score 0, not ambiguous. Empty
    table: empty result. Very long text: summed over pieces of 2^20
    characters, none left out (n-grams do not span two pieces). Ties go to the
    language that sorts first, and such a text is ambiguous. A column of
    `docs` that has the name of a new column is replaced.
    """
    new = ("lang_pred", "lang_score", "lang_ambiguous")
    keep = [c for c in (columns or docs.columns) if c.lower() not in new]
    rows = docs.select(F.col(text_col).alias("__langid_text"), *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches):
        for batch in batches:
            names, score, unsure = shared.value.predict(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*keep, *new])

    schema = StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("lang_score", "double").add("lang_ambiguous", "boolean")
    return rows.mapInArrow(step, schema)


def held_out(id_col: str = "doc_id"):
    """True for the third of the ids that training leaves out; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    found = predict(marked, model, columns=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """`docs` without those whose language stays undetermined or ambiguous; a model learnt from `docs` decides.

    Documents with no letter go (null and empty texts among them). If no
    document has both a letter and a language there is nothing to learn from,
    and all documents stay.
    """
    model = fit(docs.where(~held_out()))
    if not model.languages:
        return docs
    plain = docs.columns
    found = predict(docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(plain)], F.col("text").alias("__text")), model, text_col="__text", columns=[f"__c{i}" for i in range(len(plain))])
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & ~F.col("lang_ambiguous"))
    return kept.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(plain)])
