"""Counting unigram tokens without making them.

A unigram tokenizer takes the segmentation of least cost into vocabulary
pieces. To count tokens only the best score and its number of pieces are
carried from one text position to the next; an Aho-Corasick automaton lists
the pieces that end at each position. Ties follow the tokenizer exactly: of
equal scores the one whose last piece begins first stays, scores are double
precision sums from left to right, and a character that no piece covers costs
`UNKNOWN_PENALTY` more than the worst piece and counts as one token, or one
for a whole run of such characters.

If no piece of the vocabulary has a word mark after another character, no
piece spans a word's beginning, so a text's best segmentation is that of its
words side by side (equal up to ties of rounding, none at all with whole
scores). Words are then counted once each and remembered.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.arrow import map_columns
from claimloom.sources.tables import table

#: The sentencepiece model whose pieces and scores the production query takes.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a task remembers, and the longest word worth remembering.
_MEMO, _LONGEST = 400_000, 64
#: Positions that are kept before those that no piece can begin at are dropped.
_KEPT = 65_536


def load_pieces(path: str = MODEL) -> list[tuple[str, float]]:
    """Normal pieces and their scores; control, unknown and byte pieces are no part of a segmentation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in ids]


class Counter_:
    """Best score and number of pieces of a text."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.by_word = all(MARK not in piece.lstrip(MARK) for piece, _ in pieces) and any(p == MARK for p, _ in pieces)
        self.memo: dict[str, tuple[float, int, int]] = {}

    def viterbi(self, text: str) -> tuple[float, int, int]:
        """(score, pieces, unknown pieces) of the best segmentation of `text` as it is.

        Only positions that a piece can still begin at are kept, and the
        automaton's matches are taken as they come, so memory doesn't grow with
        the text. At each position the automaton lists longer pieces first.
        """
        scores, counts, unknowns, runs = [0.0], [0], [0], [False]
        base, unknown = 0, self.unknown  # base: the text position of the first kept entry
        top, k, u, single = None, 0, 0, False

        def close(upto: int) -> None:
            """Settle positions up to `upto`; `top` is the best of the first of them."""
            nonlocal base, top, k, u, single
            while base + len(scores) <= upto:
                run = False
                if not single:
                    s = scores[-1] + unknown
                    if top is None or s > top:
                        fresh = not runs[-1]
                        top, k, u, run = s, counts[-1] + fresh, unknowns[-1] + fresh, True
                scores.append(top)
                counts.append(k)
                unknowns.append(u)
                runs.append(run)
                top, single = None, False
            if len(scores) > _KEPT + self.longest:
                drop = len(scores) - self.longest - 1
                base += drop
                for held in (scores, counts, unknowns, runs):
                    del held[:drop]

        at = 0  # the position whose matches are being read
        for end, (size, score) in self.automaton.iter(text) if len(self.automaton) else ():
            if end + 1 != at:
                close(end)
                at = end + 1
            begin = at - size - base
            s = scores[begin] + score
            if top is None or s > top:
                top, k, u = s, counts[begin] + 1, unknowns[begin]
            if size == 1:
                single = True
        close(len(text))
        return scores[-1], counts[-1], unknowns[-1]

    def _remembered(self, word: str) -> tuple[float, int, int]:
        found = self.memo.get(word)
        if found is None:
            found = self.viterbi(word)
            if len(word) <= _LONGEST:
                if len(self.memo) >= _MEMO:
                    self.memo.clear()
                self.memo[word] = found
        return found

    def count(self, text: str | None) -> tuple[float, int, int]:
        """The same for a text as the tokenizer sees it: a mark in front, and for every space."""
        if not text:
            return 0.0, 0, 0
        if not self.by_word:
            return self.viterbi(MARK + text.replace(" ", MARK))
        words = Counter(text.split(" "))
        if "" in words or MARK in text:  # runs of marks
            words = Counter(_words(MARK + text.replace(" ", MARK)))
        else:
            words = {MARK + w: n for w, n in words.items()}
        score, pieces, unknown = 0.0, 0, 0
        known = self.memo
        for word, times in words.items():
            found = known.get(word) or self._remembered(word)
            score += times * found[0]
            pieces += times * found[1]
            unknown += times * found[2]
        return score, pieces, unknown


#: Counters that this process has made, by what their pieces are: workers that are used again needn't make them anew.
_COUNTERS: dict[str, Counter_] = {}


def _counter(digest: str, pieces: list[tuple[str, float]]) -> Counter_:
    if digest not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[digest] = Counter_(pieces)
    return _COUNTERS[digest]


def _words(text: str) -> list[str]:
    """Cuts before each mark that follows another character; runs of marks stay with what follows them."""
    parts = text.split(MARK)
    out, marks = [], 0
    for i, part in enumerate(parts):
        marks += i > 0
        if part:
            out.append(MARK * marks + part)
            marks = 0
    if marks:
        out.append(MARK * marks)
    return out


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` columns of `docs`, then n_pieces, n_unknown (long) and best_score (double).

    Null and empty texts have none of either and score 0. Repeated rows
    repeat; texts of any length are counted whole; an empty table stays
    empty. A kept column named like a new one makes way for it, in any case.
    """
    new = ["n_pieces", "n_unknown", "best_score"]
    keep = [c for c in keep if c.lower() not in new]
    rows = docs.select(F.col(f"`{text_col}`").alias("__count_text"), *[f"`{c}`" for c in keep])
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    digest = hashlib.sha256(repr(pieces).encode()).hexdigest()

    def step(batches):
        counter = _counter(digest, shared.value)
        for batch in batches:
            found = [counter.count(t) for t in batch.column(0).to_pylist()]
            made = [pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[0] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*keep, *new])

    kinds = dict(docs.dtypes)
    return map_columns(rows, step, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_pieces long, n_unknown long, best_score double"]))


def op6_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of unigram pieces in every document."""
    return count_tokens(table(spark, sf_dir, "documents"), load_pieces(), ["doc_id"])
