"""Scoring texts with a hidden Markov language model.

The corpus gives word counts (a unigram base with additive smoothing) and a
hidden Markov model over words, in which every word of the training texts has
emissions of its own, however many words there are.

Training is Baum-Welch over symbols: words tied in `CLASSES` classes by a digest.
So the model that travels to the tasks has a proven size, whatever the corpus.
Each task adds up the expected counts of its texts; Spark sums them
over all partitions, as fixed-point numbers, so the order of sums can't matter
and reruns agree. The start is the base with fixed noise; every pass covers all
training texts, and passes go on until the model has settled. One more pass unties the classes: it gathers each word's own
expected counts by state into a table of (word, n, c0, c1, ...), which grows
with the vocabulary and stays in the cluster.

Texts count whole, without windows: long ones are worked on in pieces, whose
transfer matrices give the exact weights at each border, forwards and
backwards. Scoring runs the scaled forward recursion over the whole sequence
in the same way. The most frequent words travel to the tasks, all others are
looked up by an equi-join, where none of them can be a hot key; which way a
word goes changes no result.
"""

from __future__ import annotations

import dataclasses
import itertools
import re
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.arrow import map_columns, raw_texts
from claimloom.plans.durable import cut
from claimloom.sources.tables import table

#: The token that ends a text; no word has a line end.
END = b"\n"
#: Added to each count of the base.
ADDED = 0.1
#: Symbols that words are tied in until the last pass.
CLASSES = 1 << 16
STATES = 4
#: Baum-Welch passes over all training texts go on until one moves less than this share of the emissions' mass, or up to so many.
SETTLED, PASSES = 0.05, 60
#: Taken off each expected emission count, and dealt out again by the base (absolute discounting).
DISCOUNT = 0.7
#: Words that travel to the scoring tasks; the rest is joined. No result depends on it.
TRAVELLING = 160_000
#: Tokens of a piece, tokens that a task works on at once, and distinct words that it holds before passing them on.
PIECE, _TOKENS, _HELD = 256, 200_000, 200_000
#: Expected counts are summed in units of 2^-20.
_UNIT = 1 << 20
#: Steps between two scalings of weights.
_EVERY = 4
_CHUNK, _BLOCK = 1 << 18, 1 << 14
_GAP = re.compile(rb"[ \t-\r]")


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_IS_GAP = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2^64."""
    if not _POWERS:
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            powers = np.full(2 * _CHUNK + 2, base, np.uint64)
            powers[0] = 1
            _POWERS.append(np.cumprod(powers))
    return _POWERS


def symbols_of(raw: bytes) -> np.ndarray:
    """The symbol of each token of a text: its class by a polynomial digest of its lower-cased bytes (a checksum beyond `_CHUNK` of them), and 0 for the end."""
    out = []
    up, down = _powers()
    for part in _parts(raw):
        last = b""
        if len(part) > 2 * _CHUNK:  # an unbroken run is at its end
            words = part.split()
            part, last = part[: part.rindex(words[-1])], words[-1].lower()
        x = _LOWER[np.frombuffer(part, np.uint8)]
        inside = np.zeros(len(x) + 2, np.int8)
        inside[1:-1] = ~_IS_GAP[x]
        edges = np.flatnonzero(np.diff(inside))
        begin, end = edges[::2], edges[1::2]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
        h = (sums[end] - sums[begin]) * down[begin]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        found = (h >> np.uint64(48)).astype(np.uint16)
        for i in np.flatnonzero(end - begin > _CHUNK).tolist():
            found[i] = zlib.crc32(x[begin[i] : end[i]].tobytes()) % CLASSES
        out.append(found)
        if last:
            out.append(np.array([zlib.crc32(last) % CLASSES], np.uint16))
    return np.concatenate([*out, np.zeros(1, np.uint16)])


def _numbered(numbers: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))


def tokens(raw: bytes) -> Iterator[list[bytes]]:
    """The tokens of a text, in lists of bounded length."""
    for part in _parts(raw):
        yield part.lower().split()
    yield [END]


def _parts(raw: bytes) -> Iterator[bytes]:
    """A text cut at gaps; a part is longer than `_CHUNK` only by the rest of a word."""
    at = 0
    while len(raw) - at > _CHUNK:
        gap = _GAP.search(raw, at + _CHUNK)
        if gap is None:
            break
        yield raw[at : gap.start()]
        at = gap.end()
    yield raw[at:]


def _total(x: np.ndarray) -> np.ndarray:
    """Each row's sum, in every column; a product is faster than a sum over few columns."""
    return x @ np.ones((x.shape[1], x.shape[1]), x.dtype)


class Model:
    """start (states), move (states, states) and emit (symbols, states), from `shares`, the base's share of each symbol."""

    def __init__(self, shares: np.ndarray, states: int):
        self.shares = shares
        noise = np.random.default_rng(8).gamma(0.3, size=(len(shares), states))
        self.emit = shares[:, None] * (0.01 + noise)
        self.emit /= self.emit.sum(axis=0)
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.02 / max(1, states - 1))
        np.fill_diagonal(self.move, 0.98 if states > 1 else 1.0)

    def updated(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> None:
        """Take expected counts over; the base gives what the counts leave open."""
        off = np.minimum(emit, DISCOUNT)
        emit = emit - off + (off.sum(axis=0) + 1.0) * self.shares[:, None]
        self.emit = emit / emit.sum(axis=0)
        move = move + 0.5 / len(start)
        self.move = move / move.sum(axis=1, keepdims=True)
        self.start = (start + 0.5) / (start + 0.5).sum()


# --- recursions over pieces of texts, all in step


class Steps:
    """Pieces in step: tokens lie time by time, the longest piece first, without padding."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        last = int(self.sizes[0])
        self.active = np.searchsorted(-self.sizes, -np.arange(last), side="left")  # pieces that have a token at each time
        self.at = np.concatenate(([0], np.cumsum(self.active)))
        self.lane = np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.active)
        time = np.repeat(np.arange(last), self.active)
        self.flat = (np.cumsum(sizes) - sizes)[self.order][self.lane] + time
        self.ends = self.at[self.sizes - 1] + np.arange(len(sizes))

    def ahead(self, seen: np.ndarray, move: np.ndarray, enter: np.ndarray) -> np.ndarray:
        """Forward weights, up to a factor; enter: each piece's weights before its first emission."""
        a, move = np.empty_like(seen), move.astype(seen.dtype)
        np.multiply(enter, seen[: len(enter)], out=a[: len(enter)], casting="same_kind")
        for t in range(1, len(self.active)):
            m, lo, before = self.active[t], self.at[t], self.at[t - 1]
            x = a[lo : lo + m]
            np.matmul(a[before : before + m], move, out=x)
            x *= seen[lo : lo + m]
            if t % _EVERY == 0:
                x /= _total(x)
        return a

    def behind(self, seen: np.ndarray, move: np.ndarray, leave: np.ndarray) -> np.ndarray:
        """Backward weights, up to a factor; leave: each piece's weights after its last token."""
        b, back = np.empty_like(seen), np.ascontiguousarray(move.T.astype(seen.dtype))
        for t in range(len(self.active) - 1, -1, -1):
            m, lo = self.active[t], self.at[t]
            more = self.active[t + 1] if t + 1 < len(self.active) else 0
            if more:
                after = slice(self.at[t + 1], self.at[t + 1] + more)
                np.matmul(seen[after] * b[after], back, out=b[lo : lo + more])
            b[lo + more : lo + m] = leave[more:m]
            if t % _EVERY == 0:
                x = b[lo : lo + m]
                x /= _total(x)
        return b

    def transfer(self, seen: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's matrix from the state before it to its last state, up to the factor whose logarithm comes second; a text's first piece has no move before it."""
        k, move = len(move), move.astype(seen.dtype)
        m0 = np.where(first[:, None, None], np.eye(k, dtype=seen.dtype), move) * seen[: len(first), None, :]
        logs = np.zeros(len(first))
        for t in range(1, len(self.active)):
            m, lo = self.active[t], self.at[t]
            x = (m0[:m].reshape(-1, k) @ move).reshape(m, k, k)
            x *= seen[lo : lo + m, None, :]
            if t % _EVERY == 0:
                s = x.sum(axis=(1, 2))
                x /= s[:, None, None]
                logs[:m] += np.log(s)
            m0[:m] = x
        s = m0.sum(axis=(1, 2))
        return m0 / s[:, None, None], logs + np.log(s)


class Pieces:
    """Texts (their numbers of tokens, one after another) cut into pieces, worked on in blocks of bounded size."""

    def __init__(self, sizes: np.ndarray):
        self.texts = sizes
        self.number = -(-sizes // PIECE)
        self.text = np.repeat(np.arange(len(sizes)), self.number)
        self.begin_of = np.cumsum(self.number) - self.number
        self.index = np.arange(len(self.text)) - self.begin_of[self.text]
        self.sizes = np.minimum(PIECE, sizes[self.text] - self.index * PIECE)
        self.begins = (np.cumsum(sizes) - sizes)[self.text] + self.index * PIECE

    def blocks(self, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, Steps, np.ndarray]]:
        """(piece numbers in step order, steps, token numbers in step order) of the chosen pieces."""
        upto = np.cumsum(self.sizes[chosen])
        for block in np.unique(upto // _TOKENS):
            some = chosen[upto // _TOKENS == block]
            steps = Steps(self.sizes[some])
            own = some[steps.order]
            within = np.repeat(np.arange(len(steps.active)), steps.active)
            yield own, steps, self.begins[own][steps.lane] + within

    def transfers(self, chosen: np.ndarray, emission, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matrix and logarithm of each chosen piece (others stay zero); emission maps token numbers to emissions."""
        k = len(move)
        matrices, logs = np.zeros((len(self.text), k, k)), np.zeros(len(self.text))
        for own, steps, at in self.blocks(chosen):
            matrices[own], logs[own] = steps.transfer(emission(at), move, self.index[own] == 0)
        return matrices, logs

    def chain(self, matrices: np.ndarray, logs: np.ndarray, start: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights after each piece of `texts`, scaled to one, and the texts' log likelihoods."""
        after, total = np.zeros((len(self.text), len(start))), np.zeros(len(self.texts))
        texts = texts[np.argsort(-self.number[texts], kind="stable")]
        a = np.tile(start, (len(texts), 1))
        for i in range(int(self.number[texts].max(initial=0))):
            m = int(np.searchsorted(-self.number[texts], -i, side="left"))
            at = self.begin_of[texts[:m]] + i
            a = np.einsum("ni,nij->nj", a[:m], matrices[at])
            s = a.sum(axis=1)
            a /= s[:, None]
            after[at] = a
            total[texts[:m]] += np.log(s) + logs[at]
        return after, total

    def chain_back(self, matrices: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Backward weights after each piece; one after the last of a text."""
        k = matrices.shape[1]
        behind = np.ones((len(self.text), k))
        texts = texts[np.argsort(-self.number[texts], kind="stable")]
        for i in range(int(self.number[texts].max(initial=0)) - 1, 0, -1):
            m = int(np.searchsorted(-self.number[texts], -i, side="left"))
            at = self.begin_of[texts[:m]] + i
            b = np.einsum("nij,nj->ni", matrices[at], behind[at])
            behind[at - 1] = b / b.sum(axis=1, keepdims=True)
        return behind


class Expected:
    """Expected counts of a model over texts given as arrays of symbols."""

    def __init__(self, model: Model):
        self.model, k = model, len(model.start)
        # a factor of each word changes no expected count and keeps single precision in range
        self.emit = (model.emit / model.emit.max(axis=1, keepdims=True)).astype(np.float32)
        self.move, self.start = np.zeros((k, k)), np.zeros(k)

    def of(self, ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(token numbers, probabilities of their states) in blocks; adds up moves and starts."""
        model, pieces = self.model, Pieces(sizes)
        emission = lambda at: np.take(self.emit, np.take(ids, at), axis=0)
        long = np.flatnonzero(pieces.number > 1)
        ends, behind = np.zeros((len(pieces.text), len(model.start))), np.ones((len(pieces.text), len(model.start)))
        if len(long):
            matrices, logs = pieces.transfers(np.flatnonzero(pieces.number[pieces.text] > 1), emission, model.move)
            ends, _ = pieces.chain(matrices, logs, model.start, long)
            behind = pieces.chain_back(matrices, long)
        for own, steps, at in pieces.blocks(np.arange(len(pieces.text))):
            first = pieces.index[own] == 0
            before = ends[own - 1]  # of a text's first piece it isn't used
            seen = emission(at)
            a = steps.ahead(seen, model.move, np.where(first[:, None], model.start, before @ model.move))
            b = steps.behind(seen, model.move, behind[own])
            seen *= b
            n = len(own)
            last = np.arange(n, len(a)) - np.repeat(steps.active[:-1], steps.active[1:])
            for prev, x in ((before[~first], seen[:n][~first]), (np.take(a, last, axis=0), seen[n:])):
                prev = prev / _total((prev @ model.move.astype(x.dtype)) * x)
                self.move += prev.T @ x * model.move
            a *= b
            a /= _total(a)
            self.start += a[:n][first].sum(axis=0, dtype=np.float64)
            yield at, a


def _fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * _UNIT).astype(np.int64)


def _encoded(train: DataFrame) -> DataFrame:
    """(symbols binary: two bytes a token) of every row of `train` (one text column), stored."""

    def step(batches):
        for batch in batches:
            made = [symbols_of(raw).tobytes() for raw in raw_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["symbols"])

    return cut(map_columns(train, step, "symbols binary"))


def _shares(encoded: DataFrame) -> np.ndarray:
    """The smoothed share of each symbol among all tokens."""

    def step(batches):
        counts = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                counts += np.bincount(np.frombuffer(x, np.uint16), minlength=CLASSES) if len(x) > CLASSES else 0
                if len(x) <= CLASSES:
                    np.add.at(counts, np.frombuffer(x, np.uint16), 1)
        yield from _blocks(counts)

    counts = _summed(map_columns(_gathered(encoded), step, "block int, sums binary")).astype(float)
    counts = (counts if len(counts) else np.zeros(CLASSES)) + 1.0
    return counts / counts.sum()


def _grouped(items: Iterator, size) -> Iterator[list]:
    """Lists of items of about `_TOKENS` tokens."""
    held, n = [], 0
    for x in items:
        held.append(x)
        n += size(x)
        if n >= _TOKENS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _gathered(encoded: DataFrame) -> DataFrame:
    """Splits drawn together into a number of tasks set by the cluster, so that what tasks send doesn't grow with the corpus."""
    return encoded.coalesce(max(32, 4 * encoded.sparkSession.sparkContext.defaultParallelism))


def _blocks(flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts = range(0, len(flat), _BLOCK)
    yield pa.RecordBatch.from_arrays([pa.array(list(range(len(starts))), pa.int32()), pa.array([flat[i : i + _BLOCK].tobytes() for i in starts], pa.binary())], ["block", "sums"])


def _summed(parts: DataFrame) -> np.ndarray:
    """The sums, as one array, of blocks (block, sums binary: 64-bit integers) that tasks have sent."""

    def step(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group.column("sums").to_pylist())
        return pa.table({"block": group.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    rows = parts.groupBy("block").applyInArrow(step, "block int, sums binary").collect()
    return np.concatenate([np.frombuffer(r["sums"], np.int64) for r in sorted(rows, key=lambda r: r["block"])]) if rows else np.zeros(0, np.int64)


def _pass(encoded: DataFrame, model: Model) -> float:
    """One Baum-Welch pass over all of `encoded`; returns the share of the emissions' mass that it has moved."""
    shared, states = encoded.sparkSession.sparkContext.broadcast(model), len(model.start)

    def step(batches):
        sums, emit = Expected(shared.value), np.zeros_like(shared.value.emit)
        texts = (np.frombuffer(x, np.uint16) for batch in batches for x in batch.column(0).to_pylist())
        for held in _grouped(texts, len):
            ids = np.concatenate(held)
            for at, gamma in sums.of(ids, np.array([len(x) for x in held])):
                own = np.take(ids, at)
                for k in range(states):
                    emit[:, k] += np.bincount(own, weights=gamma[:, k], minlength=len(emit))
        yield from _blocks(_fixed(np.concatenate([emit.ravel(), sums.move.ravel(), sums.start])))

    sums = _summed(map_columns(_gathered(encoded), step, "block int, sums binary")) / _UNIT
    shared.unpersist()
    before, n = model.emit, model.emit.size
    if not len(sums):
        return 0.0
    model.updated(sums[:n].reshape(model.emit.shape), sums[n : n + states * states].reshape(states, states), sums[n + states * states :])
    return float(np.abs(model.emit - before).sum(axis=0).mean() / 2)


def _symbols_of_words(words: list[bytes]) -> np.ndarray:
    """The symbol of each word, one of which may be the end."""
    end = words.index(END) if END in words else len(words)
    found = symbols_of(b" ".join(words[:end] + words[end + 1 :]))  # the end's symbol comes last
    return np.insert(found[:-1], end, 0) if end < len(words) else found[:-1]


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def _word_counts(train: DataFrame, model: Model) -> DataFrame:
    """Words (word, n, c0, c1, ... in units of 2^-20), stored: the tokens of every training word and their expected states."""
    shared, states = train.sparkSession.sparkContext.broadcast(model), len(model.start)
    names = ["word", "n", *[f"c{k}" for k in range(states)]]

    def step(batches):
        sums = Expected(shared.value)
        kinds, symbol_of = _Numbers(), np.zeros(0, np.int64)
        number, counts = np.zeros(0, np.int64), np.zeros((0, states))

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in kinds], pa.string()), pa.array(number), *[pa.array(_fixed(counts[:, k])) for k in range(states)]], names)

        def read():
            for batch in batches:
                for raw in raw_texts(batch.column(0)):
                    yield np.concatenate([_numbered(kinds, words) for words in tokens(raw)])

        for held in _grouped(read(), len):
            own = np.concatenate(held)
            fresh = list(itertools.islice(kinds, len(symbol_of), None))
            symbol_of = np.append(symbol_of, _symbols_of_words(fresh))
            number = np.append(number, np.zeros(len(fresh), np.int64)) + np.bincount(own, minlength=len(kinds))
            counts = np.vstack([counts, np.zeros((len(fresh), states))])
            for at, gamma in sums.of(symbol_of[own], np.array([len(x) for x in held])):
                some = np.take(own, at)
                for k in range(states):
                    counts[:, k] += np.bincount(some, weights=gamma[:, k], minlength=len(counts))
            if len(kinds) > _HELD:
                yield out()
                kinds, symbol_of = _Numbers(), np.zeros(0, np.int64)
                number, counts = np.zeros(0, np.int64), np.zeros((0, states))
        if kinds:
            yield out()

    columns = ", ".join(f"c{k} long" for k in range(states))
    parts = map_columns(train, step, f"word string, n long, {columns}")
    found = cut(parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in names[1:]]))
    shared.unpersist()
    return found


@dataclasses.dataclass
class Language:
    """What scoring needs: totals, start, move, and by state the sum of expected counts and what discounting leaves for the base; words stays in the cluster."""

    total: int
    kinds: int
    start: np.ndarray
    move: np.ndarray
    mass: np.ndarray
    spare: np.ndarray
    words: DataFrame

    def emissions(self, n: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Base probabilities and emissions of words with these counts; n and c are 0 for unknown words."""
        return _emissions(self.total, self.kinds, self.mass, self.spare, n, c)


def _emissions(total, kinds, mass, spare, n, c):
    base = (n + ADDED) / (total + ADDED * (kinds + 1))
    return base, (c - np.minimum(c, DISCOUNT) + spare * base[:, None]) / (mass + 1.0)


def fit(train: DataFrame, states: int = STATES, settled: float = SETTLED, passes: int = PASSES) -> Language:
    """Learn from all rows of `train` (one text column).

    Passes go on until one moves less than `settled` of the emissions' mass;
    `passes` of them is a warning, as the model is still moving.
    """
    context = train.sparkSession.sparkContext
    encoded = _encoded(train)
    model = Model(_shares(encoded), states)
    for _ in range(passes):
        moved = _pass(encoded, model)
        context._jvm.System.gc()  # else all passes' shuffle files stay until the driver happens to collect its garbage
        if moved < settled:
            break
    else:
        warnings.warn(f"the model still moved {moved:.3f} of its mass in pass {passes}", stacklevel=2)
    words = _word_counts(train, model)
    c = [F.col(f"c{k}") / _UNIT for k in range(states)]
    r = words.agg(F.sum("n"), F.count("*"), *[F.sum(x) for x in c], *[F.sum(F.least(x, F.lit(DISCOUNT))) for x in c]).first()
    sums = np.array([x or 0.0 for x in r[2:]])
    return Language(int(r[0] or 0), int(r[1]), model.start, model.move, sums[:states], sums[states:] + 1.0, words)


def log_likelihoods(emissions: np.ndarray, sizes: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Natural log likelihoods of whole texts, by the scaled forward recursion; emissions: those of all tokens, text by text."""
    pieces = Pieces(sizes)
    matrices, logs = pieces.transfers(np.arange(len(pieces.text)), lambda at: emissions[at], move)
    return pieces.chain(matrices, logs, start, np.arange(len(sizes)))[1]


#: A token's number has 24 bits; the last number marks words to be joined.
_JOINED = (1 << 24) - 1


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        return _JOINED


def _level(n):
    """Sixteenths of a doubling: counts fall into under 1024 levels."""
    return F.floor(F.log2(n) * 16)


def _travelling(words: DataFrame):
    """The most frequent words with their counts, whole levels of counts and `TRAVELLING` words at most; and the least level among them."""
    levels = words.groupBy(_level("n").alias("level")).count().collect()
    room, least = TRAVELLING, 1 << 20
    for r in sorted(levels, key=lambda r: -r["level"]):
        if r["count"] > room:
            break
        room, least = room - r["count"], int(r["level"])
    return words.where(_level("n") >= least).toPandas(), least


def score(docs: DataFrame, language: Language, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` columns of `docs`, then n_tokens, n_known, train_tokens, base_score and score (log10).

    Null text: as the empty text, whose one token is the end. Null ids and
    other nulls in `keep` stay as they are. Repeated rows repeat. Words that
    training has not seen count as one unknown word. Very long texts are scored
    whole. Empty table: empty result. A kept column named like a new one makes
    way for it, in any case.
    """
    states = len(language.start)
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in keep if c.lower() not in made]
    inner = [f"__k{i}" for i in range(len(keep))]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    rows = docs.select(F.col(f"`{text_col}`").alias("__text"), F.monotonically_increasing_id().alias("__row"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner, strict=True)])
    frame, least = _travelling(language.words)
    counts = frame[[f"c{k}" for k in range(states)]].to_numpy(float) / _UNIT
    order = np.argsort(-frame["n"].to_numpy(), kind="stable")
    held = (frame["word"].to_numpy()[order].tolist(), frame["n"].to_numpy(float)[order], counts[order])
    del frame, counts
    rule = (language.total, language.kinds, language.mass, language.spare)
    context = docs.sparkSession.sparkContext
    named, measured = context.broadcast(held[0]), context.broadcast((*held[1:], rule, language.start, language.move))

    def number(batches):
        known = _Known((w.encode(), i) for i, w in enumerate(named.value))
        for batch in batches:
            sizes, low, high, places, missing, ends = [], [], [], [np.zeros(0, np.int64)], [], [0]
            for raw in raw_texts(batch.column(0)):
                parts, n = [], 0
                for words in tokens(raw):
                    ids = _numbered(known, words)
                    rare = np.flatnonzero(ids == _JOINED)
                    missing += [words[i] for i in rare.tolist()]
                    places.append(rare + n)
                    parts.append(ids)
                    n += len(ids)
                ids = np.concatenate(parts)
                sizes.append(n)
                ends.append(len(missing))
                low.append((ids & 0xFFFF).astype(np.uint16).tobytes())
                high.append((ids >> 16).astype(np.uint8).tobytes())
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(places), pa.int32()), pa.array(missing, pa.binary()).cast(pa.string())], ["at", "word"])
            new = [pa.array(sizes, pa.int64()), pa.array(low, pa.binary()), pa.array(high, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], ["__row", *inner, "n_tokens", "__low", "__high", "__rare"])

    own = ", ".join(["__row long", *[f"{k} {t}" for k, t in zip(inner, kinds, strict=True)], "n_tokens long, __low binary, __high binary"])
    numbered = cut(rows.mapInArrow(number, f"{own}, __rare array<struct<at: int, word: string>>"))
    rare = numbered.select("__row", F.explode("__rare").alias("r")).select("__row", "r.at", "r.word")
    found = rare.join(language.words.where(_level("n") < least), "word")
    lists = found.groupBy("__row").agg(F.collect_list(F.struct("at", "n", *[f"c{k}" for k in range(states)])).alias("__found"))
    whole = numbered.drop("__rare").join(lists, "__row", "left")

    def likelihood(batches):
        n_of, c_of, rule, start, move = measured.value
        base_of, emit_of = _emissions(*rule, np.append(n_of, 0.0), np.vstack([c_of, np.zeros(states)]))  # unknown words last
        log_of = np.log10(base_of)
        for batch in batches:
            names = batch.schema.names
            low, high, sizes, lists = (batch.column(names.index(c)) for c in ("__low", "__high", "n_tokens", "__found"))
            sizes, at = sizes.to_numpy(), 0
            known, base, score = np.zeros(len(sizes), np.int64), np.zeros(len(sizes)), np.zeros(len(sizes))
            while at < len(sizes):
                upto = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), _TOKENS)))
                ids = np.concatenate([np.frombuffer(low[i].as_py(), np.uint16).astype(np.int32) | np.frombuffer(high[i].as_py(), np.uint8).astype(np.int32) << 16 for i in range(at, upto)])
                ids[ids == _JOINED] = len(n_of)
                emit, logs, seen = emit_of[ids], log_of[ids], ids < len(n_of)
                begins = np.cumsum(sizes[at:upto]) - sizes[at:upto]
                some = lists.slice(at, upto - at)
                flat = some.flatten()
                if len(flat):
                    many = np.array([len(x) if x.is_valid else 0 for x in some])
                    place = flat.field("at").to_numpy(zero_copy_only=False) + np.repeat(begins, many)
                    c = np.column_stack([flat.field(f"c{k}").to_numpy(zero_copy_only=False) for k in range(states)]) / _UNIT
                    b, emit[place] = _emissions(*rule, flat.field("n").to_numpy(zero_copy_only=False).astype(float), c)
                    logs[place], seen[place] = np.log10(b), True
                text = np.repeat(np.arange(upto - at), sizes[at:upto])
                known[at:upto] = np.bincount(text, weights=seen, minlength=upto - at)
                base[at:upto] = np.bincount(text, weights=logs, minlength=upto - at)
                score[at:upto] = log_likelihoods(emit, sizes[at:upto], start, move) / np.log(10)
                at = upto
            new = [pa.array(known), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(k)) for k in inner], batch.column(names.index("n_tokens")), *new], [*inner, "n_tokens", "n_known", "base_score", "score"])

    schema = ", ".join([*[f"{k} {t}" for k, t in zip(inner, kinds, strict=True)], "n_tokens long, n_known long, base_score double, score double"])
    scored = whole.mapInArrow(likelihood, schema)
    total = F.lit(language.total).cast("long").alias("train_tokens")
    return scored.select(*[F.col(k).alias(c) for c, k in zip(keep, inner, strict=True)], "n_tokens", "n_known", total, "base_score", "score")


def held_out(id_col: str = "doc_id"):
    """True for the tenth of the ids that training leaves out; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under a model of nine tenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    return score(docs, fit(docs.where(~F.col("held_out")).select("text")), ["doc_id", "held_out"])
