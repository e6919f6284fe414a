"""Iterations over a graph in blocks: supersteps of arrays that Spark partitions and shuffles.

A graph of many rounds costs little a round if each round is one shuffle of a
few arrays. Edges are dealt out in blocks. Each vertex has an owner block that
keeps its values; a block that holds edges of a vertex knows it by a slot, and
owners know which of their vertices each holder wants, so messages are bare
arrays in a fixed order. What holders send back is summed by vertex first:
an entity with a third of all edges is one slot in each block, like any other.

A superstep maps each block's fixed part, its state and what it was sent to
messages, the new state being one of them. Shuffles keep what every superstep
sent, so a lost executor's part is made again from the one before; `settle`
cuts lineage through the shared folder now and then and deletes what the cut
before has left there.
"""

from __future__ import annotations

import gc
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.plans.durable import cut, shared_dir

#: Edges of a block: at least, so that small graphs have few messages, and at most.
SMALL, LARGE = 20_000, 500_000
#: Supersteps after which lineage is cut, at most and at least; messages of so many edges are kept at most in between.
SETTLE_EVERY, SETTLE_LEAST, KEPT = 60, 6, 27_000_000

Message = tuple[int, tuple]


def block_of(key: int) -> int:
    return key


def number_of_blocks(df: DataFrame, edges: int) -> int:
    most = df.sparkSession.sparkContext.defaultParallelism - 1  # with the partition for `stats` as many tasks as cores
    return max(2, min(most, -(-edges // SMALL)), -(-edges // LARGE))


def settle_every(edges: int) -> int:
    """Supersteps after which lineage is cut, so that what shuffles keep until then is bounded, where rounds are large, by a few of them."""
    return max(SETTLE_LEAST, min(SETTLE_EVERY, KEPT // max(edges, 1)))


def packed(rows: DataFrame, n: int, key: str | None, pack: Callable[[pa.Table], object]) -> RDD:
    """(block, `pack` of the block's rows) for each of `n` blocks; rows are dealt out by `key`."""
    columns = rows.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        whole = pa.Table.from_batches(found) if found else pa.table({c: [] for c in columns})
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([pickle.dumps(pack(whole))], pa.large_binary())], names=["block", "value"])

    dealt = rows.repartition(n, key) if key else rows.repartition(n)
    blobs = dealt.mapInArrow(step, "block long, value binary").rdd
    return blobs.map(lambda r: (r.block, ("state", r.block, pickle.loads(r.value)))).partitionBy(n + 1, block_of)


def unpacked(values: RDD, session, unpack: Callable[[object], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows that `unpack` makes of each block's value."""
    blobs = session.createDataFrame(values.map(lambda x: (bytearray(pickle.dumps(x)),)), "value binary")

    def step(batches):
        for batch in batches:
            for value in batch.column(0):
                yield from unpack(pickle.loads(value.as_py()))

    return blobs.mapInArrow(step, schema)


class Blocks:
    """Supersteps over `n` blocks that have a fixed part each."""

    def __init__(self, fixed: RDD | None, n: int, session, every: int = SETTLE_EVERY):
        self.fixed, self.n, self.session, self.every = fixed, n, session, every
        self.steps, self.kept = 0, None
        shared_dir(session)

    def step(self, now: RDD, act: Callable, *given) -> RDD:
        """One superstep. act(block, fixed, state, mail, *given) yields (to, tag, value); mail: {tag: [(from, value)]} by sender.

        The tag `state` is the block's own, `stat` is for `stats`.
        """
        n = self.n

        def run(items):
            fixed, state, mail, at = None, None, {}, None
            for block, (tag, sender, value) in items:
                at = block
                if tag == "fixed":
                    fixed = value
                elif tag == "state":
                    state = value
                else:
                    mail.setdefault(tag, []).append((sender, value))
            if at is None or at == n:
                return
            for found in mail.values():
                found.sort(key=lambda x: x[0])
            for to, tag, value in act(at, fixed, state, mail, *given):
                yield n if tag == "stat" else to, (tag, at, value if tag in ("state", "stat") else narrowed(value))

        self.steps += 1
        whole = now if self.fixed is None else self.fixed.union(now)
        return self.dealt(whole.mapPartitions(run, preservesPartitioning=False))

    def dealt(self, rows: RDD) -> RDD:
        """(block, value) by block; one more partition takes what is for `stats`."""
        return rows.partitionBy(self.n + 1, block_of)

    def stats(self, now: RDD, combine=np.add) -> np.ndarray:
        """What blocks have sent as `stat`, a few numbers each, summed or otherwise combined."""
        found = self.session.sparkContext.runJob(now, lambda xs: [v for _, (_, _, v) in xs], [self.n])
        return combine.reduce(np.array(found, float), axis=0)

    def settle(self, now: RDD) -> RDD:
        """`now`, with lineage cut if it has grown long."""
        if self.steps < self.every:
            return now
        self.steps = 0
        now.persist(StorageLevel.DISK_ONLY).checkpoint()
        now.count()
        now.unpersist()  # it is read from the shared folder from here on
        self.release()
        # by itself: `now` holds all RDDs that it was made of, and Spark deletes shuffles only when the driver's collector finds theirs unused
        self.kept = RDD(now._jrdd, now.ctx, now._jrdd_deserializer)
        self.kept.partitioner = now.partitioner
        gc.collect()
        self.session.sparkContext._jvm.System.gc()
        return self.kept

    def release(self) -> None:
        """Delete what the last cut has left."""
        if self.kept is not None:
            place = self.session.sparkContext._jvm.org.apache.hadoop.fs.Path(self.kept.getCheckpointFile())
            place.getFileSystem(self.session.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            self.kept = None

    def start(self) -> RDD:
        """Blocks without a state."""
        n = self.n
        return self.dealt(self.session.sparkContext.parallelize(range(n), n).map(lambda i: (i, ("begin", i, None))))

    def states(self, now: RDD) -> RDD:
        return now.filter(lambda x: x[1][0] == "state").map(lambda x: x[1][2])

    def fix(self, now: RDD) -> Blocks:
        """Blocks whose fixed part is the state of `now`."""
        # shuffled like what it is united with, so that both come in one form and each task has one Python worker
        fixed = self.dealt(now.filter(lambda x: x[1][0] == "state").map(lambda x: (x[0], ("fixed", x[0], narrowed(x[1][2])))))
        return Blocks(fixed.persist(StorageLevel.MEMORY_AND_DISK), self.n, self.session, self.every)


def narrowed(value):
    """`value` with its whole numbers, in tuples and dictionaries too, in 32 bits where all of an array fit."""
    if isinstance(value, tuple):
        return tuple(map(narrowed, value))
    if isinstance(value, dict):
        return {k: narrowed(v) for k, v in value.items()}
    if isinstance(value, np.ndarray) and value.dtype == np.int64 and len(value) and value.max() < 1 << 31 and value.min() >= -(1 << 31):
        return value.astype(np.int32)
    return value


def grouped(keys: list[np.ndarray], *sums: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Distinct rows of `keys` in order, the sums of values over each, and a row of each."""
    if not len(keys[0]):
        return keys, list(sums), np.zeros(0, np.int64)
    order = np.lexsort(tuple(reversed(keys)))
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    head = np.flatnonzero(new)
    return [k[head] for k in keys], [np.add.reduceat(s[order], head) for s in sums], order[head]


def segments(owner: np.ndarray, n: int) -> np.ndarray:
    """Where each owner's stretch of a sorted column begins; the last is its length."""
    return np.searchsorted(owner, np.arange(n + 1))


def joined(mail: list, width: int) -> list[np.ndarray]:
    """The columns of all senders' values, one after the other."""
    return [np.concatenate([v[k] for _, v in mail]) if mail else np.zeros(0) for k in range(width)]


def factorized(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pd.factorize(keys)


# --- personalised PageRank


def pagerank(of: DataFrame, seeds: DataFrame, entity: list[str], damping: float, tolerance: float, most_rounds: int, settled_every: int = 3) -> DataFrame:
    """(claim_id, score) of claims that aren't seeds: see `detect.pagerank`. Claims are kept by the block that holds their edges.

    Claims and entities of a single edge are eliminated where they are, so
    rounds go over entities that edges share: their values stay with their
    owners, and blocks of edges have no state that would travel.
    """
    session, kind = of.sparkSession, of.schema["claim_id"].dataType.simpleString()
    edges = of.count()
    n = number_of_blocks(of, edges)
    key = F.concat_ws(":", *entity)
    rows = of.join(seeds.withColumn("seed", F.lit(True)), "claim_id", "left").select("claim_id", key.alias("e"), F.pmod(F.xxhash64(key), F.lit(n)).alias("owner"), "weight", F.coalesce("seed", F.lit(False)).alias("seed"))

    def pack(t: pa.Table):
        claims, keys = (t[c].combine_chunks().dictionary_encode() for c in ("claim_id", "e"))
        c, slot = claims.indices.to_numpy(), keys.indices.to_numpy()
        owner = np.zeros(len(keys.dictionary), np.int64)
        owner[slot] = t["owner"].to_numpy()
        order = np.argsort(owner, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        seed = np.zeros(len(claims.dictionary), bool)
        seed[c[t["seed"].to_numpy(zero_copy_only=False).astype(bool)]] = True
        return {"names": claims.dictionary, "c": c, "slot": place[slot], "weight": t["weight"].to_numpy().astype(float), "keys": keys.dictionary.take(pa.array(order)), "seg": segments(owner[order], n), "seed": seed}

    def register(i, _, s, mail):
        mass, count = np.bincount(s["slot"], s["weight"], len(s["keys"])), np.bincount(s["slot"], minlength=len(s["keys"]))
        for j in np.flatnonzero(np.diff(s["seg"])).tolist():
            at = np.arange(*s["seg"][j : j + 2])
            yield j, "keys", (s["keys"].take(pa.array(at)), mass[at], count[at])  # taken, as a slice would bring its whole array
        yield i, "state", {k: v for k, v in s.items() if k != "keys"}

    def own(i, _, s, mail):
        found = mail.get("keys", [])
        routes, entities = {}, 0
        if found:
            codes = pa.concat_arrays([v[0] for _, v in found]).dictionary_encode().indices.to_numpy()
            mass, count = (np.bincount(codes, np.concatenate([v[k] for _, v in found])) for k in (1, 2))
            shared = count > 1
            number, entities, at = np.cumsum(shared) - 1, int(shared.sum()), 0
            for sender, (theirs, *_) in found:
                here = codes[at : at + len(theirs)]
                at += len(theirs)
                yield sender, "mass", (mass[here], shared[here])
                if shared[here].any():
                    routes[sender] = number[here[shared[here]]]
        yield i, "state", s | {"routes": routes, "entities": entities}

    def ready(i, _, s, mail):
        slots = s["seg"][-1]
        ke, shared = np.ones(slots), np.zeros(slots, bool)
        for sender, (mass, more) in mail.get("mass", []):
            at = slice(*s["seg"][sender : sender + 2])
            ke[at], shared[at] = mass, more
        c, slot, weight = s["c"], s["slot"], s["weight"]
        give = weight / np.bincount(c, weight, len(s["seed"]))[c] * damping
        take = weight / ke[slot] * damping
        kept = shared[slot]
        back = 1 / (1 - np.bincount(c[~kept], (give * take)[~kept], len(s["seed"])))  # what a claim's own entities return to it
        before = np.concatenate([[0], np.cumsum(shared)])
        c, slot = c[kept], before[slot[kept]].astype(np.int32)
        fixed = {"c": c, "slot": slot, "up": give[kept] * back[c], "down": take[kept], "seg": before[s["seg"]], "seed": s["seed"], "back": back}
        yield i, "state", (fixed | {"routes": s["routes"], "entities": s["entities"]}, s["names"])

    setup = Blocks(None, n, session, settle_every(edges))
    laid = setup.step(setup.step(setup.step(packed(rows, n, "claim_id", pack), register), own), ready).filter(lambda x: x[1][0] == "state")
    names = setup.dealt(laid.map(lambda x: (x[0], ("names", x[0], x[1][2][1]))))
    blocks = setup.fix(laid.map(lambda x: (x[0], ("state", x[0], x[1][2][0]))))
    count = blocks.fixed.map(lambda x: int(x[1][2]["seed"].sum())).sum()
    if not count:
        blocks.fixed.unpersist()
        return of.select("claim_id", F.lit(0.0).alias("score")).limit(0)
    middle, half = 1 - damping**2 / 2, damping**2 / 2

    def raised(g, x):
        """What claims give to shared entities, to the owners of these."""
        y = np.bincount(g["slot"], g["up"] * x[g["c"]], g["seg"][-1])
        for j in np.flatnonzero(np.diff(g["seg"])).tolist():
            yield j, "up", y[g["seg"][j] : g["seg"][j + 1]]

    def lowered(g, mail):
        """What claims have from shared entities."""
        values = np.zeros(g["seg"][-1])
        for sender, value in mail.get("down", []):
            values[slice(*g["seg"][sender : sender + 2])] = value
        return np.bincount(g["c"], g["down"] * values[g["slot"]], len(g["seed"]))

    def summed(g, mail):
        total = np.zeros(g["entities"])
        for sender, value in mail.get("up", []):
            total[g["routes"][sender]] += value
        return total

    def sent(g, value):
        for holder, route in g["routes"].items():
            yield holder, "down", value[route]

    def begin(i, g, s, mail):
        yield from raised(g, g["seed"] * ((1 - damping) / count))

    def first(i, g, s, mail):
        r = summed(g, mail)
        s = {"x": np.zeros(len(r)), "r": r, "d": r / middle}
        yield i, "state", s
        yield from sent(g, s["d"])

    def through(i, g, s, mail):
        yield i, "state", s
        yield from raised(g, lowered(g, mail))

    def advance(i, g, s, mail, rho, last):
        x, r = s["x"] + s["d"], s["r"] - s["d"] + summed(g, mail)
        s = {"x": x, "r": r, "d": rho * last * s["d"] + 2 * rho / half * r}
        yield i, "state", s
        yield i, "stat", (np.abs(r).max(initial=0.0), x.max(initial=0.0))
        yield from sent(g, s["d"])

    now, rho = blocks.step(blocks.step(blocks.start(), begin), first), half / middle
    for turn in range(most_rounds):
        last, rho = rho, 1 / (2 * middle / half - rho)
        now = blocks.step(blocks.step(now, through), advance, rho, last)
        if turn % settled_every == settled_every - 1:
            now = blocks.settle(now)
            r, x = blocks.stats(now, np.maximum)
            if r <= tolerance * x:
                break
    else:
        raise RuntimeError(f"PageRank has not converged in {most_rounds} rounds")

    def again(i, g, s, mail):
        yield i, "state", s["x"]
        yield from sent(g, s["x"])

    def scored(i, g, s, mail):
        x = g["back"] * (g["seed"] * ((1 - damping) / count) + lowered(g, mail))
        yield i, "stat", (max(s.max(initial=0.0), x.max(initial=0.0)),)
        yield i, "state", (x, ~g["seed"])

    final = blocks.step(blocks.step(now, again), scored)
    most = float(blocks.stats(final, np.maximum)[0])
    scores = final.union(names).mapPartitions(lambda items: _scored({v[0]: v[2] for _, v in items}, most))

    def rows_of(value):
        yield pa.record_batch([value[0], pa.array(value[1])], names=["claim_id", "score"])

    found = cut(unpacked(scores, session, rows_of, f"claim_id {kind}, score double"))
    blocks.release()
    blocks.fixed.unpersist()
    return found


def _scored(block: dict, most: float) -> Iterator[tuple]:
    if "names" in block and len(block["names"]):
        x, rest = block["state"]
        yield block["names"].filter(pa.array(rest)), x[rest] / most
