"""Modularity communities with refinement, in blocks.

On each level vertices move between communities, communities are refined into
well-connected parts, and the parts become the vertices of the next level,
which start in the communities that they were refined from (Traag, Waltman
and van Eck 2019, in parallel). A last stage on the vertices themselves makes
sure of what is promised: every community is connected, and no vertex would
gain by moving to another.

Moving in parallel: each round draws a rank for every community by its label,
and vertices move to communities of higher rank alone, so no two trade places
for ever. While refining, by a coin of the label, a part either stays or
joins, so what a vertex joins doesn't go elsewhere meanwhile. The last stage
moves claims and entities by turns, as two of a kind are never linked: moves
of a round then touch each other by the masses of communities alone. Into and
out of each community moves go by gain a mass, as far as the mass that moves
along costs none of them more than its gain; the best of all is always among
them, so modularity rises in each round and the stage ends, after rounds that
don't grow with the number of vertices a community has left to move.

Masses of communities are summed at the block that a label hashes to. A
vertex knows the mass of its own community exactly and those of others as of
the round before, which the last stage makes up for by a round without moves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.blocks import Blocks, factorized, grouped, joined, number_of_blocks, packed, segments, settle_every, unpacked
from claimloom.plans.durable import cut

#: Least gain of a move, by total weight.
LEAST = 1e-9
#: Moving and refining end as a round moves no more than a share of the vertices, levels as one merges no more than another; rounds of moving and of refining, and levels, at most. What they leave, the last stage moves.
SETTLED, MERGED, MOVES, REFINES, LEVELS, MANY = 0.01, 0.03, 12, 6, 12, 1000
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _rank(label: np.ndarray, turn: int) -> np.ndarray:
    """A rank for each label, drawn anew each round."""
    h = (label.astype(np.uint64) + np.uint64(turn * 7919 + 1)) * _ODD
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _coin(label: np.ndarray, turn: int) -> np.ndarray:
    """A fair coin for each label and round."""
    return _rank(label, turn) >> np.uint64(63) == 1


def _mixed(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    h = (a.astype(np.uint64) * _ODD) ^ (b.astype(np.uint64) * _MIX)
    return ((h ^ (h >> np.uint64(31))) * _ODD >> np.uint64(33)).astype(np.int64) % n


def _sent(owner: np.ndarray, n: int, tag: str, *columns: np.ndarray):
    """Messages of rows to their owners."""
    order = np.argsort(owner, kind="stable")
    seg = segments(owner[order], n)
    columns = [c[order] for c in columns]
    for j in np.flatnonzero(np.diff(seg)).tolist():
        at = slice(seg[j], seg[j + 1])
        yield j, tag, tuple(c[at] for c in columns)


# --- laying out a level


def _pack(n: int) -> Callable[[pa.Table], object]:
    def pack(t: pa.Table):
        ends = [t[c].to_numpy() for c in ("a", "b")]
        codes, keys = factorized(np.concatenate(ends))
        owner = np.zeros(len(keys), np.int64)
        owner[codes] = np.concatenate([t[c].to_numpy() for c in ("oa", "ob")])
        return codes, keys, owner, t["weight"].to_numpy().astype(float)

    return pack


def _slotted(codes, keys, owner, weight, n, extra=()):
    """A holder's part of a level, and what it tells the owners of its vertices."""
    order = np.argsort(owner, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    slots, half = place[codes], len(weight)
    mass = np.bincount(slots, np.concatenate([weight, weight]), len(keys))
    seg = segments(owner[order], n)
    mine = {"a": slots[:half], "b": slots[half:], "w": weight, "seg": seg}
    told = [(j, "keys", (keys[order][seg[j] : seg[j + 1]], mass[seg[j] : seg[j + 1]])) for j in np.flatnonzero(np.diff(seg)).tolist()]
    return mine, told


def _register(i, _, s, mail, n):
    mine, told = _slotted(*s, n)
    yield i, "state", mine
    yield from told


def _own(i, _, s, mail, n):
    """Numbers the block's vertices; a vertex's id ends in its owner."""
    found = mail.get("keys", [])
    keys, mass = joined(found, 2)
    codes, names = factorized(keys)
    k = np.bincount(codes, mass, len(names)).astype(float) if len(names) else np.zeros(0)
    routes, at = {}, 0
    for sender, (theirs, _) in found:
        routes[sender] = codes[at : at + len(theirs)]
        at += len(theirs)
    side = np.fromiter((name.startswith("e") for name in names), np.int8, len(names))
    yield i, "state", s | {"routes": routes, "ids": np.arange(len(names)) * n + i, "k": k, "names": names, "side": side}


def _begin(i, g, s, mail):
    """Each vertex in a community of its own."""
    s = {"m": g["ids"].copy(), "K": g["k"].copy()} if s is None else s
    yield i, "state", s
    yield from _labels(g, s, s["m"], s["K"])


# --- a round: labels to holders, weights and masses to owners


def _labels(g, s, m, *known):
    """To holders: label of each of their vertices with what is known of it; to the blocks of labels: masses."""
    n = len(g["seg"]) - 1
    for holder, route in g["routes"].items():
        yield holder, "label", (m[route], *[x[route] for x in known])
    sums = [g["k"], np.ones(len(m))] + ([s["open"]] if "open" in s else [])
    (labels,), totals, _ = grouped([m], *sums)
    yield from _sent(labels % n, n, "mass", labels, *totals)


def _slots(g, mail, width):
    """What owners said of the holder's slots; labels and bounds are whole numbers."""
    out = [np.zeros(g["seg"][-1], np.int64 if k in (0, 4) else float) for k in range(width)]
    for sender, values in mail.get("label", []):
        at = slice(g["seg"][sender], g["seg"][sender + 1])
        for k, v in enumerate(values):
            out[k][at] = v
    return out


def _masses(mail):
    """Answers, to each sender of partial masses, the whole masses of its labels."""
    found = mail.get("mass", [])
    if found:
        columns = joined(found, len(found[0][1]))
        (labels,), sums, _ = grouped([columns[0]], *columns[1:])
        for sender, (theirs, *_) in found:
            at = np.searchsorted(labels, theirs)
            yield sender, "sum", (theirs, *[x[at] for x in sums])


def _weigh(i, g, s, mail, inside=False):
    """To owners: weights from each vertex to each label around it; with `inside`, within the bounds of communities alone."""
    n, width = len(g["seg"]) - 1, 5 if inside else 2
    known = _slots(g, mail, width)
    a, b, w = g["a"], g["b"], g["w"]
    if inside:
        keep = known[4][a] == known[4][b]
        a, b, w = a[keep], b[keep], w[keep]
    slot, other = np.concatenate([a, b]), np.concatenate([b, a])
    (slot, label), (weight,), row = grouped([slot, known[0][other]], np.concatenate([w, w]))
    rest = [x[other][row] for x in known[1 : 4 if inside else 2]]
    seg = g["seg"]
    cut = np.searchsorted(slot, seg)
    yield i, "state", s
    for j in np.flatnonzero(np.diff(cut)).tolist():
        at = slice(cut[j], cut[j + 1])
        yield j, "near", (slot[at] - seg[j], label[at], weight[at], *[x[at] for x in rest])
    yield from _masses(mail)


def _near(g, mail, width):
    """(vertex, label, weight, ...) at the owner, summed over holders."""
    found = mail.get("near", [])
    if not found:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0)] * (width - 2)]
    columns = joined(found, width)
    columns[0] = np.concatenate([g["routes"][sender][v[0]] for sender, v in found])
    (v, label), (w,), row = grouped(columns[:2], columns[2])
    return [v, label, w, *[c[row] for c in columns[3:]]]


def _own_masses(m, mail, width):
    """Whole masses (and what else was summed) of each vertex's label."""
    if not len(m):
        return [np.zeros(0) for _ in range(width)]
    columns = joined(mail["sum"], width + 1)
    order = np.argsort(columns[0], kind="stable")
    at = order[np.searchsorted(columns[0][order], m)]
    return [c[at] for c in columns[1:]]


def _gains(g, s, mail, scale):
    """Own masses; rows (vertex, label, mass, gain) of other communities around each vertex."""
    mass, count = _own_masses(s["m"], mail, 2)
    v, label, w, K = _near(g, mail, 4)
    k, m = g["k"], s["m"]
    own = label == m[v]
    stay = np.bincount(v[own], w[own], len(m)) - scale * k * (mass - k)
    v, label, w, K = (x[~own] for x in (v, label, w, K))
    gain = np.round(w - scale * k[v] * K - stay[v], 9)
    return mass, v, label, K, gain


def _best(v, label, gain):
    """A row for each vertex: that of most gain, then of least label."""
    order = np.lexsort((label, -gain, v))
    first = np.ones(len(order), bool)
    first[1:] = v[order][1:] != v[order][:-1]
    return order[first]


def _move(i, g, s, mail, scale, least, turn):
    """Vertices join communities of higher rank; then the labels of the next round. turn None: masses are renewed only."""
    mass, v, label, K, gain = _gains(g, s, mail, scale)
    m, K_own, moved = s["m"].copy(), mass.copy(), 0
    if turn is not None:
        may = np.flatnonzero((gain > least) & (_rank(label, turn) > _rank(s["m"][v], turn)))
        best = may[_best(v[may], label[may], gain[may])]
        m[v[best]], K_own[v[best]], moved = label[best], K[best] + g["k"][v[best]], len(best)
    s = s | {"m": m, "K": K_own}
    yield i, "state", s
    yield i, "stat", (moved, int((gain > least).sum()))
    yield from _labels(g, s, m, K_own)


# --- refinement


def _measure(i, g, s, mail, scale):
    """The bounds: each vertex's community and its mass; every vertex is a part by itself."""
    mass, count = _own_masses(s["m"], mail, 2)
    s = {"m": s["m"], "bound": mass, "r": g["ids"].copy(), "Kr": g["k"].copy(), "count": np.ones(len(mass)), "E": np.zeros(len(mass)), "open": np.zeros(len(mass))}
    yield i, "state", s
    yield from _labels(g, s, s["r"], s["Kr"], s["count"], s["E"], s["m"])


def _refine(i, g, s, mail, scale, least, turn):
    """Well-connected vertices that are still by themselves join well-connected parts of their community. turn None: links are measured only."""
    k, r, bound = g["k"], s["r"].copy(), s["bound"]
    mass, count, E = _own_masses(s["r"], mail, 3)
    v, label, w, K, number, open_ = _near(g, mail, 6)
    inside = np.bincount(v, w, len(k)) if len(v) else np.zeros(len(k))
    own = label == r[v]
    within = np.bincount(v[own], w[own], len(k)) if len(v) else np.zeros(len(k))
    moved = possible = 0
    K_own, count = mass.copy(), count.copy()
    if turn is not None:
        held = inside >= scale * k * (bound - k)
        gain = np.round(w - scale * k[v] * K, 9)
        good = ~own & (count[v] == 1) & held[v] & (gain > least) & (open_ >= scale * K * (bound[v] - K))
        possible = int(good.sum())
        may = np.flatnonzero(good & ~_coin(r[v], turn) & ((number > 1) | _coin(label, turn)))
        best = may[_best(v[may], label[may], gain[may])]
        at = v[best]
        r[at], K_own[at], count[at], within[at], moved = label[best], K[best] + k[at], number[best] + 1, w[best], len(best)
    s = s | {"r": r, "Kr": K_own, "count": count, "E": E, "open": inside - within}
    yield i, "state", s
    yield i, "stat", (moved, possible)
    yield from _labels(g, s, r, K_own, count, E, s["m"])


def _merge(i, g, s, mail, n):
    """Edges between parts to their new holders, parts to their owners."""
    known = _slots(g, mail, 5)[0]
    lo, hi = np.minimum(known[g["a"]], known[g["b"]]), np.maximum(known[g["a"]], known[g["b"]])
    apart = lo != hi
    (lo, hi), (w,), _ = grouped([lo[apart], hi[apart]], g["w"][apart])
    yield from _sent(_mixed(lo, hi, n), n, "pair", lo, hi, w)
    (parts,), (mass,), row = grouped([s["r"]], g["k"])
    yield from _sent(parts % n, n, "part", parts, mass, s["m"][row])
    yield i, "state", None


def _lay(i, _, s, mail, n):
    lo, hi, w = joined(mail.get("pair", []), 3)
    (lo, hi), (w,), _ = grouped([lo.astype(np.int64), hi.astype(np.int64)], w)
    parts, mass, m = joined(mail.get("part", []), 3)
    (ids,), (k,), row = grouped([parts.astype(np.int64)], mass)
    codes, keys = factorized(np.concatenate([lo, hi]))
    mine, told = _slotted(codes, keys, keys % n, w, n)
    yield i, "state", mine | {"ids": ids, "k": k, "m": m.astype(np.int64)[row]}
    yield from told


def _route(i, _, s, mail):
    yield i, "state", s | {"routes": {sender: np.searchsorted(s["ids"], keys) for sender, (keys, _) in mail.get("keys", [])}}


def _start_level(i, g, s, mail):
    """Parts start in the communities they were refined from; masses aren't known yet."""
    s = {"m": g["m"], "K": g["k"].copy()}
    yield i, "state", s
    yield from _labels(g, s, s["m"], s["K"])


# --- back to the vertices


def _ask(i, g, s, mail, n):
    """Every part asks for the community that the level above has found for it; mail: that level's answers are at its owners."""
    (parts,), _, _ = grouped([s["r"]])
    yield i, "state", s | {"parts": parts}
    yield from _sent(parts % n, n, "ask", parts)


def _answer(i, g, s, mail):
    """s: (own state, ids and communities of the level above)."""
    below, (ids, m) = s
    yield i, "state", below
    for sender, (parts,) in mail.get("ask", []):
        yield sender, "answer", (parts, m[np.searchsorted(ids, parts)])


def _take(i, g, s, mail):
    parts, found = joined(mail.get("answer", []), 2)
    order = np.argsort(parts, kind="stable")
    m = found[order][np.searchsorted(parts[order], s["r"])].astype(np.int64) if len(parts) else s["r"]
    yield i, "state", {"m": m, "K": g["k"].copy()}


def _paired(below: RDD, above: RDD, level: Blocks, upper: Blocks) -> RDD:
    """State of the lower level beside (ids, communities) of the upper, and the mail of the lower."""
    return below.union(level.dealt(upper.fixed.union(above).mapPartitions(_above)))


def _above(items):
    """(ids, communities) of a block of the upper level."""
    found, at = {}, None
    for at, (tag, _, value) in items:
        found[tag] = value
    if "fixed" in found:
        yield at, ("above", at, (found["fixed"]["ids"], found["state"]["m"]))


# --- the last stage


def _propose(i, g, s, mail, scale, least, n, side):
    """The best move of each vertex of a side, to the blocks of both communities; stat: vertices of either side that gain."""
    mass, v, label, K, gain = _gains(g, s, mail, scale)
    may = np.flatnonzero(gain > least)
    best = may[_best(v[may], label[may], gain[may])]
    yield i, "stat", (len(best), 0)
    best = best[g["side"][v[best]] == side]
    v, label, gain = v[best], label[best], gain[best]
    yield i, "state", s | {"K": mass, "to": (v, label)}
    touched, into = np.concatenate([s["m"][v], label]), np.repeat([0, 1], len(v))
    yield from _sent(touched % n, n, "propose", touched, into, *[np.tile(x, 2) for x in (g["ids"][v], gain, g["k"][v])])


def _accept(i, g, s, mail, scale, n):
    """Of the moves into a community, and of those out of it, the first by gain a mass, as long as the mass that goes with them costs none of them more than its gain."""
    yield i, "state", s
    if mail.get("propose"):
        touched, into, who, gain, k = joined(mail["propose"], 5)
        rate = gain / k
        order = np.lexsort((who, -rate, into, touched))
        touched, into, who, rate, k = (x[order] for x in (touched, into, who, rate, k))
        first = np.ones(len(order), bool)
        first[1:] = (touched[1:] != touched[:-1]) | (into[1:] != into[:-1])
        head, group = np.flatnonzero(first), np.cumsum(first) - 1
        before = np.concatenate([[0.0], np.cumsum(k)])
        along = before[1:] - before[head][group]
        fits = first | (scale * along <= rate)  # falls but once in a group: `along` rises and `rate` doesn't
        who = who[fits]
        yield from _sent(who % n, n, "accept", who)


def _carry_out(i, g, s, mail):
    v, label = s["to"]
    who = joined(mail["accept"], 1)[0] if mail.get("accept") else np.zeros(0, np.int64)
    votes = np.bincount(np.searchsorted(g["ids"], who), minlength=len(s["m"]))
    go = votes[v] == 2
    m, K = s["m"].copy(), s["K"].copy()
    m[v[go]] = label[go]
    s = {"m": m, "K": K}
    yield i, "state", s
    yield from _labels(g, s, m, K)


def _flood(i, g, s, mail):
    """Least vertex of each connected part so far: every vertex by itself."""
    s = {"m": s["m"], "f": g["ids"].copy()}
    yield i, "state", s
    for holder, route in g["routes"].items():
        yield holder, "label", (s["m"][route], s["f"][route])


def _least(i, g, s, mail):
    """To owners: the least part that a neighbour of the same community is in."""
    m, f = (np.zeros(g["seg"][-1], np.int64) for _ in range(2))
    for sender, (x, y) in mail.get("label", []):
        at = slice(g["seg"][sender], g["seg"][sender + 1])
        m[at], f[at] = x, y
    same = m[g["a"]] == m[g["b"]]
    a, b = g["a"][same], g["b"][same]
    least = f.copy()
    np.minimum.at(least, a, f[b])
    np.minimum.at(least, b, f[a])
    yield i, "state", s
    for j in np.flatnonzero(np.diff(g["seg"])).tolist():
        at = slice(g["seg"][j], g["seg"][j + 1])
        yield j, "least", least[at]


def _lower(i, g, s, mail, n):
    """The least part around, which the vertex that named the old part is told too; the new part is asked of the vertex that names it."""
    f, old = s["f"].copy(), s["f"]
    for sender, least in mail.get("least", []):
        np.minimum.at(f, g["routes"][sender], least)
    (asked,), _, _ = grouped([f])
    yield i, "state", s | {"f": f, "asked": f, "old": old}
    yield from _sent(asked % n, n, "ask", asked)
    lower = f < old
    yield from _sent(old[lower] % n, n, "hook", old[lower], f[lower])


def _jump(i, g, s, mail):
    """Vertices that name a part take the least that its members have met, so parts meet whole and not vertex by vertex."""
    f = s["f"].copy()
    for _, (part, least) in mail.get("hook", []):
        np.minimum.at(f, np.searchsorted(g["ids"], part), least)
    yield i, "state", s | {"f": f}
    for sender, (asked,) in mail.get("ask", []):
        yield sender, "answer", (asked, f[np.searchsorted(g["ids"], asked)])


def _spread(i, g, s, mail):
    f = s["f"]
    if len(f):
        asked, found = joined(mail["answer"], 2)
        order = np.argsort(asked, kind="stable")
        f = np.minimum(f, found[order][np.searchsorted(asked[order], s["asked"])])
    s = {"m": s["m"], "f": f, "changed": int((f != s["old"]).sum())}
    yield i, "state", s
    yield i, "stat", (s["changed"], 0)
    for holder, route in g["routes"].items():
        yield holder, "label", (s["m"][route], f[route])


def _parts(i, g, s, mail, n):
    """Parts in place of communities; stat: parts, and communities by the blocks of their labels."""
    (labels,), _, _ = grouped([s["m"]])
    state = {"m": s["f"], "K": g["k"].copy()}
    yield i, "state", state
    yield from _sent(labels % n, n, "name", labels)
    yield from _labels(g, state, state["m"], state["K"])


def _counted(i, g, s, mail):
    labels = np.unique(joined(mail["name"], 1)[0]) if mail.get("name") else []
    yield i, "stat", (int((s["m"] == g["ids"]).sum()), len(labels))
    yield from _weigh(i, g, s, mail)


# --- the whole


class _Level:
    """Supersteps of one level."""

    def __init__(self, blocks: Blocks, scale: float, least: float):
        self.blocks, self.scale, self.least = blocks, scale, least
        self.size = blocks.fixed.map(lambda x: len(x[1][2]["ids"])).sum()

    def step(self, now, act, *given):
        return self.blocks.step(now, act, *given)

    def round(self, now, act, turn, inside=False):
        return self.step(self.step(now, _weigh, *([True] if inside else [])), act, self.scale, self.least, turn)

    def moved(self, now, rounds: int):
        """Rounds of moving, in pairs, until they settle."""
        for turn in range(0, rounds, 2):
            now = self.round(self.round(now, _move, turn), _move, turn + 1)
            now = self.blocks.settle(now)
            if self.still(now):
                break
        return now

    def still(self, now) -> bool:
        """Whether nothing could move any more or, of many vertices, few did."""
        moved, possible = self.blocks.stats(now)
        return possible == 0 or (self.size >= MANY and moved <= SETTLED * self.size)

    def refined(self, now, rounds: int):
        now = self.step(self.step(now, _weigh), _measure, self.scale)
        now = self.round(now, _refine, None, True)
        now = self.round(now, _refine, None, True)  # a part's open links are known a round after its members'
        for turn in range(rounds):
            now = self.blocks.settle(self.round(now, _refine, turn, True))
            if turn % 2 and self.still(now):
                break
        return now

    def polished(self, now):
        """Single moves until none gains, claims and entities by turns, and whether any was made. `now` has sent its labels."""
        n, side, any_ = self.blocks.n, 0, False
        while True:
            now = self.round(now, _move, None)
            now = self.step(self.step(now, _weigh), _propose, self.scale, self.least, n, side)
            if not self.blocks.stats(now)[0]:
                return now, any_
            now = self.step(self.step(now, _accept, self.scale, n), _carry_out)
            now = self.blocks.settle(now)
            side, any_ = 1 - side, True

    def split(self, now):
        """Communities by their connected parts, with labels sent; whether any had more than one."""
        n = self.blocks.n
        now = self.step(now, _flood)
        while True:
            now = self.step(self.step(self.step(self.step(now, _least), _lower, n), _jump), _spread)
            now = self.blocks.settle(now)
            if not self.blocks.stats(now)[0]:
                break
        now = self.step(now, _parts, n)
        after = self.step(now, _counted)
        parts, communities = self.blocks.stats(after)
        return now, parts > communities


def communities(ids: DataFrame, resolution: float, moves: int = MOVES, levels: int = LEVELS) -> DataFrame:
    """(id, label) of each vertex of the weighted graph `ids` (c, e, weight): see `detect.communities`."""
    session = ids.sparkSession
    count, total = ids.agg(F.count("*"), F.sum("weight")).first()
    if not count:
        return ids.select(F.col("c").alias("id"), F.lit(0).cast("long").alias("label")).limit(0)
    n = number_of_blocks(ids, count)
    scale, least = resolution / (2 * (total or 1.0)), LEAST
    owner = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
    rows = ids.select(F.col("c").alias("a"), F.col("e").alias("b"), owner("c").alias("oa"), owner("e").alias("ob"), "weight")
    setup = Blocks(None, n, session, settle_every(count))
    laid = setup.step(setup.step(packed(rows, n, "a", _pack(n)), _register, n), _own, n)
    names = laid.filter(lambda x: x[1][0] == "state").map(lambda x: (x[0], ("names", x[0], x[1][2]["names"])))
    lean = laid.filter(lambda x: x[1][0] == "state").map(lambda x: (x[0], ("state", x[0], {k: v for k, v in x[1][2].items() if k != "names"})))
    base = _Level(setup.fix(lean), scale, least)
    level, now, stack = base, base.step(base.blocks.start(), _begin), []
    for _ in range(levels):
        now = level.moved(now, moves)
        now = level.refined(now, REFINES)
        stack.append((level, now))
        merged = level.step(level.step(level.step(now, _merge, n), _lay_of, n), _route_of)
        upper = _Level(level.blocks.fix(merged), scale, least)
        if upper.size >= (1 - MERGED) * level.size:
            upper.blocks.fixed.unpersist()
            break
        level, now = upper, upper.step(upper.blocks.start(), _start_level)
    # what the last level found goes down through the parts
    above = None
    for at, (lower, state) in enumerate(reversed(stack)):
        if at == 0:
            now = lower.step(state, _settled)
        else:
            asked = lower.step(state, _ask, n)
            now = lower.step(lower.step(_paired(asked, now, lower.blocks, above.blocks), _answer_of), _take)
        above = lower
    now = base.step(now, _begin)
    now = base.moved(now, 6)
    apart = None
    while True:
        now, any_ = base.polished(now)
        if apart is not None and not any_:
            break  # as the last split left it
        now, apart = base.split(now)
        if not apart:
            break
    values = now.union(base.blocks.dealt(names)).mapPartitions(_named)

    def rows_of(value):
        if len(value[0]):
            yield pa.record_batch([pa.array(value[0].tolist(), pa.string()), pa.array(value[1], pa.int64())], names=["id", "label"])

    found = cut(unpacked(values, session, rows_of, "id string, label long"))
    for x in (base, *(lower for lower, _ in stack)):
        x.blocks.release()
        x.blocks.fixed.unpersist()
    return found


def _named(items):
    found = {tag: v for _, (tag, _, v) in items if tag in ("state", "names")}
    if "state" in found:
        yield found["names"], found["state"]["m"]


def _lay_of(i, g, s, mail, n):
    yield from _lay(i, None, None, mail, n)


def _route_of(i, g, s, mail):
    yield from _route(i, None, s, mail)


def _settled(i, g, s, mail):
    yield i, "state", {"m": s["m"], "K": g["k"].copy()}


def _answer_of(i, g, s, mail):
    yield from _answer(i, g, (s, mail["above"][0][1]), mail)
