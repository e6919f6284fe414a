"""Chat formatting by minimum-cost role repair.

A legal conversation may begin with one system turn, then user and assistant
alternate, and an assistant turn ends it. A dynamic program over that
automaton repairs a conversation at the least cost: each turn is kept,
relabelled, merged into the turn before it, or preceded by an empty turn that
is inserted; an empty assistant turn may be added at the end.

A step of the program is a min-plus matrix over the automaton's states, and
such matrices compose, so a conversation is not confined to one task. Turns
are range-partitioned by conversation and place; a conversation that crosses
partitions is solved in pieces: each piece is folded to one matrix, the few
matrices of a conversation (one a partition it touches) give each piece the
costs it begins with, a second look gives the state it ends in, and each piece
is then repaired by itself, exactly as the whole would have been. What is
gathered is bounded by the number of partitions, however long a conversation.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimloom.plans.durable import shared_dir
from claimloom.sources.tables import table

#: States: nothing yet, then the role of the last turn.
ROLES = ("system", "user", "assistant")
STATES = ("start", *ROLES)
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: Names that count as one of the roles; any other is unknown and fits each role at `GUESS`.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
MERGE, MERGE_OTHER, RELABEL, GUESS, INSERT = 2, 7, 6, 1, 5
_FAR = 1 << 40

#: For each role (and None, unknown) and state: the moves (cost, preference, next state, action, role, inserted role).
_MOVES: dict = {}


def _moves(role: str | None, state: str):
    """All ways to take a turn in a state, cheapest first; ties: keep, merge, relabel, then with an insertion."""
    if (role, state) not in _MOVES:
        found = []
        label = lambda to: 0 if role == to else GUESS if role is None else RELABEL
        if state != "start":
            same = role == state
            found.append((MERGE if same else MERGE + GUESS if role is None else MERGE_OTHER, 1, state, "merge", state, None))
        for to in NEXT[state]:
            found.append((label(to), 0 if role == to else 2, to, "keep" if role == to else "relabel", to, None))
            for then in NEXT[to]:
                found.append((INSERT + label(then), 3 if role == then else 4, then, "keep" if role == then else "relabel", then, to))
        _MOVES[role, state] = sorted(found, key=lambda m: (m[0], m[1], STATES.index(m[2])))
    return _MOVES[role, state]


def role_of(name: str | None) -> str | None:
    """The role a name stands for, or None."""
    name = (name or "").strip().lower()
    return name if name in ROLES else ALIASES.get(name)


def _end_cost(state: str) -> int:
    """What it costs to end in a state: an assistant turn ends a conversation."""
    return 0 if state in ("assistant", "start") else INSERT if state == "user" else 2 * INSERT


def _step(costs: dict[str, int], role: str | None) -> dict[str, tuple]:
    """For each state after one more turn: (cost, preference, number of the state before, move); costs: those of the states before."""
    to: dict[str, tuple] = {}
    for at, state in enumerate(STATES):
        if state in costs:
            for move in _moves(role, state):
                way = (costs[state] + move[0], move[1], at, move)
                if move[2] not in to or way[:3] < to[move[2]][:3]:
                    to[move[2]] = way
    return to


def fold(roles: list[str | None]) -> list[list[int]]:
    """The least cost from each state to each state over a run of turns, `_FAR` if there is no way."""
    out = []
    for state in STATES:
        costs = {state: 0}
        for role in roles:
            costs = {s: w[0] for s, w in _step(costs, role).items()}
        out.append([costs.get(t, _FAR) for t in STATES])
    return out


def origins(roles: list[str | None], costs: dict[str, int]) -> list[int]:
    """For each state to end in, the number of the state with which the best way began; -1 if there is no way."""
    began = {s: STATES.index(s) for s in costs}
    for role in roles:
        to = _step(costs, role)
        costs, began = {s: w[0] for s, w in to.items()}, {s: began[STATES[w[2]]] for s, w in to.items()}
    return [began.get(s, -1) for s in STATES]


def best_end(costs: dict[str, int]) -> str:
    return min(costs, key=lambda s: (costs[s] + _end_cost(s), STATES.index(s)))


def best_moves(roles: list[str | None], costs: dict[str, int], end: str | None = None) -> tuple[list[tuple], str]:
    """The moves of the best way through a run, and its last state (`end`, if given)."""
    back = []
    for role in roles:
        back.append(_step(costs, role))
        costs = {s: w[0] for s, w in back[-1].items()}
    end = state = end or best_end(costs)
    moves = []
    for to in reversed(back):
        _, _, before, move = to[state]
        moves.append(move)
        state = STATES[before]
    return moves[::-1], end


def _runs(batches, names):
    """The rows of each conversation, or of the piece of it that a partition holds; the first of `names` is the conversation."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if held and row[0] != held[-1][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _crossings(rows: DataFrame, kind: str) -> dict:
    """For each piece (part, conversation) of a conversation in several parts: costs it begins with, state it ends in, rows before it, whether it is the last."""

    def edges(batches):
        """First and last run of the part, folded."""
        kept: list[list] = []
        for run in _runs(batches, ("conv", "role", "part")):
            kept = [*kept[:1], run]
        for n, run in enumerate(kept):
            yield _records([{"part": run[0][2], "n": n, "conv": run[0][0], "size": len(run), "cost": fold([role_of(r) for _, r, _ in run])}], shape)

    shape = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("conv", to_arrow_type(rows.schema["conv"].dataType)), ("size", pa.int64()), ("cost", pa.list_(pa.list_(pa.int64())))])
    narrow = rows.select("conv", "role", "part")
    found = sorted(narrow.mapInArrow(edges, f"part int, n int, conv {kind}, size long, cost array<array<long>>").collect(), key=lambda r: (r.part, r.n))
    chains: list[list] = []
    for r in found:
        if chains and chains[-1][-1].part != r.part and chains[-1][-1].conv == r.conv:
            chains[-1].append(r)
        else:
            chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    begins, before, last = {}, {}, {}
    for chain in chains:
        costs, count = {"start": 0}, 0
        for r in chain:
            begins[r.part, r.conv], before[r.part, r.conv] = costs, count
            count += r.size
            costs = {t: c for k, t in enumerate(STATES) if (c := min(v + r.cost[STATES.index(s)][k] for s, v in costs.items())) < _FAR}
        last[chain[-1].part, chain[-1].conv] = best_end(costs)
    if not chains:
        return {}
    shared = rows.sparkSession.sparkContext.broadcast(begins)

    def look(batches):
        for run in _runs(batches, ("conv", "role", "part")):
            if (key := (run[0][2], run[0][0])) in shared.value:
                yield _records([{"part": key[0], "conv": key[1], "origin": origins([role_of(r) for _, r, _ in run], shared.value[key])}], traced)

    traced = pa.schema([shape.field("part"), shape.field("conv"), ("origin", pa.list_(pa.int64()))])
    origin = {(r.part, r.conv): r.origin for r in narrow.mapInArrow(look, f"part int, conv {kind}, origin array<long>").collect()}
    out = {}
    for chain in chains:
        end = last[chain[-1].part, chain[-1].conv]
        for r in reversed(chain):
            key = (r.part, r.conv)
            out[key] = (begins[key], end, before[key], key in last)
            end = STATES[origin[key][STATES.index(end)]]
    return out


def _records(rows: list[dict], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, shape)


def _turn(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}"


_CLOSE = "<|end|>\n"


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each row of `turns`: conv_id, turn, place, action, role_in, role, inserted, closing, rendered.

    place: the row's number in its conversation, from 0. action: keep, relabel
    or merge (into the turn before). inserted: the role of the empty turn put
    in front, or null. closing: roles of the empty turns put after the
    conversation's last row, comma-joined, or null. rendered: the row's share
    of the repaired conversation; joined in order of place the shares are
    `<|role|>`, line end, text, `<|end|>`, line end for every turn, with a
    line end between merged texts. So a conversation of any length is rendered
    without ever being in one place.

    Rows are ordered by turn, nulls first, then by role and text; repeated
    rows have neighbouring places. Null texts render as empty. Null and
    unknown roles fit any role at a small cost. Rows of a null conversation
    are one conversation. Texts are kept whole. Empty table: empty result.
    Other columns are not read. Equal costs prefer keeping, then merging,
    relabelling, inserting, then the earlier state in `STATES`.
    """
    shared_dir(turns.sparkSession)
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    # the last key tells repeated rows apart, of which a million may be one turn; which of them is which doesn't matter
    keys = ["conv", "turn", "role", F.xxhash64("text"), "copy"]
    rows = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys[:4], "text", "copy")
    rows = rows.drop("copy").withColumn("part", F.spark_partition_id()).checkpoint()  # a scan of it has the same partitions, in the same order
    kind, turn_kind = (rows.schema[c].dataType for c in ("conv", "turn"))
    shared = turns.sparkSession.sparkContext.broadcast(_crossings(rows, kind.simpleString()))
    names = [conv_col, turn_col, "place", "action", "role_in", "role", "inserted", "closing", "rendered"]
    types = [to_arrow_type(kind), to_arrow_type(turn_kind), pa.int64(), *[pa.string()] * 6]

    def mended(run):
        begin, end, place, last = shared.value.get((run[0][4], run[0][0]), ({"start": 0}, None, 0, True))
        moves, end = best_moves([role_of(r[2]) for r in run], begin, end)
        for n, ((conv, turn, name, text, _), (_, _, _, action, role, inserted)) in enumerate(zip(run, moves, strict=True)):
            closing = []
            if last and n == len(run) - 1:
                closing = {"assistant": [], "user": ["assistant"]}.get(end, ["user", "assistant"])
            shown = "\n" + (text or "") if action == "merge" else (_CLOSE if place + n else "") + (_turn(inserted, "") + _CLOSE if inserted else "") + _turn(role, text or "")
            if last and n == len(run) - 1:
                shown += _CLOSE + "".join(_turn(c, "") + _CLOSE for c in closing)
            yield conv, turn, place + n, action, name, role, inserted, ",".join(closing) or None, shown

    def mend(batches):
        ready: list[tuple] = []
        for run in _runs(batches, ("conv", "turn", "role", "text", "part")):
            for line in mended(run):
                ready.append(line)
                if len(ready) >= 4096:
                    yield _lines(ready)
                    ready = []
        if ready:
            yield _lines(ready)

    def _lines(ready):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*ready, strict=True), types, strict=True)], names)

    schema = f"`{conv_col}` {kind.simpleString()}, `{turn_col}` {turn_kind.simpleString()}, place long, action string, role_in string, role string, inserted string, closing string, rendered string"
    return rows.mapInArrow(mend, schema)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, repaired and rendered."""
    return repair(table(spark, sf_dir, "conversations"))
