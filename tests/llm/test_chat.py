import itertools
import random

from claimloom.llm import chat


def _cheapest(roles):
    """Least cost over all ways to take each turn, by exhaustive search."""
    best = None
    for ways in itertools.product(range(12), repeat=len(roles)):
        state, cost = "start", 0
        for role, way in zip(roles, ways, strict=True):
            moves = chat._moves(role, state)
            if way >= len(moves):
                break
            cost, state = cost + moves[way][0], moves[way][2]
        else:
            cost += chat._end_cost(state)
            best = cost if best is None else min(best, cost)
    return best


def test_least_cost_by_exhaustive_search():
    r = random.Random(1)
    for _ in range(25):
        roles = [r.choice([*chat.ROLES, None]) for _ in range(r.randint(1, 4))]
        moves, end = chat.best_moves(roles, {"start": 0})
        assert sum(m[0] for m in moves) + chat._end_cost(end) == _cheapest(roles)


def _legal(shown):
    roles = [x.split("|>")[0] for x in shown.split("<|")[1:] if not x.startswith("end")]
    state = "start"
    for role in roles:
        assert role in chat.NEXT[state]
        state = role
    assert state == "assistant" and shown.endswith("<|end|>\n") and shown.count("<|end|>") == len(roles)


def _rows():
    r = random.Random(2)
    rows = [(0, t, r.choice(["user", "user", "assistant", "system", "human", None]), f"t{t}") for t in range(400)]  # one long conversation
    for c in range(1, 30):
        rows += [(c, t, r.choice(["user", "assistant", "system", "GPT ", "tool"]), r.choice(["a", "b", None, ""])) for t in range(r.randint(1, 7))]
    return rows + [(None, 0, "assistant", "x"), (50, None, "user", "first"), (50, 0, "user", "again"), (50, 0, "user", "again")]


def test_pieces_equal_the_whole_and_are_legal(spark):
    frame = spark.createDataFrame([(*x, "p") for x in _rows()], "conv_id long, turn long, role string, text string, place string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        outs = []
        for parts in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            outs.append(sorted(chat.repair(frame).collect(), key=lambda x: (x.conv_id is not None, x.conv_id, x.place)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert outs[0] == outs[1] and len(outs[0]) == len(_rows())
    whole = {}
    for x in outs[1]:
        assert x.place == len(whole.setdefault(x.conv_id, []))
        whole[x.conv_id].append(x)
    for conv, lines in whole.items():
        _legal("".join(x.rendered for x in lines))
        roles = [chat.role_of(x.role_in) for x in lines]
        moves, end = chat.best_moves(roles, {"start": 0})
        assert [(x.action, x.role, x.inserted) for x in lines] == [m[3:] for m in moves]
    texts = "".join(x.rendered for x in whole[0])
    assert all(f"t{t}" in texts for t in range(400))


def test_clean_conversation_is_left_alone_and_empty(spark):
    frame = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    found = sorted(chat.repair(frame).collect(), key=lambda x: x.place)
    assert [x.action for x in found] == ["keep"] * 3
    assert "".join(x.rendered for x in found) == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"
    assert chat.repair(frame.limit(0)).count() == 0
