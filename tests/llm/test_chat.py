import functools
import itertools
import random

import pyarrow as pa
import pytest

from lexispark.llm import chat


@functools.cache
def brute(roles):
    """Least cost over all sequences of edits, without the automaton's matrices."""
    best = {(): 0.0}  # roles of messages so far -> cost
    legal = lambda seq: all(seq[i] in chat.NEXT[seq[i - 1] if i else 0] for i in range(len(seq)))
    for read in roles:
        new = {}
        for seq, cost in best.items():
            for role in (1, 2, 3):
                base = cost + chat.RELABEL[read][role - 1]
                options = [(seq + (role,), base)] + [(seq + (x, role), base + chat.INSERT) for x in (1, 2, 3)]
                if seq and seq[-1] == role:
                    options.append((seq, base + chat.MERGE))
                for s, c in options:
                    if legal(s) and c < new.get(s, 1e9):
                        new[s] = c
        best = new
    out = []
    for seq, cost in best.items():
        for tail in ((), (3,), (2, 3)):
            s = seq + tail
            if legal(s) and s[-1] == 3:
                out.append(cost + chat.INSERT * len(tail))
    return min(out)


def conversations():
    rng = random.Random(2)
    names = ["system", "user", "assistant", "tool", None, "Human", " USER "]
    return {c: [rng.choices(names, [1, 4, 4, 1, 1, 1, 1])[0] for _ in range(rng.randint(1, 6))] for c in range(60)}


@pytest.mark.parametrize("cut", [1000, 2])
def test_against_brute_force(spark, cut):
    convs = conversations()
    convs[1000] = ["user"] * 5 + ["assistant", "system", "assistant"]
    convs[None] = ["assistant", "assistant"]
    rows = [(c, t, r, f"text {t}", "x") for c, roles in convs.items() for t, r in enumerate(roles)]
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string"), fragment_turns=cut).collect()
    for c, roles in convs.items():
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: (r.pos, r.part))
        assert sum(r.cost for r in own) == pytest.approx(brute(tuple(chat.role_number(r) for r in roles)))
        assert [r.turn for r in own if r.turn is not None] == list(range(len(roles)))
        messages = [r.role for r in own if "merge" not in r.action]
        assert [m for m in messages if m != "system"] == ["user", "assistant"] * (len([m for m in messages if m != "system"]) // 2)
        assert messages.count("system") <= 1 and (messages[0] == "system" or "system" not in messages)
        whole = "".join(r.rendered for r in own)
        assert whole.count("<|end|>") == len(messages) and whole.endswith(chat.CLOSE)
        for t in range(len(roles)):
            assert f"text {t}" in whole


def first_best(roles):
    """The lexicographically first of all state sequences of least cost, by trying every one."""
    best = None
    for states in itertools.product((1, 2, 3), repeat=len(roles)):
        cost, state = 0.0, chat.START
        for read, to in zip(roles, states):
            cost += chat.STEP[read, state, to]
            state = to
        cost += chat.END_COST[state]
        if best is None or cost < best[0]:
            best = (cost, states)
    return list(best[1])


def test_ties_go_to_the_first_sequence_of_states():
    rng = random.Random(5)
    for _ in range(300):
        roles = [rng.randrange(4) for _ in range(rng.randint(1, 7))]
        want = first_best(roles)
        assert chat.path(roles, chat.START, None) == want
        for cut in (1, 2, 3):
            parts = [roles[i : i + cut] for i in range(0, len(roles), cut)]
            rows = [(k, len(p), *(x.ravel().tolist() for x in chat.transfer(p))) for k, p in enumerate(parts)]
            chain = chat._chain(pa.Table.from_pylist([dict(zip(("frag", "n", "matrix", "place"), r)) for r in rows])).to_pylist()
            assert sum((chat.path(p, c["entry"], c["leave"]) for p, c in zip(parts, chain)), []) == want


def test_equal_output_for_any_number_of_partitions(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd", None]), f"t{t}") for c in range(12) for t in range(rng.choice([1, 5, 60, 300]))]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 7, 50):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            results.append(sorted(map(str, chat.repair(df, fragment_turns=9 * n).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_long_conversation_over_many_partitions(spark):
    rng = random.Random(3)
    roles = [rng.choice(["user", "assistant", "system", "odd"]) for _ in range(9000)]
    rows = [(7, t, r, "x" * rng.randint(0, 30)) for t, r in enumerate(roles)] + [(c, 0, "user", "hi") for c in range(20) if c != 7]
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).collect()
    own = sorted((r for r in got if r.conv_id == 7), key=lambda r: (r.pos, r.part))
    numbers = [chat.role_number(r) for r in roles]
    assert sum(r.cost for r in own) == pytest.approx((chat.transfer(numbers)[0][0] + chat.END_COST).min())
    assert [r.turn for r in own if r.turn is not None] == list(range(9000))
    messages = [r.role for r in own if "merge" not in r.action]
    start = messages[0] == "system"
    assert messages[start:] == ["user", "assistant"] * ((len(messages) - start) // 2)


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.repair(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "user", None), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (2, 5, None, None)]
    got = sorted(chat.repair(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r.conv_id, r.pos, r.part))
    assert [(r.conv_id, r.action, r.role) for r in got] == [(1, "keep", "user"), (1, "keep", "assistant"), (1, "merge", "assistant"), (2, "relabel", "user"), (2, "insert", "assistant")]
    assert "".join(r.rendered for r in got[:3]) == "<|user|>\n\n<|end|>\n<|assistant|>\na\na\n<|end|>\n"
