"""Minimum-cost role repair of conversations, and rendering (operator 4).

Legal conversations: an optional system message, then user and assistant in turn, the last from the assistant. Dynamic
programming over the automaton (nothing yet, system, user, assistant) chooses for each turn, at the least total cost, whether
to keep or relabel it, to merge it into the message before it (of the same role), or to insert an empty message before it.

Execution: turns are range-partitioned by (conversation, turn, role, text), so a conversation of any length spreads over
partitions, and packed in order into fragments of bounded size in the shared folder. A conversation inside one fragment is
solved there. Of the others each fragment gives its 4 x 4 min-plus matrix (cost from entry to exit state) and, for each entry
state, the order of its cheapest paths to the four exits; a chain over these small matrices fixes each fragment's entry and
exit state, and the fragments then trace their own paths.

Ties: of the repairs of least cost a conversation gets the one whose states after each turn come first in lexicographic order
(system, user, assistant). Costs are sums of eighths, so they compare exactly, and the choice does not depend on how a
conversation was cut: the first best path runs, in each fragment, along the first best path between its entry and its exit.

The result has one row for each turn and each inserted message, in the order (conv_id, pos, part); the pieces in ``rendered``
concatenate to the conversation. Its cost is the sum of ``cost``.

Defined cases: a null text is empty; a null conversation id is a conversation of its own; null turns come first; turns with
one number follow in the order of role and text, and repeated rows are turns of their own; unknown or null roles are
relabelled; a text of any length moves whole, alone in its fragment if it is long; empty tables give no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as tk

ROLES = ["", "system", "user", "assistant"]
START, SYSTEM, USER, ASSISTANT = range(4)
#: Other names of roles (fixed values).
ALIASES = {"human": USER, "prompter": USER, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT = 1.0, 2.0
#: Cost of relabelling: from (unknown, system, user, assistant) to (system, user, assistant); sums of these are exact.
RELABEL = {0: (0.875, 0.5, 0.75), SYSTEM: (0.0, 1.0, 2.0), USER: (2.5, 0.0, 1.5), ASSISTANT: (3.0, 1.5, 0.0)}
FRAGMENT_TURNS, FRAGMENT_BYTES = 1000, 4 << 20


def _steps() -> tuple[np.ndarray, dict]:
    """cost[role read, state, state after] and (merged, inserted role) of the cheapest way there."""
    cost = np.full((4, 4, 4), np.inf)
    ways = {}
    for read in range(4):
        for state in range(4):
            for role in (SYSTEM, USER, ASSISTANT):
                base = RELABEL[read][role - 1]
                options = [(base, (False, None))] if role in NEXT[state] else []
                if role == state:
                    options.append((base + MERGE, (True, None)))
                options += [(base + INSERT, (False, x)) for x in NEXT[state] if role in NEXT[x]]
                if options:
                    cost[read, state, role], ways[read, state, role] = min(options, key=lambda o: o[0])
    return cost, ways


STEP, WAY = _steps()
_STEPS = STEP.tolist()
#: Messages to insert at the end, by state, and what they cost.
CLOSING = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
END_COST = np.array([INSERT * len(CLOSING[s]) for s in range(4)])


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES[1:] else ALIASES.get(name, 0)


def to_go(roles: list[int], end: np.ndarray) -> list[np.ndarray]:
    """Before each turn and at the end: the least cost from each state to each goal, given ``end[state, goal]`` at the end."""
    out = [end]
    for r in reversed(roles):
        out.append((STEP[r][:, :, None] + out[-1][None]).min(axis=1))
    return out[::-1]


_SAME = np.where(np.eye(4, dtype=bool), 0.0, np.inf)


def transfer(roles: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Least cost from each entry state to each exit state over the turns, and the place of each exit's first cheapest path
    among those of one entry state in lexicographic order."""
    left = to_go(roles, _SAME)
    state, place = np.repeat(np.arange(4)[:, None], 4, axis=1), np.zeros((4, 4), dtype=np.int64)
    goal = np.arange(4)[None, :]
    for t, r in enumerate(roles):
        after = (STEP[r][state] + left[t + 1].T[None] == left[t][state, goal][:, :, None]).argmax(axis=2)
        key = place * 4 + after
        place = (key[:, None, :] < key[:, :, None]).sum(axis=2)
        state = after
    return left[0], place


def path(roles: list[int], entry: int, leave: int | None) -> list[int]:
    """States after each turn on the first cheapest path; ``leave`` None: the conversation ends here."""
    end = END_COST if leave is None else _SAME[leave]
    left = [x[:, 0].tolist() for x in to_go(roles, end[:, None])]
    state, out = entry, []
    for t, r in enumerate(roles):
        step, after = _STEPS[r][state], left[t + 1]
        state = next(s for s in (SYSTEM, USER, ASSISTANT) if step[s] + after[s] == left[t][state])
        out.append(state)
    return out


_PACKED = "conv_id long, conv_null boolean, frag long, n long, inside boolean, matrix array<double>, place array<int>, payload binary"
_PACKED_SCHEMA = pa.schema([("conv_id", pa.int64()), ("conv_null", pa.bool_()), ("frag", pa.int64()), ("n", pa.int64()), ("inside", pa.bool_()), ("matrix", pa.list_(pa.float64())), ("place", pa.list_(pa.int32())), ("payload", pa.binary())])


def _pack(fragment_turns: int):
    """Fragments of sorted turns; ``inside`` marks those that surely hold a whole conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []  # turns of one conversation
        conv, first, turns, size = None, True, 0, 0
        ready: list[tuple] = []

        def close(inside: bool):
            nonlocal seq, held, turns, size
            rows = pa.Table.from_batches(held).select(["turn", "role", "text"]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(rows)
            matrix, place = (None, None) if inside else (x.ravel().tolist() for x in transfer([role_number(r) for r in rows.column("role").to_pylist()]))
            ready.append((conv, conv is None, part << 32 | seq, rows.num_rows, inside, matrix, place, sink.getvalue().to_pybytes()))
            seq, held, turns, size = seq + 1, [], 0, 0

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in ready], f.type) for k, f in enumerate(_PACKED_SCHEMA)], schema=_PACKED_SCHEMA)
            ready.clear()
            return out

        whole = False  # the conversation began in this partition, and has not been cut
        for batch in batches:
            ids = batch.column("conv_id").to_pylist()
            lo = 0
            while lo < len(ids):
                hi = lo
                while hi < len(ids) and ids[hi] == ids[lo] and hi - lo < fragment_turns:
                    hi += 1
                if not first and ids[lo] != conv:
                    if held:
                        close(whole)
                    whole = True
                elif not first and held and (turns + hi - lo > fragment_turns or size > FRAGMENT_BYTES):
                    close(False)
                    whole = False
                conv, first = ids[lo], False
                held.append(batch.slice(lo, hi - lo))
                turns += hi - lo
                size += held[-1].nbytes
                lo = hi
                if len(ready) >= 512:
                    yield flush()
        if held:
            close(False)
        if ready:
            yield flush()

    return run


_CHAIN = "frag long, entry int, leave int, last boolean, offset long"
_CHAIN_SCHEMA = pa.schema([("frag", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()), ("offset", pa.int64())])


def _chain(table: pa.Table) -> pa.Table:
    """Entry and exit states of a conversation's fragments on the first cheapest path (about 200 bytes a fragment)."""
    table = table.sort_by("frag")
    n = table.column("n").to_pylist()
    matrices = [np.array(m.as_py()).reshape(4, 4) for m in table.column("matrix")]
    places = [np.array(p.as_py()).reshape(4, 4) for p in table.column("place")]
    left = [END_COST]
    for m in reversed(matrices):
        left.append((m + left[-1][None]).min(axis=1))
    left.reverse()
    state, entry, leave = START, [], []
    for k, (m, place) in enumerate(zip(matrices, places)):
        entry.append(state)
        best = m[state] + left[k + 1] == left[k][state]
        state = int(np.where(best, place[state], 4).argmin())
        leave.append(state)
    offsets = np.concatenate([[0], np.cumsum(n)[:-1]])
    return pa.Table.from_arrays([table.column("frag"), pa.array(entry, pa.int32()), pa.array(leave, pa.int32()), pa.array([k == len(n) - 1 for k in range(len(n))]), pa.array(offsets, pa.int64())], schema=_CHAIN_SCHEMA)


RESULT = "conv_id long, pos long, part int, turn long, action string, role string, text string, cost double, rendered string"
_RESULT_SCHEMA = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("part", pa.int32()), ("turn", pa.int64()), ("action", pa.string()), ("role", pa.string()), ("text", pa.string()), ("cost", pa.float64()), ("rendered", pa.string())])
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for conv, entry, leave, last, offset, payload in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "entry", "leave", "last", "offset", "payload"))):
            rows = pa.ipc.open_stream(payload).read_all()
            state, out = entry, []
            roles = [role_number(r) for r in rows.column("role").to_pylist()]

            def message(pos, part, turn, action, role, text, cost, fresh):
                nonlocal state
                lead = (CLOSE if state != START else "") + OPEN.format(ROLES[role]) if fresh else "\n"
                out.append([conv, pos, part, turn, action, ROLES[role], text, cost, lead + text])
                state = role

            for k, (read, to, turn, text) in enumerate(zip(roles, path(roles, entry, leave), rows.column("turn").to_pylist(), rows.column("text").to_pylist())):
                merged, inserted = WAY[read, state, to]
                if inserted is not None:
                    message(offset + k, 0, None, "insert", inserted, "", INSERT, True)
                action = "+".join(a for a, on in (("relabel", read != to), ("merge", merged)) if on) or "keep"
                message(offset + k, 1, turn, action, to, text or "", RELABEL[read][to - 1] + MERGE * merged, not merged)
            if last:
                for k, role in enumerate(CLOSING[state]):
                    message(offset + len(roles) - 1, 2 + k, None, "insert", role, "", INSERT, True)
                out[-1][8] += CLOSE
            for lo in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out[lo : lo + 4096]], f.type) for i, f in enumerate(_RESULT_SCHEMA)], schema=_RESULT_SCHEMA)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", fragment_turns: int = FRAGMENT_TURNS) -> DataFrame:
    """(conv_id, pos, part, turn, action, role, text, cost, rendered); see the module's notes."""
    spark = turns.sparkSession
    rows = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    packed = common.stored(rows.repartitionByRange(common.tasks(spark), *keys).sortWithinPartitions(*keys).mapInArrow(tk.lean(_pack(fragment_turns)), _PACKED), name="chat")
    cut = packed.filter("not inside").select("conv_id", "conv_null", "frag", "n", "matrix", "place")
    chain = cut.groupBy("conv_id", "conv_null").applyInArrow(_chain, _CHAIN)
    none = F.lit(None)
    solved = packed.filter("inside").select("conv_id", "payload", F.lit(START).alias("entry"), none.cast("int").alias("leave"), F.lit(True).alias("last"), F.lit(0).cast("long").alias("offset"))
    linked = packed.filter("not inside").join(chain, "frag").select("conv_id", "payload", "entry", "leave", "last", "offset")
    return solved.unionByName(linked).mapInArrow(tk.lean(_render), RESULT)
