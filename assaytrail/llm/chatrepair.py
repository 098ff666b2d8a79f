"""Chat formatting with repair of roles at least cost.

Legal conversations are paths of a small automaton: an optional system turn, then user and assistant in turn, ending with the
assistant. A conversation that is none is repaired by dynamic programming over the automaton. For each turn the repair may keep
its role or relabel it, join it to the turn before (same label), and insert one empty turn before it; at the end it may insert
an empty assistant turn. Costs are whole numbers, so the least cost is exact; among equal costs the first choice in the order
of :data:`CHOICES` by turn wins.

The result is one row per input turn with the piece of text it contributes; pieces of a conversation joined in order are its
rendered text. So a conversation of any length is never gathered in one value.

Turns are sorted over the whole table by ranges and written to the shared folder once. A turn's effect on the cost of the automaton's
states is a small matrix, and matrices of a stretch of turns multiply (minimum of sums). Where a conversation crosses from one
partition into the next, a first pass computes the product of each stretch; the driver gets one row per partition and such stretch
(a few dozen numbers, at most two a partition) and finds the states at the borders. A second pass repairs each stretch between
known states. A conversation with a third of all rows is repaired by as many tasks as hold its rows.

Cases: a null or unknown role can be relabelled to any; a null text is empty; turns with equal or null numbers are ordered by role
and text; repeated rows are turns of their own; a null conv_id is one conversation; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaytrail.llm.common import stored

SYSTEM, USER, ASSISTANT = range(3)
ROLES = ["system", "user", "assistant"]
#: Other names of roles.
ALIASES = {"human": USER, "prompter": USER, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
#: Automaton states: the start, and one for the label of the last turn.
START, STATES = 3, 4
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
JOIN, RELABEL, INSERT = 2, 3, 4
FAR = 1 << 40

HEAD, TAIL = "<|{}|>\n", "<|end|>\n"


def _choices() -> list[tuple[int, int, int, int | None, bool]]:
    """(from, to, extra cost, inserted label, joined?) of every way to add a turn with label ``to``, in order of preference."""
    out = []
    for s in range(STATES):
        for label in range(3):
            if s == label:
                out.append((s, label, JOIN, None, True))
            if label in NEXT[s]:
                out.append((s, label, 0, None, False))
            out += [(s, label, INSERT, x, False) for x in NEXT[s] if label in NEXT[x]]
    return sorted(out, key=lambda c: (c[4], c[3] is not None, c[0], c[1]))


CHOICES = _choices()
#: Cost of ending in each state, and the label inserted for that.
END_COST = [FAR, INSERT, 0, 0]
END_INSERT = {USER: ASSISTANT}


def role_of(name: str | None) -> int | None:
    name = (name or "").strip().lower()
    return ROLES.index(name) if name in ROLES else ALIASES.get(name)


def turn_matrices() -> np.ndarray:
    """[role, from, to]: least cost of a turn between states; the last role stands for unknown names."""
    out = np.full((4, STATES, STATES), FAR, np.int64)
    for role in range(4):
        for s, label, cost, _, _ in CHOICES:
            out[role, s, label] = min(out[role, s, label], cost + (0 if label == role else RELABEL))
    return out


MATRICES = turn_matrices()


def product(roles: list[int]) -> np.ndarray:
    """Least costs between states over a stretch of turns."""
    total = np.where(np.eye(STATES, dtype=bool), 0, FAR)
    for r in roles:
        total = np.minimum((total[:, :, None] + MATRICES[r][None]).min(1), FAR)
    return total


def repair(roles: list[int], start: int = START, end: int | None = None) -> tuple[list[tuple], int]:
    """(choices, cost) of least cost from a state on; ``end``: the last state, None for a conversation's end."""
    cost, back = [0 if s == start else FAR for s in range(STATES)], []
    for r in roles:
        now, by = [FAR] * STATES, [None] * STATES
        for choice in CHOICES:
            s, label, extra, _, _ = choice
            c = cost[s] + extra + (0 if label == r else RELABEL)
            if c < now[label]:
                now[label], by[label] = c, choice
        cost = now
        back.append(by)
    if end is None:
        totals = [c + e for c, e in zip(cost, END_COST)]
        end = min(range(STATES), key=lambda s: (totals[s], s))
        best = totals[end]
    else:
        best = cost[end]
    picked, state = [], end
    for by in reversed(back):
        picked.append(by[state])
        state = by[state][0]
    return picked[::-1], best


class _Stretches:
    """Consecutive turns of one conversation in a sorted partition."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches = batches

    def __iter__(self) -> Iterator[tuple[int | None, list[dict]]]:
        conv, rows, begun = None, [], False
        for batch in self.batches:
            for row in batch.to_pylist():
                if begun and row["conv_id"] != conv:
                    yield conv, rows
                    rows = []
                conv, begun = row["conv_id"], True
                rows.append(row)
        if begun:
            yield conv, rows


def _roles(rows: list[dict]) -> list[int]:
    return [3 if (r := role_of(row["role"])) is None else r for row in rows]


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last stretch of a partition: (conv_id, order, turns, costs between states)."""
    ends: list[tuple] = []
    for conv, rows in _Stretches(batches):
        del ends[1:]
        ends.append((conv, rows[0]["_part"], len(rows), product(_roles(rows)).reshape(-1).tolist()))
    if ends:
        yield pa.RecordBatch.from_pydict({
            "conv_id": pa.array([e[0] for e in ends], pa.int64()), "part": pa.array([e[1] for e in ends], pa.int64()),
            "place": pa.array(list(range(len(ends))), pa.int64()), "costs": pa.array([e[3] for e in ends], pa.list_(pa.int64()))})


def border_states(rows: list[tuple]) -> dict[tuple[int | None, int], tuple[int, int | None, int]]:
    """(state before, state after or None at the conversation's end, whole cost) of each stretch, by (conv_id, part), of those
    conversations that have several. ``rows``: (conv_id, part, costs) in order."""
    groups: dict = {}
    for conv, part, costs in rows:
        groups.setdefault(conv, []).append((part, np.array(costs).reshape(STATES, STATES)))
    out = {}
    for conv, pieces in groups.items():
        if len(pieces) < 2:
            continue
        cost, back = np.where(np.arange(STATES) == START, 0, FAR), []
        for _, m in pieces:
            total = cost[:, None] + m
            back.append(total.argmin(0))
            cost = np.minimum(total.min(0), FAR)
        state = int((cost + np.array(END_COST)).argmin())
        whole, after = int((cost + np.array(END_COST)).min()), None
        for (part, _), by in zip(pieces[::-1], back[::-1]):
            out[conv, part] = (int(by[state]), after if after is None else state, whole)
            state, after = int(by[state]), True
    return out


def _render(states: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, rows in _Stretches(batches):
            roles = _roles(rows)
            start, end, whole = states.get((conv, rows[0]["_part"]), (START, None, None))
            choices, cost = repair(roles, start, end)
            for row, role, (s, label, _, inserted, joined) in zip(rows, roles, choices):
                piece = ("" if joined or s == START else TAIL)
                if inserted is not None:
                    piece += HEAD.format(ROLES[inserted]) + TAIL
                piece += ("\n" if joined else HEAD.format(ROLES[label])) + (row["text"] or "")
                action = "+".join(a for a, on in (("insert", inserted is not None), ("join", joined), ("relabel", label != role)) if on) or "keep"
                out.append([conv, row["turn"], row["_order"], row["role"], ROLES[label], action,
                            None if inserted is None else ROLES[inserted], None, piece, cost if whole is None else whole])
            if end is None:
                last = choices[-1][1]
                out[-1][7] = ROLES[END_INSERT[last]] if last in END_INSERT else None
                out[-1][8] += TAIL + (HEAD.format(out[-1][7]) + TAIL if out[-1][7] else "")
            if len(out) >= 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)
    return run


_FIELDS = (("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("new_role", pa.string()),
           ("action", pa.string()), ("inserted_before", pa.string()), ("inserted_after", pa.string()), ("piece", pa.string()), ("cost", pa.int64()))


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], [n for n, _ in _FIELDS])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.repeat(pa.scalar(part, pa.int64()), n),
                                          pa.array((part << 40) + np.arange(at, at + n))], [*batch.schema.names, "_part", "_order"])
        at += n


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, position (order over the whole table), role, new_role, action, inserted_before,
    inserted_after, piece (its part of the rendered text) and cost (of the whole conversation)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    keys = ["conv_id", "turn", "role", "text"]
    ordered = (rows.repartitionByRange("conv_id", "turn", F.xxhash64("role", "text")).sortWithinPartitions("conv_id", "turn", F.xxhash64("role", "text"), *keys[2:])
               .mapInArrow(_numbered, "conv_id long, turn long, role string, text string, _part long, _order long"))
    pieces = stored(ordered, "turns")
    # a stored partition can be cut into several tasks when it is read, so it is brought together by its number again
    parts = pieces.repartition("_part").sortWithinPartitions("_order")
    crossing = parts.select("conv_id", "role", "_part", "_order").mapInArrow(
        _by_part(_borders), "conv_id long, part long, place long, costs array<long>").collect()
    states = border_states([(r.conv_id, r.part, r.costs) for r in sorted(crossing, key=lambda r: (r.part, r.place))])
    return parts.mapInArrow(_by_part(_render(states)), "conv_id long, turn long, position long, role string, new_role string, action string, "
                            "inserted_before string, inserted_after string, piece string, cost long")


def _by_part(each):
    """Runs ``each`` on the rows of every stored partition apart, as a task may hold several."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            parts = batch.column("_part").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(parts)) + 1, len(parts)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if held and held[-1].column("_part")[0].as_py() != parts[a]:
                    yield from each(iter(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from each(iter(held))
    return run
