"""Chat rendering with minimum-cost repair of turn roles.

A conversation is legal if it is an optional system turn, then user and assistant in turn,
beginning with user. Each turn may be relabelled, merged into the turn before it, or
preceded by one empty turn, each at a cost; a dynamic program over the states of the automaton
(nothing yet, or the role of the last turn) finds the cheapest legal sequence. What a turn does to the
states is a 4x4 matrix of costs, and a stretch of turns is the min-plus product of its
matrices. So long conversations are cut into chunks of bounded size: chunks are summed up in
parallel, the states at their borders are chosen over the few sums, and each chunk then
repairs its own turns between the states given.

Turns are ordered by turn, then role and a hash of the text; equal rows come in any order. A turn number that is
null comes first. Ties in cost are broken by the order keep, merge, insert, then by the order of ROLES.
Cases: null text is empty; null and unknown roles are assigned the cheapest role;
names such as "human" or "gpt" count as the role they mean. Rows with a null conv_id are
one conversation. A conversation cannot end with a system turn: it is relabelled or followed by an empty
user turn, whichever costs less.
Texts cannot forge turns: "<|" in a text is written as "<||" (see `escaped`), so every control token in a rendering is one that
the repair put there.
Each input row gives one output row, so a conversation of any length needs no single row or task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import stored

ROLES = ("system", "user", "assistant")
ALIASES = {
    "system": ("system", "developer", "instruction"),
    "user": ("user", "human", "prompter", "customer"),
    "assistant": ("assistant", "gpt", "bot", "model", "ai", "chatbot"),
}
MERGE, RELABEL, ASSIGN, INSERT = 1, 2, 1, 3
# states: nothing yet, then the role of the last turn
START, STATES = 0, 4
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
# a conversation may end with these roles; after system an empty user turn is added
END_COST = np.array([0, INSERT, 0, 0], float)
# turns per chunk
CHUNK = 4096
UNKNOWN = 3

HEADER, END, GLUE = "<|{role}|>\n", "<|end|>\n", "\n\n"


@cache
def steps(role: int) -> tuple[np.ndarray, dict[tuple[int, int], tuple[str, int | None]]]:
    """The cost matrix of a turn (UNKNOWN or an index of ROLES), and per move the action and an inserted role."""
    costs = np.full((STATES, STATES), np.inf)
    chosen: dict[tuple[int, int], tuple[str, int | None]] = {}
    for before in range(STATES):
        for new in range(1, STATES):
            label = ASSIGN if role == UNKNOWN else 0 if new - 1 == role else RELABEL
            options = [(0, "keep", None)] if new in NEXT[before] else []
            options += [(MERGE, "merge", None)] if new == before else []
            options += [(INSERT, "insert", x) for x in NEXT[before] if new in NEXT[x]]
            if options:
                cost, action, inserted = min(options, key=lambda o: o[0])
                costs[before, new] = label + cost
                chosen[before, new] = (action, inserted)
    return costs, chosen


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of two stretches, one after the other."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def stretch(roles: Iterable[int]) -> np.ndarray:
    total = np.where(np.eye(STATES, dtype=bool), 0.0, np.inf)
    for role in roles:
        total = product(total, steps(role)[0])
    return total


def path_through(matrices: list[np.ndarray], entry: int, end: np.ndarray) -> list[int]:
    """States between stretches on the cheapest way from `entry`, `end` being the cost of each last state."""
    best = [end]
    for matrix in reversed(matrices):
        best.append((matrix + best[-1][None, :]).min(axis=1))
    best.reverse()
    states = [entry]
    for i, matrix in enumerate(matrices):
        states.append(int(np.argmin(matrix[states[-1]] + best[i + 1])))
    return states


def repaired(roles: list[int], entry: int, leave: int) -> list[tuple[int, str, int | None, float]]:
    """(new role, action, inserted role, cost) per turn of a stretch between two states."""
    end = np.full(STATES, np.inf)
    end[leave] = 0
    states = path_through([steps(r)[0] for r in roles], entry, end)
    out = []
    for role, before, new in zip(roles, states, states[1:], strict=False):
        costs, chosen = steps(role)
        out.append((new - 1, *chosen[before, new], float(costs[before, new])))
    return out


def escaped(text: str) -> str:
    """A text in which nothing reads as a control token; `unescaped` gives it back."""
    return text.replace("<|", "<||")


def unescaped(text: str) -> str:
    return text.replace("<||", "<|")


def role_code(role: Column) -> Column:
    bare = F.lower(F.trim(role))
    code = F.lit(UNKNOWN)
    for i, name in enumerate(ROLES):
        code = F.when(bare.isin(*ALIASES[name]), F.lit(i)).otherwise(code)
    return code.cast("int")


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[dict]]:
    """Rows of sorted batches, by the first `keys` columns."""
    held: list[dict] = []
    last = None
    for batch in batches:
        names = batch.schema.names[:keys]
        for row in batch.to_pylist():
            key = [row[n] for n in names]
            if held and key != last:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _many(_groups(batches, 2)):
        costs = [stretch(r["code"] for r in group).ravel().tolist() for group in batch]
        yield pa.RecordBatch.from_arrays(
            [pa.array([g[0]["conv"] for g in batch], pa.string()), pa.array([g[0]["chunk"] for g in batch], pa.int64()), pa.array(costs, pa.list_(pa.float64()))],
            names=["conv", "chunk", "costs"],
        )


def _many(groups: Iterator[list[dict]], size: int = 256) -> Iterator[list[list[dict]]]:
    held = []
    for group in groups:
        held.append(group)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _many(_groups(batches, 1)):
        rows = []
        for group in batch:
            states = path_through([np.array(r["costs"]).reshape(STATES, STATES) for r in group], START, END_COST)
            rows += [(r["conv"], r["chunk"], states[i], states[i + 1], i == len(group) - 1) for i, r in enumerate(group)]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        arrays = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv", "chunk", "entry", "leave", "last"])


def _rendered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _many(_groups(batches, 2)):
        rows = []
        for group in batch:
            fixed = repaired([r["code"] for r in group], group[0]["entry"], group[0]["leave"])
            first = group[0]["entry"] == START
            for i, (row, (new, action, inserted, cost)) in enumerate(zip(group, fixed, strict=True)):
                text = escaped(row["text"] or "")
                if action == "merge":
                    piece = GLUE + text if text else ""
                else:
                    piece = "" if first and i == 0 else END
                    if inserted is not None:
                        piece += HEADER.format(role=ROLES[inserted - 1]) + END
                    piece += HEADER.format(role=ROLES[new]) + text
                if row["last"] and i == len(group) - 1:
                    piece += END
                    if new == 0:
                        cost += INSERT
                        piece += HEADER.format(role="user") + END
                rows.append((row["conv_id"], row["turn"], row["place"], row["role"], ROLES[new], action, ROLES[inserted - 1] if inserted else None, cost, piece))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string())
        arrays = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "place", "role", "new_role", "action", "inserted", "cost", "piece"])


def repair_chats(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per turn: new_role, action, inserted role, cost and rendered piece.

    The pieces of a conversation by `place` make up its rendering.
    """
    chosen = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.col("role").cast("string"),
        F.col("text").cast("string"),
    ).withColumn("salt", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", F.xxhash64("text"), "salt"]
    # a place grows along each conversation, and a chunk of places lies in one partition
    placed = chosen.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("place", F.monotonically_increasing_id()).drop("salt"), "chat-turns")
    placed = placed.withColumn("chunk", F.floor(F.col("place") / F.lit(chunk)).cast("bigint")).withColumn("code", role_code(F.col("role")))
    summed = (
        placed.select("conv", "chunk", "place", "code")
        .repartition("chunk")
        .sortWithinPartitions("chunk", "place")
        .select("conv", "chunk", "code")
        .mapInArrow(_summed, "conv string, chunk long, costs array<double>")
    )
    borders = stored(
        stored(summed, "chat-sums").repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_borders, "conv string, chunk long, entry int, leave int, last boolean"),
        "chat-borders",
    )
    ready = (
        placed.join(borders.hint("merge"), ["conv", "chunk"])
        .select("conv", "chunk", "place", "conv_id", "turn", "role", "text", "code", "entry", "leave", "last")
        .repartition("chunk")
        .sortWithinPartitions("chunk", "place")
    )
    return ready.mapInArrow(
        _rendered, "conv_id long, turn long, place long, role string, new_role string, action string, inserted string, cost double, piece string"
    )
