"""Chat formatting with minimum-cost role repair.

A conversation is legal if it has an optional system turn, then user and assistant turns in alternation that start with
the user. Every turn is kept, relabelled to another role or merged into the turn before; between two turns a missing turn
may be inserted empty. Dynamic programming over the automaton of legal turns finds the cheapest repair.

The state after a turn is the role of the last rendered turn (or none). One turn is a matrix of costs from state to state;
matrices compose by (min, +), which is associative. Rows are range-partitioned by conversation and turn, every partition
multiplies the matrices of its stretch of each conversation, and the states at the borders of the stretches follow from
these few small matrices. A second pass then chooses inside each stretch. So a conversation of any length, even one with a
third of all rows, is spread over tasks and never gathered.

The result has one row per turn, whose ``rendered`` texts, in order, are the formatted conversation. Defined cases: null
and unknown roles are relabelled at the price of a relabel; null and empty texts render empty; turns that tie on their
number are ordered by role, then text; equal costs prefer keeping, then merging, then relabelling, and among those the
role that comes first; null conversation ids form one conversation; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from grantloom.llm.common import small_batches, stored, table

# Roles, and the template of a turn.
ROLES = ("system", "user", "assistant")
OPEN, CLOSE, JOINT = "<|im_start|>{role}\n", "<|im_end|>\n", "\n\n"
#: Prices. Inserting is dearer than merging, relabelling dearer than both together, so that labels are trusted.
RELABEL, MERGE, INSERT = 4, 2, 3
#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, FAR = 4, 1 << 40
#: What may follow each state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


@lru_cache(maxsize=16)
def choices(role: str | None) -> dict[tuple[int, int], tuple[int, int, str, tuple[int, ...]]]:
    """For each (state before, state after) the cheapest way to take a turn: cost, preference, action, inserted roles."""
    own = ROLES.index(role) + 1 if role in ROLES else None
    found: dict[tuple[int, int], tuple[int, int, str, tuple[int, ...]]] = {}
    for before in range(STATES):
        for after in (SYSTEM, USER, ASSISTANT):
            label = 0 if after == own else RELABEL
            name = "keep" if after == own else "relabel"
            ways = []
            if after == before:
                ways.append((MERGE + label, 1 if not label else 3, "merge", ()))
            if after in LEGAL[before]:
                ways.append((label, 0 if not label else 2, name, ()))
            for middle in LEGAL[before]:  # one empty turn makes any turn legal, except a late system turn
                if after in LEGAL[middle]:
                    ways.append((INSERT + label, 0 if not label else 2, name, (middle,)))
                for second in LEGAL[middle]:
                    if after in LEGAL[second]:
                        ways.append((2 * INSERT + label, 0 if not label else 2, name, (middle, second)))
            if ways:
                found[before, after] = min(ways, key=lambda w: (w[0], w[1], w[3]))
    return found


@lru_cache(maxsize=16)
def matrix(role: str | None) -> np.ndarray:
    costs = np.full((STATES, STATES), FAR, dtype=np.int64)
    for (before, after), way in choices(role).items():
        costs[before, after] = way[0]
    return costs


def product(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.minimum((one[:, :, None] + other[None, :, :]).min(axis=1), FAR)


def best_path(roles: list[str | None], entry: int, leave: int | None) -> list[int]:
    """The cheapest states after each turn from ``entry``, ending in ``leave`` if given."""
    costs = [np.where(np.arange(STATES) == entry, 0, FAR)]
    for role in roles:
        costs.append(np.minimum((costs[-1][:, None] + matrix(role)).min(axis=0), FAR))
    state = int(costs[-1].argmin()) if leave is None else leave
    path = [state]
    for k in range(len(roles) - 1, 0, -1):
        into = costs[k] + matrix(roles[k])[:, path[-1]]
        tied = np.flatnonzero(into == into.min())
        state = min(tied.tolist(), key=lambda s: (choices(roles[k])[s, path[-1]][1], s))
        path.append(state)
    return path[::-1] if roles else []


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Consecutive rows of one conversation within a partition, in pieces that end at most one batch later."""
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][0] != rows[start][0]:
                yield rows[start][0], rows[start:i]
                start = i


PIECE = "part int, piece int, conv_id {kind}, costs array<bigint>"
TURN = "conv_id {kind}, turn bigint, role string, action string, new_role string, inserted array<string>, rendered string"


def repaired(turns: DataFrame) -> DataFrame:
    """One row per turn of ``conv_id, turn, role, text`` with its repair and its rendered text, in turn order."""
    spark = turns.sparkSession
    small_batches(spark)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.repartitionByRange("conv_id", "turn", F.xxhash64("text")).sortWithinPartitions("conv_id", "turn", "role", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (conv, own) in enumerate(_stretches(batches)):
            costs = matrix(own[0][2])
            for row in own[1:]:
                costs = product(costs, matrix(row[2]))
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([conv], batch_kind)]
            columns += [pa.array([costs.reshape(-1).tolist()], pa.list_(pa.int64()))]
            columns += [pa.array([[r[i] for r in own]], pa.list_(t)) for i, t in ((1, pa.int64()), (2, pa.string()), (3, pa.string()))]
            yield pa.record_batch(columns, names=["part", "piece", "conv_id", "costs", "turns", "roles", "texts"])

    batch_kind = to_arrow_type(rows.schema["conv_id"].dataType)
    pieces = stored(
        rows.mapInArrow(cut, PIECE.format(kind=kind) + ", turns array<bigint>, roles array<string>, texts array<string>"), "chat-pieces"
    )
    # Conversations in one piece start at START and may end anywhere; of the others only the small matrices are gathered.
    several = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1").select("conv_id")
    small = pieces.select("part", "piece", "conv_id", "costs")
    split = small.join(several, small["conv_id"].eqNullSafe(several["conv_id"]), "left_semi")

    def border(group: pa.Table) -> pa.Table:
        own = sorted(group.to_pylist(), key=lambda r: (r["part"], r["piece"]))
        steps = [np.array(r["costs"]).reshape(STATES, STATES) for r in own]
        reach = [np.where(np.arange(STATES) == START, 0, FAR)]
        for step in steps:
            reach.append(np.minimum((reach[-1][:, None] + step).min(axis=0), FAR))
        leave = [int(reach[-1].argmin())]
        for k in range(len(steps) - 1, 0, -1):
            leave.append(int((reach[k] + steps[k][:, leave[-1]]).argmin()))
        leave.reverse()
        entry = [START, *leave[:-1]]
        last = [False] * (len(own) - 1) + [True]
        return pa.table(
            [pa.array([r["part"] for r in own], pa.int32()), pa.array([r["piece"] for r in own], pa.int32()), pa.array(entry, pa.int32()),
             pa.array(leave, pa.int32()), pa.array(last, pa.bool_())],
            names=["part", "piece", "entry", "leave", "last"],
        )

    borders = split.groupBy("conv_id").applyInArrow(border, "part int, piece int, entry int, leave int, last boolean")
    # A turn is closed where the next one opens (or at the end), so a piece needs nothing of the piece after it.
    placed = pieces.join(borders, ["part", "piece"], "left")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                roles, entry = row["roles"], row["entry"] if row["entry"] is not None else START
                path = best_path(roles, entry, row["leave"])
                out, before = [], entry
                for k, (role, state) in enumerate(zip(roles, path, strict=True)):
                    _, _, action, inserted = choices(role)[before, state]
                    text, name = row["texts"][k] or "", ROLES[state - 1]
                    if action == "merge":
                        shown = JOINT + text
                    else:
                        shown = CLOSE if before != START else ""
                        shown += "".join(OPEN.format(role=ROLES[i - 1]) + CLOSE for i in inserted) + OPEN.format(role=name) + text
                    if k == len(roles) - 1 and row["last"] in (True, None):
                        shown += CLOSE
                    out.append((row["conv_id"], row["turns"][k], role, action, name, [ROLES[i - 1] for i in inserted], shown))
                    before = state
                kinds = (batch_kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
                yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in TURN.split(", ")])

    return placed.select("conv_id", "turns", "roles", "texts", "entry", "leave", "last").mapInArrow(render, TURN.format(kind=kind))


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired and rendered turns of every conversation."""
    return repaired(table(spark, sf_dir, "conversations"))
