"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn and then user and assistant turns in turn. Dynamic programming over the automaton
of legal turns gives every turn a role at the least total cost: a turn can be kept, merged into the turn before it, given
another role, or preceded by an inserted empty turn. The repaired sequence is then rendered.

A conversation of any length is dealt to many tasks: all turns are range-partitioned in order, so a conversation is a row of pieces.
The costs between the states at both ends of a piece form a matrix, matrices of a conversation's pieces are chained (one row a piece),
and each piece then finds its own turns' roles from the costs at its start and the state at its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import runs, store

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
ENDS = (USER, ASSISTANT)
MERGE, RELABEL, INSERT = 1, 2, 3  # costs
FAR = 1 << 40
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _steps() -> tuple[np.ndarray, list[list[str | None]], list[list[int]]]:
    """Cost between states without relabelling, what is done, and the state inserted."""
    cost = np.full((4, 4), FAR, np.int64)
    done: list[list[str | None]] = [[None] * 4 for _ in range(4)]
    extra = [[START] * 4 for _ in range(4)]
    for s in range(4):
        for o in (SYSTEM, USER, ASSISTANT):
            if (s, o) in NEXT:
                cost[s, o], done[s][o] = 0, "append"
            elif s == o:
                cost[s, o], done[s][o] = MERGE, "merge"
            else:
                through = [x for x in (SYSTEM, USER, ASSISTANT) if (s, x) in NEXT and (x, o) in NEXT]
                if through:
                    cost[s, o], done[s][o], extra[s][o] = INSERT, "insert", through[0]
    return cost, done, extra


STEP, DONE, EXTRA = _steps()
#: By the role given (0 for an unknown one): cost between states.
COST = np.stack([STEP + np.array([0, *(0 if r == o else RELABEL for o in (1, 2, 3))]) for r in range(4)])


def _codes(column) -> list[int]:
    return [ROLES.index(r) + 1 if r in ROLES else 0 for r in column.to_pylist()]


def forward(start: np.ndarray, codes: list[int]) -> np.ndarray:
    """Least costs of each state before the first and after every turn."""
    out = np.empty((len(codes) + 1, 4), np.int64)
    out[0] = start
    for i, r in enumerate(codes):
        out[i + 1] = np.minimum((out[i][:, None] + COST[r]).min(axis=0), FAR)
    return out


def backward(costs: np.ndarray, codes: list[int], state: int) -> list[int]:
    """States before the first and after every turn on the cheapest way to ``state``; of equal ones the first state."""
    path = [state]
    for i in range(len(codes) - 1, -1, -1):
        path.append(int(np.flatnonzero(costs[i] + COST[codes[i]][:, path[-1]] == costs[i + 1][path[-1]])[0]))
    return path[::-1]


def _matrix(group: pa.Table) -> dict:
    codes = _codes(group.column("role"))
    start = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(start, 0)
    return {"m": np.stack([forward(s, codes)[-1] for s in start]).reshape(-1).tolist()}


def _maps(group: pa.Table) -> dict:
    codes = _codes(group.column("role"))
    costs = forward(np.array(group.column("entry")[0].as_py()), codes)
    return {"back": [backward(costs, codes, s)[0] if costs[-1][s] < FAR else -1 for s in range(4)]}


def _first(group: pa.Table) -> Iterator[dict]:
    """Costs of the states at the start of each piece of a conversation."""
    costs = np.array([0, FAR, FAR, FAR], np.int64)
    for m in group.column("m").to_pylist():
        yield {"entry": costs.tolist()}
        costs = np.minimum((costs[:, None] + np.array(m).reshape(4, 4)).min(axis=0), FAR)


def _last(group: pa.Table) -> Iterator[dict]:
    """The state at the end of each piece, and whether the conversation ends there."""
    final = np.array(group.column("entry")[-1].as_py())
    costs = np.minimum((final[:, None] + np.array(group.column("m")[-1].as_py()).reshape(4, 4)).min(axis=0), FAR)
    state = min(ENDS, key=lambda s: (costs[s], s)) if min(costs[s] for s in ENDS) < FAR else int(costs.argmin())
    out = []
    backs = group.column("back").to_pylist()
    for i in range(len(backs) - 1, -1, -1):
        out.append({"state": state, "ends": i == len(backs) - 1})
        state = backs[i][state]
    yield from reversed(out)


def _render(group: pa.Table) -> Iterator[dict]:
    codes = _codes(group.column("role"))
    texts = group.column("text").to_pylist()
    costs = forward(np.array(group.column("entry")[0].as_py()), codes)
    path = backward(costs, codes, group.column("state")[0].as_py())
    ends = group.column("ends")[0].as_py()
    for i, r in enumerate(codes):
        s, o = path[i], path[i + 1]
        done, extra = DONE[s][o], EXTRA[s][o]
        before = "" if s == START else "\n" if done == "merge" else CLOSE
        if done == "insert":
            before += f"{OPEN}{ROLES[extra - 1]}\n{CLOSE}"
        if done != "merge":
            before += f"{OPEN}{ROLES[o - 1]}\n"
        after = CLOSE if ends and i == len(codes) - 1 else ""
        yield {
            "new_role": ROLES[o - 1], "action": done, "relabelled": r != o, "inserted": ROLES[extra - 1] if done == "insert" else None,
            "rendered": before + (texts[i] or "").replace("<|", "< |") + after,
        }


def _each(fn: Callable, keys: tuple[str, ...], copied: list[str], schema: pa.Schema) -> Callable:
    """Apply ``fn`` to every run of ``keys``; one row a run, or one a row of it, beside the columns ``copied``."""

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, *keys):
            made = fn(group)
            rows = [made] if isinstance(made, dict) else list(made)
            names = [f for f in schema.names if f not in copied]
            data = {c: group.column(c).slice(0, len(rows)).combine_chunks() for c in copied} | {f: [r[f] for r in rows] for f in names}
            yield pa.RecordBatch.from_arrays([pa.array(data[f], schema.field(f).type) if f in names else data[f].cast(schema.field(f).type) for f in schema.names], schema=schema)

    return go


def _grouped(df: DataFrame, fn: Callable, by: list[str], order: list[str], copied: dict[str, pa.DataType], made: dict[str, pa.DataType], ddl: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([*copied.items(), *made.items()])
    rows = df.repartition(n, *by).sortWithinPartitions(*by, *order)
    return store(rows.mapInArrow(_each(fn, tuple(by), list(copied), schema), ddl))[0]


def repair(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``turns``: conv_id, turn, place (order of the turns over all), role, new_role, action (append, merge or insert), relabelled, inserted
    (role of the empty turn put before it), rendered. A conversation's ``rendered`` in order of ``place`` make its text.

    Turns are ordered by number (null first), then role and text; rows equal in all of them are equal turns. Roles are trimmed
    and lower-cased, others than system, user and assistant get the cheapest role. A null text is empty. Rows with a
    null conversation are one conversation. Markers inside a text are broken up. An empty table gives none; other columns are ignored.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("given"),
        F.lower(F.trim(F.col(role_col).cast("string"))).alias("role"), F.col(text_col).alias("text"),
    ).withColumn("_salt", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", F.xxhash64("text"), "_salt"]
    placed, _ = store(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_salt").withColumn("pos", F.monotonically_increasing_id()))
    placed = placed.withColumn("_null", F.col("conv").isNull()).withColumn("conv", F.coalesce("conv", F.lit(0))).withColumn("piece", F.shiftright("pos", 33))
    by = ["_null", "conv", "piece"]
    whole = ["_null", "conv"]
    keys = {"_null": pa.bool_(), "conv": pa.int64(), "piece": pa.int64()}
    base = "_null boolean, conv long, piece long, "
    lists = pa.list_(pa.int64())
    light = placed.select(*by, "pos", "role")
    matrices = _grouped(light, _matrix, by, ["pos"], keys, {"m": lists}, base + "m array<long>")
    starts = _grouped(matrices, _first, whole, ["piece"], keys | {"m": lists}, {"entry": lists}, base + "m array<long>, entry array<long>")
    entry = starts.select(F.col("_null").alias("_n"), F.col("conv").alias("_c"), F.col("piece").alias("_p"), "entry", "m")
    at = (F.col("_null") == F.col("_n")) & (F.col("conv") == F.col("_c")) & (F.col("piece") == F.col("_p"))
    maps = _grouped(light.join(entry, at), _maps, by, ["pos"], keys | {"m": lists, "entry": lists}, {"back": lists}, base + "m array<long>, entry array<long>, back array<long>")
    ends = _grouped(
        maps, _last, whole, ["piece"], keys | {"entry": lists}, {"state": pa.int32(), "ends": pa.bool_()},
        base + "entry array<long>, state int, ends boolean",
    )
    known = ends.select(F.col("_null").alias("_n"), F.col("conv").alias("_c"), F.col("piece").alias("_p"), "entry", "state", "ends")
    text = pa.string()
    out = _grouped(
        placed.join(known, at), _render, by, ["pos"], keys | {"pos": pa.int64(), "turn": pa.int64(), "given": text},
        {"new_role": text, "action": text, "relabelled": pa.bool_(), "inserted": text, "rendered": text},
        base + "pos long, turn long, given string, new_role string, action string, relabelled boolean, inserted string, rendered string",
    )
    return out.select(
        F.when(~F.col("_null"), F.col("conv")).alias(conv_col), F.col("turn").alias(turn_col), F.col("pos").alias("place"), F.col("given").alias(role_col),
        "new_role", "action", "relabelled", "inserted", "rendered",
    )
