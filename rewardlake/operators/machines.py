"""State machines over ordered rows by an associative scan.

A machine reads a key's rows in order; each row's input moves it from state
to state and adds to counters.  Rows are range-partitioned by (key, order), so
a partition is a bounded piece of the sequence whatever the keys are: a key
that holds a third of the rows, even all of them on one day, lies in many
partitions.  Then

1. every partition becomes one small function: for each state it may be
   entered in, the state it is left in and what it adds to the counters,
2. these functions are composed along a tree (functions that span a key's
   start forget what came before), which gives every partition the state and
   counters it is entered with,
3. every partition runs once more from there and labels its rows.

The rows are shuffled once and kept by a checkpoint, which fixes the
partitions; steps 1 and 3 are narrow, step 2 handles one row per partition.
Within an Arrow batch states are found by composing moves in doubling steps,
not row by row.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: functions composed at once, by a task or at the top by the driver
FAN = 1024


@dataclass(frozen=True)
class Machine:
    """``states`` (every key starts in the first), ``inputs``, the next state
    by (state, input) and what a row adds to each counter by (state before
    it, input).  A pair without an entry stays and adds nothing; so does a
    row whose input is null."""
    states: tuple[str, ...]
    inputs: tuple[str, ...]
    moves: Mapping[tuple[str, str], str] = field(default_factory=dict)
    counts: Mapping[str, Mapping[tuple[str, str], int]] = field(default_factory=dict)

    def __post_init__(self):
        pairs = [*self.moves, *(p for c in self.counts.values() for p in c)]
        for state, inp in pairs:
            if state not in self.states or inp not in self.inputs:
                raise ValueError(f"unknown state or input in {(state, inp)}")
        if not set(self.moves.values()) <= set(self.states):
            raise ValueError("a move leads to an unknown state")

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(state, input) -> next state, and (counter, state, input) -> what
        is added; the last input stands for null."""
        s, c = len(self.states), len(self.inputs)
        move = np.repeat(np.arange(s)[:, None], c + 1, axis=1)
        add = np.zeros((len(self.counts), s, c + 1), np.int64)
        for (state, inp), to in self.moves.items():
            move[self.states.index(state), self.inputs.index(inp)] = self.states.index(to)
        for k, table in enumerate(self.counts.values()):
            for (state, inp), n in table.items():
                add[k, self.states.index(state), self.inputs.index(inp)] = n
        return move, add


#: numbers the rows of a key
NUMBERING = Machine(("on",), ("row",), counts={"n": {("on", "row"): 1}})


# ------------------------------------------------------ a piece of the rows
def states_before(move: np.ndarray, inputs: np.ndarray, starts: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
    """The state before every row of a piece entered in ``entry``, and the
    state after the last; a row that starts a key is met in state 0."""
    n = len(inputs)
    steps = move[:, inputs].T.copy()                      # row -> (state before -> state after)
    steps[starts] = steps[starts][:, :1]
    if len(move) > 1:
        d = 1
        while d < n:                                      # steps[i] covers the last 2d rows up to i
            steps[d:] = np.take_along_axis(steps[d:], steps[:-d].copy(), axis=1)
            d *= 2
    after = steps[:, entry]
    before = np.concatenate([[entry], after[:-1]])
    before[starts] = 0
    return before, int(after[-1])


def counts_upto(add: np.ndarray, inputs: np.ndarray, starts: np.ndarray, before: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """(counter, row): the counters after every row, from ``entry`` until a
    key starts and from 0 then."""
    total = np.cumsum(add[:, before, inputs], axis=1)
    at = np.maximum.accumulate(np.where(starts, np.arange(len(inputs)), -1))
    padded = np.concatenate([np.zeros((len(add), 1), np.int64), total], axis=1)
    base = np.where(at >= 0, padded[:, np.maximum(at, 0)], -entry[:, None])
    return total - base


def _differs(col: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before it (nulls are equal)."""
    a, b = col[1:], col[:-1]
    unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return unlike | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


class _Piece:
    """Key starts of the batches of a partition, one after the other."""

    def __init__(self, keys: int):
        self.names = [f"_k{i}" for i in range(keys)]
        self.first = self.last = None

    def starts(self, batch: pa.RecordBatch, continued: bool) -> np.ndarray:
        """Rows of the batch that start a key; ``continued``: the partition's
        first row goes on with the key before it."""
        cols = [batch.column(n) for n in self.names]
        out = np.zeros(batch.num_rows, bool)
        for c in cols:
            out[1:] |= _differs(c)
        head, tail = (repr(tuple(c[i].as_py() for c in cols)) for i in (0, -1))
        out[0] = not continued if self.first is None else head != self.last
        self.first, self.last = self.first or head, tail
        return out


_FUNCTION = ("_part int, first_key string, last_key string, leaves array<int>, adds array<bigint>, fresh boolean")
_FUNCTION_ARROW = pa.schema([("_part", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()),
                             ("leaves", pa.list_(pa.int32())), ("adds", pa.list_(pa.int64())), ("fresh", pa.bool_())])
_ENTRY = "_at int, entry int, held array<bigint>, before_key string, goes_on boolean"
_ENTRY_ARROW = pa.schema([("_at", pa.int32()), ("entry", pa.int32()), ("held", pa.list_(pa.int64())),
                          ("before_key", pa.string()), ("goes_on", pa.bool_())])


def _summaries(machine: Machine, keys: int):
    move, add = machine.tables()
    s, k = len(machine.states), len(machine.counts)

    def run(batches):
        piece, part, fresh = _Piece(keys), None, False
        at, held = np.arange(s), np.zeros((s, k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("_part")[0].as_py()
            starts, inputs = piece.starts(batch, True), batch.column("_in").to_numpy()
            done = {}
            for q in range(s):
                state = int(at[q])
                if state not in done:
                    before, after = states_before(move, inputs, starts, state)
                    counts = counts_upto(add, inputs, starts, before, np.zeros(k, np.int64))[:, -1]
                    done[state] = after, counts
                at[q] = done[state][0]
                held[q] = done[state][1] + (0 if starts.any() else held[q])
            fresh = fresh or bool(starts.any())
        if part is not None:
            yield pa.RecordBatch.from_pylist([{"_part": part, "first_key": piece.first, "last_key": piece.last,
                                               "leaves": at.tolist(), "adds": held.ravel().tolist(), "fresh": fresh}],
                                             schema=_FUNCTION_ARROW)
    return run


# -------------------------------------------------------- functions, composed
def compose(f: dict, g: dict) -> dict:
    """The function of ``f``'s rows followed by ``g``'s."""
    s, k = len(f["leaves"]), len(f["adds"]) // len(f["leaves"])
    same = f["last_key"] == g["first_key"]
    leaves, adds = [], []
    for q in range(s):
        mid = f["leaves"][q] if same else 0
        leaves.append(g["leaves"][mid])
        held = f["adds"][q * k:(q + 1) * k] if same and not g["fresh"] else [0] * k
        adds += [a + b for a, b in zip(held, g["adds"][mid * k:(mid + 1) * k], strict=True)]
    return {"_part": f["_part"], "first_key": f["first_key"], "last_key": g["last_key"], "leaves": leaves, "adds": adds,
            "fresh": f["fresh"] or g["fresh"] or not same}


def push(functions: list[dict], entry: int, held: list[int], before_key: str | None) -> list[dict]:
    """What every function is entered with when the first one is entered
    with ``entry`` and ``held`` after rows of ``before_key`` (None: nothing)."""
    out, k = [], len(held)
    for f in functions:
        goes_on = f["first_key"] == before_key
        if not goes_on:
            entry, held = 0, [0] * k
        out.append({"_at": f["_part"], "entry": entry, "held": held, "before_key": before_key, "goes_on": goes_on})
        add = f["adds"][entry * k:(entry + 1) * k]
        held = add if f["fresh"] else [a + b for a, b in zip(held, add, strict=True)]
        entry, before_key = f["leaves"][entry], f["last_key"]
    return out


def _entries(functions: DataFrame, parts: int, counters: int, fan: int) -> DataFrame:
    """``_ENTRY`` rows of all partitions: functions are composed ``fan`` at a
    time until ``fan`` are left, and what these are entered with is pushed
    down again.  The driver sees ``fan`` rows at most."""
    if parts <= fan:
        rows = sorted((r.asDict() for r in functions.collect()), key=lambda r: r["_part"])
        pushed = push(rows, 0, [0] * counters, None)
        return functions.sparkSession.createDataFrame([tuple(e[f.name] for f in _ENTRY_ARROW) for e in pushed], _ENTRY)

    def ordered(table: pa.Table) -> list[dict]:
        return sorted(table.to_pylist(), key=lambda r: r["_part"])

    def join(table: pa.Table) -> pa.Table:
        rows = ordered(table)
        whole = reduce(compose, rows)
        return pa.Table.from_pylist([whole | {"_part": rows[0]["_part"] // fan}], schema=_FUNCTION_ARROW)

    def down(table: pa.Table) -> pa.Table:
        rows = ordered(table)
        return pa.Table.from_pylist(push(rows, rows[0]["entry"], rows[0]["held"], rows[0]["before_key"]), schema=_ENTRY_ARROW)

    functions = functions.checkpoint().withColumn("_up", F.floor(F.col("_part") / fan).cast("int"))
    above = functions.groupBy("_up").applyInArrow(join, _FUNCTION).checkpoint()
    above = _entries(above, -(-parts // fan), counters, fan)
    return functions.join(above, F.col("_up") == F.col("_at")).drop("_at", "goes_on").groupBy("_up").applyInArrow(down, _ENTRY)


def _labels(machine: Machine, keys: int, keep: int, state: str | None):
    move, add = machine.tables()
    names = np.array(machine.states, object)

    def run(batches):
        piece, at, held = _Piece(keys), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            continued = True
            if held is None:
                first = batch.slice(0, 1)
                at, held = first.column("entry")[0].as_py(), np.array(first.column("held")[0].as_py(), np.int64)
                continued = first.column("goes_on")[0].as_py()
            starts, inputs = piece.starts(batch, continued), batch.column("_in").to_numpy()
            before, after = states_before(move, inputs, starts, at)
            counts = counts_upto(add, inputs, starts, before, held)
            at, held = after, counts[:, -1]
            cols = [batch.column(i) for i in range(keep)] + ([pa.array(names[before], pa.string())] if state else []) + \
                [pa.array(c, pa.int64()) for c in counts]
            fields = [batch.schema.field(i).name for i in range(keep)] + ([state] if state else []) + list(machine.counts)
            yield pa.RecordBatch.from_arrays(cols, fields)
    return run


def scan(df: DataFrame, keys: list[str], order: list[str], machine: Machine, inputs: Column | None = None,
         state: str | None = None, fan: int = FAN) -> DataFrame:
    """``df`` with the machine's counters after every row (columns named as
    in ``machine.counts``) and, as column ``state``, its state before the row.

    ``inputs`` names a row's input (if not given: the machine's first).  Null
    keys are a group like any other; rows that tie in ``order`` come in no
    stated order; without ``keys`` the whole table is one sequence.  An empty
    table stays empty."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    given = F.lit(machine.inputs[0]) if inputs is None else inputs
    number = F.coalesce(*[F.when(given == F.lit(name), F.lit(i)) for i, name in enumerate(machine.inputs)],
                        F.lit(len(machine.inputs)))
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    marks = [(F.col(k).cast("string") if k in floats else F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = df.select("*", number.alias("_in"), *marks).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = rows.withColumn("_part", F.spark_partition_id()).checkpoint()
    functions = rows.mapInArrow(_summaries(machine, len(keys)), _FUNCTION)
    entries = _entries(functions, rows.rdd.getNumPartitions(), len(machine.counts), fan)
    # one row a partition of ``rows``
    entered = rows.join(F.broadcast(entries), F.col("_part") == F.col("_at"))
    out = T.StructType([*df.schema.fields, *([T.StructField(state, T.StringType())] if state else []),
                        *(T.StructField(c, T.LongType()) for c in machine.counts)])
    return entered.mapInArrow(_labels(machine, len(keys), len(df.columns), state), out)


# worker-side functions of this module travel with the task (see shipping.py)
from ..shipping import ship_by_value  # noqa: E402

ship_by_value(__name__)
