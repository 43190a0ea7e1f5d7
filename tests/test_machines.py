"""The associative scan against a loop, with keys that span many partitions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardlake.operators import machines as M

#: states that forget, stay and swap; counters that depend on the state
ODD = M.Machine(
    ("a", "b", "c"), ("x", "y", "z"),
    moves={("a", "x"): "b", ("b", "x"): "c", ("c", "x"): "a", ("a", "y"): "c", ("c", "y"): "a", ("b", "z"): "a"},
    counts={"n": {(s, i): 1 for s in "abc" for i in "xyz"}, "w": {("a", "x"): 2, ("b", "z"): -3, ("c", "y"): 5}})


def _loop(rows, machine=ODD):
    """rows (key, order, input) -> (key, order): state before, counters after."""
    out, at, held = {}, {}, {}
    for k, o, i in sorted(rows, key=lambda r: r[1]):
        state = at.get(k, machine.states[0])
        got = held.setdefault(k, [0] * len(machine.counts))
        for c, table in enumerate(machine.counts.values()):
            got[c] += table.get((state, i), 0)
        out[(k, o)] = (state, *got)
        at[k] = machine.moves.get((state, i), state)
    return out


def _parts(spark, n):
    class Set:
        def __enter__(self):
            self.before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

        def __exit__(self, *_):
            for c, v in self.before.items():
                spark.conf.set(c, v)
    return Set()


@pytest.mark.parametrize("parts,fan", [(1, 1024), (7, 1024), (40, 3)])
def test_scan_matches_a_loop(spark, parts, fan):
    rnd = random.Random(parts)
    # one key holds most rows; others have a row or two; a null key; null inputs
    rows = [(rnd.choice([0] * 12 + [1, 2, None, rnd.randint(3, 60)]), o, rnd.choice(["x", "y", "z", None])) for o in rnd.sample(range(9000), 2500)]
    df = spark.createDataFrame(rows, "k long, o long, i string").withColumn("text", F.concat(F.lit("t"), "o"))
    with _parts(spark, parts):
        out = M.scan(df, ["k"], ["o"], ODD, F.col("i"), state="before", fan=fan)
        got = {(r.k, r.o): (r.before, r.n, r.w) for r in out.collect()}
        assert all(r.text == f"t{r.o}" for r in out.collect())
    assert got == _loop(rows)


def test_small_batches_carry_on(spark):
    rows = [(k, o, "xyz"[(o * o + k) % 3]) for k in (1, 2) for o in range(300)]
    df = spark.createDataFrame(rows, "k long, o long, i string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        with _parts(spark, 3):
            got = {(r.k, r.o): (r.before, r.n, r.w) for r in M.scan(df, ["k"], ["o"], ODD, F.col("i"), state="before").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == _loop(rows)


def test_one_hot_day_is_spread(spark):
    """A third of all rows are of one key and one day: they lie in many
    partitions, none of them large."""
    n = 30_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 200 + 1).alias("k"),
                               F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 2).alias("ts"), "id")
    assert df.select(F.countDistinct(F.to_date("ts"))).first()[0] <= 2
    with _parts(spark, 16):
        out = M.scan(df, ["k"], ["ts", "id"], M.NUMBERING)
        sizes = [(r["c"], r["hot"]) for r in out.groupBy(F.spark_partition_id()).agg(
            F.count("n").alias("c"), F.count_if(F.col("k") == 0).alias("hot")).collect()]
        got = {(r.k, r.id): r.n for r in out.select("k", "id", "n").collect()}
    assert max(c for c, _ in sizes) < 0.15 * n and sum(h > 0 for _, h in sizes) >= 4
    seen = {}
    for i in range(n):
        k = 0 if i % 3 == 0 else i % 200 + 1
        seen[k] = seen.get(k, 0) + 1
        assert got[(k, i)] == seen[k]


def test_rows_move_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = M.scan(df, ["k"], ["id"], M.NUMBERING)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" not in plan and "Exchange hashpartitioning" not in plan


def test_unkeyed_empty_and_odd_keys(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2), (None, 3), (0.5, 4), (None, 5)], "k double, o int")
    got = {r.o: r.n for r in M.scan(df, ["k"], ["o"], M.NUMBERING).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: 2}
    assert {r.o: r.n for r in M.scan(df, [], ["o"], M.NUMBERING).collect()} == {i: i for i in range(1, 6)}
    assert M.scan(df.limit(0), ["k"], ["o"], M.NUMBERING).collect() == []
    with pytest.raises(ValueError):
        M.Machine(("a",), ("x",), moves={("a", "x"): "b"})
    with pytest.raises(ValueError):
        M.Machine(("a",), ("x",), counts={"n": {("a", "y"): 1}})


def test_functions_compose_associatively():
    rnd = random.Random(1)

    def function(part):
        return {"_part": part, "first_key": rnd.choice("pq"), "last_key": rnd.choice("pq"), "leaves": [rnd.randrange(3) for _ in range(3)],
                "adds": [rnd.randint(-5, 5) for _ in range(6)], "fresh": rnd.random() < 0.4}
    for _ in range(300):
        f, g, h = (function(i) for i in range(3))
        assert M.compose(M.compose(f, g), h) == M.compose(f, M.compose(g, h))
        # pushing through the members ends where the composed function does
        held, key = [rnd.randint(0, 9), rnd.randint(0, 9)], rnd.choice(["p", "q", None])
        end = function(9)
        a = M.push([f, g, h, end], 1, held, key)[-1]
        b = M.push([M.compose(M.compose(f, g), h), end], 1, held, key)[-1]
        assert a == b


def test_states_by_doubling():
    move, _ = ODD.tables()
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 31, 64, 100):
        inputs, starts = rng.integers(0, 4, n), rng.random(n) < 0.1
        for entry in range(3):
            before, after = M.states_before(move, inputs, starts, entry)
            at = entry
            for i in range(n):
                at = 0 if starts[i] else at
                assert before[i] == at
                at = move[at, inputs[i]]
            assert after == at
