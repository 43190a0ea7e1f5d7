"""Order-dependent operators against brute force, including a hot key that
spans many chunks and the unkeyed (whole-table) case."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rewardlake.operators import sequence as SQ


def test_round_robin_hot_key_and_unkeyed(spark):
    rnd = random.Random(7)
    rows = [(0 if rnd.random() < 0.5 else rnd.randint(1, 20), i * 7 + rnd.randint(0, 6)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long")
    got = {(r.k, r.o): r.worker for r in SQ.round_robin(df, "k", "o", 4, chunk_width=50).collect()}
    by_key = {}
    for k, o in sorted(rows, key=lambda x: x[1]):
        by_key.setdefault(k, []).append(o)
    want = {(k, o): i % 4 for k, os_ in by_key.items() for i, o in enumerate(os_)}
    assert got == want
    flat = {r.o: r.worker for r in SQ.round_robin(df, None, "o", 3, chunk_width=50).collect()}
    assert flat == {o: i % 3 for i, o in enumerate(sorted(o for _, o in rows))}


def test_breaker_across_chunks(spark):
    # user 1: 12 failures in a row spanning two chunks, then a success
    seq = [("u1", i, i >= 3 and i < 15) for i in range(20)] + [("u2", i, i % 2 == 0) for i in range(10)]
    df = spark.createDataFrame(seq, "u string, t long, fail boolean")
    got = {r.u: (r.max_streak, r.tripped)
           for r in SQ.breaker(df, "u", ["t"], F.col("fail"), 10).collect()}
    assert got == {"u1": (12, True), "u2": (1, False)}


def test_chunked_scan_lag_and_sums_cross_chunks(spark):
    rnd = random.Random(3)
    rows = [(k, t, rnd.choice("abc")) for k in (1, 2) for t in rnd.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "k long, t long, v string")
    got = {(r.k, r.t): (r.n, r.na, r.prev) for r in SQ.chunked_scan(
        df, ["k"], ["t"], F.floor(F.col("t") / 7), sums={"n": F.lit(1), "na": F.when(F.col("v") == "a", 1).otherwise(0)},
        lags={"prev": "v"}).collect()}
    want = {}
    for k in (1, 2):
        seq = sorted((t, v) for kk, t, v in rows if kk == k)
        na = 0
        for i, (t, v) in enumerate(seq):
            na += v == "a"
            want[(k, t)] = (i + 1, na, seq[i - 1][1] if i else None)
    assert got == want


def test_attempt_blocks_independent_of_partitioning(spark):
    from rewardlake.operators.dialog import attempt_blocks
    from rewardlake.sources.tables import table
    from tests.conftest import SF_SMALL
    conv = table(spark, SF_SMALL, "conversations")
    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts, merge in (("1", "true"), ("60", "false")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
        got.append(sorted(tuple(r) for r in attempt_blocks(conv).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got[0] == got[1] and got[0]


def test_attempt_blocks_cases(spark):
    from rewardlake.operators.dialog import attempt_blocks
    talks = {1: "system user assistant user assistant", 2: "user assistant user user assistant system user", 3: "assistant",
             4: "system assistant assistant user", 5: "user", 6: "tool assistant none user"}
    rows = [(k, t, None if r == "none" else r, f"{k}.{t}") for k, talk in talks.items() for t, r in enumerate(talk.split())]
    got = sorted((r.conv_id, r.turn, r.kind, r.attempt) for r in attempt_blocks(
        spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect())
    assert got == [(1, 2, "attempt", 1), (1, 3, "feedback", 1), (1, 4, "attempt", 2),
                   (2, 1, "attempt", 1), (2, 2, "feedback", 1), (2, 4, "attempt", 2),
                   (4, 2, "attempt", 1), (4, 3, "feedback", 1), (6, 1, "attempt", 1)]


def test_prefix_until_keeps_rows_before_first_stop(spark):
    rows = [("r1", 1, "ok"), ("r1", 2, "err"), ("r1", 3, "limit"), ("r1", 4, "ok"), ("r2", 1, "ok")]
    df = spark.createDataFrame(rows, "run string, t long, what string")
    got = sorted((r.run, r.t) for r in SQ.prefix_until(df, "run", ["t"], F.col("what") == "limit").collect())
    assert got == [("r1", 1), ("r1", 2), ("r2", 1)]


def test_null_keys_and_chunks_stay(spark):
    from pyspark.sql import functions as F

    from rewardlake.operators.sequence import chunked_scan

    rows = [("a", 1, 0), ("a", 2, None), (None, 3, 0), (None, 4, 1), ("a", 5, 1)]
    d = spark.createDataFrame(rows, "k string, v int, c int")
    out = chunked_scan(d, ["k"], ["v"], "c", sums={"s": F.col("v")}, lags={"before": "v"}).collect()
    assert len(out) == 5
    assert {r.v: r.s for r in out if r.k is None} == {3: 3, 4: 7}
    assert {r.v: r.before for r in out if r.k is None} == {3: None, 4: 3}
