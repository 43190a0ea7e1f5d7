"""Conversations and multi-turn runs.

Messages are a long table ``(conv_id, turn, role, text)``; recorded turns of
a multi-turn run are ``(instance_id, turn, output, all_passed,
aggregate_score)``.  The reference replays a loop per instance; here the
same outcome is computed set-wise: per-instance facts (first passing turn,
message counts) are ``groupBy`` aggregates joined back, and only truly
sequential facts (attempt numbering, previous role) use windows
partitioned by conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HISTORY_SEPARATOR  # noqa: F401

from ..functions.feedback import feedback_message
from ..functions.text import truthy
from .joins import join_back
from .machines import Machine, scan


def conversation_array(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """H1: one ordered ``array<struct<turn, role, text>>`` per conversation
    (a conversation is one record in the reference, so it is one group)."""
    return (messages.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")))


def turn_index(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(message count - prefix) // 2, prefix 2 when the first message is
    a system message, else 1.  Pure aggregates: no window."""
    g = messages.groupBy(key).agg(F.count(F.lit(1)).alias("n_messages"),
                                  F.min_by("role", "turn").alias("first_role"))
    prefix = F.when(F.col("first_role") == "system", F.lit(2)).otherwise(F.lit(1))
    return g.select(key, F.col("n_messages").cast("bigint").alias("n_messages"),
                    F.floor((F.col("n_messages") - prefix) / 2).cast("bigint").alias("turn_index"))


#: E2 as a state machine: ``first``/``second`` are the prefix (two messages
#: if the first is a system message), ``answered`` follows an attempt
ATTEMPTS = Machine(
    ("first", "second", "open", "answered"), ("system", "assistant", "user", "other"),
    moves={("first", "system"): "second"}
    | {("first", i): "open" for i in ("assistant", "user", "other")}
    | {("second", i): "open" for i in ("system", "assistant", "user", "other")}
    | {(s, "assistant"): "answered" for s in ("open", "answered")}
    | {("answered", i): "open" for i in ("system", "user", "other")},
    counts={"attempt": {("open", "assistant"): 1, ("answered", "assistant"): 1}})


def attempt_blocks(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """After the prefix, each assistant message opens attempt k (from 1)
    and a user message right after it is that attempt's feedback; other
    messages are skipped.  Returns the attempt and feedback rows only.

    One associative scan (``machines.scan``): the messages move once, into
    range partitions by (conversation, turn), so a conversation of any length
    is spread; no window.
    """
    m = messages.select(key, "turn", "role", "text")
    role = F.when(F.col("role").isin("system", "assistant", "user"), F.col("role")).otherwise(F.lit("other"))
    s = scan(m, [key], ["turn"], ATTEMPTS, role, state="_state")
    kind = F.when((F.col("role") == "assistant") & F.col("_state").isin("open", "answered"), F.lit("attempt")) \
        .when((F.col("role") == "user") & (F.col("_state") == "answered"), F.lit("feedback"))
    return s.select(key, "turn", kind.alias("kind"), "attempt", "text").filter(F.col("kind").isNotNull())


def history_text(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Prior attempts and feedback as one text per conversation
    (blocks in message order, joined by a blank line)."""
    blocks = attempt_blocks(messages, key)
    head = F.when(F.col("kind") == "attempt", F.lit("### Attempt ")).otherwise(F.lit("### Feedback on Attempt "))
    block = F.concat(head, F.col("attempt").cast("string"), F.lit("\n"), F.col("text"))
    g = (blocks.groupBy(key)
         .agg(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))).alias("bs")))
    return g.select(key, F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("history"))


def augmented_problem(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """For a conversation past its first turn, the problem statement
    (first user message) followed by the separator and the history text."""
    problem = (messages.filter(F.col("role") == "user").groupBy(key)
               .agg(F.min_by("text", "turn").alias("problem")))
    t = turn_index(messages, key)
    h = history_text(messages, key)
    j = t.join(problem, key, "left").join(h, key, "left")
    aug = F.when((F.col("turn_index") > 0) & truthy(F.col("history")),
                 F.concat(F.coalesce(F.col("problem"), F.lit("")), F.lit(HISTORY_SEPARATOR), F.col("history"))
                 ).otherwise(F.coalesce(F.col("problem"), F.lit("")))
    return j.select(key, "turn_index", aug.alias("problem_statement"))


# ------------------------------------------------------------- E3 / E4 / E13
def replay_early_exit(turns: DataFrame, max_turns: int, has_intermediate: bool = True) -> DataFrame:
    """The turns a run with early exit keeps, set-wise.

    A run stops at the first turn whose intermediate checks all pass, or
    after ``max_turns``.  Feedback is produced for a kept turn that neither
    exits nor is the last allowed one.  The first passing turn is an
    aggregate joined back (AQE can split a hot instance in that join).
    Without intermediate verifiers every turn scores 1.0, none exits early
    and none gets feedback.
    """
    if not has_intermediate:
        kept = turns.filter(F.col("turn") <= max_turns - 1)
        return kept.select("instance_id", F.col("turn").cast("bigint").alias("turn"), "output",
                           F.lit(1.0).alias("aggregate_score"), "all_passed",
                           F.lit(False).alias("exits"), F.lit(False).alias("has_feedback"))
    first_pass = (turns.groupBy("instance_id")
                  .agg(F.min(F.when(F.col("all_passed"), F.col("turn"))).alias("first_pass")))
    last_allowed = F.lit(max_turns - 1)
    cut = F.least(F.coalesce(F.col("first_pass"), last_allowed), last_allowed)
    kept = join_back(turns, first_pass, "instance_id").filter(F.col("turn") <= cut)
    exits = F.coalesce(F.col("turn") == F.col("first_pass"), F.lit(False))
    return kept.select(
        "instance_id", F.col("turn").cast("bigint").alias("turn"), "output", "aggregate_score",
        "all_passed", exits.alias("exits"), (~exits & (F.col("turn") < last_allowed)).alias("has_feedback"))


def run_outcomes(instances: DataFrame, turns: DataFrame, max_turns: int) -> DataFrame:
    """E4 + D8 inputs: per instance, the replayed run: number of turns,
    early stop, final output (the *last* kept turn, not the best) and, for
    comparison, the best kept turn.  Instances without recorded turns come
    from the left side with zero turns."""
    kept = replay_early_exit(turns, max_turns)
    g = kept.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("num_turns"),
        F.bool_or("exits").alias("stopped_early"),
        F.max("turn").alias("final_turn"),
        F.max_by("output", "turn").alias("final_output"),
        F.max_by("aggregate_score", "turn").alias("final_score"),
        F.max_by("all_passed", "turn").alias("final_passed"),
        F.min_by("turn", F.struct(-F.col("aggregate_score"), F.col("turn"))).alias("best_turn"),
        F.max("aggregate_score").alias("best_score"))
    return (instances.select("instance_id").join(g, "instance_id", "left")
            .select("instance_id",
                    F.coalesce(F.col("num_turns"), F.lit(0)).cast("bigint").alias("num_turns"),
                    F.coalesce(F.col("stopped_early"), F.lit(False)).alias("stopped_early"),
                    "final_turn", F.coalesce(F.col("final_output"), F.lit("")).alias("final_output"),
                    "final_score", "final_passed", "best_turn", "best_score"))


def turn_rewards(turns: DataFrame, max_turns: int) -> DataFrame:
    """Sparse reward (the outcome on the last kept turn only) and dense
    reward (per-turn score minus the previous turn's)."""
    kept = replay_early_exit(turns, max_turns)
    # at most max_turns turns of an instance are kept, so the window is bounded
    w = Window.partitionBy("instance_id").orderBy("turn")
    return (kept
            .select("instance_id", "turn",
                    F.when(F.lead("turn").over(w).isNull(), F.col("aggregate_score"))
                    .otherwise(F.lit(0.0)).alias("sparse_reward"),
                    (F.col("aggregate_score") - F.coalesce(F.lag("aggregate_score").over(w), F.lit(0.0)))
                    .alias("dense_reward")))


# ------------------------------------------------------------- H2 / H3
def nest_turns(turns: DataFrame) -> DataFrame:
    """H2: one record per instance with its turns as an array of structs
    (the per-instance multi-turn record); bounded by the turn count."""
    return (turns.groupBy("instance_id")
            .agg(F.sort_array(F.collect_list(F.struct(
                F.col("turn").cast("bigint").alias("turn"), "output", "aggregate_score",
                F.col("all_passed").alias("passed")))).alias("turns"))
            .select("instance_id", F.size("turns").cast("bigint").alias("num_turns"), "turns"))


def unnest_turns(nested: DataFrame) -> DataFrame:
    """H3: back to one row per turn for analysis."""
    return nested.select("instance_id", F.explode("turns").alias("t")).select("instance_id", "t.*")


def multi_turn_record(turns: DataFrame, checks: DataFrame, max_turns: int, finals: DataFrame | None = None) -> DataFrame:
    """H2 with both levels: one record per run with ``num_turns,
    stopped_early, final_aggregate_score`` and its kept turns, each with
    output, feedback (null where none was given), aggregate score and the
    results of its verifiers in config order.

    ``checks`` has one row per (instance, turn, configured verifier):
    ``ord, name, status, score, pass_threshold`` (and ``details``, ``stdout``
    where recorded).  ``finals`` is ``(instance_id, final_aggregate_score)``;
    without it the last kept turn's score stands in.  Groups are bounded by
    the configured verifiers and by ``max_turns``; null ids form one run."""
    key = F.struct(F.col("instance_id").alias("id"), F.col("turn").cast("bigint").alias("turn"))
    keyed = checks.withColumn("instance_id", key)
    passed = F.coalesce((F.col("status") == "ok") & (F.col("score") >= F.col("pass_threshold")), F.lit(False))
    results = keyed.groupBy("instance_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "name", "status", "score", passed.alias("passed")))).alias("_r"))
    told = feedback_message(keyed).join(results, "instance_id").withColumnRenamed("instance_id", "_key")
    kept = replay_early_exit(turns, max_turns).withColumn("_key", key).join(told, "_key", "left")
    results_of = F.transform(F.coalesce("_r", F.array()), lambda r: F.struct(
        r["name"].alias("name"), r["status"].alias("status"), r["score"].alias("score"), r["passed"].alias("passed")))
    turn = F.struct("turn", "output", F.when(F.col("has_feedback"), F.col("feedback")).alias("feedback"),
                    "aggregate_score", results_of.alias("verifier_results"))
    record = kept.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("num_turns"), F.bool_or("exits").alias("stopped_early"),
        F.max_by("aggregate_score", "turn").alias("_last"), F.sort_array(F.collect_list(turn)).alias("turns"))
    if finals is None:
        score = F.col("_last")
    else:
        final = finals.select(F.struct(F.col("instance_id").alias("id")).alias("_id"), "final_aggregate_score")
        record = record.join(final, F.struct(F.col("instance_id").alias("id")) == F.col("_id"), "left")
        score = F.col("final_aggregate_score")
    return record.select("instance_id", "num_turns", "stopped_early", score.alias("final_aggregate_score"), "turns")


def unnest_record(record: DataFrame) -> DataFrame:
    """H3 with both levels: one row per (run, turn, verifier result); a turn
    without results keeps one row."""
    head = ["instance_id", "num_turns", "stopped_early", "final_aggregate_score"]
    t = record.select(*head, F.explode("turns").alias("t")).select(*head, "t.*")
    t = t.withColumn("v", F.explode_outer("verifier_results"))
    return t.select(*head, "turn", "output", "feedback", "aggregate_score", "v.name", "v.status", "v.score", "v.passed")


# ------------------------------------------------------------- D8
def run_summary(instances: DataFrame, turns: DataFrame, max_turns: int, finals: DataFrame | None = None) -> DataFrame:
    """Run summary over the *dataset*: instances whose run produced no
    turns are error rows; completion = evaluated / dataset size; average
    turns over non-error rows (default 1); early exits counted over all
    rows, reported beside the non-error count.

    ``finals`` is ``(instance_id, resolved)``: what the final unit-test result
    of a run says; a run without one is unresolved.  Without the table the
    last turn's checks stand in for it."""
    r = run_outcomes(instances, turns, max_turns)
    if finals is None:
        r = r.withColumnRenamed("final_passed", "resolved")
    else:
        r = r.join(finals.select("instance_id", "resolved"), "instance_id", "left") \
             .withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    is_error = F.col("num_turns") == 0
    evaluated = ~is_error & F.col("resolved").isNotNull()
    n = F.count(F.lit(1))
    agg = r.agg(
        n.alias("total"),
        F.count_if(is_error).alias("errors"),
        F.count_if(evaluated).alias("evaluated"),
        F.count_if(evaluated & F.col("resolved")).alias("resolved"),
        F.avg(F.when(~is_error, F.when(F.col("num_turns") > 0, F.col("num_turns")).otherwise(F.lit(1))))
        .alias("avg_turns"),
        F.count_if(F.col("stopped_early")).alias("early_exits"),
        F.count_if(~is_error).alias("non_error_rows"))
    return agg.select(
        F.col("total").cast("bigint").alias("total"), F.col("errors").cast("bigint").alias("errors"),
        F.col("evaluated").cast("bigint").alias("evaluated"),
        F.when(F.col("total") > 0, F.col("evaluated") / F.col("total")).otherwise(F.lit(0.0)).alias("completion_rate"),
        F.col("resolved").cast("bigint").alias("resolved"),
        F.when(F.col("evaluated") > 0, F.col("resolved") / F.col("evaluated")).otherwise(F.lit(0.0))
        .alias("resolve_rate"),
        "avg_turns", F.col("early_exits").cast("bigint").alias("early_exits"),
        F.col("non_error_rows").cast("bigint").alias("non_error_rows"))
