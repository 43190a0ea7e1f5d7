"""Structured Streaming versions of the incremental operators.

* ``episode_stream``   J2/J3: stateful episode reducer keyed by episode
  (``transformWithState``: list state, value state and event-time timers).
  An episode's first steps in (ts, event_id) order are kept as short entries;
  once the watermark has passed the step that ends it (first submit, step cap,
  or the last one before ``idle_ms`` without a step) nothing can come before
  that any more, and the summary is emitted once.  A closed episode leaves a
  mark that ignores its further steps, and that is removed after
  ``closed_ms``.
* ``running_report``   J4: the precedence report (D6) as a streaming
  aggregation; each epoch rewrites the (one-row) result table.
* ``new_predictions``  J1: a batch of incoming predictions less completed
  and already taken instances; ``runner.run_intake`` applies it per epoch.

Rows older than the watermark are dropped and counted by Spark (late data);
all others count, in whatever order they arrive, so the stream gives the
batch result.  A source that may fall silent should send heartbeats (rows with
action ``HEARTBEAT``) to keep the watermark moving; they touch no episode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.reports import count_where, safe_ratio, with_bucket
from ..operators.rollout import MAX_STEPS

HEARTBEAT = "heartbeat"
#: how long after its end a closed episode's further steps are still recognised
CLOSED_MS = 24 * 3_600_000
EPISODE_OUT = ("episode long, steps long, nonzero_exits long, total_output_chars long, "
               "immediate_submit double, end_reason string")
_OUT_NAMES = [c.split()[0] for c in EPISODE_OUT.split(", ")]
#: a kept step: time in microseconds, id, output characters, non-zero exit, submit
STEP_STATE = "ts long, event_id long, chars long, nonzero int, submit boolean"


def _ms(ts: int) -> int:
    """The first millisecond that is not before a time in microseconds."""
    return -(-ts // 1000)


def episode_end(steps: list[tuple], watermark: int, max_steps: int, idle_ms: int | None) -> tuple[list[tuple], str] | None:
    """The steps of an episode up to its end, and why it ended; None while
    that is open.  ``steps`` are in order; those up to the watermark are
    final, nothing can come before them any more.  What ended the episode
    depends on the steps' times only, not on when they arrived: a submit, the
    step cap, or ``idle_ms`` without a next step."""
    for i, step in enumerate(steps[:max_steps]):
        at = _ms(step[0])
        if at > watermark:
            return None
        if step[4]:
            return steps[:i + 1], "submit"
        if i + 1 == max_steps:
            return steps[:i + 1], "forced"
        if idle_ms is not None and watermark >= at + idle_ms and (i + 1 == len(steps) or steps[i + 1][0] > (at + idle_ms) * 1000):
            return steps[:i + 1], "timeout"
    return None


def _summary(episode, steps: list[tuple], reason: str) -> pd.DataFrame:
    counted = steps if reason == "timeout" else steps[:-1]  # the terminal step has no output
    row = (episode, len(steps), sum(s[3] for s in counted), sum(s[2] for s in counted),
           1.0 if len(steps) <= 1 else 0.0, reason)
    return pd.DataFrame([row], columns=_OUT_NAMES)


class EpisodeProcessor(StatefulProcessor):
    """State of an episode: a list of short step entries, to which a
    micro-batch's steps are appended without reading it, their number, and,
    once it has ended, until when its mark stays.  The list is read when a
    timer fires (a submit, the cap or an idle limit may have become final) and
    when it holds twice the step cap."""

    def __init__(self, max_steps: int, idle_ms: int | None, closed_ms: int):
        self.max_steps, self.idle_ms, self.closed_ms = max_steps, idle_ms, closed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getListState("steps", STEP_STATE)
        self.held = handle.getValueState("held", "n long")
        self.closed = handle.getValueState("closed", "until_ms long")

    def _ordered(self) -> list[tuple]:
        rows = [tuple(r) for r in self.steps.get()] if self.held.exists() else []
        return sorted(rows, key=lambda r: (r[0], r[1]))[:self.max_steps]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            pdf = pdf[pdf["action"] != HEARTBEAT]
            ts = pdf["ts"].astype("datetime64[us]").astype("int64")
            new += [(int(t), int(eid), len(out or ""), int(code != 0), action == "submit")
                    for t, eid, action, code, out in zip(ts, pdf["event_id"], pdf["action"], pdf["exit_code"], pdf["stdout"], strict=True)]
        if not new or self.closed.exists():
            return
        n = (self.held.get()[0] if self.held.exists() else 0) + len(new)
        self.steps.appendList(new)
        looks = {_ms(s[0]) for s in new if s[4]}
        if self.idle_ms is not None:
            looks.add(_ms(max(s[0] for s in new)) + self.idle_ms)
        self.held.update((n,))
        if n >= self.max_steps:
            kept = self._ordered()
            looks.add(_ms(kept[-1][0]))
            if n >= 2 * self.max_steps:
                self.steps.put(kept)
                self.held.update((len(kept),))
        for at in looks:
            self.handle.registerTimer(max(at, 1))
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.closed.exists():
            if now >= self.closed.get()[0]:
                self.closed.clear()
            return
        end = episode_end(self._ordered(), now, self.max_steps, self.idle_ms)
        if end is None:
            return
        self.steps.clear()
        self.held.clear()
        self.closed.update((now + self.closed_ms,))
        self.handle.registerTimer(now + self.closed_ms)
        yield _summary(key[0], *end)

    def close(self) -> None:
        pass


def episode_stream(steps: DataFrame, max_steps: int = MAX_STEPS, watermark: str = "1 hour",
                   idle_ms: int | None = None, closed_ms: int = CLOSED_MS) -> DataFrame:
    """J2/J3 on a streaming DataFrame of raw steps
    ``(episode, event_id, ts, action, exit_code, stdout)``.

    Steps first pass a watermark-aware de-duplication on ``event_id``:
    a re-delivered step is applied once, and a step that arrives behind the
    watermark is dropped there and counted by Spark
    (``numRowsDroppedByWatermark``, see ``runner.late_rows_dropped``).

    State: at most twice ``max_steps`` short entries and a micro-batch's own
    per running episode, a mark per episode closed within ``closed_ms``;
    running episodes without ``idle_ms`` stay until they end.  The session
    needs the RocksDB state store (``runner.stream_session`` sets it)."""
    s = (steps.select("episode", "event_id", F.col("ts").cast("timestamp").alias("ts"), "action",
                      "exit_code", "stdout")
         .withWatermark("ts", watermark)
         .dropDuplicatesWithinWatermark(["event_id"]))
    return s.groupBy("episode").transformWithStateInPandas(
        EpisodeProcessor(max_steps, idle_ms, closed_ms), EPISODE_OUT, "append", "EventTime")


def running_report(results: DataFrame) -> DataFrame:
    """D6 counters as a streaming aggregation (complete/update mode)."""
    b = F.col("bucket")
    return (with_bucket(results)
            .agg(F.count(F.lit(1)).alias("total_instances"),
                 count_where(b == "passed").alias("resolved_instances"),
                 count_where(b != "passed").alias("unresolved_instances"),
                 count_where(b == "error").alias("error_instances"),
                 count_where(b == "empty").alias("empty_patch_instances"))
            .withColumn("resolve_rate", safe_ratio(F.col("resolved_instances"), F.col("total_instances"))))


def new_predictions(batch: DataFrame, completed: DataFrame, taken: DataFrame) -> DataFrame:
    """The predictions of a batch for instances that are neither
    completed nor taken by an earlier batch, one per id (the smallest record
    of a batch that holds several)."""
    fields = [c for c in batch.columns if c != "instance_id"]
    one = batch.groupBy("instance_id").agg(F.min(F.struct(*fields)).alias("r")).select("instance_id", "r.*")
    return (one.join(completed.select("instance_id"), "instance_id", "left_anti")
            .join(taken.select("instance_id"), "instance_id", "left_anti"))


# worker-side functions of this module travel with the task (see shipping.py)
from ..shipping import ship_by_value  # noqa: E402

ship_by_value(__name__)
