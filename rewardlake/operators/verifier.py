"""The verifier extension point.

A verifier maps patch contexts ``(instance_id, patch, changed_files,
task_id, metadata)`` to result rows ``(instance_id, name, status, score,
pass_threshold, wall_clock_seconds, details)``.  Two forms:

* ``ColumnVerifier``: a ``DataFrame -> DataFrame`` built from Column
  expressions (stays in the JVM; preferred).
* ``PythonVerifier``: a per-row Python check run through ``mapInPandas`` in
  Arrow batches.  Every row is isolated in a child process of the worker
  (``guard.py``): an exception, a lack of memory or a process that ends
  becomes an ``error`` result (score 0.0, type and message in ``details``),
  and a check that is still running at the verifier's limit is killed and
  becomes ``timeout`` (score 0.0); the rows after it get a new process.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_FINAL_VERIFIERS
from .guard import Guard, Outcome

RESULT_SCHEMA = ("instance_id string, name string, status string, score double, pass_threshold double, "
                 "wall_clock_seconds double, details string")

DEFAULT_FINAL = DEFAULT_FINAL_VERIFIERS


@dataclass(frozen=True)
class ColumnVerifier:
    name: str
    mode: str  # 'static' or 'dynamic'
    fn: Callable[[DataFrame], DataFrame]
    pass_threshold: float = 1.0

    def run(self, contexts: DataFrame) -> DataFrame:
        out = self.fn(contexts)
        return out.select("instance_id", F.lit(self.name).alias("name"), "status",
                          F.col("score").cast("double").alias("score"),
                          F.lit(self.pass_threshold).alias("pass_threshold"),
                          F.lit(0.0).alias("wall_clock_seconds"),
                          F.coalesce(F.col("details"), F.lit("{}")).alias("details")
                          if "details" in out.columns else F.lit("{}").alias("details"))


def checked_result(outcome: Outcome) -> tuple[str, float, dict]:
    """Status, score and details recorded for a guarded check."""
    if outcome.kind == "ok":
        return outcome.value
    if outcome.kind == "timeout":
        return "timeout", 0.0, {"timeout": outcome.value}
    kind, message = outcome.value if outcome.kind == "raised" else ("ProcessDied", outcome.value)
    return "error", 0.0, {"error": message, "error_type": kind}


@dataclass(frozen=True)
class PythonVerifier:
    """``check(row: dict) -> (status, score, details: dict)``, stopped after
    ``timeout_seconds`` and held to ``memory_mb`` more than the worker has."""
    name: str
    mode: str
    check: Callable[[dict], tuple[str, float, dict]]
    pass_threshold: float = 1.0
    timeout_seconds: float = 60.0
    memory_mb: int | None = 2048

    def run(self, contexts: DataFrame) -> DataFrame:
        name, check, thr, limit, memory = self.name, self.check, self.pass_threshold, self.timeout_seconds, self.memory_mb

        def one(rec: dict) -> tuple[str, float, str]:
            status, score, details = check(rec)
            return status, float(score), json.dumps(details, default=str)

        def batches(it):
            with Guard(one, limit, memory) as guard:
                for pdf in it:
                    rows = []
                    recs = pdf.to_dict("records")
                    for rec, outcome in zip(recs, guard.map(recs), strict=True):
                        status, score, details = checked_result(outcome)
                        details = details if isinstance(details, str) else json.dumps(details)
                        rows.append((rec["instance_id"], name, status, score, thr, outcome.seconds, details))
                    yield pd.DataFrame(rows, columns=["instance_id", "name", "status", "score", "pass_threshold",
                                                      "wall_clock_seconds", "details"])

        return contexts.mapInPandas(batches, RESULT_SCHEMA)


def verifier_config(verifiers, intermediate: list[str] | None, final: list[str] | None, spark) -> DataFrame:
    """B10 + F3: the verifier set a run uses.  No final list -> only the unit
    test verifier; a verifier named in neither list is left out; each
    requested name appears once (intermediate first, then final)."""
    final = list(final) if final else list(DEFAULT_FINAL)
    inter = list(intermediate or [])
    requested = list(dict.fromkeys(inter + final))
    by_name = {v.name: v for v in verifiers}
    unknown = [n for n in requested if n not in by_name]
    if unknown:
        raise ValueError(f"unknown verifiers: {unknown}")
    rows = [(i + 1, n, by_name[n].mode, n in inter, n in final, float(by_name[n].pass_threshold), 1.0)
            for i, n in enumerate(requested)]
    return spark.createDataFrame(rows, "ord int, name string, mode string, run_intermediate boolean, "
                                       "run_final boolean, pass_threshold double, weight double")


def run_verifier_set(contexts: DataFrame, verifiers, names: list[str]) -> DataFrame:
    """run the static verifiers and the dynamic ones on the same contexts
    and union their results (each verifier is one DataFrame branch)."""
    by_name = {v.name: v for v in verifiers}
    chosen = [by_name[n] for n in names]
    static = [v.run(contexts) for v in chosen if v.mode == "static"]
    dynamic = [v.run(contexts) for v in chosen if v.mode == "dynamic"]
    parts = static + dynamic
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# worker-side functions of this module travel with the task (see shipping.py)
from ..shipping import ship_by_value  # noqa: E402

ship_by_value(__name__)
