"""Job logs read once for any number of agents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def dispatch(logs: DataFrame, agents: Mapping[str, str], model_name: str = "agent-model") -> DataFrame:
    """Every agent's prediction from every log ``(instance_id, logs)``,
    with the log's apply status.  ``agents`` maps a name to its extraction
    (``preds_json:...`` reads the JSON block, any other the patch block).

    One scan: a log's markers are looked for once (``log_marks``), each kind
    of block that some agent needs is cut out once, and only the short
    extracts are multiplied by the agents; a null log gives empty extracts."""
    kinds = {a: "preds" if e.startswith("preds_json:") else "raw" for a, e in agents.items()}
    name = F.lit(model_name)
    marked = logs.select("instance_id", F.coalesce("logs", F.lit("")).alias("_log")).withColumn("_marks", T.log_marks("_log"))
    found = {"raw": F.struct(F.col("instance_id"), T.marked_block("_log", F.col("_marks"), "patch").alias("model_patch"),
                             name.alias("model_name_or_path")),
             "preds": T.block_predictions(T.marked_block("_log", F.col("_marks"), "preds"), F.col("instance_id"), name)}
    cut = marked.select("instance_id", T.marked_status(F.col("_marks")).alias("apply_status"),
                        *[found[k].alias(f"_{k}") for k in dict.fromkeys(kinds.values())])
    rows = F.array(*[F.struct(F.lit(a).alias("agent"), F.col(f"_{k}").alias("p")) for a, k in kinds.items()])
    return cut.select("instance_id", "apply_status", F.inline(rows)).select(
        "agent", "instance_id", F.col("p.instance_id").alias("pred_instance_id"), "p.model_patch", "p.model_name_or_path",
        "apply_status")
