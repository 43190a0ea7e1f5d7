"""Math-answer rewards as staged projections.

``functions.text.answer_reward`` is one nested expression; inside CASE
branches Spark cannot share the repeated extraction work.  Here each
intermediate is its own column: Catalyst keeps a non-cheap expression that
is referenced more than once in its own projection instead of inlining it
twice, so every regex runs once per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ANSWER_TOLERANCE
from ..functions.text import extract_answer, normalize_number, strip_prompt, truthy


def score_answers(df: DataFrame, query: str = "query", prompt: str = "prompt", label: str = "label") -> DataFrame:
    """Adds response, pred_text, pred_num, gold_num and reward."""
    staged = (df.withColumn("response", strip_prompt(F.col(query), F.col(prompt)))
              .withColumn("pred_text", extract_answer("response"))
              .withColumn("gold_text", F.when(truthy(F.col(label)), extract_answer(label))))
    staged = (staged.withColumn("pred_num", normalize_number("pred_text"))
              .withColumn("gold_num", F.when(truthy(F.col("gold_text")), normalize_number("gold_text"))
                          .otherwise(normalize_number(label))))
    p, g = F.col("pred_num"), F.col("gold_num")
    ok = p.isNotNull() & g.isNotNull() & ~F.isnan(p) & ~F.isnan(g) & F.coalesce(F.abs(p - g) < ANSWER_TOLERANCE, F.lit(False))
    return staged.withColumn("reward", F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0))).drop("gold_text")


def accuracy(scored: DataFrame) -> DataFrame:
    """Mean 0/1 reward (in double) over the batch."""
    return scored.agg(F.count(F.lit(1)).alias("n_samples"), F.avg("reward").alias("accuracy"))
