"""Image lists and the mirror job's bookkeeping.

The mirror job walks the sorted image list and stops at the first
rate-limit failure.  Set-wise: the first stop position is a global minimum
(one partial aggregation) used as a scalar subquery, so no row order has to
be materialised on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import image_dest, repo_key


def unique_images(images: DataFrame) -> DataFrame:
    """Distinct image refs of the instances that produced one (a null
    ref is an instance whose test spec failed)."""
    return images.filter(F.col("image").isNotNull()).select("image").distinct()


def image_summary(images: DataFrame) -> DataFrame:
    """Instances, unique images and failed instances."""
    return images.agg(F.count(F.lit(1)).alias("instances"),
                      F.count_distinct("image").alias("unique_images"),
                      F.count_if(F.col("image").isNull()).alias("failed"))


def images_per_repo(images: DataFrame) -> DataFrame:
    """Unique images per repository key."""
    return (unique_images(images).groupBy(repo_key(F.col("image")).alias("repo"))
            .agg(F.count(F.lit(1)).alias("images")))


def mirror_pending(images: DataFrame, registry: str) -> DataFrame:
    """Destination refs still to copy: rewritable (``:latest``) unique
    images whose destination is not mirrored yet (left anti join)."""
    dest = image_dest(F.col("image"), registry, strict=True)
    wanted = unique_images(images).select(dest.alias("dest")).filter(F.col("dest").isNotNull())
    done = (images.filter(F.col("mirrored") & F.col("image").isNotNull())
            .select(dest.alias("dest")).filter(F.col("dest").isNotNull()))
    return wanted.join(done, "dest", "left_anti")


def mirror_lines(images: DataFrame, registry: str, copy_result: Column) -> DataFrame:
    """One row per line of the image list with what the job would do:
    'bad_tag' (not ``:latest``, counted as failed), 'skip' (already in the
    registry), or the recorded copy result ('ok', 'error', 'rate_limit').
    ``copy_result`` is evaluated per image over its records."""
    per_image = (images.filter(F.col("image").isNotNull()).groupBy("image")
                 .agg(F.bool_or("mirrored").alias("mirrored"), F.min(copy_result).alias("copy")))
    dest = image_dest(F.col("image"), registry, strict=True)
    return per_image.select(
        "image",
        F.when(dest.isNull(), F.lit("bad_tag")).when(F.col("mirrored"), F.lit("skip"))
        .otherwise(F.col("copy")).alias("action"))


def mirror_tally(lines: DataFrame) -> DataFrame:
    """D16 + E9: total, pulled, skipped, failed and remaining for a run that
    stops at the first rate-limit line (in image order); lines from there on
    are remaining."""
    first_stop = lines.filter(F.col("action") == "rate_limit").agg(F.min("image")).scalar()
    before = F.coalesce(F.col("image") < first_stop, F.lit(True))
    a = F.col("action")
    t = lines.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(before & (a == "ok")).alias("pulled"),
        F.count_if(before & (a == "skip")).alias("skipped"),
        F.count_if(before & a.isin("bad_tag", "error")).alias("failed"))
    return t.select("total", "pulled", "skipped", "failed",
                    (F.col("total") - F.col("pulled") - F.col("skipped") - F.col("failed")).alias("remaining"))
