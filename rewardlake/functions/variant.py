"""Labels of unknown shape in one VARIANT column.

A label may come as JSON text, as a struct or as a map.  As VARIANT all of
them share one column without a fixed schema; fields are asked for by path
and type, and what a label does not have is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_label(df: DataFrame, column: str) -> Column:
    """A column as VARIANT: JSON text is parsed (null if it is none), structs
    and maps with text keys are converted, anything else becomes a scalar;
    VARIANT stays."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.VariantType):
        return c
    if isinstance(kind, T.StringType):
        return F.try_parse_json(c)
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_variant_object(c)
    return c.cast("variant")


def label_field(label: Column, field: str, kind: str = "string") -> Column:
    """A top-level field of a label; null where the label is no object, has
    no such field or one of another type."""
    return F.try_variant_get(label, f"$.{field}", kind)


def label_object(label: Column) -> Column:
    """The top-level fields of a label as a map; null if it is no object."""
    return F.try_variant_get(label, "$", "map<string, variant>")


def label_id(label: Column, default: str = "unknown") -> Column:
    """H5: the instance id of a label, ``default`` where there is none."""
    return F.coalesce(label_field(label, "instance_id"), F.lit(default))


def union_labels(*frames: DataFrame, label: str = "label") -> DataFrame:
    """Rows of frames whose label columns have different types, with the
    label as VARIANT."""
    out = None
    for f in frames:
        f = f.withColumn(label, as_label(f, label))
        out = f if out is None else out.unionByName(f)
    return out


def label_fields(labels: DataFrame, label: str = "label") -> DataFrame:
    """``field, type, n``: the top-level fields that labels have, their types
    and how many labels have them."""
    return (labels.select(F.explode(F.map_entries(label_object(F.col(label)))).alias("e"))
            .groupBy(F.col("e.key").alias("field"), F.schema_of_variant(F.col("e.value")).alias("type"))
            .agg(F.count(F.lit(1)).alias("n")))
