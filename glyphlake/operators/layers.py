"""Visibility of layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible_items(items: DataFrame, layers: DataFrame, frozen: bool = False, locked: bool = False, off: bool = False, leaders: bool = False) -> DataFrame:
    """Items whose layer is shown; the switches let hidden kinds of layers in.

    A blank or unknown layer is shown.  Names are compared in any letter case; a
    name that a drawing has twice is hidden if either row is.  Leaders are not
    filtered unless ``leaders`` is set.  The layers are joined by path and name,
    not broadcast: their number grows with the drawings.
    """
    flag = lambda c, let_in: F.lit(False) if let_in else F.coalesce(c, F.lit(False))
    hidden = flag(F.col("frozen"), frozen) | flag(F.col("locked"), locked) | flag(F.col("off"), off)
    state = layers.groupBy("path", F.upper("name").alias("layer_key")).agg(F.bool_or(hidden).alias("hidden")).where("hidden")
    left = items.withColumn("layer_key", F.upper(F.when(F.trim("layer_name") != "", F.col("layer_name"))))
    joined = left.join(state, ["path", "layer_key"], "left")
    free = F.lit(False) if leaders else F.col("entity_type") == "MLeader"
    return joined.where(free | F.col("hidden").isNull()).select(*items.columns)
