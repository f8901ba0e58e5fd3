"""Extension: deliveries read as they arrive.

``first_deliveries`` drops repeated deliveries within a watermark, so its state
is bounded by the delay and not by the stream; ``orphan_alerts`` counts the
references of a stream of edits that a snapshot of the items does not know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.operators.orphan_refs import parent_keys, parse_handles


def stream_table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files that are dropped into a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def first_deliveries(stream: DataFrame, key: str, at: str, delay: str = "7 days") -> DataFrame:
    """Each key once, as long as its repeats come within ``delay`` of the newest time seen."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def orphan_alerts(edits: DataFrame, items: DataFrame, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """``window, missing``: references of the edits, per window of ``sent_at``, to handles that the items lack."""
    keys = parent_keys(items).select("path", "handle", F.lit(True).alias("known"))
    refs = edits.withWatermark("sent_at", delay).select("path", F.explode(parse_handles(F.col("id"))).alias("handle"), "sent_at")
    joined = refs.join(keys, ["path", "handle"], "left")
    return joined.groupBy(F.window("sent_at", window)).agg(F.count_if(F.col("known").isNull()).alias("missing"))
