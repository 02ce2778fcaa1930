"""Quote streams: bars by event-time window, and alerts on them.

The bars are the same plan as in batch (``operators.studies.quote_bars``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.studies import quote_bars

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over the Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def stream_bars(quotes: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars that are final once the watermark has passed their window."""
    return quote_bars(quotes, width, late)


def stream_alerts(quotes: DataFrame, levels: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first quote of a code and side past its level: ``levels (event_type, above, below)``; stream-static join."""
    side = F.when(F.col("value") >= F.col("above"), "above").when(F.col("value") <= F.col("below"), "below")
    hits = quotes.withWatermark("ts", late).join(levels, "event_type").withColumn("side", side).where("side is not null")
    return hits.dropDuplicates(["event_type", "side"]).select("event_type", "side", "ts", "value")
