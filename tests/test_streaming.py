"""A stream over files gives the bars of the batch plan."""

import shutil
import tempfile

from barloom.operators.studies import quote_bars
from barloom.streaming.quotes import read_quotes, stream_alerts, stream_bars


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_stream_bars_equal_batch_bars(spark, sf_dir):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    shutil.copy(f"{sf_dir}/events.parquet", f"{folder}/a.parquet")
    drain(stream_bars(read_quotes(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("bars_out").start())
    batch = quote_bars(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour")
    got = spark.table("bars_out").select(*batch.columns)
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0


def test_alerts_fire_once_a_side(spark, sf_dir):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    shutil.copy(f"{sf_dir}/events.parquet", f"{folder}/a.parquet")
    levels = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type", "0.0 as above", "-1.0 as below").distinct()
    drain(stream_alerts(read_quotes(spark, folder), levels).writeStream.outputMode("append").format("memory").queryName("alerts_out").start())
    assert spark.table("alerts_out").count() == spark.table("alerts_out").select("event_type", "side").distinct().count() > 0
