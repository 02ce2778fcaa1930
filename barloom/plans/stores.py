"""Queries on stored histories and the ledger of picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import crosses_up, onset
from barloom.operators import ledger
from barloom.operators.indicators import add_indicators
from barloom.plans.queries import r
from barloom.sources import history, market

#: The day on which the stored histories end, and from which the new bars start.
STORED, FROM = "1999-01-01", "1998-12-20"
HOLD = 20


def incremental_upsert(spark, sf):
    """Histories stored up to 1999 and the bars since the last ten days of 1998, merged; codes whose number ends in 1 were stored before a split in two."""
    full = market.bars(spark, sf).select(*history.BARS)
    twice = F.when(F.col("code").endswith("1"), 2.0).otherwise(1.0)
    old = full.where(F.col("date") < F.lit(STORED).cast("date")).withColumns({x: F.col(x) * twice for x in ("open", "high", "low", "close")})
    m = history.merge_bars(old, full.where(F.col("date") >= F.lit(FROM).cast("date")), full, since="1995-06-01")
    return m.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), r(F.sum("close"), 2).alias("closes"))


def columnar_history(spark, sf):
    """Each code's history as one row of integer arrays."""
    c = history.columnar(market.bars(spark, sf))
    return c.select("code", "scale", *[F.array_join(F.col(k).cast("array<string>"), ",").alias(k) for k in "tohlcv"])


def _picks(spark, sf):
    d = add_indicators(market.bars(spark, sf)).withColumn("__up", crosses_up(F.col("ma5"), F.col("ma20")))
    d = d.withColumn("__on", onset(F.col("__up"))).where(F.col("__on") & F.col("atr_pct").isNotNull())
    price = lambda k: F.col("close") * (1 + k * F.col("atr_pct"))
    return d.select(F.concat_ws("|", "code", F.date_format("date", "yyyy-MM-dd")).alias("id"), "code", "date", price(2.0).alias("target"), price(-1.5).alias("stop"), F.lit(HOLD).alias("h"))


def pick_ledger(spark, sf):
    """Golden crosses as picks with target and stop by the range, scored over the bars that followed."""
    s = ledger.score_picks(_picks(spark, sf), market.bars(spark, sf))
    return s.select("id", "status", r("entry", 7).alias("entry"), "exit_date", r("exit", 7).alias("exit"), r("ret", 6).alias("ret"), "days")


def pick_summary(spark, sf):
    s = ledger.ledger_summary(ledger.score_picks(_picks(spark, sf), market.bars(spark, sf)))
    return s.select("total", "closed", "open", *[r(k, 6).alias(k) for k in ("win", "mean", "days")])


STORE_QUERIES = {f.__name__: f for f in (incremental_upsert, columnar_history, pick_ledger, pick_summary)}
