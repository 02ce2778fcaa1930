"""Queries on the last bar of each code: swings and phases, retracements, volume zones, levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import levels
from barloom.operators.indicators import add_indicators, add_moving
from barloom.plans.queries import r
from barloom.sources import market


def swing_phases(spark, sf):
    """The swing of the last 120 bars, its phase and its retracement prices."""
    p = levels.retracements(levels.phases(add_moving(market.bars(spark, sf))))
    shares = [r(k, 6).alias(k) for k in ("fall", "rise", "back", "span", "rebound")]
    return p.select("code", "days", "high", "low", "after", *shares, "phase", "kind", F.array_join(F.transform("fib", lambda x: x.cast("decimal(18,1)").cast("string")), "|").alias("fib"))


def volume_zones(spark, sf):
    return levels.volume_zones(market.bars(spark, sf))


def price_levels(spark, sf):
    """Three supports and resistances of each code from pivots, averages, retracements, volume zones and the year's ends."""
    return levels.price_levels(add_indicators(market.bars(spark, sf)))


REPORT_QUERIES = {f.__name__: f for f in (swing_phases, volume_zones, price_levels)}
