"""Queries on sectors and opinions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import lag, pct_rank
from barloom.operators import panels, rating
from barloom.plans.panels import LEAST
from barloom.plans.queries import r
from barloom.sources import market


def _panel(spark, sf):
    # brands have no sectors: the first digit of their numbers stands for one
    listing = market.listing(spark, sf).select("code", "marcap", F.substring("code", 7, 1).alias("sector"))
    return panels.panel(market.bars(spark, sf), LEAST).join(listing, "code")


def market_betas(spark, sf):
    """Each code's 60-day beta on the last bar of every month."""
    d = _panel(spark, sf)
    b = rating.market_beta(d, panels.market_return(d)).where("beta is not null")
    month = F.trunc("date", "month")
    return b.groupBy("code", month.alias("month")).agg(F.max_by("beta", "date").alias("beta")).select("code", "month", r("beta", 6).alias("beta"))


def sector_ranks(spark, sf):
    """Sectors (first digit of the brand) by day: figures against the market, score and place."""
    s = rating.sector_scores(_panel(spark, sf), "sector")
    return s.select("date", "sector", *[r(k, 6).alias(k) for k in ("r5", "r20", "r60", "breadth", "amount", "near_high", "score")], "place")


def opinion_changes(spark, sf):
    """Opinions by 60-day momentum's rank, and the last twelve changes of each code."""
    d = panels.panel(market.bars(spark, sf), LEAST).withColumn("mom", F.col("close") / lag("close", 60) - 1)
    d = d.withColumn("rank", pct_rank("mom", ["date"]))
    return rating.changes(rating.opinions(d, "rank"), "opinion")


RATING_QUERIES = {f.__name__: f for f in (market_betas, sector_ranks, opinion_changes)}
