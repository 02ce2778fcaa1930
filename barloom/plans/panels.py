"""Queries over panels of codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import flag, lag, lead, mean, pct_rank, rolling
from barloom.operators import panels
from barloom.sources import market

#: Codes of a day, at least (the tables have 25 codes).
LEAST = 10
BAN = ("1996-01-01", "1996-03-31")


def rounded(d, digits: int, *names):
    return d.withColumns({k: F.round(k, digits) for k in names})


def market_returns(spark, sf):
    """Equal-weight return and return by the weights of the day before, over trading days."""
    d = panels.panel(market.bars(spark, sf), LEAST).join(F.broadcast(market.listing(spark, sf).select("code", "marcap")), "code")
    return rounded(panels.market_return(d), 6, "equal", "weighted")


def equity_metrics(spark, sf):
    return rounded(panels.equity_metrics(market.bars(spark, sf)), 4, "total", "cagr", "mdd", "vol", "sharpe")


def periodic_returns(spark, sf):
    """Yearly and monthly returns of each code."""
    d = market.bars(spark, sf)
    both = [panels.periodic_return(d, u).withColumn("unit", F.lit(u)) for u in ("year", "month")]
    return rounded(both[0].unionByName(both[1]), 6, "ret")


def _momentum(spark, sf):
    d = market.bars(spark, sf).select("code", "date", "close")
    return d.withColumns({"mom": F.col("close") / lag("close", 60) - 1, "fwd": lead("close", 20) / F.col("close") - 1, "ma120": mean("close", 120)})


def rank_ic_by_year(spark, sf):
    """Rank correlation of 60-day momentum with the next 20 days' return, day by day, by year."""
    d = panels.rank_ic(_momentum(spark, sf), "mom", "fwd", LEAST)
    return d.groupBy(F.year("date").alias("year")).agg(F.count("ic").alias("n_days"), F.round(F.avg("ic"), 5).alias("mean_ic"), F.round(F.avg((F.col("ic") > 0).cast("double")), 5).alias("positive"))


def momentum_bands(spark, sf):
    """Bands of the next 20 days' return by tenth of the day's momentum rank and trend, returns winsorised by year."""
    d = _momentum(spark, sf).withColumn("year", F.year("date"))
    d = panels.winsorised(d, "fwd", "year").withColumn("score", pct_rank("mom", ["date"])).withColumn("up", F.col("close") > F.col("ma120"))
    return rounded(panels.bands(d, "score", "up", "fwd", 1000), 5, "mean", "p10", "p50", "p90", "win", "bound")


def capped_picks(spark, sf):
    """The five codes of most momentum on each day, three of a market at most."""
    d = _momentum(spark, sf).join(F.broadcast(market.listing(spark, sf).select("code", "market")), "code")
    return panels.capped_top(d, "mom", "market", 5, 3).select("date", "place", "code", "market", F.round("mom", 6).alias("mom"))


def _short_frame(spark, sf):
    """Returned quantities stand for short sales, their sum over ten reports for the balance, and the size for the shares."""
    line, part = market.table(spark, sf, "lineitem"), market.table(spark, sf, "part")
    sold = line.where("l_returnflag = 'R'").join(part, F.col("l_partkey") == F.col("p_partkey"))
    sold = sold.groupBy(F.col("p_brand").alias("code"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("sv"))
    shorts = sold.withColumn("bal", rolling(F.sum("sv"), "sv", 10, 1))
    shares = market.listing(spark, sf).select("code", (F.col("marcap") / 1e6).alias("shares"))
    return panels.short_frame(market.bars(spark, sf).join(F.broadcast(shares), "code"), shorts, [BAN])


def short_sale_study(spark, sf):
    return rounded(panels.short_study(_short_frame(spark, sf), LEAST), 5, "excess", "win")


def short_sale_fifths(spark, sf):
    return rounded(panels.short_fifths(_short_frame(spark, sf)), 5, "mean", "win")


def signal_overlap(spark, sf):
    """Days above the 20-day mean and days of much volume: both, either, one alone."""
    d = market.bars(spark, sf)
    d = d.select("code", "date", flag(F.col("close") > mean("close", 20)).alias("a"), flag(F.col("volume") > 1.5 * mean("volume", 20)).alias("b"))
    return panels.signal_sets(d.where("a").select("code", "date"), d.where("b").select("code", "date"))


PANEL_QUERIES = {f.__name__: f for f in (market_returns, equity_metrics, periodic_returns, rank_ic_by_year, momentum_bands, capped_picks, short_sale_study, short_sale_fifths, signal_overlap)}
