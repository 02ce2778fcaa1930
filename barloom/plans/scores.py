"""Queries on scores: walk-forward learning, calibration, bands, and contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.expr import lag, lead, pct_rank
from barloom.operators import panels, scoring
from barloom.operators.indicators import add_indicators
from barloom.plans.panels import LEAST
from barloom.plans.queries import r
from barloom.sources import market

#: Days from the signal to the end of a forward return.
HORIZON = 20
FEATURES = ["rsi", "sto_k", "adx", "dmi", "bb_pos", "bb_width", "atr_pct", "vol_r", "d_ma5", "d_ma20", "d_ma60", "ret5", "ret20", "ret60", "hi52"]


def _panel(spark, sf) -> DataFrame:
    """Trading days with features, the forward return less the day's mean (``excess``), and momentum's rank."""
    d = add_indicators(panels.panel(market.bars(spark, sf), LEAST))
    c, col = F.col("close"), F.col
    d = d.withColumns(
        {
            "dmi": col("pdi") - col("mdi"), "bb_pos": F.try_divide(c - col("bb_lower"), col("bb_upper") - col("bb_lower")), "vol_r": F.try_divide(col("volume"), col("vol_ma20")),
            "d_ma5": c / col("ma5") - 1, "d_ma20": c / col("ma20") - 1, "d_ma60": c / col("ma60") - 1, "ret5": c / lag("close", 5) - 1, "ret20": c / lag("close", 20) - 1, "hi52": c / col("hh252") - 1,
            "fwd": F.try_divide(lead("close", HORIZON), lead("open", 1)) - 1,
        }
    )
    return d.withColumn("fwd", F.when(F.abs("fwd") <= 3, F.col("fwd")))


def _targets(d: DataFrame) -> DataFrame:
    """``excess``: the forward return within its first and last percentile, less the day's mean."""
    bounds = d.agg(F.percentile("fwd", F.array(F.lit(0.01), F.lit(0.99))).alias("__q")).withColumn("__one", F.lit(1))
    d = d.withColumn("__one", F.lit(1)).join(F.broadcast(bounds), "__one")  # one row
    d = d.withColumn("__y", F.when(F.col("fwd").isNotNull(), F.greatest(F.least("fwd", F.get("__q", F.lit(1))), F.get("__q", F.lit(0)))))
    day = d.groupBy("date").agg(F.avg("__y").alias("__mean"))
    return d.join(day, "date").withColumn("excess", F.col("__y") - F.col("__mean")).drop("__one", "__q", "__y", "__mean")


def walk_forward_scores(spark, sf):
    """By fold of 126 days: days, rows, mean rank correlation of the score with the return that followed, and the return of the day's upper fifth less the day's mean."""
    d = scoring.daily_ranks(_targets(_panel(spark, sf)), FEATURES).select("code", "date", "day", "fwd", "excess", *[f"z_{f}" for f in FEATURES])
    days = d.agg(F.max("day")).first()[0] or 0
    s = scoring.walk_forward(d, [f"z_{f}" for f in FEATURES], "excess", days, HORIZON)
    s = s.withColumn("rank", pct_rank("pred", ["date"]))
    ic = panels.rank_ic(s, "pred", "fwd", LEAST).join(s.select("date", "fold").distinct(), "date").groupBy("fold").agg(F.count(F.lit(1)).alias("n_days"), r(F.avg("ic"), 6).alias("ic"))
    top = s.groupBy("fold").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("fwd").alias("n"), r(F.avg(F.when(F.col("rank") > 0.8, F.col("excess"))), 6).alias("top_excess"))
    return top.join(ic, "fold", "left")


def _momentum(spark, sf) -> DataFrame:
    """Momentum's rank of the day and the forward return in units of the day's range."""
    d = add_indicators(panels.panel(market.bars(spark, sf), LEAST))
    d = d.withColumns({"mom": F.col("close") / lag("close", 60) - 1, "fwd": F.try_divide(lead("close", HORIZON), lead("open", 1)) - 1})
    d = d.where(F.col("mom").isNotNull() & F.col("fwd").isNotNull() & (F.abs("fwd") <= 3) & (F.col("atr_pct") > 0))
    return d.select("code", "date", "day", F.round(pct_rank("mom", ["date"]), 9).alias("rank"), (F.col("fwd") / F.greatest(F.col("atr_pct"), F.lit(0.005))).alias("value"))


def score_calibration(spark, sf):
    """Means of the return by bucket of momentum's rank, the rising curve through them, and that curve at the bucket's ends."""
    b = scoring.bucket_means(_momentum(spark, sf), "rank", "value")
    curve = scoring.monotone(b).withColumn("__one", F.lit(1))
    d = b.withColumn("__one", F.lit(1)).join(F.broadcast(curve), "__one")  # one row of knots
    at = lambda x: r(scoring.interpolate(x, F.col("xs"), F.col("ys")), 6)
    return d.select("bucket", "lo", "hi", "n", r("mean", 6).alias("mean"), at((F.col("lo") + F.col("hi")) / 2).alias("fitted"), at(F.col("lo")).alias("at_lo"), at(F.col("hi")).alias("at_hi"))


def band_coverage(spark, sf):
    """How often the bands by tenth of momentum, made on the first two thirds of the days, hold on the last third."""
    d = _momentum(spark, sf)
    days = d.select("date").distinct()


    last = days.select("date", (F.row_number().over(W.orderBy("date")) <= F.floor(F.count(F.lit(1)).over(W.partitionBy()) * F.lit(2 / 3))).alias("first"))
    out = scoring.band_coverage(d.join(last, "date"), "rank", "value", F.col("first"))
    return out.select("n", *[r(k, 6).alias(k) for k in ("outer", "inner", "over_median")])


def factor_contributions(spark, sf):
    """The last day's codes by a linear stand-in for the forward rank on daily ranks, with the three inputs that raise it most."""
    d = scoring.daily_ranks(_panel(spark, sf), FEATURES)
    d = d.withColumn("__y", pct_rank("fwd", ["date"]) - 0.5)
    inputs = [f"z_{f}" for f in FEATURES]
    coefficients = scoring.ridge(d, inputs, "__y")
    if not coefficients:
        return d.limit(0).select("code", "date", F.lit(0.0).alias("score"), F.lit("").alias("reasons"))
    score = sum((F.lit(c) * F.col(x) for x, c in coefficients.items()), F.lit(0.0))
    d = d.withColumns({"score": score, "why": scoring.contributions(coefficients)})
    last = d.agg(F.max("date").alias("date"))
    names = F.array_join(F.transform("why", lambda p: F.regexp_replace(p["name"], "^z_", "")), "+")
    return d.join(F.broadcast(last), "date").select("code", "date", r("score", 6).alias("score"), names.alias("reasons"))


SCORE_QUERIES = {f.__name__: f for f in (walk_forward_scores, score_calibration, band_coverage, factor_contributions)}
