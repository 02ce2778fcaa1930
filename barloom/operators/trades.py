"""Forward returns and trade simulation: a signal at a close is bought at the next open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import by_code, lag, lead

COST = 0.0025


def horizon_return(h: int, cost: float = COST) -> Column:
    """close(t+h) / open(t+1) - 1 - cost; null beyond the series and for moves over 300 %."""
    r = F.try_divide(lead("close", h), lead("open", 1)) - 1 - cost
    return F.when(F.abs(r) <= 3, r)


def barrier_exit(d: DataFrame, h: int, target: float, stop: float, cap: float = 0.08, cost: float = COST) -> DataFrame:
    """Add ``ret, days, outcome`` of a trade with a target and a stop, both multiples of the ATR share.

    The stop is tested before the target on a bar; a gap fills at the open;
    after ``h`` bars the close ends it. Null without ``h`` further bars and
    without a positive entry. The next bars are one array per row: a window,
    no self-join; ``exits.signals`` keeps it for signal rows only.
    """
    ahead = F.collect_list(F.struct("open", "high", "low", "close")).over(by_code(1, h))
    k = F.least(F.col("atr_pct"), F.lit(cap))
    d = d.withColumn("__f", ahead).withColumn("__entry", F.get("__f", F.lit(0))["open"])
    d = d.withColumn("__t", F.col("__entry") * (1 + target * k)).withColumn("__s", F.col("__entry") * (1 - stop * k))
    down = F.array_position(F.transform("__f", lambda b: b["low"] <= F.col("__s")), True)
    up = F.array_position(F.transform("__f", lambda b: b["high"] >= F.col("__t")), True)
    d = d.withColumn("__d", F.when(down > 0, down).otherwise(h + 1)).withColumn("__u", F.when(up > 0, up).otherwise(h + 1))
    stopped, hit = (F.col("__d") <= h) & (F.col("__d") <= F.col("__u")), F.col("__u") <= h
    bar = lambda at: F.get("__f", (at - 1).cast("int"))
    price = F.when(stopped, F.least(bar(F.col("__d"))["open"], F.col("__s"))).when(hit, F.greatest(bar(F.col("__u"))["open"], F.col("__t"))).otherwise(F.get("__f", F.lit(h - 1))["close"])
    whole = (F.size("__f") == h) & F.col("__t").isNotNull() & (F.col("__entry") > 0)
    return (
        d.withColumn("ret", F.when(whole, price / F.col("__entry") - 1 - cost))
        .withColumn("days", F.when(whole, F.least(F.least("__d", "__u"), F.lit(h))))
        .withColumn("outcome", F.when(whole, F.when(stopped, "stop").when(hit, "target").otherwise("time")))
        .drop("__f", "__entry", "__t", "__s", "__d", "__u")
    )


def trade_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Count, win rate, mean, lower bound of the mean and profit factor of ``ret``."""
    r = F.col("ret")
    gain, loss = F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, -r))
    return df.where(r.isNotNull()).groupBy(*by).agg(
        F.count(r).alias("n"),
        F.round(F.avg((r > 0).cast("double")), 6).alias("win_rate"),
        F.round(F.avg(r), 6).alias("mean_ret"),
        F.round(F.avg(r) - 1.64 * F.stddev_pop(r) / F.sqrt(F.count(r)), 6).alias("lower_bound"),
        F.round(F.try_divide(gain, loss), 4).alias("profit_factor"),
    )


def drawdown(d: DataFrame) -> DataFrame:
    """Add the running peak's distance from the close."""
    from pyspark.sql import Window as W

    return d.withColumn("dd", F.col("close") / F.max("close").over(by_code(W.unboundedPreceding)) - 1)


def streak(d: DataFrame, x: str) -> DataFrame:
    """Add ``streak``: rows of the current run of one sign of ``x``, signed; 0 where x is 0 or missing."""
    from pyspark.sql import Window as W

    sign = F.coalesce(F.signum(F.col(x)), F.lit(0.0)).cast("int")
    d = d.withColumn("__s", sign).withColumn("__new", F.when(F.col("__s") == lag("__s"), 0).otherwise(1))
    d = d.withColumn("__run", F.sum("__new").over(by_code(W.unboundedPreceding)))
    inside = W.partitionBy("code", "__run").orderBy("date")
    return d.withColumn("streak", F.col("__s") * F.row_number().over(inside)).drop("__s", "__new", "__run")
