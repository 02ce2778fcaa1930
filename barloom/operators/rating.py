"""Sectors and opinions day by day: market beta, sector indices with their ranks, levels of a score and when they changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.expr import by_code, highest, lag, mean, pct_rank
from barloom.operators.panels import daily_return

#: Ranks from which an opinion is strong buy (2), buy (1), neutral (0), sell (-1); below it is -2.
CUTS = (0.95, 0.75, 0.25, 0.05)
#: Bounds of a day's return.
LEAST_RETURN, MOST_RETURN = -0.5, 1.0


def market_beta(d: DataFrame, market: DataFrame, n: int = 60, least: int = 40) -> DataFrame:
    """Panel rows with ``beta``: the mean product of the code's and the market's returns over the mean square of the market's, over ``n`` rows of a code (``least`` of them)."""
    d = d.withColumn("__r", F.col("close") / lag("close") - 1).join(market.select("date", F.col("weighted").alias("__m")), "date")
    d = d.withColumns({"__rm": F.col("__r") * F.col("__m"), "__mm": F.col("__m") * F.col("__m")})
    return d.withColumn("beta", F.try_divide(mean("__rm", n, least), mean("__mm", n, least))).drop("__r", "__m", "__rm", "__mm")


def _growth(n: int) -> Column:
    w = W.partitionBy("__of").orderBy("date")
    return F.exp(F.col("__log") - F.lag("__log", n).over(w)) - 1


def _levels(d: DataFrame, by: list[str]) -> DataFrame:
    """Logarithm of the index of each group: returns by the weights of the day before."""
    both = F.col("__r").isNotNull() & F.col("__w").isNotNull()
    day = d.groupBy("date", *by).agg(F.coalesce(F.try_divide(F.sum(F.when(both, F.col("__r") * F.col("__w"))), F.sum(F.when(both, F.col("__w")))), F.lit(0.0)).alias("__i"))
    day = day.withColumn("__of", F.col(by[0]) if by else F.lit("market"))
    # a row a day and group
    return day.withColumn("__log", F.sum(F.log1p("__i")).over(W.partitionBy("__of").orderBy("date").rowsBetween(W.unboundedPreceding, 0)))


def sector_scores(d: DataFrame, by: str, least: int = 3) -> DataFrame:
    """Sectors of ``least`` codes or more by day: returns over the market's, breadth, share of traded value, and their rank.

    Needs panel rows (``panels.panel``) with ``marcap`` and the sector ``by``.
    Returns ``date, by, r5, r20, r60, breadth, amount, near_high, score, place``.
    ``score`` is the mean of five ranks of the day; ranks of missing figures
    are missing, and so is their mean. ``place`` 1 is the best, ties share.
    """
    sizes = d.groupBy(by).agg(F.count_distinct("code").alias("__k")).where(F.col("__k") >= least).select(by)
    r = F.greatest(F.least(daily_return(), F.lit(MOST_RETURN)), F.lit(LEAST_RETURN))
    d = d.withColumns({"__r": r, "__w": F.when(lag("day") == F.col("day") - 1, F.col("marcap") * lag("close")), "__amt": F.col("close") * F.col("volume")})
    d = d.withColumns({"__a5": mean("__amt", 5, 3), "__a60": mean("__amt", 60, 30), "__m20": mean("close", 20, 15), "__h": highest("high", 250, 120)})
    whole = _levels(d, [])
    whole = whole.select("date", *[_growth(n).alias(f"__g{n}") for n in (5, 20, 60)])
    total = d.groupBy("date").agg(F.sum("__a5").alias("__t5"), F.sum("__a60").alias("__t60"))
    mine = d.join(sizes, by)
    index = _levels(mine, [by]).select("date", by, *[_growth(n).alias(f"g{n}") for n in (5, 20, 60)])
    share = lambda x: F.avg(x.cast("double"))
    day = mine.groupBy("date", by).agg(share(F.col("close") > F.col("__m20")).alias("breadth"), share(F.col("close") >= 0.95 * F.col("__h")).alias("near_high"), F.sum("__a5").alias("__s5"), F.sum("__a60").alias("__s60"))
    s = index.join(day, ["date", by]).join(whole, "date").join(total, "date")
    s = s.withColumns({**{f"r{n}": F.col(f"g{n}") - F.col(f"__g{n}") for n in (5, 20, 60)}, "amount": F.try_divide(F.col("__s5") / F.col("__t5"), F.col("__s60") / F.col("__t60"))})
    # sums in two orders differ in their last digits, ties must not
    ranked = {k: F.round(k, 9) for k in ("r20", "r60", "breadth", "amount", "near_high")}
    s = s.withColumns({f"__{k}": x for k, x in ranked.items()})
    s = s.withColumn("score", sum((pct_rank(f"__{k}", ["date"]) for k in ranked), F.lit(0.0)) / len(ranked))
    place = F.when(F.col("score").isNotNull(), F.rank().over(W.partitionBy("date").orderBy(F.round("score", 9).desc_nulls_last())))
    return s.select("date", by, "r5", "r20", "r60", "breadth", "amount", "near_high", "score", place.alias("place"))


def opinions(d: DataFrame, rank: str, rows: int = 5) -> DataFrame:
    """Rows with ``rank`` and their ``opinion``: the mean of the last ``rows`` ranks of a code, ranked anew within the day, by CUTS."""
    d = d.where(F.col(rank).isNotNull()).withColumn("__s", F.round(F.avg(rank).over(by_code(-(rows - 1), 0)), 9))
    d = d.withColumn("__p", F.round(pct_rank("__s", ["date"]), 9))
    level = F.lit(-2)
    for value, cut in zip((-1, 0, 1, 2), reversed(CUTS)):
        level = F.when(F.col("__p") >= cut, value).otherwise(level)
    return d.withColumn("opinion", level).drop("__s", "__p")


def changes(d: DataFrame, state: str, most: int = 12) -> DataFrame:
    """The last ``most`` rows of each code on which ``state`` changed (its first row too): ``code, date, state, rows``, with the rows that it lasted."""
    d = d.withColumn("__new", F.when(F.col(state).eqNullSafe(lag(state)) & lag("date").isNotNull(), 0).otherwise(1))
    d = d.withColumn("__run", F.sum("__new").over(by_code(W.unboundedPreceding, 0)))
    runs = d.groupBy("code", "__run").agg(F.min("date").alias("date"), F.first(state).alias(state), F.count(F.lit(1)).alias("rows"))
    return runs.withColumn("__k", F.row_number().over(W.partitionBy("code").orderBy(F.desc("__run")))).where(F.col("__k") <= most).select("code", "date", state, "rows")
