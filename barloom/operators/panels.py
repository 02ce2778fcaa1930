"""Cross-sections and equity curves of a panel of codes: market returns, rank studies, short sales, capped picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.expr import by_code, flag, lag, lead, mean, pct_rank, rolling

#: Quantile of the Wilson bound.
Z = 1.64


def panel(bars: DataFrame, least: int = 20, share: float = 0.3) -> DataFrame:
    """Bars of trading days, with ``day``, the number of the day.

    Prices that are not positive are missing, a missing open is the close. A
    trading day has ``least`` closes and ``share`` of the most closes of any
    day, at least. Days are one row each when they are numbered.
    """
    price = {c: F.when(F.col(c) > 0, F.col(c)) for c in ("open", "high", "low", "close")}
    d = bars.withColumns(price | {"open": F.coalesce(price["open"], price["close"])})
    days = d.groupBy("date").agg(F.count("close").alias("__n"))
    most = F.max("__n").over(W.partitionBy())
    days = days.withColumn("__most", most).where(F.col("__n") >= F.greatest(F.lit(least), share * F.col("__most")))
    days = days.select("date", F.row_number().over(W.orderBy("date")).alias("day"))
    return d.join(days, "date")


def daily_return() -> Column:
    """Return since the panel's day before; missing where the code has no bar on it."""
    return F.when(lag("day") == F.col("day") - 1, F.col("close") / lag("close") - 1)


def market_return(d: DataFrame) -> DataFrame:
    """By day of ``panel`` rows with ``marcap``: equal-weight return, and return by the weights of the day before (0 without any)."""
    weight = F.when(lag("day") == F.col("day") - 1, F.col("marcap") * lag("close"))
    d = d.withColumns({"__r": daily_return(), "__w": weight})
    both = F.col("__r").isNotNull() & F.col("__w").isNotNull()
    total = F.sum(F.when(both, F.col("__w")))
    return d.groupBy("date").agg(
        F.count("__r").alias("n_codes"),
        F.avg("__r").alias("equal"),
        F.coalesce(F.try_divide(F.sum(F.when(both, F.col("__r") * F.col("__w"))), total), F.lit(0.0)).alias("weighted"),
    )


def equity_metrics(d: DataFrame, level: str = "close") -> DataFrame:
    """By code: whole and yearly growth, deepest drawdown, volatility and Sharpe ratio of ``level``, a year being 252 rows."""
    d = d.withColumns({"__r": F.col(level) / lag(level) - 1, "__dd": F.col(level) / F.max(level).over(by_code(W.unboundedPreceding)) - 1})
    g = d.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max_by(level, "date") / F.min_by(level, "date")).alias("__growth"),
        F.min("__dd").alias("mdd"),
        F.stddev_pop("__r").alias("__sd"),
        F.avg("__r").alias("__mean"),
    )
    sharpe = F.when(F.col("__sd") > 0, F.col("__mean") / F.col("__sd") * F.sqrt(F.lit(252.0))).otherwise(0.0)
    return g.select("code", "n", (F.col("__growth") - 1).alias("total"), (F.pow("__growth", 252 / F.col("n")) - 1).alias("cagr"), "mdd", (F.col("__sd") * F.sqrt(F.lit(252.0))).alias("vol"), sharpe.alias("sharpe"))


def periodic_return(d: DataFrame, unit: str) -> DataFrame:
    """By code and period: the last close over the last one of the period before (over the first close in the first period)."""
    p = d.groupBy("code", F.trunc("date", unit).alias("period")).agg(F.max_by("close", "date").alias("__last"), F.min_by("close", "date").alias("__first"))
    before = F.coalesce(F.lag("__last").over(W.partitionBy("code").orderBy("period")), F.col("__first"))
    return p.select("code", "period", (F.col("__last") / before - 1).alias("ret"))


def rank_ic(d: DataFrame, score: str, ahead: str, least: int) -> DataFrame:
    """By day with ``least`` codes: correlation of the ranks of ``score`` and of ``ahead``, to nine digits."""
    d = d.where(F.col(score).isNotNull() & F.col(ahead).isNotNull())
    d = d.withColumns({"__x": pct_rank(score, ["date"]), "__y": pct_rank(ahead, ["date"])})
    return d.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("__x", "__y"), 9).alias("ic")).where(F.col("n") >= least)


def wilson_bound(p: Column, n: Column, z: float = Z) -> Column:
    """Lower bound of a share ``p`` of ``n`` cases; 0 without cases."""
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (p + z * z / (2 * n) - spread) / (1 + z * z / n)).otherwise(0.0)


def winsorised(d: DataFrame, x: str, by: str, share: float = 0.01) -> DataFrame:
    """``x`` within its ``share`` and 1 - ``share`` quantiles of each ``by``; a group of its own has one row of bounds."""
    bounds = d.groupBy(by).agg(F.percentile(x, F.lit(share)).alias("__lo"), F.percentile(x, F.lit(1 - share)).alias("__hi"))
    return d.join(bounds, by).withColumn(x, F.when(F.col(x).isNotNull(), F.greatest(F.least(x, "__hi"), "__lo"))).drop("__lo", "__hi")


def bands(d: DataFrame, score: str, state: str, ahead: str, enough: int) -> DataFrame:
    """Quantiles of ``ahead``, share of gains and its Wilson bound by tenth of ``score`` (a rank in (0, 1]) and ``state``.

    A cell with fewer than ``enough`` rows takes its tenth's figures.
    """
    d = d.where(F.col(score).isNotNull() & F.col(ahead).isNotNull() & F.col(state).isNotNull()).withColumn("tenth", (F.ceil(F.col(score) * 10) - 1).cast("int"))
    win, n = F.avg((F.col(ahead) > 0).cast("double")), F.count(F.lit(1))
    figures = {"n": n, "mean": F.avg(ahead), "p10": F.percentile(ahead, F.lit(0.1)), "p50": F.percentile(ahead, F.lit(0.5)), "p90": F.percentile(ahead, F.lit(0.9)), "win": win, "bound": wilson_bound(win, n)}
    cell = d.groupBy("tenth", state).agg(*[x.alias(k) for k, x in figures.items()])
    tenth = d.groupBy("tenth").agg(*[x.alias(f"__{k}") for k, x in figures.items()])
    small = F.col("n") < enough
    return cell.join(tenth, "tenth").select("tenth", state, F.col("n").alias("n_cell"), small.alias("of_tenth"), *[F.when(small, F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in figures])


def capped_top(d: DataFrame, score: str, group: str, n: int, cap: int, free: str = "other") -> DataFrame:
    """The ``n`` best codes of each day with ``cap`` of a ``group`` at most (``free`` has no cap); ties by code."""
    best = [F.col(score).desc(), F.col("code")]
    d = d.where(F.col(score).isNotNull()).withColumn("__k", F.row_number().over(W.partitionBy("date", group).orderBy(*best)))
    d = d.where((F.col("__k") <= cap) | (F.col(group) == free))
    return d.withColumn("place", F.row_number().over(W.partitionBy("date").orderBy(*best))).where(F.col("place") <= n).drop("__k")


def short_frame(d: DataFrame, shorts: DataFrame, bans: list[tuple[str, str]] = (), h: int = 20) -> DataFrame:
    """Bars with ``shares`` and short sales ``(code, date, sv, bal)``: r, r20, b, bch, ok, fwd.

    Balances come late, so the last one is carried on; sales after the last
    report are unknown, others that are missing are 0. ``ok`` is off in a ban,
    without a balance and without sales in 60 rows (20 at least).
    """
    last = shorts.groupBy("code").agg(F.max("date").alias("__last"))
    d = d.join(shorts, ["code", "date"], "left").join(last, "code")
    d = d.withColumns({"bal": F.coalesce(F.last("bal", True).over(by_code(W.unboundedPreceding)), F.lit(0.0)), "__sv": F.coalesce("sv", F.lit(0.0))})
    d = d.withColumn("__sv", F.when(F.col("date") <= F.col("__last"), F.col("__sv")))
    d = d.withColumns({"r": F.when(F.col("volume") > 0, F.col("__sv") / F.col("volume") * 100), "__sold": F.coalesce("__sv", F.lit(0.0)), "__was": lag("bal", h)})
    banned = F.lit(False)
    for a, b in bans:
        banned = banned | F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return d.withColumns(
        {
            "r20": mean("r", 20, 10),
            "b": F.col("bal") / F.col("shares") * 100,
            "bch": F.when(F.col("__was") > 0, (F.col("bal") / F.col("__was") - 1) * 100),
            "ok": flag(~banned & (rolling(F.sum("__sold"), "__sold", 60, 20) > 0) & (F.col("bal") > 0)),
            "fwd": lead("close", h) / F.col("close") - 1,
        }
    ).drop("sv", "__last", "__sv", "__sold", "__was")


def short_study(frame: DataFrame, least: int = 30, rows: int = 60) -> DataFrame:
    """Excess return over the day's mean for five groups of a day's ranks by balance, its change and the share of sales.

    Codes with more than ``rows`` usable rows, days with ``least`` codes.
    """
    d = frame.where(F.col("ok") & F.col("fwd").isNotNull())
    d = d.withColumn("__rows", F.count(F.lit(1)).over(W.partitionBy("code"))).where(F.col("__rows") > rows)
    day = W.partitionBy("date")
    d = d.withColumns({"ex": F.col("fwd") - F.avg("fwd").over(day), "__n": F.count(F.lit(1)).over(day)}).where(F.col("__n") >= least)
    d = d.withColumns({f"__{k}": pct_rank(k, ["date"]) for k in ("b", "bch", "r20")})
    groups = {"balance_top": F.col("__b") >= 0.9, "balance_low_half": F.col("__b") < 0.5, "rise_top": F.col("__bch") >= 0.9, "fall_top": F.col("__bch") <= 0.1, "sales_top": F.col("__r20") >= 0.9}
    member = F.filter(F.array(*[F.when(flag(x), F.lit(k)) for k, x in groups.items()]), lambda x: x.isNotNull())
    e = d.select(F.explode(member).alias("key"), "ex")
    return e.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("ex").alias("excess"), F.avg((F.col("ex") > 0).cast("double")).alias("win"))


def short_fifths(frame: DataFrame, least: int = 200, edges: int = 4) -> DataFrame:
    """By code with ``least`` usable rows: forward returns by fifth of its own balances; equal edges are one, ``edges`` at least."""
    d = frame.where(F.col("ok") & F.col("fwd").isNotNull())
    cut = F.percentile("bal", F.array(*[F.lit(x) for x in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)]))
    of = d.groupBy("code").agg(F.count(F.lit(1)).alias("__n"), F.array_distinct(F.transform(cut, lambda x: F.round(x, 6))).alias("__e"))
    of = of.where((F.col("__n") >= least) & (F.size("__e") >= edges))
    at = F.size(F.filter("__e", lambda x: x <= F.col("bal"))) - 1
    d = d.join(of, "code").withColumn("fifth", F.greatest(F.least(at, F.size("__e") - 2), F.lit(0)))
    return d.groupBy("code", "fifth").agg(F.count(F.lit(1)).alias("n"), F.min(F.get("__e", F.col("fifth"))).alias("lo"), F.min(F.get("__e", F.col("fifth") + 1)).alias("hi"), F.avg("fwd").alias("mean"), F.avg((F.col("fwd") > 0).cast("double")).alias("win"))


def signal_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes by code of two sets of ``(code, date)``: both, either, only the first, only the second."""
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "only_a": a.join(b, ["code", "date"], "left_anti"), "only_b": b.subtract(a)}
    long = None
    for k, p in parts.items():
        p = p.withColumn("part", F.lit(k))
        long = p if long is None else long.unionByName(p)
    return long.groupBy("code").agg(*[F.count_if(F.col("part") == k).alias(k) for k in parts])
