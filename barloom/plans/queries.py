"""The market queries, by name. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.expr import by_code, ewm_all, flag, highest, lag, lead, mean, onset, pct_rank, rolling, tick
from barloom.operators.conditions import CANDLES, CONDITIONS, add_candles, add_conditions, events
from barloom.operators.indicators import add_indicators, add_moving
from barloom.operators.oscillators import OSCILLATORS, PATTERNS, add_oscillator_patterns, add_oscillators
from barloom.operators.patterns import WINDOW_PATTERNS, add_window_patterns
from barloom.operators.studies import asof_backward, combo_table, early_days, index_series, onset_combos, quote_bars, resample, split_day, volume_profile
from barloom.operators.trades import barrier_exit, drawdown, horizon_return, streak, trade_stats
from barloom.sources import market


def r(x, n: int):
    return F.round(x, n)


def bars_daily(spark, sf):
    return market.bars(spark, sf).select("code", "date", "open", "high", "low", "close", "volume", r("amount", 2).alias("amount"))


def resample_weekly(spark, sf):
    return resample(market.bars(spark, sf), "week")


def resample_monthly(spark, sf):
    return resample(market.bars(spark, sf), "month")


def listing_filter(spark, sf):
    """All codes of the listed markets with their rank by size in their market."""
    found = market.listing(spark, sf)
    return found.where(F.upper("market").startswith("KOS")).withColumn("size_rank", F.row_number().over(W.partitionBy("market").orderBy(F.desc("marcap"), "code"))).select("code", "market", "theme", "marcap", "size_rank")


def market_breadth(spark, sf):
    d = market.bars(spark, sf).withColumn("ma20", mean("close", 20)).withColumn("chg", F.col("close") - lag("close"))
    return d.groupBy("date").agg(
        F.count_if(F.col("chg") > 0).alias("n_up"), F.count_if(F.col("chg") < 0).alias("n_down"), F.count_if(F.col("chg") == 0).alias("n_flat"),
        r(F.avg(F.when(F.col("ma20").isNotNull(), (F.col("close") > F.col("ma20")).cast("double"))), 6).alias("above_ma20"),
    )


def moving_indicators(spark, sf):
    d = add_moving(market.bars(spark, sf))
    names = {"ma5": 2, "ma20": 2, "ma60": 2, "ma120": 2, "ma60_slope": 4, "bb_upper": 2, "bb_width": 4, "sto_k": 2, "sto_d": 2, "vol_ma20": 4, "ret60": 4, "ret120": 4}
    return d.select("code", "date", "obv", "hh20_prev", "hh252", *[r(k, n).alias(k) for k, n in names.items()])


def recursive_indicators(spark, sf):
    d = add_indicators(market.bars(spark, sf))
    return d.select("code", "date", *[r(k, 2).alias(k) for k in ("rsi", "macd", "macd_signal", "atr", "pdi", "mdi", "adx")])


def condition_counts(spark, sf):
    d = add_conditions(add_indicators(market.bars(spark, sf)))
    return d.groupBy("code").agg(F.count(F.lit(1)).alias("n_bars"), *[F.count_if(F.col(k)).alias(k) for k in CONDITIONS])


def candle_counts(spark, sf):
    d = add_candles(add_indicators(market.bars(spark, sf)))
    return d.groupBy("code").agg(*[F.count_if(F.col(k)).alias(k) for k in CANDLES])


def oscillator_indicators(spark, sf):
    d = add_oscillators(market.bars(spark, sf))
    exact = {"conversion", "base", "span_a", "span_b", "cloud_top", "cloud_bottom"}
    return d.select("code", "date", *[F.col(k) if k in exact else r(k, 2).alias(k) for k in OSCILLATORS])


def oscillator_counts(spark, sf):
    d = add_oscillator_patterns(add_oscillators(add_indicators(market.bars(spark, sf))))
    return d.groupBy("code").agg(*[F.count_if(F.col(k)).alias(k) for k in PATTERNS])


def window_pattern_counts(spark, sf):
    """How often each pattern of averages, limits and swings occurs, by code."""
    d = add_window_patterns(add_indicators(market.bars(spark, sf)))
    return d.groupBy("code").agg(*[F.count_if(F.col(k)).alias(k) for k in WINDOW_PATTERNS])


def golden_cross_study(spark, sf):
    d = market.bars(spark, sf).withColumns({"ma5": mean("close", 5), "ma20": mean("close", 20)})
    d = d.withColumn("gc", flag((F.col("ma5") > F.col("ma20")) & (lag("ma5") <= lag("ma20")))).withColumn("ret", horizon_return(20))
    return trade_stats(d.withColumn("on", onset(F.col("gc"))).where("on"), ["code"])


def horizon_stats(spark, sf):
    horizons = (1, 5, 20, 60)
    d = market.bars(spark, sf).withColumns({f"r{h}": horizon_return(h) for h in horizons})
    d = d.select("code", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"r{h}").alias("ret")) for h in horizons])).alias("x")).select("code", "x.*")
    return trade_stats(d, ["code", "h"])


def barrier_sim(spark, sf):
    d = add_indicators(market.bars(spark, sf))
    d = d.withColumn("on", onset(flag((F.col("ma5") > F.col("ma20")) & (lag("ma5") <= lag("ma20")))))
    d = barrier_exit(d, 20, 3.0, 2.0).where("on and outcome is not null")
    return d.groupBy("code", "outcome").agg(F.count(F.lit(1)).alias("n"), r(F.avg("ret"), 4).alias("mean_ret"), F.sum("days").alias("days"))


def cross_rank(spark, sf):
    d = market.bars(spark, sf).withColumn("ret60", F.col("close") / lag("close", 60) - 1)
    return d.withColumn("rank", pct_rank("ret60", ["date"])).where("rank is not null").select("code", "date", r("rank", 6).alias("rank"))


def index_capweighted(spark, sf):
    return index_series(market.bars(spark, sf), market.listing(spark, sf).select("code", "marcap"), [])


def sector_index(spark, sf):
    return index_series(market.bars(spark, sf), market.listing(spark, sf).select("code", "marcap", "market"), ["market"])


def sector_leaders(spark, sf):
    """The three strongest codes of each market and month by return."""
    m = resample(market.bars(spark, sf), "month").withColumn("ret", F.col("close") / F.col("open") - 1).join(market.listing(spark, sf).select("code", "market"), "code")
    best = W.partitionBy("market", "period").orderBy(F.desc("ret"), "code")
    return m.withColumn("rank", F.row_number().over(best)).where("rank <= 3").select("market", "period", "rank", "code", r("ret", 6).alias("ret"))


def drawdown_metrics(spark, sf):
    d = drawdown(market.bars(spark, sf)).withColumn("ret", F.col("close") / lag("close") - 1)
    return d.groupBy("code").agg(r(F.min("dd"), 6).alias("max_drawdown"), r(F.stddev_pop("ret"), 6).alias("vol"), r(F.avg("ret"), 6).alias("mean_ret"), r(F.avg("ret") / F.stddev_pop("ret"), 4).alias("sharpe_day"))


def monthly_table(spark, sf):
    d = resample(market.bars(spark, sf), "month")
    d = d.withColumn("before", F.lag("close").over(W.partitionBy("code").orderBy("period")))
    return d.groupBy(F.year("period").alias("year"), F.month("period").alias("month")).agg(F.count("before").alias("n"), r(F.avg(F.col("close") / F.col("before") - 1), 6).alias("mean_ret"))


def return_histogram(spark, sf):
    d = market.bars(spark, sf).withColumn("ret", horizon_return(20)).where("ret is not null")
    x = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.round("ret", 9)))
    return d.withColumn("bin", F.least(F.lit(20), F.width_bucket(x, F.lit(-0.5), F.lit(0.5), F.lit(20)))).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def flow_streak(spark, sf):
    """Length of the last run of net buying or selling of each investor group and code."""
    f = market.flows(spark, sf).withColumn("code", F.concat_ws("|", "code", "investor"))
    last = W.partitionBy("code").orderBy(F.desc("date"))
    d = streak(f, "net").withColumn("rn", F.row_number().over(last)).where("rn = 1")
    return d.select(F.split("code", r"\|")[0].alias("code"), F.split("code", r"\|")[1].alias("investor"), "date", "net", "streak")


def net_buy_rank(spark, sf):
    """Each month's three codes with the most net buying of each investor group."""
    m = market.flows(spark, sf).groupBy("investor", "code", F.trunc("date", "MM").alias("month")).agg(F.sum("net").alias("net"))
    best = W.partitionBy("investor", "month").orderBy(F.desc("net"), "code")
    return m.withColumn("rank", F.row_number().over(best)).where("rank <= 3").select("investor", "month", "rank", "code", "net")


#: The customer segments of the tables, which stand for investor groups.
INVESTORS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def investor_study(spark, sf):
    """Each group's 20-day net buying over 20 times the 60-day mean of traded value, its top tenth each day, and the return from the
    next open over 5, 20 and 60 days, raw and less the day's mean over all codes; and how often a buying day is followed by buying in the next 20."""
    horizons = (5, 20, 60)
    b = market.bars(spark, sf).withColumn("amt", mean(F.col("close") * F.col("volume"), 60, 30))
    b = b.withColumns({f"fw{h}": F.try_divide(lead("close", h), lead("open", 1)) - 1 for h in horizons})
    b = b.withColumns({f"fx{h}": F.col(f"fw{h}") - F.avg(f"fw{h}").over(W.partitionBy("date")) for h in horizons})
    # a row for each day of a code and group: days without a trade of the group have no net
    f = market.flows(spark, sf).groupBy("code", "date", "investor").agg(F.sum("net").alias("net"))
    d = b.withColumn("investor", F.explode(F.array(*[F.lit(g) for g in INVESTORS])))
    d = d.join(f, ["code", "date", "investor"], "left").withColumn("one", F.concat_ws("|", "code", "investor"))
    w = lambda a, z: W.partitionBy("one").orderBy("date").rowsBetween(a, z)
    strength = F.when(F.count("net").over(w(-19, 0)) >= 12, F.try_divide(F.sum("net").over(w(-19, 0)), F.col("amt") * 20))
    buys = F.when(F.col("net").isNotNull(), (F.col("net") > 0).cast("double"))
    d = d.withColumns({"x": strength, "buys": buys})
    d = d.withColumn("after", F.when((F.count("buys").over(w(1, 20)) >= 10) & F.lead("date", 19).over(W.partitionBy("one").orderBy("date")).isNotNull(), F.avg("buys").over(w(1, 20))))
    d = d.withColumn("top", flag(F.round(pct_rank("x", ["investor", "date"]), 9) >= 0.9))
    of = lambda x: F.when(F.col("top"), F.col(x))
    return d.groupBy("investor").agg(
        F.count_if("top").alias("n"),
        *[r(F.avg(of(f"fx{h}")), 6).alias(f"excess{h}") for h in horizons],
        *[r(F.avg((of(f"fw{h}") > 0).cast("double")), 6).alias(f"win{h}") for h in horizons],
        r(F.avg(F.when(F.col("buys") == 1, F.col("after"))), 6).alias("persistence"),
    )


def asof_fundamentals(spark, sf):
    """Each bar with its code's last month-end value that was known the day before."""
    b = market.bars(spark, sf)
    facts = resample(b, "month").select("code", F.date_add(F.last_day("period"), 1).alias("date"), F.col("close").alias("book"))
    d = asof_backward(b, facts, "book").where("book is not null")
    return d.groupBy("code").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("close") / F.col("book")), 6).alias("price_to_book"), F.max("book").alias("max_book"))


def volume_profiles(spark, sf):
    return volume_profile(market.bars(spark, sf), 120, 24)


def tick_rounding(spark, sf):
    d = market.bars(spark, sf).withColumn("p", F.col("close") * 100).withColumn("t", tick(F.col("p")))
    return d.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum((F.floor(F.col("p") / F.col("t")) * F.col("t")).cast("long")).alias("down"), F.sum((F.ceil(F.col("p") / F.col("t")) * F.col("t")).cast("long")).alias("up"))


def top_movers(spark, sf):
    """The five largest gains and losses of each day."""
    d = market.bars(spark, sf).withColumn("chg", F.round(F.col("close") / lag("close") - 1, 6)).where("chg is not null")
    d = d.withColumn("up_rank", F.row_number().over(W.partitionBy("date").orderBy(F.desc("chg"), "code"))).withColumn("down_rank", F.row_number().over(W.partitionBy("date").orderBy("chg", "code")))
    return d.where("up_rank <= 5 or down_rank <= 5").select("date", "code", "chg", "up_rank", "down_rank")


#: Rows of a code before its patterns count, and rows that a code needs.
WARM, WHOLE = 130, 160


def pattern_event_study(spark, sf):
    """What follows the onset of each candle and window pattern: bought at the next open, sold at the close 5 and 20 days on.

    Mean, mean less the day's mean over all codes, share of gains and their number (30 at least), over all codes and by size
    (large, middle, small: thirds by capitalisation). Rows of key ``_base`` hold the same for all days of all codes.
    """
    horizons = (5, 20)
    third = F.ntile(3).over(W.orderBy(F.desc("marcap"), "code"))
    sizes = market.listing(spark, sf).select("code", F.element_at(F.array(F.lit("L"), F.lit("M"), F.lit("S")), third).alias("size"))
    d = add_window_patterns(add_candles(add_indicators(market.bars(spark, sf))))
    d = d.withColumns({"rn": F.row_number().over(by_code()), "rows": F.count(F.lit(1)).over(W.partitionBy("code")), **{f"r{h}": horizon_return(h) for h in horizons}})
    d = d.withColumns({f"r{h}": F.when((F.col("rn") > WARM) & (F.col("rows") >= WHOLE), F.col(f"r{h}")) for h in horizons})
    d = d.withColumns({f"x{h}": F.col(f"r{h}") - F.avg(f"r{h}").over(W.partitionBy("date")) for h in horizons}).join(F.broadcast(sizes), "code")
    keys, kept = [*CANDLES, *WINDOW_PATTERNS], ["code", "date", "size", "rn", "rows", *[f"{x}{h}" for h in horizons for x in "rx"]]
    on = events(d.select(*kept, *keys), keys)
    every = d.select(*kept, F.lit("_base").alias("key"))
    warm = on.unionByName(every).where((F.col("rn") > WARM) & (F.col("rows") >= WHOLE))
    found = warm.groupingSets([["key"], ["key", "size"]], "key", "size")
    enough = lambda h, x: F.when((F.count(f"r{h}") >= 30) | (F.col("key") == "_base"), x)
    out = {"n": F.count(F.lit(1))}
    for h in horizons:
        gain = F.avg((F.col(f"r{h}") > 0).cast("double"))
        out |= {f"n{h}": F.count(f"r{h}"), f"mean{h}": r(enough(h, F.avg(f"r{h}")), 5), f"excess{h}": r(enough(h, F.when(F.col("key") != "_base", F.avg(f"x{h}"))), 5), f"win{h}": r(enough(h, gain), 5)}
    return found.agg(*[x.alias(k) for k, x in out.items()])


SETUPS = ["dip", "rsi2", "pull", "high52", "flow", "base"]


def add_setups(d):
    """The five setups and the 10 % base as flags, over bars with ``large`` (boolean) and ``net_a``, ``net_b`` (two groups' net buying).

    Liquid is over the lowest fifth of the day by 20-day traded value: the tables have no currency for a fixed bound.
    """
    c, o, v, col = F.col("close"), F.col("open"), F.col("volume"), F.col
    d = d.withColumns({f"ma{n}": mean("close", n) for n in (5, 20, 60, 200)})
    d = d.withColumns({"__amt": c * v, "__ret1": c / lag("close") - 1, "__body": F.try_divide(c - o, o), "__vol20": mean("volume", 20, 15), "__d": c - lag("close")})
    d = d.withColumn("__amt20", mean("__amt", 20, 15))
    known = col("__d").isNotNull()
    d = ewm_all(d, {"__gain": (F.when(known, F.greatest("__d", F.lit(0.0))), 0.5), "__loss": (F.when(known, F.greatest(-col("__d"), F.lit(0.0))), 0.5)})
    d = d.withColumn("__rsi2", 100 - 100 / (1 + F.try_divide(col("__gain"), col("__loss"))))
    d = d.withColumn("__kb", flag((col("__ret1") >= 0.07) & (col("__body") >= 0.05) & (v >= 3 * lag("__vol20"))))
    near = by_code(-9, 0)
    both = F.when(col("net_a").isNotNull(), ((col("net_a") > 0) & flag(col("net_b") > 0)).cast("double"))
    d = d.withColumns({"__recent": F.max(col("__kb").cast("int")).over(near) == 1, "__kb_open": F.last(F.when(col("__kb"), o), True).over(near), "__kb_vol": F.last(F.when(col("__kb"), v), True).over(near), "__both": both})
    d = d.withColumns({"__both5": rolling(F.sum("__both"), "__both", 5), "__top": highest("high", 250, 200, shift=1)})
    d = d.withColumn("__liq", flag(pct_rank("__amt20", ["date"]) > 0.2))
    rules = {
        "dip": col("large") & (c <= 0.88 * col("ma20")),
        "rsi2": (c > col("ma200")) & (col("__rsi2") < 10),
        "pull": (col("ma20") > col("ma60")) & col("__recent") & ~col("__kb") & (c < col("ma5")) & (c > col("__kb_open")) & (v < col("__kb_vol") / 3),
        "high52": (c > col("__top")) & (col("__amt") >= 1.5 * lag("__amt20")) & (col("__body") > 0),
        "flow": (col("__both5") >= 4) & (c > col("ma20")),
        "base": F.substring(F.md5(F.concat_ws("|", "code", F.date_format("date", "yyyy-MM-dd")).cast("binary")), 1, 3) < "19a",  # 410 of 4,096
    }
    d = d.withColumns({k: flag(col("__liq") & x) for k, x in rules.items()})
    return d.drop(*[x for x in d.columns if x.startswith("__")])


def setup_stats_by_year(spark, sf):
    """The five setups and a base of 10 % of liquid bars: ten-day trades by year. Large is the larger half by size; the flow groups are two customer segments."""
    sizes = market.listing(spark, sf).select("code", (F.percent_rank().over(W.orderBy("marcap")) >= 0.5).alias("large"))
    net = lambda group: F.sum(F.when(F.col("investor") == group, F.col("net")))
    flows = market.flows(spark, sf).groupBy("code", "date").agg(net("BUILDING").alias("net_a"), net("MACHINERY").alias("net_b"))
    d = add_setups(market.bars(spark, sf).join(flows, ["code", "date"], "left").join(sizes, "code"))
    d = d.withColumn("ret", horizon_return(10, 0.003))
    e = events(d.select("code", "date", "ret", *SETUPS), SETUPS)
    return trade_stats(e.withColumn("year", F.year("date")), ["key", "year"])


def combo_mine(spark, sf):
    """One- to three-way conjunctions of twelve conditions, on all rows; the first 65 % of the days are early. ``combo_mine_all`` mines all of them."""
    names = ["align", "ma60up", "ma120", "mom3m", "hi52", "brk20", "near20", "gc", "vol", "bigc", "up3", "bb_rev"]
    bars = market.bars(spark, sf)
    d = add_conditions(add_indicators(bars)).withColumn("ret", horizon_return(20)).where("ret is not null").select("date", "ret", *names)
    days = early_days(bars.withColumn("ret", horizon_return(20)).where("ret is not null"))
    return combo_table(d.join(days, "date"), names, 3, 60)


def combo_mine_all(spark, sf):
    """Onsets of all one- to three-way conjunctions of all conditions, with the least signals of each part of time; the first 65 % of the days are early."""
    bars = market.bars(spark, sf)
    split = split_day(bars.withColumn("ret", horizon_return(20)).where("ret is not null"))
    d = add_conditions(add_indicators(bars)).withColumn("ret", horizon_return(20))
    return onset_combos(d, CONDITIONS, 3, F.lit(split).cast("date"), 60, 30)


def regime_lamps(spark, sf):
    """Market lamps day by day: the index over its 60- and 20-day means, breadth of 40 %, volatility below the top 15 % of a year; on if all are."""
    i = index_capweighted(spark, sf).select("date", F.lit("index").alias("code"), F.exp("log_level").alias("level"))
    i = i.withColumns({"m60": mean("level", 60), "m20": mean("level", 20), "__r": F.col("level") / lag("level") - 1})
    i = i.withColumn("vol", F.round(rolling(F.stddev_samp("__r"), "__r", 20) * math.sqrt(252), 9))
    year = F.collect_list("vol").over(by_code(-249, 0))  # at most 250 values
    below, same = F.size(F.filter("__year", lambda x: x < F.col("vol"))), F.size(F.filter("__year", lambda x: x == F.col("vol")))
    i = i.withColumn("__year", year)
    i = i.withColumn("vol_rank", F.when(F.col("vol").isNotNull() & (F.size("__year") >= 120), (below + (same + 1) / 2) / F.size("__year")))
    d = i.join(market_breadth(spark, sf), "date", "left")
    lamps = {"over60": F.col("level") > F.col("m60"), "over20": F.col("level") > F.col("m20"), "broad": F.col("above_ma20") >= 0.4, "calm": F.col("vol_rank") < 0.85}
    d = d.withColumns({k: flag(x) for k, x in lamps.items()})
    return d.select("date", *lamps, r("vol_rank", 6).alias("vol_rank"), (F.col("over60") & F.col("over20") & F.col("broad") & F.col("calm")).alias("on"))


def price_alerts(spark, sf):
    """Days on which a close passes a code's alert levels (10 % around its first close)."""
    first = W.partitionBy("code").orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = market.bars(spark, sf).withColumn("ref", F.first("close").over(first))
    d = d.withColumn("side", F.when(F.round(F.col("close") / F.col("ref"), 9) >= 1.1, "above").when(F.round(F.col("close") / F.col("ref"), 9) <= 0.9, "below")).where("side is not null")
    return d.groupBy("code", "side").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


def portfolio_value(spark, sf):
    """Every customer's holdings by code at the last close: cost, value, gain and weight."""
    line = market.table(spark, sf, "lineitem")
    part, orders = market.table(spark, sf, "part"), market.table(spark, sf, "orders")
    held = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("custkey"), F.col("p_brand").alias("code")).agg(F.sum("l_quantity").alias("qty"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cost"))
    last = market.bars(spark, sf).groupBy("code").agg(F.max_by("close", "date").alias("px"))
    d = held.join(last, "code").withColumn("value", F.col("qty") * F.col("px"))
    total = F.sum("value").over(W.partitionBy("custkey"))
    return d.select("custkey", "code", "qty", "cost", "value", r(F.col("value") * 100 / F.col("cost") - 1, 4).alias("gain"), r(F.col("value") / total, 4).alias("weight"))


def valuation_median(spark, sf):
    """Median price and upper tenth by theme, for themes with three codes or more."""
    part = market.table(spark, sf, "part")
    return part.groupBy("p_type").agg(F.median("p_retailprice").alias("m"), F.count_distinct("p_brand").alias("n_codes"), F.percentile("p_retailprice", F.lit(0.9)).alias("p90")).where("n_codes >= 3").select("p_type", r("m", 4).alias("median_price"), "n_codes", r("p90", 4).alias("p90_price"))


def screen_metrics(spark, sf):
    """The last bar of each code with its screening figures."""
    d = add_moving(market.bars(spark, sf)).withColumn("chg", F.col("close") / lag("close") - 1).withColumn("rn", F.row_number().over(W.partitionBy("code").orderBy(F.desc("date")))).where("rn = 1")
    c = F.col("close")
    return d.select("code", "date", "close", r("chg", 6).alias("chg"), r(c / F.col("ma20") - 1, 6).alias("gap20"), r(c / F.col("hh252") - 1, 6).alias("gap_high"), r(F.try_divide(F.col("volume"), F.col("vol_ma20")), 6).alias("vr"), (flag(c > F.col("ma5")).cast("int") + flag(c > F.col("ma20")).cast("int") + flag(c > F.col("ma60")).cast("int")).alias("trend"))


def quotes_hourly(spark, sf):
    """Hourly bars of the event stream by type (the batch form of ``barloom.streaming``)."""
    return quote_bars(market.table(spark, sf, "events"), "1 hour").select("code", "start", "open", "high", "low", "close", "n")


QUERIES = {
    f.__name__: f
    for f in (
        bars_daily, resample_weekly, resample_monthly, listing_filter, market_breadth, moving_indicators, recursive_indicators, condition_counts, candle_counts, window_pattern_counts, oscillator_indicators, oscillator_counts,
        golden_cross_study, horizon_stats, barrier_sim, cross_rank, index_capweighted, sector_index, sector_leaders, drawdown_metrics, monthly_table, return_histogram,
        flow_streak, net_buy_rank, investor_study, asof_fundamentals, volume_profiles, tick_rounding, top_movers, pattern_event_study, setup_stats_by_year, combo_mine, combo_mine_all,
        regime_lamps, price_alerts, portfolio_value, valuation_median, screen_metrics, quotes_hourly,
    )
}
