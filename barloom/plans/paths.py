"""Queries over paths: sequential patterns, parabolic SAR, exits after entry, and the choice of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.expr import by_code, crosses_up, flag, lag, mean, onset, pct_rank, rolling
from barloom.operators import exits, rules, sequences
from barloom.operators.conditions import CONDITIONS, add_conditions
from barloom.operators.indicators import add_indicators
from barloom.operators.studies import index_series
from barloom.operators.trades import barrier_exit, horizon_return
from barloom.plans.queries import SETUPS, WARM, WHOLE, add_setups, r
from barloom.sources import market

#: Of SEQUENCES, those whose SQL is a join of pivots.
NECKLINES = ["hs_top", "inv_hs", "dbl_bottom", "dbl_top", "bull_div", "bear_div", "triple_bottom", "prev_high_brk", "prev_low_brk"]
#: The market's conditions: relative strength, the index, and three investor groups.
MARKET_CONDITIONS = ["rs", "mkt", "frg", "inst", "pen", "dual"]
ALL_CONDITIONS = [*CONDITIONS, *MARKET_CONDITIONS]
#: Customer segments that stand for foreign, institutional and pension money.
GROUPS = {"frg": "BUILDING", "inst": "MACHINERY", "pen": "FURNITURE"}
HOLD = 20
LEAST_EARLY, LEAST_LATE = 60, 30


def _fired(spark, sf, *kept: str) -> DataFrame:
    """Bars with the sequential patterns, SAR turns and flags of a bar in one array."""
    d = sequences.add_flags(add_indicators(market.bars(spark, sf)))
    d = d.select("code", "date", "open", "high", "low", "close", "volume", "rsi", "vol_ma20", *sequences.FLAGS)
    d = sequences.sar_turns(sequences.add_sequences(d))
    more = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in [*sequences.FLAGS, *sequences.TURNS]]))
    return d.select("code", "date", "open", "close", "sar", *sequences.TURNS, F.concat("fired", more).alias("fired"))


def _counts(d: DataFrame, names: list[str]) -> DataFrame:
    return d.groupBy("code").agg(*[F.count_if(F.array_contains("fired", k)).alias(k) for k in names])


def parabolic_sar(spark, sf):
    """Stop and reverse of each bar, and the bars on which it changes sides."""
    nothing = F.lit(None).cast("double")  # the stop needs prices only
    d = market.bars(spark, sf).select("code", "date", "open", "high", "low", "close", "volume", nothing.alias("rsi"), nothing.alias("vol_ma20"))
    return sequences.sar_turns(sequences.add_sequences(d)).select("code", "date", r("sar", 7).alias("sar"), *sequences.TURNS)


def neckline_counts(spark, sf):
    """How often each code breaks a neckline, a previous level or diverges from its RSI."""
    return _counts(_fired(spark, sf), NECKLINES)


def sequence_counts(spark, sf):
    """How often each code fires each sequential pattern, SAR turn and flag."""
    return _counts(_fired(spark, sf), [*sequences.SEQUENCES, *sequences.TURNS, *sequences.FLAGS])


def flag_counts(spark, sf):
    d = sequences.add_flags(market.bars(spark, sf))
    return d.groupBy("code").agg(*[F.count_if(k).alias(k) for k in sequences.FLAGS])


def sequence_event_study(spark, sf):
    """What follows the onset of each sequential pattern, SAR turn and flag, as ``pattern_event_study`` has it for the others, by size."""
    horizons = (5, 20)
    d = _fired(spark, sf)
    d = d.withColumns({"rn": F.row_number().over(by_code()), "rows": F.count(F.lit(1)).over(W.partitionBy("code")), "__before": F.flatten(F.collect_list("fired").over(by_code(-5, -1))), **{f"r{h}": horizon_return(h) for h in horizons}})
    d = d.where((F.col("rn") > WARM) & (F.col("rows") >= WHOLE))
    d = d.withColumns({f"x{h}": F.col(f"r{h}") - F.avg(f"r{h}").over(W.partitionBy("date")) for h in horizons})
    third = F.ntile(3).over(W.orderBy(F.desc("marcap"), "code"))
    sizes = market.listing(spark, sf).select("code", F.element_at(F.array(F.lit("L"), F.lit("M"), F.lit("S")), third).alias("size"))
    # "_base" is on every bar
    keys = F.array_append(F.array_except("fired", "__before"), F.lit("_base"))
    found = d.join(sizes, "code").select("size", *[f"{x}{h}" for h in horizons for x in "rx"], F.explode(keys).alias("key")).groupingSets([["key"], ["key", "size"]], "key", "size")
    out = {"n": F.count(F.lit(1))}
    for h in horizons:
        enough = lambda x, h=h: F.when((F.count(f"r{h}") >= 30) | (F.col("key") == "_base"), x)
        out |= {f"n{h}": F.count(f"r{h}"), f"mean{h}": r(enough(F.avg(f"r{h}")), 5), f"excess{h}": r(enough(F.when(F.col("key") != "_base", F.avg(f"x{h}"))), 5), f"win{h}": r(enough(F.avg((F.col(f"r{h}") > 0).cast("double"))), 5)}
    return found.agg(*[x.alias(k) for k, x in out.items()])


def _trade_figures(d: DataFrame, by: list[str]) -> DataFrame:
    """Count, share of gains, mean, median, best, worst, fifth percentile, profit factor and mean days of ``ret``."""
    x = F.col("ret")
    return d.groupBy(*by).agg(
        F.count(x).alias("n"), r(F.avg((x > 0).cast("double")), 6).alias("win"), r(F.avg(x), 6).alias("mean"), r(F.median(x), 6).alias("median"),
        r(F.max(x), 6).alias("best"), r(F.min(x), 6).alias("worst"), r(F.percentile(x, F.lit(0.05)), 6).alias("p5"),
        r(F.try_divide(F.sum(F.when(x > 0, x)), F.sum(F.when(x < 0, -x))), 4).alias("profit_factor"), r(F.avg("days"), 4).alias("days"),
    )


def exit_study(spark, sf):
    """Golden-cross entries under four exits over 20 days: held, a stop and target by volatility, half sold first, and barriers at two and one and a half ATR."""
    d = add_indicators(market.bars(spark, sf)).withColumn("ret1", F.col("close") / lag("close") - 1)
    d = d.withColumns({"vol60": exits.daily_volatility(), "__up": crosses_up(F.col("ma5"), F.col("ma20"))})
    at = onset(F.col("__up")) & F.col("vol60").isNotNull() & F.col("atr_pct").isNotNull()
    s = exits.signals(d, at, HOLD)
    one = F.array(F.struct(F.lit(2.0).alias("target"), F.lit(1.5).alias("stop")))
    held = s.withColumns({"ret": F.get("__ahead", F.lit(HOLD - 1))["close"] / F.col("__entry") - 1 - exits.COST, "days": F.lit(HOLD)})
    half = exits.half_exit(s, HOLD, "vol60").withColumn("days", F.lit(None).cast("int"))
    barrier = exits.barrier_grid(s, HOLD, one).withColumn("days", F.lit(None).cast("int"))
    kinds = {"hold": held, "volatility": exits.volatility_exit(s, HOLD, "vol60"), "half": half, "barrier": barrier}
    every = None
    for k, x in kinds.items():
        x = x.select(F.lit(k).alias("exit"), "ret", "days")
        every = x if every is None else every.unionByName(x)
    return _trade_figures(every, ["exit"])


#: The exit rule of each setup.
SETUP_RULES = {"dip": "mr5", "rsi2": "mr5", "pull": "mr5", "high52": "h20", "flow": "h20"}
#: Signals of a setup on one day, by traded value; bars of a code before its first, and after its last.
A_DAY, FIRST, LAST = 20, 250, 31


def market_regime(spark, sf) -> DataFrame:
    """By day: the index over both its means of 50 and 200 days ('up'), under both ('down'), or between."""
    i = index_series(market.bars(spark, sf), market.listing(spark, sf).select("code", "marcap"), []).select("date", F.lit("index").alias("code"), F.exp("log_level").alias("level"))
    i = i.withColumns({"m50": mean("level", 50), "m200": mean("level", 200)})
    up, down = (F.col("level") > F.col("m50")) & (F.col("level") > F.col("m200")), (F.col("level") < F.col("m50")) & (F.col("level") < F.col("m200"))
    return i.select("date", F.when(up, "up").when(down, "down").otherwise("between").alias("regime"))


def setup_exits(spark, sf):
    """Each setup under its own exit rule against the 10 % base under the same rule: figures over all bars, and the edge in mean and share of gains."""
    sizes = market.listing(spark, sf).select("code", (F.percent_rank().over(W.orderBy("marcap")) >= 0.5).alias("large"))
    net = lambda group: F.sum(F.when(F.col("investor") == group, F.col("net")))
    flows = market.flows(spark, sf).groupBy("code", "date").agg(net("BUILDING").alias("net_a"), net("MACHINERY").alias("net_b"))
    b = add_indicators(market.bars(spark, sf)).select("code", "date", "open", "high", "low", "close", "volume", "atr", mean("close", 10).alias("ma10"))
    d = add_setups(b.join(flows, ["code", "date"], "left").join(sizes, "code"))
    d = d.withColumns({"__amt": F.col("close") * F.col("volume"), "__rn": F.row_number().over(by_code()), "__n": F.count(F.lit(1)).over(W.partitionBy("code"))})
    d = d.withColumns({"amt20": rolling(F.avg("__amt"), "__amt", 20, 15), "__inside": (F.col("__rn") > FIRST) & (F.col("__rn") <= F.col("__n") - LAST)})
    every = None
    for rule, (_, h, *_) in exits.RULES.items():
        keys = [k for k, x in SETUP_RULES.items() if x == rule] + ["base"]
        on = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in keys]))
        s = exits.signals(d.withColumn("__keys", on), F.col("__inside") & (F.size("__keys") > 0), h, ("ma5", "ma10"))
        s = s.withColumn("key", F.explode("__keys"))
        s = s.withColumn("__k", F.row_number().over(W.partitionBy("key", "date").orderBy(F.desc("amt20"), "code"))).where((F.col("key") == "base") | (F.col("__k") <= A_DAY))
        x = exits.rule_exit(s, rule, cost=0.003).select("key", F.lit(rule).alias("rule"), "ret", "days")
        every = x if every is None else every.unionByName(x)
    f = _trade_figures(every, ["key", "rule"])
    base = f.where("key = 'base'").select("rule", F.col("mean").alias("base_mean"), F.col("win").alias("base_win"))
    f = f.where("key <> 'base'").join(base, "rule")
    edge = F.col("mean") - F.col("base_mean")
    return f.withColumns({"edge": r(edge, 6), "accepted": flag((edge >= 0.003) & (F.col("win") >= F.col("base_win")) & (F.col("profit_factor") >= 1.1))})


def add_market_conditions(d: DataFrame, index: DataFrame, flows: DataFrame) -> DataFrame:
    """MARKET_CONDITIONS as columns, over bars with ``ret120``.

    ``index (date, level)`` is carried on to a code's days without one;
    ``flows (code, date, frg, inst, pen)`` are net buying, missing days are unknown.
    """
    i = index.withColumn("code", F.lit("index")).withColumn("__m60", mean("level", 60)).select("date", flag(F.col("level") > F.col("__m60")).alias("__up"))
    d = d.join(i, "date", "left").join(flows, ["code", "date"], "left")
    d = d.withColumns({"__mkt": F.last("__up", True).over(by_code(W.unboundedPreceding)), **{f"__{g}5": rolling(F.sum(g), g, 5) for g in GROUPS}})
    rules_ = {
        "rs": F.round(pct_rank("ret120", ["date"]), 9) >= 0.7,
        "mkt": F.col("__mkt"),
        "__frg": (F.col("__frg5") > 0) & (F.col("frg") > 0),
        "__inst": (F.col("__inst5") > 0) & (F.col("inst") > 0),
        "__pen": F.col("__pen5") > 0,
        "dual": (F.col("frg") > 0) & (F.col("inst") > 0),
    }
    d = d.withColumns({k: flag(x) for k, x in rules_.items()})
    return d.drop("frg", "inst", "pen", "__up", "__mkt", *[f"__{g}5" for g in GROUPS]).withColumnsRenamed({f"__{g}": g for g in GROUPS})


def _all_conditions(spark, sf) -> DataFrame:
    b = market.bars(spark, sf)
    index = index_series(b, market.listing(spark, sf).select("code", "marcap"), []).select("date", F.exp("log_level").alias("level"))
    net = [F.sum(F.when(F.col("investor") == g, F.col("net"))).alias(k) for k, g in GROUPS.items()]
    flows = market.flows(spark, sf).where(F.col("investor").isin(list(GROUPS.values()))).groupBy("code", "date").agg(*net)
    return add_market_conditions(add_conditions(add_indicators(b)), index, flows)


def market_condition_counts(spark, sf):
    d = _all_conditions(spark, sf)
    return d.groupBy("code").agg(*[F.count_if(k).alias(k) for k in MARKET_CONDITIONS])


def _rows(spark, sf) -> DataFrame:
    """Bars with their condition bits and the default barrier trade; ``early`` parts the first 65 % of the days with a trade."""
    d = _all_conditions(spark, sf).withColumn("bits", rules.condition_bits(ALL_CONDITIONS))
    d = barrier_exit(d.select("code", "date", "open", "high", "low", "close", "atr_pct", "bits", "ma120"), HOLD, 2.0, 1.5, cap=float("inf"))
    d = d.withColumns({"hit": F.col("outcome") == "target", "__rn": F.row_number().over(by_code())}).drop("outcome", "days")
    d = d.withColumn("ret", F.when((F.col("__rn") > rules.WARM) & F.col("ma120").isNotNull(), F.col("ret"))).drop("__rn", "ma120")
    days = d.where("ret is not null").select("date").distinct()
    days = days.select("date", (F.row_number().over(W.orderBy("date")) <= F.floor(0.65 * F.count(F.lit(1)).over(W.partitionBy()))).alias("__early"))
    last = days.agg(F.max(F.when(F.col("__early"), F.col("date"))).alias("__last"))
    return d.withColumn("__one", F.lit(1)).join(F.broadcast(last.withColumn("__one", F.lit(1))), "__one").withColumn("early", flag(F.col("date") <= F.col("__last"))).drop("__one", "__last")


def _mined(d: DataFrame) -> DataFrame:
    """Rules with enough signals in both parts that gain in both, by mask."""
    stats = rules.rule_stats(rules.onset_masks(d).where("ret is not null"), ["mask"])
    return stats.where((F.col("n_early") >= LEAST_EARLY) & (F.col("n_late") >= LEAST_LATE) & (F.col("mean_early") > 0) & (F.col("mean_late") > 0))


def rule_mining(spark, sf):
    """Every conjunction of one to three of the 27 conditions whose barrier trades gain on early and on late days."""
    m = _mined(_rows(spark, sf))
    digits = {k: 6 for k in ("win", "mean", "hit", "win_early", "mean_early", "win_late", "mean_late", "score")}
    return m.select(rules.rule_name(F.col("mask"), ALL_CONDITIONS).alias("rule"), "n", "n_early", "n_late", *[r(k, n).alias(k) for k, n in digits.items()])


def _chosen(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Bars, and the ten best distinct rules under their best exits."""
    d = _rows(spark, sf)
    chosen = rules.distinct_rules(_mined(d))
    events = rules.onset_masks(d).join(F.broadcast(chosen.select("mask")), "mask").select("code", "date", "mask")
    marked = d.join(events.groupBy("code", "date").agg(F.collect_set("mask").alias("__masks")), ["code", "date"], "left")
    s = exits.signals(marked.drop("ret", "hit"), F.col("__masks").isNotNull() & (F.col("atr_pct") > 0), HOLD).withColumn("mask", F.explode("__masks")).drop("__masks")
    return d, rules.tuned_rules(s, chosen, HOLD, LEAST_EARLY, exits.COST)


def rule_selection(spark, sf):
    """The ten best rules of which none holds another, each with the exit of the grid that earns most on early days; by their gain on late days."""
    _, best = _chosen(spark, sf)
    digits = ("win", "mean", "hit", "win_early", "mean_early", "win_late", "mean_late", "score")
    return best.select("rank", rules.rule_name(F.col("mask"), ALL_CONDITIONS).alias("rule"), "kt", "ks", "n", "n_early", "n_late", *[r(k, 6).alias(k) for k in digits])


def rule_picks(spark, sf):
    """Codes that hold a selected rule on the last day, begun in the last three bars, with target and stop; the best rule wins."""
    d, best = _chosen(spark, sf)
    found = rules.fresh_signals(d.select("code", "date", "bits"), best)
    prices = d.select("code", "date", "close", "atr_pct")
    out = found.join(best.select("rank", "kt", "ks"), "rank").join(prices, ["code", "date"])
    move = lambda k, sign: r(F.col("close") * (1 + sign * F.col(k) * F.col("atr_pct")), 4)
    return out.select("code", "date", "rank", rules.rule_name(F.col("mask"), ALL_CONDITIONS).alias("rule"), "days_ago", r("close", 4).alias("close"), move("kt", 1).alias("target"), move("ks", -1).alias("stop"))


PATH_QUERIES = {
    f.__name__: f
    for f in (parabolic_sar, neckline_counts, sequence_counts, flag_counts, sequence_event_study, exit_study, setup_exits, market_condition_counts, rule_mining, rule_selection, rule_picks)
}
