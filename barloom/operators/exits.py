"""Exits that hang on the path after the entry, for the signals of a table: the close decides, the next open fills.

A signal is bought at the next open. The ``h`` bars ahead become one array by
a window and only signal rows keep it; each exit then is one expression on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import by_code, flag, rolling
from barloom.operators.trades import COST

#: Multiples of the daily volatility over the holding time: distance of the stop, and of the first target; reward for a unit of risk.
STOP_WIDTH, FIRST_WIDTH, REWARD = 1.5, 0.5, 2.0
#: Least and most distance of the stop by days of holding.
RISK = {5: (0.04, 0.10), 20: (0.08, 0.20), 60: (0.12, 0.25)}
#: Rule, days at most, stop in ATR, distance of the stop at most.
RULES = {"mr5": ("over_ma5", 10, 3.0, 0.10), "h20": ("hold", 20, 3.0, 0.15), "tr10": ("under_ma10", 30, 2.5, 0.15)}


def _ahead() -> Column:
    return F.col("__ahead")


def _entry() -> Column:
    return F.col("__entry")


def signals(d: DataFrame, at: Column, h: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``d`` where ``at`` holds that have ``h`` further bars and a positive next open, with the bars ahead."""
    bars = F.collect_list(F.struct("open", "high", "low", "close", *extra)).over(by_code(1, h))
    d = d.withColumns({"__at": flag(at), "__ahead": bars}).where("__at").drop("__at").where(F.size("__ahead") == h)
    # each bar knows the next open, as far as it is within the holding time
    linked = F.transform("__ahead", lambda b, i: F.struct(b["open"].alias("open"), b["high"].alias("high"), b["low"].alias("low"), b["close"].alias("close"), F.get("__ahead", i + 1)["open"].alias("next"), *[b[x].alias(x) for x in extra]))
    return d.withColumn("__entry", F.get("__ahead", F.lit(0))["open"]).where(_entry() > 0).withColumn("__ahead", linked)


def daily_volatility(rows: int = 60, least: int = 40) -> Column:
    """Needs ``ret1``, the return since the bar before."""
    return rolling(F.stddev_samp("ret1"), "ret1", rows, least)


def risk_share(volatility: Column, h: int) -> Column:
    """Distance of the stop: STOP_WIDTH volatilities over the holding time, within the bounds of RISK."""
    low, high = RISK[h]
    return F.least(F.greatest(STOP_WIDTH * volatility * h**0.5, F.lit(low)), F.lit(high))


def _first(test) -> Column:
    """Number of the first bar ahead that passes, from 1; null for none."""
    at = F.array_position(F.transform(_ahead(), lambda b: flag(test(b))), True)
    return F.when(at > 0, at.cast("int"))


def _bar(n: Column) -> Column:
    return F.get(_ahead(), n - 1)


def close_stop_exit(s: DataFrame, stop: Column, target: Column, cost: float = COST) -> DataFrame:
    """``ret, days, outcome`` for prices ``stop`` and ``target``: the target is filled within the day, the stop is a close, filled at the next open.

    On one bar the target comes first; without a next bar in the holding time
    a stop fills at its close; the last close ends the trade.
    """
    s = s.withColumns({"__stop": stop, "__target": target})
    s = s.withColumns({"__down": _first(lambda b: b["close"] <= F.col("__stop")), "__up": _first(lambda b: b["high"] >= F.col("__target"))})
    down, up, far = F.col("__down"), F.col("__up"), F.size(_ahead()) + 1
    stopped = down.isNotNull() & (down < F.coalesce(up, far))
    hit = up.isNotNull() & ~stopped
    price = F.when(stopped, F.coalesce(_bar(down)["next"], _bar(down)["close"])).when(hit, F.greatest(_bar(up)["open"], F.col("__target"))).otherwise(_bar(F.size(_ahead()))["close"])
    outcome = F.when(stopped, "stop").when(hit, "target").otherwise("time")
    return s.withColumns({"ret": price / _entry() - 1 - cost, "days": F.when(stopped, down).when(hit, up).otherwise(F.size(_ahead())), "outcome": outcome}).drop("__stop", "__target", "__down", "__up")


def volatility_exit(s: DataFrame, h: int, volatility: str, cost: float = COST) -> DataFrame:
    """A stop by volatility and a target of REWARD times its distance."""
    risk = risk_share(F.col(volatility), h)
    return close_stop_exit(s, _entry() * (1 - risk), _entry() * (1 + REWARD * risk), cost)


def half_exit(s: DataFrame, h: int, volatility: str, cost: float = COST) -> DataFrame:
    """Half is sold at the first target and the stop moves to the entry; the rest goes at the second target, the stop's close or the end.

    A fold over the bars ahead: its state is whether half is sold, what is
    earned, what is left, the stop and whether all is over.
    """
    risk, reach = risk_share(F.col(volatility), h), FIRST_WIDTH * F.col(volatility) * h**0.5
    s = s.withColumns({"__first": _entry() * (1 + reach), "__second": _entry() * (1 + REWARD * risk), "__stop": _entry() * (1 - risk)})
    start = F.struct(F.lit(False).alias("half"), F.lit(0.0).alias("earned"), F.lit(1.0).alias("left"), F.col("__stop").alias("stop"), F.lit(False).alias("over"))

    def step(a, b):
        touch = ~a["half"] & (b["high"] >= F.col("__first"))
        earned = F.when(touch, 0.5 * (F.greatest(b["open"], F.col("__first")) / _entry() - 1)).otherwise(a["earned"])
        left, stop = F.when(touch, F.lit(0.5)).otherwise(a["left"]), F.when(touch, _entry()).otherwise(a["stop"])
        price = F.when(b["high"] >= F.col("__second"), F.greatest(b["open"], F.col("__second"))).when(b["close"] <= stop, F.coalesce(b["next"], b["close"]))
        after = F.struct(
            (a["half"] | touch).alias("half"),
            F.when(price.isNotNull(), earned + left * (price / _entry() - 1)).otherwise(earned).alias("earned"),
            left.alias("left"),
            stop.alias("stop"),
            price.isNotNull().alias("over"),
        )
        return F.when(a["over"] | b["close"].isNull(), a).otherwise(after)

    s = s.withColumn("__end", F.aggregate(_ahead(), start, step))
    rest = F.when(F.col("__end.over"), 0.0).otherwise(F.col("__end.left") * (_bar(F.size(_ahead()))["close"] / _entry() - 1))
    return s.withColumns({"ret": F.col("__end.earned") + rest - cost, "half_sold": F.col("__end.half")}).drop("__first", "__second", "__stop", "__end")


def rule_exit(s: DataFrame, rule: str, atr: str = "atr", cost: float = COST) -> DataFrame:
    """``ret, days`` by a rule of RULES; ``signals`` needs its days and, as extra columns, ``ma5`` or ``ma10``.

    A close at the stop or the rule's sign is sold at the next open; both on
    one bar count as the stop.
    """
    kind, h, width, most = RULES[rule]
    s = s.withColumn("__stop", F.greatest(_entry() - width * F.col(atr), _entry() * (1 - most)))
    sign = {"over_ma5": lambda b: b["close"] > b["ma5"], "under_ma10": lambda b: b["close"] < b["ma10"], "hold": lambda b: F.lit(False)}[kind]
    s = s.withColumns({"__down": _first(lambda b: b["close"] <= F.col("__stop")), "__sign": _first(sign)})
    at = F.least("__down", "__sign")
    price = F.when(at.isNotNull(), F.coalesce(_bar(at)["next"], _bar(at)["close"])).otherwise(_bar(F.lit(h))["close"])
    outcome = F.when(F.col("__down").isNotNull() & (F.col("__down") == at), "stop").when(at.isNotNull(), "rule").otherwise("time")
    return s.withColumns({"ret": price / _entry() - 1 - cost, "days": F.when(at.isNotNull(), F.least(at + 1, F.lit(h))).otherwise(h), "outcome": outcome}).drop("__stop", "__down", "__sign")


def barrier_grid(s: DataFrame, h: int, grid: Column, atr_pct: str = "atr_pct", cost: float = COST) -> DataFrame:
    """A row for each signal and cell of ``grid`` (array of structs ``target``, ``stop`` in ATR): ``kt, ks, ret, hit``.

    Both barriers are prices within the day, the stop first; a gap fills at
    the open. Needs ``signals`` of ``h`` bars; a null ATR share gives no row.
    """
    s = s.where(F.col(atr_pct).isNotNull()).withColumn("__cell", F.explode(grid))
    s = s.withColumns({"kt": F.col("__cell.target"), "ks": F.col("__cell.stop")})
    s = s.withColumns({"__target": _entry() * (1 + F.col("kt") * F.col(atr_pct)), "__stop": _entry() * (1 - F.col("ks") * F.col(atr_pct))})
    s = s.withColumns({"__down": _first(lambda b: b["low"] <= F.col("__stop")), "__up": _first(lambda b: b["high"] >= F.col("__target"))})
    down, up = F.col("__down"), F.col("__up")
    stopped = down.isNotNull() & (down <= F.coalesce(up, down))
    hit = up.isNotNull() & ~stopped
    opened = lambda n: F.when(_bar(n)["open"] > 0, _bar(n)["open"])
    price = F.when(stopped, F.least(opened(down), F.col("__stop"))).when(hit, F.greatest(opened(up), F.col("__target"))).otherwise(_bar(F.lit(h))["close"])
    return s.withColumns({"ret": price / _entry() - 1 - cost, "hit": hit}).drop("__cell", "__target", "__stop", "__down", "__up")
