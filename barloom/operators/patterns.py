"""More chart patterns that windows express: averages as support, limits, swings off the 120-day high. Missing values make a pattern false.

All windows are by code in date order. Rows are trading days of the code; a
rule that needs more rows than a code has is false for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.expr import by_code, crosses_down, crosses_up, flag, highest, lag, lowest, mean, rolling, rolling_quantile

WINDOW_PATTERNS = [
    "ma5_sup", "ma5_rej", "ma20_sup", "ma20_rej", "ma60_sup", "ma60_rej", "gc", "dc", "align_on", "align_off", "pullback",
    "squeeze", "rsi_os", "rsi_ob", "macd_gc", "macd_dc", "obv_lead", "inv_hammer", "hanging", "rising3", "falling3",
    "bear_recover", "limit_up", "limit_dn", "limit_up_pull", "ma10_sup", "ma120_up", "ma120_dn", "ma120_sup", "ma240_up",
    "ma240_dn", "ma240_sup", "gc_120", "dc_120", "ma20_turn", "ma_conv_up", "env_high", "vol_max_up", "vol_bottom_brk",
    "squeeze_brk", "ath", "price_corr", "time_corr", "fib_zone", "near_high", "fib_bounce", "island_bot", "island_top",
]

#: Days of the swing patterns' window.
LOOK = 120
#: The daily price limit was widened on this day.
LIMIT_CHANGE = "2015-06-15"


def _recent(x: Column, n: int, shift: int = 1) -> Column:
    """Whether a flag was set in the n rows up to ``shift`` rows ago."""
    return F.max(x.cast("int")).over(by_code(-(n - 1) - shift, -shift)) == 1


def _held(x: Column, n: int) -> Column:
    """The last value of ``x`` in the n rows before this one."""
    return F.last(x, True).over(by_code(-n, -1))


def add_window_patterns(d: DataFrame) -> DataFrame:
    """``d`` with a boolean column for each of WINDOW_PATTERNS. Needs ``add_indicators``."""
    c, o, h, low, v, atr = (F.col(x) for x in ("close", "open", "high", "low", "volume", "atr"))
    col, names = F.col, set(d.columns)
    top3, low3 = F.greatest("ma5", "ma20", "ma60"), F.least("ma5", "ma20", "ma60")
    d = d.withColumns(
        {
            "__ma10": mean("close", 10),
            "__ma240": mean("close", 240),
            "__up": c > o,
            "__body": F.abs(c - o),
            "__span": F.when(h > low, h - low),
            "__ut": h - F.greatest(c, o),
            "__lt": F.least(c, o) - low,
            "__r5": c / lag("close", 5) - 1,
            "__chg": c / lag("close") - 1,
            "__vr": F.try_divide(v, lag("vol_ma20")),
            "__v5": mean("volume", 5),
            "__v60q": rolling_quantile("volume", 60, 0.15),
            "__rising": flag((col("ma5") > col("ma20")) & (col("ma20") > col("ma60")) & (col("ma60") > col("ma120"))),
            "__falling": flag((col("ma5") < col("ma20")) & (col("ma20") < col("ma60")) & (col("ma60") < col("ma120"))),
            "__tight": flag(col("bb_width") <= rolling_quantile("bb_width", 120, 0.1, 60)),
            "__near": flag((top3 - low3) / c <= 0.03),
            "__top3": top3,
            "__s20": col("ma20") - lag("ma20"),
            "__rn": F.row_number().over(by_code()),
            "__n": F.count(F.lit(1)).over(W.partitionBy("code")),
            "__least": lowest("low", LOOK, 20),
        }
    )
    body, span, ut, lt, r5, chg, vr, up = (col(f"__{x}") for x in ("body", "span", "ut", "lt", "r5", "chg", "vr", "up"))
    limit = F.when(col("date") < F.lit(LIMIT_CHANGE).cast("date"), 0.145).otherwise(0.295)
    d = d.withColumns(
        {
            "__limit": flag(chg >= limit),
            "__quiet": flag(lag("__v5") <= lag("__v60q")),
            "__down20": flag(col("__s20") < 0).cast("int"),
            # the latest of the highest bars of the window, and the lowest low up to it
            "__peak": F.max(F.struct("high", "__rn", "__least")).over(by_code(-(LOOK - 1), 0)),
            "__lows": F.collect_list("low").over(by_code(-(LOOK - 1), 0)),
            "__past": F.collect_list(F.struct("high", "low")).over(by_code(-11, 0)),
        }
    )
    d = d.withColumns(
        {
            "__limit_mid": _held(F.when(col("__limit"), (o + c) / 2), 11),
            "__bear_open": _held(F.when((c < o) & (body >= 1.2 * atr), o), 6),
            "__days": (col("__rn") - col("__peak.__rn")).cast("int"),
        }
    )
    high, floor, days = col("__peak.high"), col("__peak.__least"), col("__days")
    after = F.when(days > 0, F.array_min(F.slice("__lows", F.greatest(F.size("__lows") - days + 1, F.lit(1)), F.greatest(days, F.lit(1))))).otherwise(high)
    whole = (col("__n") >= 2 * LOOK) & (col("__rn") >= LOOK)
    fall, rise, deep, back = c / high - 1, high / floor - 1, high / after - 1, F.try_divide(high - c, high - floor)

    def support(ma: str, near: float, rows: int) -> Column:
        return (lag("close") > lag(ma)) & (low <= near * col(ma)) & (c >= col(ma)) & (col(ma) > lag(ma, rows))

    def rejected(ma: str) -> Column:
        return (lag("close") < lag(ma)) & (h >= 0.995 * col(ma)) & (c < col(ma)) & (col(ma) < lag(ma, 3))

    def between_bars(largest: Column) -> Column:
        """Three bars inside the bar before them, with small bodies."""
        inside = (highest("high", 3, shift=1) <= lag("high", 4)) & (rolling(F.min("low"), "low", 3, None, 1) >= lag("low", 4))
        return (largest >= 0.8 * lag("atr", 4)) & inside & (highest("__body", 3, shift=1) <= 0.6 * lag("__body", 4)) & (body >= 0.8 * atr)

    def island(bottom: bool) -> Column:
        """A gap of today and one of 1 to 10 days ago the other way, with all bars between beyond both."""
        past, n = col("__past"), F.size("__past")
        bar = lambda i: F.get(past, i)
        today = bar(n - 1)

        def cut_off(a: Column) -> Column:
            between = F.slice(past, a + 1, n - 1 - a)  # bars a .. yesterday
            if bottom:
                edge = F.least(bar(a - 1)["low"], today["low"])
                return (bar(a)["high"] < bar(a - 1)["low"]) & (F.array_max(F.transform(between, lambda b: b["high"])) < edge)
            edge = F.greatest(bar(a - 1)["high"], today["high"])
            return (bar(a)["low"] > bar(a - 1)["high"]) & (F.array_min(F.transform(between, lambda b: b["low"])) > edge)

        gap = low > lag("high") if bottom else h < lag("low")
        return gap & (n >= 3) & F.exists(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), cut_off)

    rules = {
        "ma5_sup": support("ma5", 1.005, 3),
        "ma5_rej": rejected("ma5"),
        "ma20_sup": support("ma20", 1.005, 3),
        "ma20_rej": rejected("ma20"),
        "ma60_sup": support("ma60", 1.005, 3),
        "ma60_rej": rejected("ma60"),
        "gc": crosses_up(col("ma5"), col("ma20")),
        "dc": crosses_down(col("ma5"), col("ma20")),
        "align_on": col("__rising") & ~F.coalesce(lag("__rising"), F.lit(False)),
        "align_off": col("__falling") & ~F.coalesce(lag("__falling"), F.lit(False)),
        "pullback": (col("ma20") > col("ma60")) & (col("ma60") > lag("ma60", 5)) & (c / lag("close", 40) - 1 > 0.05)
        & (c / col("ma20") - 1).between(-0.02, 0.025) & (col("__v5") < 0.8 * col("vol_ma20")) & (c < 0.97 * highest("close", 10)),
        "squeeze": col("__tight"),
        "rsi_os": col("rsi") < 30,
        "rsi_ob": col("rsi") > 70,
        "macd_gc": crosses_up(col("macd"), col("macd_signal")),
        "macd_dc": crosses_down(col("macd"), col("macd_signal")),
        "obv_lead": (col("obv") >= highest("obv", 60)) & (c < 0.97 * highest("close", 60)),
        "inv_hammer": (body <= 0.35 * span) & (ut >= 2 * body) & (lt <= 0.15 * span) & (r5 < -0.04) & (low <= lowest("low", 10)),
        "hanging": (body <= 0.35 * span) & (lt >= 2 * body) & (ut <= 0.15 * span) & (r5 > 0.05) & (h >= highest("high", 10)),
        "rising3": between_bars(lag("close", 4) - lag("open", 4)) & up & (c > lag("close", 4)),
        "falling3": between_bars(lag("open", 4) - lag("close", 4)) & (c < o) & (c < lag("close", 4)),
        "bear_recover": (c > col("__bear_open")) & (lag("close") <= col("__bear_open")),
        "limit_up": col("__limit"),
        "limit_dn": chg <= -limit,
        "limit_up_pull": (low <= 1.01 * col("__limit_mid")) & (c >= col("__limit_mid")) & (lag("low") > 1.01 * col("__limit_mid")),
        "ma10_sup": support("__ma10", 1.005, 3),
        "ma120_up": crosses_up(c, col("ma120")),
        "ma120_dn": crosses_down(c, col("ma120")),
        "ma120_sup": support("ma120", 1.01, 5),
        "ma240_up": crosses_up(c, col("__ma240")),
        "ma240_dn": crosses_down(c, col("__ma240")),
        "ma240_sup": support("__ma240", 1.01, 5),
        "gc_120": crosses_up(col("ma60"), col("ma120")),
        "dc_120": crosses_down(col("ma60"), col("ma120")),
        "ma20_turn": (col("__s20") > 0) & (F.sum("__down20").over(by_code(-10, -1)) == 10),
        "ma_conv_up": _recent(col("__near"), 5) & (c > 1.02 * col("__top3")) & (lag("close") <= 1.02 * lag("__top3")) & (vr >= 1.5),
        "env_high": crosses_up(c, 1.2 * col("ma20")),
        "vol_max_up": (v >= highest("volume", 250, 120)) & up,
        "vol_bottom_brk": _recent(col("__quiet"), 10, 0) & (vr >= 3) & up & (chg > 0.03),
        "squeeze_brk": _recent(col("__tight"), 5) & crosses_up(c, col("bb_upper")),
        "ath": (col("__rn") > 250) & (c > F.max("close").over(by_code(W.unboundedPreceding, -1))),
        "price_corr": whole & (rise >= 0.2) & (fall <= -0.15) & days.between(3, 40),
        "time_corr": whole & (rise >= 0.2) & days.between(15, 80) & (deep <= 0.15),
        "fib_zone": whole & (rise >= 0.25) & back.between(0.45, 0.66) & (days >= 3),
        "near_high": whole & (days >= 10) & (fall >= -0.03) & (fall < 0) & (after / high - 1 <= -0.08),
        "fib_bounce": whole & (rise >= 0.2) & back.between(0.382, 0.618) & (days >= 5) & up & (c > lag("close")) & (c - o >= 0.5 * (h - low)),
        "island_bot": island(True),
        "island_top": island(False),
    }
    d = d.withColumns({k: flag(x) for k, x in rules.items()})
    return d.drop(*[x for x in d.columns if x.startswith("__") and x not in names])
