"""Entry conditions: boolean columns over bars with indicators. Missing values make a condition false."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import by_code, crosses_up, flag, highest, lag, mean, rolling, rolling_quantile

CONDITIONS = [
    "align", "ma60up", "ma20_60", "ma120", "adx_up", "mom3m", "hi52", "brk20", "sqz", "rsi_pb", "near20", "rsi_os",
    "sto", "bb_rev", "gc", "macd_x", "macd_h", "vol", "obv_hi", "bigc", "up3",
]


def add_conditions(d: DataFrame) -> DataFrame:
    c, o, h, low = (F.col(x) for x in ("close", "open", "high", "low"))
    col = F.col
    narrow = rolling_quantile("bb_width", 120, 0.2)
    d = d.withColumn("__tight", flag(col("bb_width") <= narrow).cast("int"))
    rules = {
        "align": (col("ma5") > col("ma20")) & (col("ma20") > col("ma60")) & (col("ma60") > col("ma120")),
        "ma60up": (c > col("ma60")) & (col("ma60_slope") > 0),
        "ma20_60": col("ma20") > col("ma60"),
        "ma120": c > col("ma120"),
        "adx_up": (col("adx") > 25) & (col("pdi") > col("mdi")),
        "mom3m": col("ret60") > 0.10,
        "hi52": c >= 0.95 * col("hh252"),
        "brk20": c > col("hh20_prev"),
        "sqz": (highest("__tight", 5) == 1) & (c > col("bb_upper")),
        "rsi_pb": col("rsi").between(40, 55),
        "near20": (c / col("ma20") - 1).between(-0.03, 0.02),
        "rsi_os": col("rsi") < 30,
        "sto": (col("sto_k") > col("sto_d")) & (lag("sto_k") <= lag("sto_d")) & (lag("sto_k") < 25),
        "bb_rev": (low < col("bb_lower")) & (c > col("bb_lower")),
        "gc": crosses_up(col("ma5"), col("ma20")),
        "macd_x": crosses_up(col("macd"), col("macd_signal")),
        "macd_h": (col("macd_hist") < 0) & (col("macd_hist") > lag("macd_hist")) & (lag("macd_hist") > lag("macd_hist", 2)),
        "vol": (col("volume") > 2 * col("vol_ma20")) & (c > o) & (c > lag("close")),
        "obv_hi": col("obv") >= highest("obv", 20),
        "bigc": (F.try_divide(c - o, o) > 0.03) & ((h - c) < (c - o) * 0.3),
        "up3": (c > lag("close")) & (lag("close") > lag("close", 2)) & (lag("close", 2) > lag("close", 3)),
    }
    return d.withColumns({k: flag(v) for k, v in rules.items()}).drop("__tight")


CANDLES = [
    "vol_bull", "vol_bear", "hammer", "shooting", "bull_engulf", "bear_engulf", "morning_star", "evening_star", "three_white",
    "three_black", "gap_up", "gap_down", "doji_top", "harami_bull", "harami_bear", "piercing", "dark_cloud", "upper_tail",
    "lower_tail", "up_streak", "dn_streak", "ma20_up", "ma20_dn", "ma60_up", "ma60_dn", "gc_long", "dc_long", "hi52_brk", "lo52_brk",
    "overheat", "oversold", "bb_up", "bb_dn", "env_low", "half_off", "box_up", "box_dn", "vol_dry", "ma_conv", "pivot_hi", "pivot_lo",
]


def add_candles(d: DataFrame) -> DataFrame:
    """Candle, moving-average and range patterns that windows express. Needs ``add_moving`` and ``atr``."""
    c, o, h, low, atr = (F.col(x) for x in ("close", "open", "high", "low", "atr"))
    col = F.col
    body, span, up = F.abs(c - o), F.when(h > low, h - low), c > o  # a flat bar has no range
    d = d.withColumns({"__body": body, "__up": up, "__dn": c < o, "__ut": h - F.greatest(c, o), "__lt": F.least(c, o) - low, "__vr": F.try_divide(col("volume"), col("vol_ma20")), "__r5": c / lag("close", 5) - 1, "__mid": (o + c) / 2})
    body, up, dn, ut, lt, vr, r5 = (col(x) for x in ("__body", "__up", "__dn", "__ut", "__lt", "__vr", "__r5"))
    big = body >= 0.6 * atr
    d = d.withColumns({"__big": flag(big), "__rise": flag((c > o) & (body >= 0.3 * atr) & (c > lag("close"))).cast("int"), "__fall": flag((c < o) & (body >= 0.3 * atr) & (c < lag("close"))).cast("int"), "__p52h": highest("close", 252, 200, shift=1), "__p52l": rolling(F.min("close"), "close", 252, 200, 1), "__bh": highest("high", 60, shift=1), "__bl": rolling(F.min("low"), "low", 60, None, 1)})
    box = (col("__bh") / col("__bl") - 1) <= 0.25
    top3, low3 = F.greatest("ma5", "ma20", "ma60"), F.least("ma5", "ma20", "ma60")
    before = lag("__body") >= 0.8 * atr  # the bar before, against the range of today
    inside = (F.greatest(c, o) <= F.greatest(lag("close"), lag("open"))) & (F.least(c, o) >= F.least(lag("close"), lag("open"))) & (body <= 0.5 * lag("__body"))
    small = lag("__body") <= 0.3 * lag("__body", 2)
    rules = {
        "vol_bull": up & big & (vr >= 2) & (c > lag("close")) & (ut <= 0.5 * body),
        "vol_bear": dn & big & (vr >= 2) & (c < lag("close")),
        "hammer": (lt >= 2 * body) & (ut <= 0.3 * span) & (r5 < -0.03) & (low <= rolling(F.min("low"), "low", 10)),
        "shooting": (ut >= 2 * body) & (lt <= 0.3 * span) & (r5 > 0.03) & (h >= highest("high", 10)),
        "bull_engulf": up & lag("__dn") & (c >= lag("open")) & (o <= lag("close")) & (r5 < 0),
        "bear_engulf": dn & lag("__up") & (c <= lag("open")) & (o >= lag("close")) & (r5 > 0),
        "morning_star": lag("__dn", 2) & (lag("__body", 2) >= 0.6 * atr) & small & up & (c >= lag("__mid", 2)),
        "evening_star": lag("__up", 2) & (lag("__body", 2) >= 0.6 * atr) & small & dn & (c <= lag("__mid", 2)),
        "three_white": rolling(F.sum("__rise"), "__rise", 3) == 3,
        "three_black": rolling(F.sum("__fall"), "__fall", 3) == 3,
        "gap_up": low > lag("high"),
        "gap_down": h < lag("low"),
        "doji_top": (body <= 0.1 * span) & (r5 > 0.05) & (h >= highest("high", 20)),
        "harami_bull": lag("__dn") & before & inside & up & (r5 < -0.03),
        "harami_bear": lag("__up") & before & inside & dn & (r5 > 0.03),
        "piercing": up & lag("__dn") & before & (o < lag("close")) & (c > lag("__mid")) & (c < lag("open")),
        "dark_cloud": dn & lag("__up") & before & (o > lag("close")) & (c < lag("__mid")) & (c > lag("open")),
        "upper_tail": (ut >= 0.55 * span) & (span >= 1.2 * atr),
        "lower_tail": (lt >= 0.55 * span) & (span >= 1.2 * atr),
        "up_streak": (c > lag("close")) & (lag("close") > lag("close", 2)) & (lag("close", 2) > lag("close", 3)) & (lag("close", 3) > lag("close", 4)) & (lag("close", 4) > lag("close", 5)),
        "dn_streak": (c < lag("close")) & (lag("close") < lag("close", 2)) & (lag("close", 2) < lag("close", 3)) & (lag("close", 3) < lag("close", 4)) & (lag("close", 4) < lag("close", 5)),
        "ma20_up": crosses_up(c, col("ma20")) & (vr >= 1.5),
        "ma20_dn": (c < col("ma20")) & (lag("close") >= lag("ma20")),
        "ma60_up": crosses_up(c, col("ma60")),
        "ma60_dn": (c < col("ma60")) & (lag("close") >= lag("ma60")),
        "gc_long": crosses_up(col("ma20"), col("ma60")),
        "dc_long": (col("ma20") < col("ma60")) & (lag("ma20") >= lag("ma60")),
        "hi52_brk": c > col("__p52h"),
        "lo52_brk": c < col("__p52l"),
        "overheat": c > 1.15 * col("ma20"),
        "oversold": c < 0.88 * col("ma20"),
        "bb_up": crosses_up(c, col("bb_upper")),
        "bb_dn": (c < col("bb_lower")) & (lag("close") >= lag("bb_lower")),
        "env_low": low <= 0.8 * col("ma20"),
        "half_off": c <= 0.5 * highest("high", 250, 120),
        "box_up": box & (c > col("__bh")) & (lag("close") <= lag("__bh")) & (vr >= 1.5),
        "box_dn": box & (c < col("__bl")) & (lag("close") >= lag("__bl")),
        "vol_dry": mean("volume", 5) < 0.5 * mean("volume", 60),
        "ma_conv": (top3 - low3) / c <= 0.03,
        "pivot_hi": (lag("high", 5) == highest("high", 11)) & (lag("high", 5) > lag("high", 6)),
        "pivot_lo": (lag("low", 5) == rolling(F.min("low"), "low", 11)) & (lag("low", 5) < lag("low", 6)),
    }
    return d.withColumns({k: flag(v) for k, v in rules.items()}).drop(*[x for x in d.columns if x.startswith("__")])


def events(d: DataFrame, names: list[str], quiet: int = 5) -> DataFrame:
    """Long form of the onsets of flags: the columns of ``d`` besides them, and ``key``.

    A flag that was set in the ``quiet`` rows before is no onset. The flags of
    a row are one array, so one window serves all of them.
    """
    others = [x for x in d.columns if x not in names]
    true = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in names]))
    rows = d.select(*others, true.alias("__true")).withColumn("__before", F.flatten(F.collect_list("__true").over(by_code(-quiet, -1))))
    return rows.select(*others, F.explode(F.array_except("__true", "__before")).alias("key"))
