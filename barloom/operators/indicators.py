"""Technical indicators over daily bars, one column each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.expr import by_code, ewm_all, highest, lag, lowest, mean, rolling


def add_moving(df: DataFrame) -> DataFrame:
    """Moving averages, bands, stochastic, volume, highs and returns: windows over one sort."""
    for n in (5, 20, 60, 120):
        df = df.withColumn(f"ma{n}", mean("close", n))
    df = df.withColumn("ma60_slope", F.col("ma60") / lag("ma60", 5) - 1)
    sd = rolling(F.stddev_samp("close"), "close", 20)
    df = df.withColumn("bb_sd", sd).withColumn("bb_upper", F.col("ma20") + 2 * F.col("bb_sd")).withColumn("bb_lower", F.col("ma20") - 2 * F.col("bb_sd"))
    df = df.withColumn("bb_width", (F.col("bb_upper") - F.col("bb_lower")) / F.col("ma20")).drop("bb_sd")
    low, high = lowest("low", 14), highest("high", 14)
    df = df.withColumn("__ll", low).withColumn("__hh", high).withColumn("__fast", F.try_divide(100 * (F.col("close") - F.col("__ll")), F.col("__hh") - F.col("__ll")))
    df = df.withColumn("sto_k", mean("__fast", 3)).withColumn("sto_d", mean("sto_k", 3)).drop("__ll", "__hh", "__fast")
    df = df.withColumn("vol_ma20", mean("volume", 20))
    df = df.withColumn("__signed", F.coalesce(F.signum(F.col("close") - lag("close")), F.lit(0.0)) * F.col("volume"))
    df = df.withColumn("obv", F.sum("__signed").over(by_code(W.unboundedPreceding))).drop("__signed")
    df = df.withColumn("hh20_prev", highest("high", 20, shift=1)).withColumn("hh252", highest("close", 252, 120))
    return df.withColumn("ret60", F.col("close") / lag("close", 60) - 1).withColumn("ret120", F.col("close") / lag("close", 120) - 1)


def add_recursive(df: DataFrame) -> DataFrame:
    """RSI(14), MACD(12, 26, 9), ATR(14), directional movement and ADX(14)."""
    c, before = F.col("close"), lag("close")
    up, dn = F.col("__up"), F.col("__dn")
    df = df.withColumns({"__d": c - before, "__up": F.col("high") - lag("high"), "__dn": lag("low") - F.col("low"), "__tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))})
    change = F.col("__d")
    df = ewm_all(
        df,
        {
            "__gain": (F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), 1 / 14),
            "__loss": (F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))), 1 / 14),
            "__fast": (c, 2 / 13),
            "__slow": (c, 2 / 27),
            "atr": (F.col("__tr"), 1 / 14),
            "__p": (F.when((up > dn) & (up > 0), up).otherwise(0.0), 1 / 14),
            "__m": (F.when((dn > up) & (dn > 0), dn).otherwise(0.0), 1 / 14),
        },
    )
    df = df.withColumns(
        {
            "rsi": 100 - 100 / (1 + F.try_divide(F.col("__gain"), F.col("__loss"))),
            "macd": F.col("__fast") - F.col("__slow"),
            "atr_pct": F.col("atr") / c,
            "pdi": F.try_divide(100 * F.col("__p"), F.col("atr")),
            "mdi": F.try_divide(100 * F.col("__m"), F.col("atr")),
        }
    )
    dx = F.try_divide(100 * F.abs(F.col("pdi") - F.col("mdi")), F.col("pdi") + F.col("mdi"))
    df = ewm_all(df, {"macd_signal": (F.col("macd"), 2 / 10), "adx": (dx, 1 / 14)})
    df = df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return df.drop("__d", "__up", "__dn", "__tr", "__gain", "__loss", "__fast", "__slow", "__p", "__m")


def add_indicators(df: DataFrame) -> DataFrame:
    """All columns. Bars stay partitioned by code: one exchange, one sort order."""
    return add_recursive(add_moving(df))
