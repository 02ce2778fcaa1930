"""Oscillators beyond the core indicators, the cloud chart, and the patterns read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import crosses_up, flag, highest, lag, lowest, mean, rolling

OSCILLATORS = ["ma10", "ma240", "conversion", "base", "span_a", "span_b", "cloud_top", "cloud_bottom", "cci", "mfi", "wr", "vwap120"]
PATTERNS = [
    "sto_gc", "sto_dc", "macd_zero_up", "macd_zero_dn", "rsi_os_exit", "rsi_ob_exit", "rsi50_up", "cci_up", "cci_dn", "mfi_os", "mfi_ob", "wr_os_exit", "dmi_gc", "dmi_dc",
    "adx25_up", "adx25_dn", "bb_rebound", "ichi_cloud_up", "ichi_cloud_dn", "ichi_tk_gc", "ichi_tk_dc", "ichi_chikou", "ichi_twist", "vwap_up", "vwap_dn",
]


def add_oscillators(d: DataFrame) -> DataFrame:
    """Cloud lines, CCI(20), MFI(14), Williams %R(14), 120-day average price and two more means."""
    c, v = F.col("close"), F.col("volume")
    middle = lambda n: (highest("high", n) + lowest("low", n)) / 2
    d = d.withColumns({"ma10": mean("close", 10), "ma240": mean("close", 240), "conversion": middle(9), "base": middle(26), "span_b": middle(52)})
    d = d.withColumn("span_a", (F.col("conversion") + F.col("base")) / 2).withColumns({"__a": lag("span_a", 26), "__b": lag("span_b", 26)})
    known = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    d = d.withColumns({"cloud_top": F.when(known, F.greatest("__a", "__b")), "cloud_bottom": F.when(known, F.least("__a", "__b"))})
    d = d.withColumn("__tp", (F.col("high") + F.col("low") + c) / 3).withColumn("__m", mean("__tp", 20)).withColumn("__dev", F.abs(F.col("__tp") - F.col("__m")))
    d = d.withColumn("cci", F.try_divide(F.col("__tp") - F.col("__m"), 0.015 * mean("__dev", 20)))
    d = d.withColumn("__before", lag("__tp"))
    flow = F.col("__tp") * v
    d = d.withColumns({"__pos": F.when(F.col("__tp") > F.col("__before"), flow).otherwise(0.0), "__neg": F.when(F.col("__tp") < F.col("__before"), flow).otherwise(0.0)})
    d = d.withColumn("mfi", 100 - 100 / (1 + F.try_divide(rolling(F.sum("__pos"), "__pos", 14), rolling(F.sum("__neg"), "__neg", 14))))
    hh, ll = highest("high", 14), lowest("low", 14)
    d = d.withColumn("wr", F.try_divide(-100 * (hh - c), hh - ll)).withColumn("__cv", c * v)
    d = d.withColumn("vwap120", F.try_divide(rolling(F.sum("__cv"), "__cv", 120), rolling(F.sum("volume"), "volume", 120)))
    return d.drop("__a", "__b", "__tp", "__m", "__dev", "__before", "__pos", "__neg", "__cv")


def add_oscillator_patterns(d: DataFrame) -> DataFrame:
    """Needs the core indicators and ``add_oscillators``."""
    col = F.col

    def level_up(x: str, level: float):
        return (col(x) > level) & (lag(x) <= level)

    def level_down(x: str, level: float):
        return (col(x) < level) & (lag(x) >= level)

    def down(x: str, y: str):
        return (col(x) < col(y)) & (lag(x) >= lag(y))

    up = lambda x, y: crosses_up(col(x), col(y))
    rules = {
        "sto_gc": up("sto_k", "sto_d") & (lag("sto_k") <= 20), "sto_dc": down("sto_k", "sto_d") & (lag("sto_k") >= 80),
        "macd_zero_up": level_up("macd", 0), "macd_zero_dn": level_down("macd", 0),
        "rsi_os_exit": level_up("rsi", 30), "rsi_ob_exit": level_down("rsi", 70), "rsi50_up": level_up("rsi", 50),
        "cci_up": level_up("cci", -100), "cci_dn": level_down("cci", 100), "mfi_os": col("mfi") <= 20, "mfi_ob": col("mfi") >= 80, "wr_os_exit": level_up("wr", -80),
        "dmi_gc": up("pdi", "mdi") & (col("adx") >= 20), "dmi_dc": down("pdi", "mdi") & (col("adx") >= 20),
        "adx25_up": level_up("adx", 25) & (col("pdi") > col("mdi")), "adx25_dn": level_up("adx", 25) & (col("pdi") < col("mdi")),
        "bb_rebound": (lag("close") < lag("bb_lower")) & (col("close") > col("bb_lower")),
        "ichi_cloud_up": up("close", "cloud_top"), "ichi_cloud_dn": down("close", "cloud_bottom"), "ichi_tk_gc": up("conversion", "base"), "ichi_tk_dc": down("conversion", "base"),
        "ichi_chikou": (col("close") > lag("close", 26)) & (lag("close") <= lag("close", 27)), "ichi_twist": up("span_a", "span_b"), "vwap_up": up("close", "vwap120"), "vwap_dn": down("close", "vwap120"),
    }
    return d.withColumns({k: flag(v) for k, v in rules.items()})
