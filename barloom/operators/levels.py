"""The last bar of each code in its surroundings: swing and phase, retracements, volume zones, support and resistance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.expr import by_code, flag, highest, lag, lowest, tick
from barloom.operators.studies import volume_profile

LOOK, BINS = 120, 24
#: Bars on either side of a pivot that may be a level.
SIDE = 8
#: Prices this near to a level's first one belong to it; levels of a side.
NEAR, LEVELS = 0.012, 3
#: Shares of a swing.
RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)
#: Candidates in the order in which equal prices are named.
KINDS = ["pivot_high", "pivot_low", "ma20", "ma60", "ma120", "fib382", "fib500", "fib618", "zone_above", "zone_below", "high250", "low250"]


def to_tick(p: Column) -> Column:
    """The nearest price step; a half goes up."""
    return F.floor(p / tick(p) + 0.5) * tick(p)


def swings(d: DataFrame, look: int = LOOK) -> DataFrame:
    """One row a code: the latest of the highest bars of the last ``look``, the low before it and the low after it.

    Returns ``code, n, t, high, low, after, close, days, fall, rise, back, span, rebound``; ``t`` is the high's
    bar number, ``low`` the lowest of the ``look`` bars up to it, ``after`` the lowest since (the high's own
    low when it is the last bar).
    """
    d = d.select("code", "date", "high", "low", "close").withColumns({"rn": F.row_number().over(by_code()), "n": F.count(F.lit(1)).over(W.partitionBy("code"))})
    top = F.max(F.when(F.col("rn") > F.col("n") - look, F.struct("high", "rn")))
    d = d.withColumn("top", top.over(W.partitionBy("code"))).withColumn("t", F.col("top.rn"))
    g = d.groupBy("code").agg(
        F.first("n").alias("n"), F.first("t").alias("t"), F.first("top.high").alias("high"),
        F.min(F.when(F.col("rn").between(F.col("t") - look, F.col("t")), F.col("low"))).alias("low"),
        F.min(F.when(F.col("rn") > F.col("t"), F.col("low"))).alias("__after"),
        F.max(F.when(F.col("rn") == F.col("t"), F.col("low"))).alias("__own"), F.max_by("close", "rn").alias("close"),
    )
    g = g.withColumn("after", F.coalesce("__after", "__own")).drop("__after", "__own")
    h, low, after, c = (F.col(x) for x in ("high", "low", "after", "close"))
    positive = lambda x, y: F.when(y > 0, x / y - 1).otherwise(0.0)
    return g.withColumns({"days": F.col("n") - F.col("t"), "fall": c / h - 1, "rise": positive(h, low), "back": F.when(h > low, (h - c) / (h - low)).otherwise(0.0), "span": positive(h, after), "rebound": positive(c, after)})


def phases(d: DataFrame) -> DataFrame:
    """``swings`` with ``phase``, from the averages and ranges of the last bar. Needs ``add_moving``."""
    d = d.withColumns(
        {
            "__s60": F.coalesce(F.col("ma60") / lag("ma60", 5) - 1, F.lit(0.0)), "__s20": F.coalesce(F.col("ma20") / lag("ma20", 5) - 1, F.lit(0.0)),
            "__r20": F.max("high").over(by_code(-19, 0)) / F.min("low").over(by_code(-19, 0)) - 1, "__r60": F.max("high").over(by_code(-59, 0)) / F.min("low").over(by_code(-59, 0)) - 1,
            "__n": F.row_number().over(by_code()), "__left": F.row_number().over(W.partitionBy("code").orderBy(F.desc("date"))),
        }
    )
    now = d.where("__left = 1").select("code", "ma20", "ma60", "ma120", F.when(F.col("__n") > 70, F.col("__s60")).otherwise(0.0).alias("s60"), F.when(F.col("__n") > 26, F.col("__s20")).otherwise(0.0).alias("s20"), F.col("__r20").alias("r20"), F.col("__r60").alias("r60"))
    s = swings(d).join(now, "code")
    col = F.col
    fall, rise, days, worst = col("fall"), col("rise"), col("days"), col("after") / col("high") - 1
    rules = {
        "uptrend": (fall >= -0.06) & (col("ma20") > col("ma60")) & (col("s60") > 0),
        "price_corr": (rise >= 0.15) & (fall <= -0.12) & (col("rebound") < 0.07) & (days <= 60),
        "price_corr_rb": (rise >= 0.15) & (worst <= -0.12) & (col("rebound") >= 0.07) & (days <= 90) & (fall <= -0.05),
        "time_corr": (rise >= 0.15) & (days >= 12) & (col("span") <= 0.16),
        "base": (fall <= -0.25) & (col("close") < col("ma120")) & (col("r20") <= 0.14) & (F.abs("s20") < 0.02),
        "downtrend": (col("ma20") < col("ma60")) & (col("s60") < 0) & (fall <= -0.15),
        "box": col("r60") <= 0.25,
    }
    phase = F.lit("mixed")
    for k, rule in reversed(rules.items()):
        phase = F.when(flag(rule), k).otherwise(phase)
    return s.withColumn("phase", phase)


def retracements(p: DataFrame) -> DataFrame:
    """``phases`` with ``kind`` and ``fib``, the prices at RATIOS of the rise ('retr') or of the fall ('rebound'); null where neither counts."""
    up = F.col("phase").isin("uptrend", "price_corr", "price_corr_rb", "time_corr", "box", "mixed") & (F.col("rise") >= 0.15)
    down = F.col("phase").isin("downtrend", "base") & (F.col("high") / F.col("after") - 1 >= 0.2) & (F.col("days") > 0)
    kind = F.when(up, "retr").when(down, "rebound")
    at = lambda ratio: F.when(up, F.col("high") - (F.col("high") - F.col("low")) * ratio).when(down, F.col("after") + (F.col("high") - F.col("after")) * ratio)
    return p.withColumns({"kind": kind, "fib": F.when(kind.isNotNull(), F.array(*[to_tick(at(x)) for x in RATIOS]))})


def volume_zones(d: DataFrame, look: int = LOOK, bins: int = BINS) -> DataFrame:
    """``code, zone_above, zone_below``: the middle of the nearest run of heavy bins wholly above, and wholly below, the last close.

    Heavy bins hold 1.25 times an even share and are among the upper three
    tenths. A code's bins are an array of fixed length.
    """
    last = d.withColumn("rn", F.row_number().over(W.partitionBy("code").orderBy(F.desc("date")))).where(F.col("rn") <= look)
    ends = last.groupBy("code").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.max_by("close", "date").alias("close"))
    p = volume_profile(d, look, bins).groupBy("code").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "value"))), lambda x: x["value"]).alias("v"))
    p = p.withColumn("total", F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).where("total > 0")
    p = p.withColumn("share", F.transform("v", lambda x: x / F.col("total"))).join(ends, "code")
    at = 0.7 * (bins - 1)
    k = int(at)
    ordered = F.sort_array("share")
    bound = F.greatest(F.lit(1.25 / bins), F.get(ordered, F.lit(k)) + (at - k) * (F.get(ordered, F.lit(min(k + 1, bins - 1))) - F.get(ordered, F.lit(k))))
    p = p.withColumns({"step": (F.col("hi") - F.col("lo")) / bins, "heavy": F.transform("share", lambda x: x >= bound)})
    edge = lambda i: F.col("lo") + i * F.col("step")
    every = F.sequence(F.lit(0), F.lit(bins - 1))
    heavy = lambda i: F.get("heavy", i)
    p = p.withColumns({"a0": F.array_min(F.filter(every, lambda i: (edge(i) > F.col("close")) & heavy(i))), "b1": F.array_max(F.filter(every, lambda i: (edge(i + 1) < F.col("close")) & heavy(i)))})
    # the run ends before the next light bin
    p = p.withColumns({"a1": F.coalesce(F.array_min(F.filter(every, lambda i: (i > F.col("a0")) & ~heavy(i))) - 1, F.lit(bins - 1)), "b0": F.coalesce(F.array_max(F.filter(every, lambda i: (i < F.col("b1")) & ~heavy(i))) + 1, F.lit(0))})
    middle = lambda a, z: (to_tick(edge(F.col(a))) + to_tick(edge(F.col(z) + 1))) / 2
    return p.select("code", F.when(F.col("a0").isNotNull(), middle("a0", "a1")).alias("zone_above"), F.when(F.col("b1").isNotNull(), middle("b0", "b1")).alias("zone_below"))


def price_levels(d: DataFrame) -> DataFrame:
    """Up to LEVELS supports and resistances of each code's last bar, nearest first: ``code, side, place, price, kinds``.

    Candidates are confirmed pivots, averages, retracements, volume zones and
    the year's ends; those within NEAR of a level's first price join it, and
    it bears the first three of their kinds. Needs ``add_moving`` and ``atr_pct``.
    """
    rows = d.withColumns(
        {
            "__left": F.row_number().over(W.partitionBy("code").orderBy(F.desc("date"))),
            "__h250": F.max("high").over(by_code(-249, 0)), "__l250": F.min("low").over(by_code(-249, 0)),
            "__ph": flag((lag("high", SIDE) == highest("high", 2 * SIDE + 1)) & (lag("high", SIDE) > lag("high", SIDE + 1))), "__pl": flag((lag("low", SIDE) == lowest("low", 2 * SIDE + 1)) & (lag("low", SIDE) < lag("low", SIDE + 1))),
            "__ph_at": lag("high", SIDE), "__pl_at": lag("low", SIDE),
        }
    )
    # a pivot counts if all its neighbours are among the last LOOK bars
    inside = F.col("__left") <= LOOK - 2 * SIDE
    kind = lambda k, p: F.struct(p.alias("price"), F.lit(KINDS.index(k)).alias("k"))
    pivots = rows.where(inside & (F.col("__ph") | F.col("__pl"))).select("code", F.array(F.when(F.col("__ph"), kind("pivot_high", F.col("__ph_at"))), F.when(F.col("__pl"), kind("pivot_low", F.col("__pl_at")))).alias("c"))
    pivots = pivots.groupBy("code").agg(F.flatten(F.collect_list("c")).alias("pivots"))  # of at most LOOK bars
    now = rows.where("__left = 1").select("code", "close", "atr_pct", "ma20", "ma60", "ma120", "__h250", "__l250")
    fib = retracements(phases(d)).select("code", "fib")
    x = now.join(pivots, "code", "left").join(fib, "code").join(volume_zones(d), "code", "left")
    named = {"ma20": F.col("ma20"), "ma60": F.col("ma60"), "ma120": F.col("ma120"), "fib382": F.get("fib", F.lit(1)), "fib500": F.get("fib", F.lit(2)), "fib618": F.get("fib", F.lit(3)), "zone_above": F.col("zone_above"), "zone_below": F.col("zone_below"), "high250": F.col("__h250"), "low250": F.col("__l250")}
    fixed = F.array(*[F.when(p.isNotNull(), kind(k, p)) for k, p in named.items()])
    nothing = F.array().cast("array<struct<price:double,k:int>>")
    every = F.array_compact(F.concat(F.coalesce("pivots", nothing), fixed))
    gap = F.greatest(F.lit(NEAR), 0.4 * F.coalesce("atr_pct", F.lit(0.02)))
    x = x.select("code", "close", gap.alias("gap"), every.alias("every"))
    x = x.select("code", "close", "gap", "every", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"))
    beyond = lambda p: F.when(F.col("side") > 0, p["price"] > F.col("close") * (1 + F.col("gap"))).otherwise(p["price"] < F.col("close") * (1 - F.col("gap")))
    # nearest first: by price, falling for supports, then by kind
    ordered = F.array_sort(F.transform(F.filter("every", beyond), lambda p: F.struct((p["price"] * F.col("side")).alias("at"), p["k"].alias("k"), p["price"].alias("price"))))
    none = F.array().cast("array<struct<price:double,kinds:array<int>>>")

    def gather(found: Column, p: Column) -> Column:
        last = F.element_at(found, -1)
        joins = (F.size(found) > 0) & (F.abs(p["price"] / F.get(found, F.size(found) - 1)["price"] - 1) <= NEAR)
        longer = F.concat(F.slice(found, 1, F.size(found) - 1), F.array(F.struct(last["price"].alias("price"), F.array_union(last["kinds"], F.array(p["k"])).alias("kinds"))))
        fresh = F.array_append(found, F.struct(p["price"].alias("price"), F.array(p["k"]).alias("kinds")))
        return F.when(F.size(found) >= LEVELS, found).when(joins, longer).otherwise(fresh)

    x = x.select("code", "side", F.posexplode(F.aggregate(ordered, none, gather)).alias("place", "level"))
    names = F.array(*[F.lit(k) for k in KINDS])
    kinds = F.array_join(F.transform(F.slice("level.kinds", 1, 3), lambda k: F.get(names, k)), "+")
    return x.select("code", F.when(F.col("side") > 0, "resistance").otherwise("support").alias("side"), (F.col("place") + 1).alias("place"), to_tick(F.col("level.price")).alias("price"), kinds.alias("kinds"))
