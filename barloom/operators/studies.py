"""Resampling, as-of join, indices, volume profile, rule mining and quote bars."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.expr import by_code, lag


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Bars of each ``unit`` (week from Monday, month, year): code, period, open, high, low, close, volume."""
    return bars.groupBy("code", F.to_date(F.date_trunc(unit, "date")).alias("period")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume")
    )


def asof_backward(bars: DataFrame, facts: DataFrame, value: str) -> DataFrame:
    """``bars`` with the last ``value`` of ``facts (code, date, value)`` dated no later.

    A union and one running window: no range join, and each side is shuffled once.
    """
    marked = bars.withColumn("__kind", F.lit(1)).unionByName(facts.select("code", "date", value).withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    so_far = W.partitionBy("code").orderBy("date", "__kind").rowsBetween(W.unboundedPreceding, 0)
    return marked.withColumn(value, F.last(value, True).over(so_far)).where("__kind = 1").drop("__kind")


def index_series(bars: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """Size-weighted daily return and the logarithm of the level it compounds to; ``sizes (code, marcap, *by)`` is one row a code."""
    d = bars.withColumn("ret", F.col("close") / lag("close") - 1).where("ret is not null").join(sizes, "code")
    day = d.groupBy("date", *by).agg((F.sum(F.col("ret") * F.col("marcap")) / F.sum("marcap")).alias("ret"), F.count(F.lit(1)).alias("n"))
    so_far = W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    # one row a day: a calendar, whatever the number of codes
    return day.withColumn("log_level", F.round(F.sum(F.log1p("ret")).over(so_far), 6)).withColumn("ret", F.round("ret", 6)).select("date", *by, "ret", "n", "log_level")


def volume_profile(bars: DataFrame, days: int, bins: int) -> DataFrame:
    """Traded value by price over each code's last ``days`` bars, spread over ``bins`` equal bins by overlap."""
    last = bars.withColumn("rn", F.row_number().over(W.partitionBy("code").orderBy(F.desc("date")))).where(F.col("rn") <= days)
    ends = last.groupBy("code").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    d = last.join(ends, "code").withColumn("width", (F.col("hi") - F.col("lo")) / bins).where("width > 0")
    d = d.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("a", F.col("lo") + F.col("bin") * F.col("width"))
    part = F.greatest(F.lit(0.0), F.least("high", F.col("a") + F.col("width")) - F.greatest("low", F.col("a")))
    flat = (F.col("bin") == F.least(F.lit(bins - 1), F.floor((F.col("close") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).cast("double")
    share = F.when(F.col("high") > F.col("low"), part / (F.col("high") - F.col("low"))).otherwise(flat)
    return d.groupBy("code", "bin").agg(F.round(F.sum(F.col("volume") * F.col("close") * share), 2).alias("value"))


def _masks(names: list[str], most: int):
    """The bits of the flags ``names`` that hold in a row, and what makes conjunctions of one flag more of an array of them."""
    if not 1 <= most <= 3 or len(names) > 62:
        raise ValueError("one to three of at most 62 flags")
    one = F.array_compact(F.array(*[F.when(F.col(x), F.lit(1 << i).cast("long")) for i, x in enumerate(names)]))
    wider = lambda below: F.flatten(F.transform(below, lambda c: F.transform(F.filter("__one", lambda m: m > c), lambda m: m.bitwiseOR(c))))
    return one, wider


def early_days(d: DataFrame, share: float = 0.65) -> DataFrame:
    """``date, early`` of the days of ``d``: whether a day is among the first ``share``. One row a day, whatever the codes."""
    days = d.select("date").distinct()
    return days.select("date", (F.row_number().over(W.orderBy("date")) <= F.floor(share * F.count(F.lit(1)).over(W.partitionBy()))).alias("early"))


def combo_table(d: DataFrame, names: list[str], most: int, least: int) -> DataFrame:
    """Statistics of ``ret`` for every conjunction of up to ``most`` of the flags ``names``; ``early`` parts the days.

    A row's conjunctions are expanded in the row, as bit masks of the flags it
    has, and meet again in one aggregation with partial sums: at most as many
    groups as combinations.
    """
    one, wider = _masks(names, most)
    d = d.select("ret", "early", one.alias("__one"))
    levels = ["__one"]
    for k in range(1, most):
        d = d.withColumn(f"__l{k}", wider(F.col(levels[-1])))
        levels.append(f"__l{k}")
    long = d.select("ret", "early", F.explode(F.concat(*levels)).alias("mask"))
    mean = F.avg("ret")
    return (
        long.groupBy("mask")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(mean, 6).alias("mean_ret"),
            F.round(mean - 1.64 * F.stddev_pop("ret") / F.sqrt(F.count(F.lit(1))), 6).alias("lower_bound"),
            F.round(F.avg(F.when(F.col("early"), F.col("ret"))), 6).alias("early_mean"),
            F.round(F.avg(F.when(~F.col("early"), F.col("ret"))), 6).alias("late_mean"),
        )
        .where(F.col("n") >= least)
        .withColumn("combo", F.concat_ws("+", *[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(x)) for i, x in enumerate(names)]))
        .drop("mask")
    )


def onset_combos(d: DataFrame, names: list[str], most: int, split, least_early: int, least_late: int, quiet: int = 5) -> DataFrame:
    """Statistics of ``ret`` at the onsets of every conjunction of up to three of the flags ``names``; ``split`` parts early from late days.

    Only conjunctions that hold in a row are expanded, from its bit mask; one
    that held in the ``quiet`` rows before is no onset. They meet again in one
    aggregation with partial sums: at most as many groups as combinations.
    """
    if not 1 <= most <= 3 or len(names) > 62:
        raise ValueError("one to three of at most 62 flags")
    bits = sum((F.when(F.col(x), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, x in enumerate(names)), F.lit(0).cast("long"))
    d = d.select("code", "date", "ret", bits.alias("__bits"))
    d = d.withColumn("__before", F.collect_list("__bits").over(by_code(-quiet, -1))).where("ret is not null and __bits <> 0")
    d = d.withColumn("__one", F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(len(names))]), lambda m: m.bitwiseAND(F.col("__bits")) != 0))
    more = lambda below: F.flatten(F.transform(below, lambda c: F.transform(F.filter("__one", lambda m: m > c), lambda m: m.bitwiseOR(c))))
    for k, below in (("__two", "__one"), ("__three", "__two"))[: most - 1]:
        d = d.withColumn(k, more(below))
    all_ = F.concat(*("__one", "__two", "__three")[:most])
    new = F.filter(all_, lambda m: ~F.exists("__before", lambda b: b.bitwiseAND(m) == m))
    late, mean = F.col("date") >= split, F.avg("ret")
    return (
        d.select("ret", late.alias("late"), F.explode(new).alias("__mask"))
        .groupBy("__mask")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(mean, 6).alias("mean_ret"),
            F.round(mean - 1.64 * F.stddev_pop("ret") / F.sqrt(F.count(F.lit(1))), 6).alias("lower_bound"),
            F.count_if(~F.col("late")).alias("n_early"),
            F.round(F.avg(F.when(~F.col("late"), F.col("ret"))), 6).alias("early_mean"),
            F.count_if("late").alias("n_late"),
            F.round(F.avg(F.when(F.col("late"), F.col("ret"))), 6).alias("late_mean"),
        )
        .where((F.col("n_early") >= least_early) & (F.col("n_late") >= least_late))
        .withColumn("combo", F.concat_ws("+", *[F.when(F.col("__mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(x)) for i, x in enumerate(names)]))
        .drop("__mask")
    )


def split_day(d: DataFrame, share: float = 0.65):
    """The day that ``share`` of the distinct days of ``d`` lie before; null for none. Days are as many as the calendar has."""
    days = d.select("date").distinct().agg(F.sort_array(F.collect_set("date")).alias("days"))
    return days.select(F.get("days", F.floor(F.size("days") * F.lit(share)).cast("int"))).first()[0]


def quote_bars(quotes: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Bars of ``events (ts, event_type, value, event_id)`` by type and window; with ``late``, a watermark.

    The same plan serves batch tables and streams.
    """
    source = quotes.where("value is not null")
    if late:
        source = source.withWatermark("ts", late)
    order = F.struct("ts", "event_id")
    return (
        source.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("code"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("n"))
        .select("code", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")
    )
