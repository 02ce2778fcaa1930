"""Column helpers for daily series. ``by_code()`` is the one order all of them share, so Spark sorts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows whose sums an exponential average carries in one block: beyond it the weight of a row is under 1e-16.
EWM_BLOCK = 500


def by_code(first: int | None = None, last: int | None = None):
    """Window of a code in date order; with bounds, a frame of rows."""
    w = W.partitionBy("code").orderBy("date")
    return w if first is None else w.rowsBetween(first, 0 if last is None else last)


def lag(x, n: int = 1) -> Column:
    return F.lag(x, n).over(by_code())


def lead(x, n: int = 1) -> Column:
    return F.lead(x, n).over(by_code())


def rolling(agg: Column, x, n: int, least: int | None = None, shift: int = 0) -> Column:
    """``agg`` over the last n rows (``shift`` rows ago), null until ``least`` values (n by default) are there."""
    w = by_code(-(n - 1) - shift, -shift)
    return F.when(F.count(x).over(w) >= (least or n), agg.over(w))


def mean(x, n: int, least: int | None = None) -> Column:
    return rolling(F.avg(x), x, n, least)


def highest(x, n: int, least: int | None = None, shift: int = 0) -> Column:
    return rolling(F.max(x), x, n, least, shift)


def lowest(x, n: int, least: int | None = None, shift: int = 0) -> Column:
    return rolling(F.min(x), x, n, least, shift)


def rolling_quantile(x: str, n: int, q: float, least: int | None = None) -> Column:
    """The ``q`` quantile of the last n values, between neighbours in proportion; null until ``least`` values (n by default) are there.

    One sorted array a row: cheaper than an aggregate that is filled anew for each frame.
    """
    values = F.sort_array(F.collect_list(x).over(by_code(-(n - 1), 0)))

    def at(v: Column) -> Column:
        place = q * (F.size(v) - 1)
        low = F.floor(place)
        a, b = F.get(v, low.cast("int")), F.get(v, F.ceil(place).cast("int"))
        between = (F.ceil(place) - place) * a + (place - low) * b
        return F.when(F.size(v) >= (least or n), F.when(low == F.ceil(place), a).otherwise(between))

    return F.element_at(F.transform(F.array(values), at), 1)


def flag(condition: Column) -> Column:
    """A condition on missing values is false."""
    return F.coalesce(condition, F.lit(False))


def crosses_up(x: Column, y: Column) -> Column:
    return flag((x > y) & (lag(x) <= lag(y)))


def crosses_down(x: Column, y: Column) -> Column:
    return flag((x < y) & (lag(x) >= lag(y)))


def onset(f: Column, quiet: int = 5) -> Column:
    """The flag, where it was not set in the ``quiet`` rows before."""
    return f & (F.coalesce(F.max(f.cast("int")).over(by_code(-quiet, -1)), F.lit(0)) == 0)


def pct_rank(x: str, within: list[str]) -> Column:
    """Average rank over the number of values, as a share; null for null."""
    order = W.partitionBy(*within).orderBy(F.col(x).asc_nulls_last())
    ties = F.count(x).over(W.partitionBy(*within, x))
    return F.when(F.col(x).isNotNull(), (F.rank().over(order) + (ties - 1) / 2) / F.count(x).over(W.partitionBy(*within)))


def ewm_all(df: DataFrame, series: dict[str, tuple[Column, float]]) -> DataFrame:
    """Add a column for each name: the recursive average y = (1-a) y + a x of its (x, a), from its first value on.

    Each ``x`` may be missing at the start of a series only. Running weighted
    sums in blocks of EWM_BLOCK rows; the end of the last block is carried on.
    Blocks follow the date, so windows of a code and windows of a block need
    the same order and all series share one sort.
    """
    names = list(series)
    s = df.withColumn("__i", F.row_number().over(by_code()) - 1)
    s = s.withColumns({"__b": F.floor(F.col("__i") / EWM_BLOCK), "__k": F.col("__i") % EWM_BLOCK} | {f"__x_{n}": x for n, (x, _) in series.items()})
    ordered = W.partitionBy("code").orderBy("__b", "date")
    block = W.partitionBy("code", "__b").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumns({f"__n_{n}": F.count(f"__x_{n}").over(ordered.rowsBetween(W.unboundedPreceding, 0)) for n in names})
    own = {}
    for n, (_, alpha) in series.items():
        weight = F.when(F.col(f"__n_{n}") == 1, 1.0).otherwise(alpha)
        decay = F.lit(1.0 - alpha)
        own[f"__own_{n}"] = F.sum(weight * F.col(f"__x_{n}") * F.pow(decay, -F.col("__k"))).over(block) * F.pow(decay, F.col("__k"))
    s = s.withColumns(own)
    s = s.withColumns({f"__end_{n}": F.last(F.when(F.col("__k") == EWM_BLOCK - 1, F.col(f"__own_{n}")), True).over(ordered.rowsBetween(W.unboundedPreceding, -1)) for n in names})
    out = {}
    for n, (_, alpha) in series.items():
        value = F.col(f"__own_{n}") + F.coalesce(F.col(f"__end_{n}") * F.pow(F.lit(1.0 - alpha), F.col("__k") + 1), F.lit(0.0))
        out[n] = F.when(F.col(f"__x_{n}").isNotNull(), value)
    return s.withColumns(out).drop("__i", "__b", "__k", *[f"__{p}_{n}" for n in names for p in ("x", "n", "own", "end")])


def ewm(df: DataFrame, out: str, x: Column, alpha: float) -> DataFrame:
    """``ewm_all`` of one series."""
    return ewm_all(df, {out: (x, alpha)})


def tick(p: Column) -> Column:
    """Price step of the exchange at price p."""
    size = F.lit(1000)
    for bound, step in ((500_000, 500), (200_000, 100), (50_000, 50), (20_000, 10), (5_000, 5), (2_000, 1)):
        size = F.when(p < bound, step).otherwise(size)
    return size
