"""Scores learned walk-forward, their calibration, and what a score is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import pct_rank

#: Rows that a bucket of a calibration, and a cell of a band, needs.
LEAST_BUCKET, LEAST_CELL = 30, 200
#: Bounds of the buckets of a score's rank, and quantiles of a band.
EDGES = [*(k / 10 for k in range(9)), 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 1.0]
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def daily_ranks(d: DataFrame, features: list[str]) -> DataFrame:
    """``z_<feature>`` for each: its rank of the day less one half, 0 where it is missing."""
    return d.withColumns({f"z_{f}": F.coalesce(pct_rank(f, ["date"]) - 0.5, F.lit(0.0)) for f in features})


def fold_starts(days: int, share: float = 0.45, most: int = 756, width: int = 126) -> list[int]:
    """First days of the folds that are scored: the last ``share`` of the days, ``most`` at most, ``width`` days each."""
    return list(range(days - min(most, int(days * share)) + 1, days + 1, width))


def walk_forward(d: DataFrame, features: list[str], target: str, days: int, horizon: int, width: int = 126, trees: int = 30, depth: int = 5, seed: int = 7) -> DataFrame:
    """Rows of the scored folds with ``fold, pred``: a forest fitted on days so early that their targets were known when the fold began.

    ``day`` numbers the panel's days from 1 to ``days``. A fold that begins on
    day s learns from days up to s - ``horizon`` - 1, so no target reaches into
    it. Fitting is Spark ML's, spread over the partitions, a pass for each
    level of the trees; the input is cached for the folds. Folds without a row
    to learn from are left out. ``features`` must not be null.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = VectorAssembler(inputCols=features, outputCol="__x").transform(d).cache()
    known = rows.where(F.col(target).isNotNull()).agg(F.min("day")).first()[0]
    scored = None
    for fold, start in enumerate(fold_starts(days, width=width), 1):
        if known is None or start - horizon - 1 < known:
            continue
        train = rows.where((F.col("day") <= start - horizon - 1) & F.col(target).isNotNull())
        forest = RandomForestRegressor(featuresCol="__x", labelCol=target, predictionCol="pred", numTrees=trees, maxDepth=depth, minInstancesPerNode=50, subsamplingRate=0.7, seed=seed)
        test = forest.fit(train).transform(rows.where(F.col("day").between(start, start + width - 1))).withColumn("fold", F.lit(fold))
        scored = test if scored is None else scored.unionByName(test)
    if scored is None:
        return d.limit(0).withColumns({"pred": F.lit(0.0), "fold": F.lit(0)})
    return scored.drop("__x")


def bucket_means(d: DataFrame, rank: str, value: str, edges: list[float] = EDGES, least: int = LEAST_BUCKET) -> DataFrame:
    """``bucket, lo, hi, n, mean`` of ``value`` by bucket of ``rank`` (the last one holds its upper end), ``least`` rows each."""
    k = F.least(F.size(F.filter(F.array(*[F.lit(x) for x in edges]), lambda e: e <= F.col(rank))) - 1, F.lit(len(edges) - 2))
    bounds = F.array(*[F.lit(x) for x in edges])
    g = d.where(F.col(rank).isNotNull() & F.col(value).isNotNull()).groupBy(k.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= least)
    return g.select("bucket", F.get(bounds, F.col("bucket")).alias("lo"), F.get(bounds, F.col("bucket") + 1).alias("hi"), "n", "mean")


def monotone(buckets: DataFrame) -> DataFrame:
    """One row ``xs, ys``: middles of the buckets, and the rising sequence nearest to their means by weight ``n``.

    The value at i is the largest over j <= i of the smallest over k >= i of
    the weighted mean of j .. k. Buckets are a fixed number.
    """
    listed = buckets.agg(F.sort_array(F.collect_list(F.struct("bucket", ((F.col("lo") + F.col("hi")) / 2).alias("x"), "n", "mean"))).alias("b"))
    last = F.size("b") - 1
    total = lambda j, k, of: F.aggregate(F.slice("b", j + 1, k - j + 1), F.lit(0.0), lambda a, x: a + of(x))
    mean = lambda j, k: total(j, k, lambda x: x["n"] * x["mean"]) / total(j, k, lambda x: x["n"].cast("double"))
    fitted = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_max(F.transform(F.sequence(F.lit(0), i), lambda j: F.array_min(F.transform(F.sequence(i, last), lambda k: mean(j, k))))))
    return listed.where(F.size("b") > 0).select(F.transform("b", lambda x: x["x"]).alias("xs"), fitted.alias("ys"))


def interpolate(p: Column, xs: Column, ys: Column) -> Column:
    """The broken line through (xs, ys) at ``p``; flat beyond its ends, null for null. ``xs`` rise."""
    n = F.size(xs)
    k = F.size(F.filter(xs, lambda x: x <= p))  # knots up to p
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    inside = y0 + (p - x0) / (x1 - x0) * (y1 - y0)
    return F.when(p.isNull() | (n <= 0), F.lit(None)).when(k == 0, F.get(ys, F.lit(0))).when(k >= n, F.get(ys, n - 1)).otherwise(inside)


def band_table(d: DataFrame, rank: str, value: str, least: int = LEAST_CELL) -> DataFrame:
    """``tenth, n, q``: quantiles of ``value`` by tenth of ``rank``; a tenth with ``least`` rows or fewer takes those of all rows."""
    tenth = F.least(F.floor(F.col(rank) * 10).cast("int"), F.lit(9))
    q = F.percentile(value, F.array(*[F.lit(x) for x in QUANTILES]))
    d = d.where(F.col(rank).isNotNull() & F.col(value).isNotNull())
    own = d.groupBy(tenth.alias("tenth")).agg(F.count(F.lit(1)).alias("n"), q.alias("__own"))
    every = d.agg(q.alias("__all")).withColumn("tenth", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return every.join(own, "tenth", "left").select("tenth", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n") > least, F.col("__own")).otherwise(F.col("__all")).alias("q"))


def band_coverage(d: DataFrame, rank: str, value: str, first: Column) -> DataFrame:
    """How the bands of the ``first`` part of the days hold on the rest: rows, shares within the outer and the inner quantiles, and over the median."""
    d = d.where(F.col(rank).isNotNull() & F.col(value).isNotNull()).withColumn("__first", first)
    bands = band_table(d.where("__first"), rank, value)
    late = d.where("not __first").withColumn("tenth", F.least(F.floor(F.col(rank) * 10).cast("int"), F.lit(9))).join(F.broadcast(bands.select("tenth", "q")), "tenth")
    q, x = (lambda k: F.get("q", F.lit(k))), F.col(value)
    share = lambda c: F.avg(c.cast("double"))
    return late.agg(F.count(F.lit(1)).alias("n"), share(x.between(q(0), q(4))).alias("outer"), share(x.between(q(1), q(3))).alias("inner"), share(x > q(2)).alias("over_median"))


def ridge(d: DataFrame, inputs: list[str], target: str, alpha: float = 10.0) -> dict[str, float]:
    """Coefficients of ``target`` on ``inputs`` with a free constant and a penalty ``alpha`` on squared coefficients.

    The sums of products are one aggregation with partial sums; the driver
    solves a system of the inputs' number. Empty without complete rows.
    """
    import numpy as np

    d = d.where(" and ".join(f"`{c}` is not null" for c in [*inputs, target]))
    names = [*inputs, target]
    sums = [F.sum(F.lit(1.0)).alias("n"), *[F.sum(a).alias(f"s{i}") for i, a in enumerate(names)]]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    row = d.agg(*sums, *products).first()
    if not row["n"]:
        return {}
    k, n = len(inputs), row["n"]
    s = np.array([row[f"s{i}"] for i in range(k + 1)])
    p = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) - np.outer(s, s) / n
    return dict(zip(inputs, np.linalg.solve(p[:k, :k] + alpha * np.eye(k), p[:k, k]).tolist()))


def contributions(coefficients: dict[str, float], most: int = 3) -> Column:
    """The inputs that add most to a row's score: up to ``most`` structs (name, part), largest first, only what raises it."""
    parts = F.array(*[F.struct((F.lit(-c) * F.col(x)).alias("less"), F.lit(x).alias("name")) for x, c in coefficients.items()])
    best = F.slice(F.filter(F.array_sort(parts), lambda p: p["less"] < 0), 1, most)
    return F.transform(best, lambda p: F.struct(p["name"].alias("name"), (-p["less"]).alias("part")))
