"""Scores: leakage, calibration, bands, ridge; and DuckDB on the smallest tables."""

import random

import duckdb
import numpy as np
import pytest

from barloom.operators import scoring
from barloom.plans.scores import SCORE_QUERIES
from barloom.plans.scores_sql import SCORE_SQL
from pyspark.sql import functions as F
from test_market import TABLES, rows


@pytest.mark.parametrize("name", SCORE_SQL)
def test_query_equals_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(SCORE_QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(SCORE_SQL[name]).df())


def days_frame(spark, change=0.0, after=10**9):
    """Sixty codes over 300 days; the target is the feature, from day ``after`` on something else."""
    rng = random.Random(3)
    data = []
    for day in range(1, 301):
        for code in range(20):
            x = rng.uniform(-1, 1)
            data.append((f"c{code}", day, x, x + (change if day >= after else 0.0) if day <= 290 else None))
    return spark.createDataFrame(data, "code string, day int, x double, y double")


def test_a_fold_learns_from_days_before_it_only(spark):
    run = lambda d: {(r["code"], r["day"]): (r["fold"], r["pred"]) for r in scoring.walk_forward(d, ["x"], "y", 300, 10, width=50, trees=3, depth=3).collect()}
    starts = scoring.fold_starts(300, width=50)
    assert starts[0] == 300 - int(300 * 0.45) + 1 and starts[-1] <= 300
    plain = run(days_frame(spark))
    assert {d for _, d in plain} == set(range(starts[0], 301))
    # targets that a fold must not know are changed: its scores stay, those of later folds change
    second = starts[1]
    changed = run(days_frame(spark, 50.0, second - 10))
    assert all(changed[k] == plain[k] for k in plain if k[1] < second + 50 and plain[k][0] <= 2)
    assert any(changed[k] != plain[k] for k in plain if plain[k][0] == 3)


def test_too_few_days_score_nothing(spark):
    assert scoring.walk_forward(days_frame(spark).where("day < 6").withColumn("day", F.col("day")), ["x"], "y", 5, 10).count() == 0


def pooled(values, weights):
    """Pool adjacent violators, the classical way."""
    blocks = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            (a, wa, na), (b, wb, nb) = blocks[-2:]
            blocks[-2:] = [[(a * wa + b * wb) / (wa + wb), wa + wb, na + nb]]
    return [v for v, _, n in blocks for _ in range(n)]


def test_monotone_equals_pooling(spark):
    rng = random.Random(9)
    for n in (1, 2, 7, 16):
        means, weights = [rng.uniform(-1, 1) + k * 0.1 for k in range(n)], [rng.randint(1, 50) for _ in range(n)]
        d = spark.createDataFrame([(k, k / n, (k + 1) / n, w, m) for k, (m, w) in enumerate(zip(means, weights))], "bucket int, lo double, hi double, n long, mean double")
        [r] = scoring.monotone(d).collect()
        assert np.allclose(r["ys"], pooled(means, weights)) and np.allclose(r["xs"], [(k + 0.5) / n for k in range(n)])
    assert scoring.monotone(d.limit(0)).count() == 0


def test_interpolation_is_flat_beyond_its_ends(spark):
    xs, ys, at = [0.1, 0.4, 0.5], [1.0, 2.0, 10.0], [None, -1.0, 0.1, 0.25, 0.4, 0.45, 0.5, 7.0]
    d = spark.createDataFrame([(p, xs, ys) for p in at], "p double, xs array<double>, ys array<double>")
    got = [r[0] for r in d.select(scoring.interpolate(F.col("p"), F.col("xs"), F.col("ys"))).collect()]
    assert got[0] is None and np.allclose(got[1:], np.interp(at[1:], xs, ys))


def test_buckets_hold_their_lower_ends_and_the_last_its_upper(spark):
    d = spark.createDataFrame([(p, 1.0) for p in (0.0, 0.1, 0.1, 0.99, 1.0, None)], "p double, v double")
    got = {r["bucket"]: r["n"] for r in scoring.bucket_means(d, "p", "v", least=1).collect()}
    assert got == {0: 1, 1: 2, len(scoring.EDGES) - 2: 2}


def test_bands_of_few_rows_take_those_of_all(spark):
    data = [(0.05, float(k), True) for k in range(300)] + [(0.95, 1000.0, True)] * 5 + [(0.95, float(k), False) for k in range(10)]
    d = spark.createDataFrame(data, "p double, v double, first boolean")
    bands = {r["tenth"]: (r["n"], r["q"]) for r in scoring.band_table(d.where("first"), "p", "v").collect()}
    assert len(bands) == 10 and bands[0][0] == 300 and np.allclose(bands[0][1], np.quantile(range(300), scoring.QUANTILES))
    assert bands[9][0] == 5 and np.allclose(bands[9][1], np.quantile([*range(300), *[1000.0] * 5], scoring.QUANTILES))
    [c] = scoring.band_coverage(d, "p", "v", F.col("first")).collect()
    assert c["n"] == 10 and c["outer"] == 0.0


def test_ridge_and_contributions(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-0.5, 0.5, (400, 4))
    y = 0.3 + x @ np.array([0.8, -0.5, 0.0, 0.2]) + rng.normal(0, 0.05, 400)
    d = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double, y double")
    got = scoring.ridge(d, ["a", "b", "c", "d"], "y", alpha=10.0)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 10 * np.eye(4), xc.T @ yc)
    assert np.allclose(list(got.values()), want)
    one = spark.createDataFrame([(0.5, 0.4, 0.1, 0.3)], "a double, b double, c double, d double")
    [r] = one.select(scoring.contributions({"a": 0.8, "b": -0.5, "c": 0.1, "d": 0.2}, 2).alias("w")).collect()
    assert [(p["name"], round(p["part"], 9)) for p in r["w"]] == [("a", 0.4), ("d", 0.06)]
    assert scoring.ridge(d.limit(0), ["a"], "y") == {}
