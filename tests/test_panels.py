"""Operators over panels of codes: hand-made cases, and DuckDB on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

from barloom.operators import panels
from barloom.plans.panels import PANEL_QUERIES
from barloom.plans.panels_sql import PANEL_SQL
from pyspark.sql import functions as F
from test_market import TABLES, rows, series


@pytest.mark.parametrize("name", PANEL_QUERIES)
def test_query_equals_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(PANEL_QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(PANEL_SQL[name]).df())


def test_panel_leaves_thin_days_out_and_masks_prices(spark):
    d = series(spark, [1, 2, 3, 4], "a").unionByName(series(spark, [5, 0, 7], "b")).withColumn("open", F.when(F.col("code") == "a", F.lit(0.0)).otherwise(F.col("open")))
    got = {(r["code"], r["date"].day): (r["day"], r["open"], r["close"]) for r in panels.panel(d, 2).collect()}
    # day 2 has one positive close, day 4 one bar
    assert got == {("a", 1): (1, 1.0, 1.0), ("b", 1): (1, 5.0, 5.0), ("a", 3): (2, 3.0, 3.0), ("b", 3): (2, 7.0, 7.0)}


def test_market_return_weighs_by_the_day_before(spark):
    d = series(spark, [10, 20], "a", marcap=[1, 1]).unionByName(series(spark, [10, 5], "b", marcap=[3, 3]))
    got = panels.market_return(panels.panel(d, 2)).orderBy("date").collect()
    assert [(r["n_codes"], r["equal"], r["weighted"]) for r in got] == [(0, None, 0.0), (2, 0.25, (1 * 10 - 0.5 * 30) / 40)]


def test_equity_metrics(spark):
    [r] = panels.equity_metrics(series(spark, [100, 120, 90, 99])).collect()
    moves = [0.2, -0.25, 0.1]
    m = sum(moves) / 3
    sd = math.sqrt(sum((x - m) ** 2 for x in moves) / 3)
    for got, want in ((r["total"], -0.01), (r["cagr"], 0.99**63 - 1), (r["mdd"], -0.25), (r["vol"], sd * math.sqrt(252)), (r["sharpe"], m / sd * math.sqrt(252))):
        assert got == pytest.approx(want)
    assert panels.equity_metrics(series(spark, [5, 5])).first()["sharpe"] == 0.0


def test_wilson_bound(spark):
    p, n, z = 0.6, 50, 1.64
    want = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    d = spark.createDataFrame([(p, n), (0.0, 0)], "p double, n long")
    assert [r["b"] for r in d.select(panels.wilson_bound(F.col("p"), F.col("n")).alias("b")).collect()] == [pytest.approx(want), 0.0]


def test_capped_top_breaks_ties_by_code_and_frees_others(spark):
    day = dt.date(2024, 1, 1)
    d = spark.createDataFrame([(day, c, g, s) for c, g, s in [("d", "x", 1.0), ("a", "x", 3.0), ("c", "x", 2.0), ("b", "x", 2.0), ("o1", "other", 0.5), ("o2", "other", 0.4), ("n", "y", None)]], "date date, code string, grp string, score double")
    assert [(r["place"], r["code"]) for r in panels.capped_top(d, "score", "grp", 4, 2).orderBy("place").collect()] == [(1, "a"), (2, "b"), (3, "o1"), (4, "o2")]


def test_short_frame_carries_balances_and_forgets_late_sales(spark):
    d = series(spark, [10] * 80, shares=[200.0] * 80)
    first = dt.date(2024, 1, 1)
    shorts = spark.createDataFrame([("a", first + dt.timedelta(days=i), 5.0, float(10 + i)) for i in range(0, 61, 2)], "code string, date date, sv double, bal double")
    got = panels.short_frame(d, shorts, [("2024-01-30", "2024-02-01")]).orderBy("date").collect()
    assert (got[0]["r"], got[1]["r"], got[1]["bal"], got[1]["b"]) == (50.0, 0.0, 10.0, 5.0)
    assert got[61]["r"] is None and got[61]["bal"] == 70.0  # after the last report
    assert [i for i, r in enumerate(got) if r["ok"]] == [*range(19, 29), *range(32, 80)]
    assert got[40]["bch"] == pytest.approx((50 / 30 - 1) * 100) and got[10]["bch"] is None and got[79]["fwd"] is None


def test_signal_sets(spark):
    day = [dt.date(2024, 1, i) for i in (1, 2, 3)]
    a = spark.createDataFrame([("x", day[0]), ("x", day[1])], "code string, date date")
    b = spark.createDataFrame([("x", day[1]), ("y", day[2])], "code string, date date")
    got = {r["code"]: (r["both"], r["either"], r["only_a"], r["only_b"]) for r in panels.signal_sets(a, b).collect()}
    assert got == {"x": (1, 2, 1, 0), "y": (0, 1, 0, 1)}
