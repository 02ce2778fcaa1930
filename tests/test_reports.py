"""Swings, phases, zones and levels of the last bar: hand-made bars, and DuckDB on the smallest tables."""


import duckdb
import pytest

from barloom.operators import levels
from barloom.operators.indicators import add_indicators, add_moving
from barloom.plans.reports import REPORT_QUERIES
from barloom.plans.reports_sql import REPORT_SQL
from test_market import TABLES, rows
from test_paths import frame, path


@pytest.mark.parametrize("name", REPORT_SQL)
def test_query_equals_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(REPORT_QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(REPORT_SQL[name]).df())


def bars(spark, closes):
    return frame(spark, closes).drop("rsi", "vol_ma20")


def test_swing_takes_the_latest_high_and_the_lows_around_it(spark):
    [s] = levels.swings(bars(spark, path((0, 100), (30, 80), (60, 120), (70, 110), (80, 120), (100, 90), (110, 96)))).collect()
    assert (s["t"], s["days"]) == (81, 30)
    assert abs(s["low"] - 80 * 0.995) < 1e-9 and abs(s["after"] - 90 * 0.995) < 1e-9
    assert abs(s["fall"] - (96 / (120 * 1.005) - 1)) < 1e-9
    [last] = levels.swings(bars(spark, path((0, 100), (50, 150)))).collect()
    assert last["days"] == 0 and abs(last["after"] - 150 * 0.995) < 1e-9


@pytest.mark.parametrize(
    "points, phase",
    [
        (((0, 100), (150, 160)), "uptrend"),
        (((0, 100), (120, 150), (140, 120)), "price_corr"),
        (((0, 100), (120, 150), (140, 120), (150, 135)), "price_corr_rb"),
        (((0, 300), (100, 260), (160, 120)), "downtrend"),
        (((0, 100), (40, 102), (80, 100), (120, 102), (160, 99)), "box"),
    ],
)
def test_phases(spark, points, phase):
    [p] = levels.phases(add_moving(bars(spark, path(*points)))).collect()
    assert p["phase"] == phase


def test_zones_are_the_nearest_heavy_runs(spark):
    d = bars(spark, [100.0] * 40 + [150.0] * 40 + path((0, 150), (10, 125)) + [125.0] * 3)
    [z] = levels.volume_zones(d).collect()
    assert abs(z["zone_above"] - 150) < 4 and abs(z["zone_below"] - 100) < 4


def test_near_candidates_share_a_level(spark):
    closes = path((0, 100), (20, 130), (40, 100), (60, 130.5), (80, 100), (110, 115))
    got = levels.price_levels(add_indicators(bars(spark, closes))).orderBy("side", "place").collect()
    above = [r for r in got if r["side"] == "resistance"]
    assert above and any("pivot_high" in r["kinds"] for r in above) and [r["place"] for r in above] == list(range(1, len(above) + 1))
    prices = [r["price"] for r in above]
    assert prices == sorted(prices) and all(b / a - 1 > 0.01 for a, b in zip(prices, prices[1:]))
    below = [r["price"] for r in got if r["side"] == "support"]
    assert below == sorted(below, reverse=True) and all(p < closes[-1] for p in below)


def test_few_bars_and_empty_tables(spark):
    d = add_indicators(bars(spark, [100.0, 101.0]))
    assert levels.swings(d).count() == 1 and levels.price_levels(d).count() >= 0
    assert levels.price_levels(d.limit(0)).count() == 0 and levels.volume_zones(d.limit(0)).count() == 0
