"""Market operators against DuckDB on the smallest tables, and hand-made series."""

import datetime as dt
import math

import duckdb
import pandas as pd
import pytest

from barloom.functions.expr import ewm, lag, onset, pct_rank, tick
from barloom.operators.studies import asof_backward
from barloom.operators.trades import barrier_exit, horizon_return, streak
from barloom.plans.oracle import ORACLE_SQL
from barloom.plans.queries import QUERIES
from pyspark.sql import functions as F

TABLES = "customer lineitem orders part events".split()
FAST = ["bars_daily", "market_breadth", "moving_indicators", "cross_rank", "flow_streak", "asof_fundamentals", "tick_rounding", "golden_cross_study", "horizon_stats", "quotes_hourly", "recursive_indicators", "candle_counts", "window_pattern_counts", "condition_counts", "investor_study", "regime_lamps", "volume_profiles"]


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)[:10]
    return sorted((tuple(clean(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def series(spark, closes, code="a", **more):
    first = dt.date(2024, 1, 1)
    out = [{"code": code, "date": first + dt.timedelta(days=i), "open": float(c), "high": c + 1.0, "low": c - 1.0, "close": float(c), "volume": 10.0, "amount": 10.0 * c} for i, c in enumerate(closes)]
    for k, values in more.items():
        for row, v in zip(out, values):
            row[k] = v
    return spark.createDataFrame(pd.DataFrame(out)).replace(float("nan"), None)


def test_ewm_is_the_recursion_over_several_blocks(spark):
    closes = [100 + 10 * math.sin(i / 7) + i % 5 for i in range(1300)]
    for alpha in (1 / 14, 0.5):
        want, y = [], None
        for c in closes:
            y = c if y is None else (1 - alpha) * y + alpha * c
            want.append(y)
        got = [r["e"] for r in ewm(series(spark, closes), "e", F.col("close"), alpha).orderBy("date").collect()]
        assert max(abs(a / b - 1) for a, b in zip(got, want)) < 1e-11


def test_ewm_starts_at_the_first_value(spark):
    d = ewm(series(spark, [1, 2, 4]), "e", F.col("close") - lag("close"), 0.5)
    assert [r["e"] for r in d.orderBy("date").collect()] == [None, 1.0, 1.5]


def test_pct_rank_shares_ties_and_skips_nulls(spark):
    d = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("x", 3.0), ("x", None)], "g string, v double")
    assert sorted((r["p"] for r in d.select(pct_rank("v", ["g"]).alias("p")).collect()), key=str) == sorted([0.5, 0.5, 1.0, None], key=str)


def test_onset_needs_five_quiet_rows(spark):
    flags = [True, False, True, False, False, False, False, False, True]
    d = series(spark, range(10, 19), f=flags).withColumn("on", onset(F.col("f")))
    assert [r["on"] for r in d.orderBy("date").collect()] == [True] + [False] * 7 + [True]


def test_stop_comes_before_target_on_one_bar(spark):
    d = series(spark, [100, 100, 100], atr_pct=[0.005] * 3)
    out = barrier_exit(d, 2, 1.0, 1.0, cost=0.0).orderBy("date").first()
    assert (out["outcome"], out["days"]) == ("stop", 1) and abs(out["ret"] + 0.005) < 1e-12


def test_trade_without_enough_bars_is_null(spark):
    d = barrier_exit(series(spark, [1, 2], atr_pct=[0.1, 0.1]), 5, 1.0, 1.0).withColumn("h", horizon_return(5))
    assert all(r["ret"] is None and r["outcome"] is None and r["h"] is None for r in d.collect())


def test_streak_is_signed_and_zero_breaks_it(spark):
    d = streak(series(spark, [1] * 6, x=[1.0, 2.0, 0.0, -1.0, -2.0, None]), "x")
    assert [r["streak"] for r in d.orderBy("date").collect()] == [1, 2, 0, -1, -2, 0]


def test_asof_takes_the_last_known_value(spark):
    bars = series(spark, [1, 2, 3])
    facts = spark.createDataFrame([("a", dt.date(2024, 1, 2), 7.0), ("b", dt.date(2023, 1, 1), 9.0)], "code string, date date, book double")
    assert [r["book"] for r in asof_backward(bars, facts, "book").orderBy("date").collect()] == [None, 7.0, 7.0]


def test_tick_ladder(spark):
    d = spark.createDataFrame([(p,) for p in (1999.0, 2000.0, 499999.0, 500000.0)], "p double")
    assert [r[0] for r in d.select(tick(F.col("p"))).collect()] == [1, 5, 500, 1000]


def test_no_feature_changes_when_later_rows_go(spark):
    from barloom.operators.indicators import add_moving

    closes = [50 + (i * 7) % 13 for i in range(80)]
    cols = ["date", "ma20", "sto_k", "bb_upper", "obv"]
    whole = add_moving(series(spark, closes)).select(*cols).orderBy("date").limit(60).collect()
    assert whole == add_moving(series(spark, closes[:60])).select(*cols).orderBy("date").collect()


def test_empty_bars_give_empty_results(spark):
    from barloom.operators.conditions import add_conditions
    from barloom.operators.indicators import add_indicators

    assert add_conditions(add_indicators(series(spark, [1]).limit(0))).count() == 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0


def test_listing_has_every_code_with_its_rank(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf_dir}/part.parquet'")
    found = QUERIES["listing_filter"](spark, sf_dir).toPandas()
    assert set(found["code"]) == {c for (c,) in con.execute("SELECT DISTINCT p_brand FROM part").fetchall()}
    assert rows(found) == rows(con.execute(ORACLE_SQL["listing_filter"]).df())
