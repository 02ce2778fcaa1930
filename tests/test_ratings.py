"""Sectors and opinions: hand-made bars, and DuckDB on the smallest tables."""

import duckdb
import pytest

from barloom.operators import panels, rating
from barloom.plans.ratings import RATING_QUERIES
from barloom.plans.ratings_sql import RATING_SQL
from pyspark.sql import functions as F
from test_market import TABLES, rows, series


@pytest.mark.parametrize("name", RATING_SQL)
def test_query_equals_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(RATING_QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(RATING_SQL[name]).df())


def test_beta_of_a_code_that_moves_twice_as_much(spark):
    moves = [0.01, -0.02, 0.03, 0.01, -0.01, 0.02]
    level = lambda k: [100.0] + [100.0 * __import__("math").prod(1 + k * m for m in moves[: i + 1]) for i in range(len(moves))]
    d = panels.panel(series(spark, level(2), "a"), 1)
    days = [r["date"] for r in d.orderBy("date").collect()]
    m = spark.createDataFrame([(day, x) for day, x in zip(days, [0.0, *moves])], "date date, weighted double")
    got = [r["beta"] for r in rating.market_beta(d, m, 4, 3).orderBy("date").collect()]
    assert got[:2] == [None, None] and all(abs(b - 2) < 1e-9 for b in got[4:])


def test_changes_are_islands_and_the_last_ones_stay(spark):
    d = series(spark, range(1, 9), opinion=[1, 1, 2, 2, 2, 1, None, None])
    got = [(r["date"].day, r["opinion"], r["rows"]) for r in rating.changes(d, "opinion").orderBy("date").collect()]
    assert got == [(1, 1, 2), (3, 2, 3), (6, 1, 1), (7, None, 2)]
    assert [r["date"].day for r in rating.changes(d, "opinion", 2).orderBy("date").collect()] == [6, 7]
    assert rating.changes(d.limit(0), "opinion").count() == 0


def test_opinions_smooth_five_rows(spark):
    d = None
    for k in range(20):
        x = series(spark, [1] * 6, f"c{k:02d}", rank=[(k + 1) / 20] * 5 + [1.0 if k == 0 else (k + 1) / 20])
        d = x if d is None else d.unionByName(x)
    got = {(r["code"], r["date"].day): r["opinion"] for r in rating.opinions(d, "rank").collect()}
    assert [got[f"c{k:02d}", 5] for k in range(20)] == [-1] * 4 + [0] * 10 + [1] * 4 + [2] * 2
    assert got["c00", 6] < 1  # one high rank of five does not turn the worst into a buy


def test_sectors_need_three_codes(spark):
    d = None
    for code, sector, up in (("a", "x", 1.02), ("b", "x", 1.02), ("c", "x", 1.02), ("d", "y", 0.99), ("e", "y", 0.99), ("f", "y", 0.99), ("g", "z", 1.0)):
        s = series(spark, [100 * up**i for i in range(130)], code, marcap=[1.0] * 130).withColumn("sector", F.lit(sector))
        d = s if d is None else d.unionByName(s)
    last = rating.sector_scores(panels.panel(d, 2), "sector").orderBy(F.desc("date"), "place").limit(2).collect()
    assert [(r["sector"], r["place"]) for r in last] == [("x", 1), ("y", 2)] and last[0]["breadth"] == 1.0 and last[1]["breadth"] == 0.0
