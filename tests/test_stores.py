"""Stored histories and the ledger: merges, round trips, batch against stream, and DuckDB on the smallest tables."""

import datetime as dt
import random
import tempfile

import duckdb
import pytest

from barloom.operators import ledger
from barloom.plans.stores import STORE_QUERIES
from barloom.plans.stores_sql import STORE_SQL
from barloom.sources import history
from pyspark.sql import functions as F
from test_market import TABLES, rows

DAY = dt.date(2021, 3, 1)
SCHEMA = "code string, date date, open double, high double, low double, close double, volume double"


@pytest.mark.parametrize("name", STORE_SQL)
def test_query_equals_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(STORE_QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(STORE_SQL[name]).df())


def bars(spark, *parts):
    """Parts (code, first day, closes)."""
    data = [(code, DAY + dt.timedelta(a + i), c, c + 1.0, c - 1.0, float(c), 10.0) for code, a, closes in parts for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(data, SCHEMA)


def closes(d):
    return {(r["code"], (r["date"] - DAY).days): r["close"] for r in d.collect()}


def test_merge_keeps_the_last_and_replaces_split_codes(spark):
    old = bars(spark, ("a", 0, [10, 11, 12]), ("b", 0, [20, 22, 24]), ("c", 0, [5]))
    recent = bars(spark, ("a", 2, [12.01, 13]), ("b", 2, [12, 13]), ("d", 4, [7]))
    full = bars(spark, ("a", 0, [99] * 4), ("b", 0, [10, 11, 12, 13]), ("e", 0, [1]))
    got = closes(history.merge_bars(old, recent, full))
    assert got == {("a", 0): 10, ("a", 1): 11, ("a", 2): 12.01, ("a", 3): 13, ("b", 0): 10, ("b", 1): 11, ("b", 2): 12, ("b", 3): 13, ("c", 0): 5, ("d", 4): 7}
    assert closes(history.merge_bars(old, recent, full, since=str(DAY + dt.timedelta(3)))) == {("a", 3): 13, ("b", 3): 13, ("d", 4): 7}
    none = old.limit(0)
    assert closes(history.merge_bars(none, recent, full)) == closes(recent) and closes(history.merge_bars(old, none, full)) == closes(old)
    holed = recent.withColumns({"volume": F.lit(0.0), "extra": F.lit(1)}).unionByName(recent.withColumns({"code": F.lit(None).cast("string"), "extra": F.lit(1)}))
    assert closes(history.merge_bars(old.where("code = 'c'"), holed, full)) == {("c", 0): 5}


def test_upsert_touches_the_codes_it_has_and_may_be_repeated(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    old = bars(spark, ("a", 0, [10, 11]), ("b", 0, [20, 22]))
    history.write_history(old, f"{folder}/store")
    recent, full = bars(spark, ("b", 1, [11, 12]), ("c", 1, [3])), bars(spark, ("b", 0, [10, 11, 12]), ("c", 0, [2, 3]))
    want = {("a", 0): 10, ("a", 1): 11, ("b", 0): 10, ("b", 1): 11, ("b", 2): 12, ("c", 1): 3}
    for k in range(2):
        history.upsert_history(spark, f"{folder}/store", recent, full, f"{folder}/stage{k}")
        assert closes(history.read_history(spark, f"{folder}/store")) == want


def test_a_stream_of_bars_fills_the_store(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    first, full = bars(spark, ("a", 0, [10, 11])), bars(spark, ("a", 0, [10, 11, 12]), ("b", 0, [1, 2, 3]))
    history.write_history(first, f"{folder}/store")
    full.where("code = 'b' or day(date) > 1").write.parquet(f"{folder}/in")
    full.write.parquet(f"{folder}/full")
    stream = spark.readStream.schema(full.schema).parquet(f"{folder}/in")
    q = history.stream_upserts(stream, f"{folder}/store", lambda s: s.read.parquet(f"{folder}/full"), f"{folder}/stage").start()
    q.processAllAvailable()
    q.stop()
    assert closes(history.read_history(spark, f"{folder}/store")) == closes(full)


def test_columnar_rows_give_the_bars_back(spark):
    d = bars(spark, ("big", 0, [2000, 2001, 2500.5]), ("small", 0, [10.126, 11.5, 12.0]))
    odd = spark.createDataFrame([("big", DAY + dt.timedelta(9), 0.0, None, float("nan"), 2100.0, 7.0), ("big", DAY + dt.timedelta(10), 1.0, 1.0, 1.0, float("inf"), 7.0)], SCHEMA)
    c = history.columnar(d.unionByName(odd))
    assert {r["code"]: (r["scale"], len(r["t"])) for r in c.collect()} == {"big": (1, 4), "small": (100, 3)}
    back = closes(history.from_columnar(c))
    assert back == {("big", 0): 2000, ("big", 1): 2001, ("big", 2): 2500, ("big", 9): 2100, ("small", 0): 10.13, ("small", 1): 11.5, ("small", 2): 12.0}
    [r] = history.from_columnar(c).where(F.col("date") == DAY + dt.timedelta(9)).collect()
    assert r["open"] == r["high"] == r["low"] == 2100
    assert history.from_columnar(history.columnar(d.limit(0))).count() == 0


def test_json_holds_no_bad_numbers(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    d = spark.createDataFrame([("a", 1.5), ("a", float("nan")), ("b", float("-inf")), ("b", None)], "code string, x double")
    history.write_json(d, f"{folder}/out", "code")
    assert sorted((r["code"], r["x"]) for r in spark.read.json(f"{folder}/out").collect() if r["x"] is not None) == [("a", 1.5)]


# the ledger

PICK = "id string, code string, date date, target double, stop double, h int"


def scored_by_hand(pick, series, cost):
    _, _, date, target, stop, h = pick
    after = [b for b in series if b[0] > date and (b[0] - date).days <= 4 * h][:h]
    if not after or not after[0][1] > 0:
        return ("open", None, None)
    entry = after[0][1]
    for k, (day, o, hi, lo, c) in enumerate(after, 1):
        price = min(o, stop) if lo <= stop else max(o, target) if hi >= target else c if k == h else None
        if price is not None:
            ret = price / entry - 1 - cost
            return ("win" if ret > 0 else "loss", ret, k)
    return ("open", after[-1][4] / entry - 1, len(after))


def ledger_case(spark):
    rng = random.Random(4)
    data, picks = [], []
    for code in "abc":
        p = 100.0
        for t in range(60):
            if rng.random() < 0.1:
                continue
            o, p = p * rng.uniform(0.97, 1.03), p * rng.uniform(0.95, 1.055)
            data.append((code, DAY + dt.timedelta(t), o, max(o, p) * 1.01, min(o, p) * 0.99, p, 5.0))
            if rng.random() < 0.4:
                picks.append((f"{code}{t}", code, DAY + dt.timedelta(t), p * 1.08, p * 0.94, rng.choice([3, 5, 10])))
    picks += [("early", "a", DAY - dt.timedelta(3), 1e9, 0.0, 5), ("nobody", "z", DAY, 1.0, 1.0, 5)]
    return data, picks


def test_ledger_equals_a_loop(spark):
    data, picks = ledger_case(spark)
    got = {r["id"]: r for r in ledger.score_picks(spark.createDataFrame(picks, PICK), spark.createDataFrame(data, SCHEMA), 0.001).collect()}
    assert len(got) == len(picks) and {r["status"] for r in got.values()} == {"win", "loss", "open"}
    for p in picks:
        status, ret, days = scored_by_hand(p, [(d, o, h, lo, c) for code, d, o, h, lo, c, _ in data if code == p[1]], 0.001)
        r = got[p[0]]
        assert (r["status"], r["days"]) == (status, days) and (ret is None) == (r["ret"] is None) and (ret is None or abs(ret - r["ret"]) < 1e-12), p
    s = ledger.ledger_summary(ledger.score_picks(spark.createDataFrame(picks, PICK), spark.createDataFrame(data, SCHEMA))).first()
    assert s["total"] == len(picks) == s["closed"] + s["open"]


def test_stream_closes_the_picks_that_the_batch_closes(spark):
    data, picks = ledger_case(spark)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    b, p = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(picks, PICK)
    cut = DAY + dt.timedelta(25)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for k, part in enumerate((b.where(F.col("date") < cut), b.where(F.col("date") >= cut))):
        part.withColumn("ts", F.col("date").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/in{k}")
    schema = spark.read.parquet(f"{folder}/in0").schema
    import os
    import shutil

    os.makedirs(f"{folder}/in")
    out = f"{folder}/out"
    q = ledger.stream_scores(spark.readStream.schema(schema).parquet(f"{folder}/in"), p, 0.001).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/cp").start(out)
    for k in range(2):
        [f] = [x for x in os.listdir(f"{folder}/in{k}") if x.endswith(".parquet")]
        shutil.copy(f"{folder}/in{k}/{f}", f"{folder}/in/{k}.parquet")
        q.processAllAvailable()
    q.stop()
    batch = ledger.score_picks(p, b, 0.001).where("status <> 'open'")
    got = {r["id"]: (r["status"], r["days"], round(r["ret"], 12), r["exit_date"]) for r in spark.read.schema(ledger.SCORED).parquet(out).collect()}
    assert got == {r["id"]: (r["status"], r["days"], round(r["ret"], 12), r["exit_date"]) for r in batch.collect()} and len(got) > 10
