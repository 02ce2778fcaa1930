"""Sequential patterns, exits and rules: hand-made bars, brute force, and DuckDB on the smallest tables."""

import datetime as dt
import random
from itertools import combinations

import duckdb
import pytest

from barloom.operators import exits, rules, sequences
from barloom.plans.paths import PATH_QUERIES
from barloom.plans.paths_sql import PATH_SQL
from pyspark.sql import functions as F
from test_market import TABLES, rows

DAY = dt.date(2020, 1, 1)
BAR = "code string, date date, open double, high double, low double, close double, volume double, rsi double, vol_ma20 double"


@pytest.mark.parametrize("name", PATH_SQL)
def test_query_equals_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(PATH_QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(PATH_SQL[name]).df())


def frame(spark, bars, code="a"):
    """Bars given as (open, high, low, close[, volume]) or as closes with a range of one per cent."""
    full = [b if isinstance(b, tuple) else (b, b * 1.005, b * 0.995, b) for b in bars]
    return spark.createDataFrame([(code, DAY + dt.timedelta(i), *map(float, b[:4]), float(b[4]) if len(b) > 4 else 100.0, 50.0, 100.0) for i, b in enumerate(full)], BAR)


def fired(d):
    return [r["fired"] for r in sequences.add_sequences(d).orderBy("code", "date").collect()]


def days_of(d, key):
    return [i for i, keys in enumerate(fired(d)) if key in keys]


def path(*points):
    """Straight lines through (bar, price) points."""
    out = []
    for (a, p), (b, q) in zip(points, points[1:]):
        out += [p + (q - p) * k / (b - a) for k in range(b - a)]
    return [*out, points[-1][1]]


def test_double_top_breaks_its_neckline_once(spark):
    d = frame(spark, path((0, 80), (20, 100), (30, 90), (40, 100.2), (54, 80), (60, 78), (70, 95), (80, 75)))
    [day] = days_of(d, "dbl_top")
    assert 45 < day < 54  # confirmed five bars after the second top


def test_head_and_shoulders_and_its_mirror(spark):
    top = path((0, 80), (15, 100), (22, 92), (32, 110), (42, 92), (50, 100), (64, 80))
    assert len(days_of(frame(spark, top), "hs_top")) == 1 and not days_of(frame(spark, top), "inv_hs")
    bottom = [200 - x for x in top]
    assert len(days_of(frame(spark, bottom), "inv_hs")) == 1 and not days_of(frame(spark, bottom), "hs_top")


def test_previous_high_is_broken_then_tested_again(spark):
    d = frame(spark, path((0, 80), (20, 100), (40, 90), (58, 104), (63, 101), (75, 120)))
    [day] = days_of(d, "prev_high_brk")
    assert 40 < day <= 58 and all(day + 2 <= t <= day + 12 for t in days_of(d, "retest")) and len(days_of(d, "retest")) == 1


def test_patterns_of_levels_need_sixty_bars(spark):
    d = frame(spark, path((0, 80), (20, 100), (40, 90), (58, 104)))
    assert not days_of(d.limit(59), "prev_high_brk") and days_of(frame(spark, path((0, 80), (20, 100), (40, 90), (58, 104), (60, 104))), "prev_high_brk")


def test_falling_trend_line_is_broken(spark):
    d = frame(spark, path((0, 90), (10, 120), (20, 105), (32, 112), (45, 95), (70, 130)))
    assert len(days_of(d, "tl_dn_brk")) == 1


def test_reference_bar(spark):
    flat, big = (100, 100.5, 99.5, 100), (100, 113, 99.8, 112, 900)
    after = [(112, 113, 111, 112)] * 3 + [(110, 111, 106.5, 108)] + [(109, 112, 108, 111)] * 2 + [(112, 116, 111, 115)] + [(114, 114, 97, 98)] * 2
    d = frame(spark, [flat] * 30 + [big] + after)
    assert days_of(d, "base_mid") == [34] and days_of(d, "base_hi") == [37] and days_of(d, "base_lo") == [38]


def test_gaps(spark):
    bars = [(100, 101, 99, 100)] * 60 + [(104, 106, 103, 105), (105, 106, 104, 105), (104, 105, 102.5, 104)]  # gap 101 .. 103, touched two bars later
    bars += [(95, 96, 94, 95), (96, 103, 95.5, 102.8)]  # gap down 102.5 .. 96, then filled
    d = frame(spark, bars)
    assert days_of(d, "gap_sup") == [62] and days_of(d, "gap_fill_up") == [64]


def naive_sar(bars):
    out, rising, extreme, pace, sar = [None], True, bars[0][0], 0.02, bars[0][1]
    for t in range(1, len(bars)):
        (h, low), before = bars[t], bars[max(0, t - 2) : t]
        nxt = sar + pace * (extreme - sar)
        nxt = min([nxt, *[b[1] for b in before]]) if rising else max([nxt, *[b[0] for b in before]])
        if (low < nxt) if rising else (h > nxt):
            nxt, extreme, pace, rising = extreme, (low if rising else h), 0.02, not rising
        elif (h > extreme) if rising else (low < extreme):
            extreme, pace = (h if rising else low), min(pace + 0.02, 0.2)
        sar = nxt
        out.append(sar)
    return out


def walk(n, seed=1):
    rng, price, out = random.Random(seed), 100.0, []
    for _ in range(n):
        o, price = price * rng.uniform(0.97, 1.03), price * rng.uniform(0.95, 1.055)
        out.append((o, max(o, price) * rng.uniform(1, 1.02), min(o, price) * rng.uniform(0.98, 1), price, rng.choice([50, 100, 400])))
    return out


def test_sar_equals_its_definition(spark):
    bars = walk(300)
    got = [r["sar"] for r in sequences.add_sequences(frame(spark, bars)).orderBy("date").collect()]
    assert got == naive_sar([b[1:3] for b in bars])


def test_later_bars_change_nothing_and_codes_are_apart(spark):
    a, b = walk(500, 2), walk(430, 3)
    whole = sequences.add_sequences(frame(spark, a).unionByName(frame(spark, b, "b"))).orderBy("code", "date").collect()
    assert {k for r in whole for k in r["fired"]} >= {"tl_dn_brk", "tl_up_sup", "prev_high_brk", "gap_fill_up"}
    for n in (60, 201, 333):
        part = fired(frame(spark, a[:n]))
        assert part == [r["fired"] for r in whole[:n]]
    assert fired(frame(spark, b, "b")) == [r["fired"] for r in whole[500:]]


def test_missing_prices_and_empty_tables(spark):
    bars = walk(80, 5)
    d = frame(spark, bars).withColumns({x: F.when(F.col("date") != DAY + dt.timedelta(40), F.col(x)) for x in ("high", "low", "close")})
    got = sequences.add_sequences(d.withColumn("extra", F.lit(1))).orderBy("date").collect()
    assert got[40]["fired"] == [] and got[40]["sar"] is None and len(got) == 80 and got[0]["extra"] == 1
    assert sequences.add_sequences(d.limit(0)).count() == 0 and sequences.add_flags(d.limit(0)).count() == 0


# exits


def trades(spark, bars, run, h, **columns):
    d = frame(spark, bars).withColumns({k: F.lit(v) for k, v in columns.items()})
    return run(exits.signals(d, F.col("date") == DAY, h, ("ma5", "ma10") if "ma5" in columns else ())).collect()


def test_close_stop_and_target(spark):
    at = lambda bars, h=3: trades(spark, [(100, 100, 100, 100), *bars], lambda s: exits.close_stop_exit(s, F.lit(95.0), F.lit(110.0), 0.0), h)
    one = lambda *x: at(*x)[0]
    calm = (100, 101, 99, 100)
    r = one([calm, (100, 100, 90, 96), (97, 111, 96, 105)])  # a low under the stop is no stop
    assert (r["outcome"], r["days"], round(r["ret"], 9)) == ("target", 3, 0.1)
    r = one([calm, (100, 100, 90, 94), (93, 120, 92, 100)])
    assert (r["outcome"], r["days"], round(r["ret"], 9)) == ("stop", 2, -0.07)
    r = one([calm, calm, (96, 97, 90, 91)])  # no next bar: its close
    assert (r["outcome"], round(r["ret"], 9)) == ("stop", -0.09)
    r = one([calm, (112, 115, 90, 94), calm])  # target first on one bar, filled at the open
    assert (r["outcome"], round(r["ret"], 9)) == ("target", 0.12)
    assert (one([calm] * 3)["outcome"], at([calm] * 2), at([(0, 1, 0, 1)] + [calm] * 2)) == ("time", [], [])


def half_by_hand(bars, h, vol, reward=2.0):
    e = bars[0][0]
    risk, reach = min(max(1.5 * vol * h**0.5, exits.RISK[h][0]), exits.RISK[h][1]), 0.5 * vol * h**0.5
    stop, earned, left, half = e * (1 - risk), 0.0, 1.0, False
    for k, (o, hi, _, c) in enumerate(bars):
        if not half and hi >= e * (1 + reach):
            earned, left, half, stop = 0.5 * (max(o, e * (1 + reach)) / e - 1), 0.5, True, e
        if hi >= e * (1 + reward * risk):
            return earned + left * (max(o, e * (1 + reward * risk)) / e - 1)
        if c <= stop:
            return earned + left * ((bars[k + 1][0] if k + 1 < h else c) / e - 1)
    return earned + left * (bars[-1][3] / e - 1)


def test_half_exit_equals_a_loop(spark):
    bars = walk(400, 9)
    d = frame(spark, bars).withColumn("vol", F.lit(0.02))
    for h in (5, 20):
        got = exits.half_exit(exits.signals(d, F.lit(True), h), h, "vol", 0.0).orderBy("date").collect()
        assert len(got) == 400 - h and any(r["half_sold"] for r in got)
        for k, r in enumerate(got):
            assert abs(r["ret"] - half_by_hand([b[:4] for b in bars[k + 1 : k + 1 + h]], h, 0.02)) < 1e-12


def test_rule_exits(spark):
    calm = (100, 101, 99, 100)
    run = lambda rule: lambda s: exits.rule_exit(s, rule, cost=0.0)
    [r] = trades(spark, [calm, calm, (100, 104, 99, 103), (105, 106, 104, 105), *[calm] * 8], run("mr5"), 10, ma5=102.0, ma10=102.0, atr=2.0)
    assert (r["outcome"], r["days"], round(r["ret"], 9)) == ("rule", 3, 0.05)
    [r] = trades(spark, [calm, calm, (95, 96, 90, 93), (92, 96, 90, 95), *[calm] * 8], run("mr5"), 10, ma5=102.0, ma10=102.0, atr=2.0)
    assert (r["outcome"], r["days"], round(r["ret"], 9)) == ("stop", 3, -0.08)
    [r] = trades(spark, [calm] * 21, run("h20"), 20, ma5=102.0, ma10=102.0, atr=2.0)
    assert (r["outcome"], r["days"], r["ret"]) == ("time", 20, 0.0)


def test_barrier_grid_equals_a_loop(spark):
    bars, h = walk(150, 4), 10
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(s).alias("stop")) for t in (1.0, 2.0) for s in (1.0, 1.5)])
    s = exits.signals(frame(spark, bars).withColumn("atr_pct", F.lit(0.03)), F.lit(True), h)
    got = exits.barrier_grid(s, h, cells, cost=0.0).collect()
    assert len(got) == 4 * (150 - h)
    for r in got:
        ahead = bars[(k := (r["date"] - DAY).days) + 1 : k + 1 + h]
        e = ahead[0][0]
        target, stop, want = e * (1 + r["kt"] * 0.03), e * (1 - r["ks"] * 0.03), (ahead[-1][3] / e - 1, False)
        for o, hi, low, _, _ in ahead:
            if low <= stop or hi >= target:
                want = (min(o, stop) / e - 1, False) if low <= stop else (max(o, target) / e - 1, True)
                break
        assert abs(r["ret"] - want[0]) < 1e-12 and r["hit"] == want[1]


# rules


def bits_frame(spark, n=260, codes=3, names=5, seed=6):
    rng = random.Random(seed)
    data = []
    for c in range(codes):
        for t in range(n):
            bits = sum(1 << i for i in range(names) if rng.random() < (0.5 if i == 0 else 0.15))
            ret = rng.gauss(0.01, 0.05) if t < n - 5 else None
            data.append((f"c{c}", DAY + dt.timedelta(t), bits, ret, rng.random() < 0.4, t < 0.65 * n))
    return data, spark.createDataFrame(data, "code string, date date, bits long, ret double, hit boolean, early boolean")


def begins(series, t, mask, quiet=5, warm=130):
    return t >= warm and series[t] & mask == mask and all(series[k] & mask != mask for k in range(t - quiet, t))


def test_onsets_of_masks_equal_brute_force(spark):
    data, d = bits_frame(spark)
    got = sorted((r["code"], (r["date"] - DAY).days, r["mask"]) for r in rules.onset_masks(d).collect())
    masks = [sum(1 << i for i in c) for k in (1, 2, 3) for c in combinations(range(5), k)]
    series = {c: [r[2] for r in data if r[0] == c] for c in ("c0", "c1", "c2")}
    assert got == sorted((c, t, m) for c, s in series.items() for t in range(len(s)) for m in masks if begins(s, t, m))


def test_chosen_rules_hold_no_other_and_have_results_of_their_own(spark):
    stats = [(1, 0.9, 10, 0.5, 0.1), (3, 0.8, 9, 0.5, 0.1), (4, 0.7, 10, 0.5, 0.1), (8, 0.6, 7, 0.4, 0.2), (12, 0.5, 8, 0.4, 0.2), (16, 0.4, 8, 0.3, 0.3), (32, 0.3, 8, 0.3, 0.4)]
    d = spark.createDataFrame(stats, "mask long, score double, n long, win double, mean double")
    # 3 holds 1, 4 repeats the results of 1, 12 holds 8
    assert [tuple(r) for r in rules.distinct_rules(d, 3).orderBy("place").collect()] == [(1, 1), (2, 8), (3, 16)]
    assert rules.distinct_rules(d.limit(0)).count() == 0


def test_fresh_signals_equal_brute_force(spark):
    data, d = bits_frame(spark, seed=11, codes=3)
    later = [r for r in data if r[0] != "c2" or r[1] < DAY + dt.timedelta(259)]  # c2 ends a day before
    d = spark.createDataFrame(later, d.schema)
    chosen = spark.createDataFrame([(k + 1, m) for k, m in enumerate((24, 2, 4, 1, 8, 16))], "rank int, mask long")
    got = {(r["code"], r["rank"], r["mask"], r["days_ago"]) for r in rules.fresh_signals(d, chosen, fresh=6).collect()}
    want = set()
    for c in ("c0", "c1"):
        s = [r[2] for r in later if r[0] == c]
        for rank, m in enumerate((24, 2, 4, 1, 8, 16), 1):
            ago = [a for a in range(6) if begins(s, len(s) - 1 - a, m)]
            if s[-1] & m == m and ago:
                want.add((c, rank, m, ago[0]))
                break
    assert got == want


def test_tuned_rules_take_the_best_early_cell(spark):
    bars = walk(330, 21)
    d = frame(spark, bars).withColumns({"atr_pct": F.lit(0.03), "early": F.col("date") < DAY + dt.timedelta(200)})
    s = exits.signals(d, F.dayofmonth("date") % 2 == 0, 20).withColumn("mask", F.lit(5).cast("long"))
    chosen = spark.createDataFrame([(1, 5)], "place int, mask long")
    cells = exits.barrier_grid(s, 20, rules.exit_grid(), cost=0.0).where("early").groupBy("kt", "ks").agg(F.avg("ret").alias("m")).collect()
    best = max(cells, key=lambda r: (round(r["m"], 12), -r["kt"], -r["ks"]))
    got = rules.tuned_rules(s, chosen, 20, 10, 0.0).collect()
    late = exits.barrier_grid(s, 20, rules.exit_grid(), cost=0.0).where(f"not early and kt = {best['kt']} and ks = {best['ks']}").agg(F.avg("ret")).first()[0]
    if best["m"] > 0 and late > 0:
        assert [(r["rank"], r["kt"], r["ks"]) for r in got] == [(1, best["kt"], best["ks"])] and abs(got[0]["mean_early"] - best["m"]) < 1e-12
    else:
        assert got == []


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(PATH_QUERIES) - set(PATH_SQL)):
        assert PATH_QUERIES[name](spark, sf_dir).count() >= 0, name
