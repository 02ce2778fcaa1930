"""Hand-made bars on which a candle rule must and must not fire."""

import datetime as dt

import pytest
from barloom.operators.conditions import add_candles
from barloom.operators.indicators import add_indicators
from barloom.operators.patterns import WINDOW_PATTERNS, add_window_patterns
from pyspark.sql import functions as F


def falling(n=40, start=200.0, step=2.0):
    """n bars that fall by ``step`` a day, each of a range of 4."""
    return [(start - step * i + 1, start - step * i + 2, start - step * i - 2, start - step * i - 1) for i in range(n)]


def rising(n=40, start=100.0, step=2.0):
    return [(o, h, low, c) for o, h, low, c in ((start + step * i - 1, start + step * i + 2, start + step * i - 2, start + step * i + 1) for i in range(n))]


#: name: (bars, whether the last bar shows it). ATR is close to 4 after ``falling`` and ``rising``.
CASES = {
    "hammer": [
        (falling() + [(119.0, 119.6, 108.0, 119.5)], True),
        (falling() + [(108.0, 108.0, 108.0, 108.0)], False),  # a flat bar has no tails
    ],
    "shooting": [
        (rising() + [(181.0, 195.0, 180.8, 181.5)], True),
        (rising() + [(195.0, 195.0, 195.0, 195.0)], False),
    ],
    "three_white": [
        (falling() + [(118, 123, 118, 122), (122, 126, 122, 125), (125, 130, 125, 129)], True),
        (falling() + [(118, 121, 118, 120.9), (118, 123, 118, 122), (118.5, 122, 118, 121.5), (121, 126, 121, 125)], False),  # one close below the last
    ],
    "three_black": [
        (rising() + [(180, 180, 175, 176), (176, 176, 171, 172), (172, 172, 167, 168)], True),
        (rising() + [(185, 185, 181, 182), (182, 182, 177, 178), (184, 184, 178, 179), (179, 179, 173, 174)], False),
    ],
    "morning_star": [
        (falling() + [(122, 122, 113, 114), (113, 114, 112, 113.5), (114, 119, 114, 118)], True),  # closes at the middle
        (falling() + [(122, 122, 113, 114), (113, 114, 112, 113.5), (114, 118, 114, 117.9)], False),
    ],
    "harami_bull": [
        (falling() + [(121, 121, 115, 116), (117, 119, 116, 119)], True),
        (falling() + [(121, 121, 115, 116), (116.5, 120, 116, 119.5)], False),  # over half the body before
    ],
    "piercing": [
        (falling() + [(121, 121, 115, 116), (115, 120, 114, 119.5)], True),
        (falling() + [(119, 119.5, 115, 116), (115, 119, 114, 118.5)], False),  # under 0.8 of today's range before
    ],
    "dark_cloud": [
        (rising() + [(180, 186, 180, 185), (186, 187, 181, 181.5)], True),
        (rising() + [(180, 186, 180, 185), (186, 187, 182, 183)], False),  # above the middle
    ],
}


@pytest.fixture(scope="module")
def last_bars(spark):
    rows = []
    for name, cases in CASES.items():
        for k, (bars, _) in enumerate(cases):
            for i, (o, h, low, c) in enumerate(bars):
                rows.append((f"{name}-{k}", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(o), float(h), float(low), float(c), 100.0, i == len(bars) - 1))
    d = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, final boolean")
    return {r["code"]: r for r in add_candles(add_indicators(d)).where("final").collect()}


@pytest.mark.parametrize("name", CASES)
def test_rule_fires_where_it_must_only(last_bars, name):
    assert [last_bars[f"{name}-{k}"][name] for k in range(len(CASES[name]))] == [want for _, want in CASES[name]]


def test_window_patterns_on_made_series(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    rows = []
    # 260 rising days: an all-time high each day from row 251 on; then a fall of a fifth of the rise
    for i in range(270):
        c = 100.0 + i if i < 260 else 359.0 - 25 * (i - 259)
        rows.append(("up", day(i), c - 0.5, c + 1, c - 1, c, 100.0))
    # an island: gap down, three bars, gap up
    levels = [50.0] * 20 + [40.0] * 3 + [50.0]
    rows += [("isle", day(i), x, x + 1, x - 1, x, 100.0) for i, x in enumerate(levels)]
    # a jump of 20 % and its limit before the change of the limits
    rows += [("limit", dt.date(2014, 1, 1) + dt.timedelta(days=i), x, x, x, x, 100.0) for i, x in enumerate([100.0, 120.0, 144.0])]
    d = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double")
    got = add_window_patterns(add_indicators(d.withColumn("__mine", F.lit(1))))
    assert "__mine" in got.columns and not [x for x in got.columns if x.startswith("__") and x != "__mine"]
    got = {(r["code"], r["date"]): r for r in got.collect()}
    assert [i for i in range(270) if got["up", day(i)]["ath"]] == list(range(250, 260))
    assert got["up", day(263)]["price_corr"] and not got["up", day(261)]["price_corr"]
    assert got["isle", day(23)]["island_bot"] and not any(got["isle", day(i)]["island_bot"] for i in range(23))
    assert [got["limit", dt.date(2014, 1, 1 + i)]["limit_up"] for i in range(3)] == [False, True, True]
    assert not add_window_patterns(add_indicators(d.limit(0))).where(" or ".join(WINDOW_PATTERNS)).count()
