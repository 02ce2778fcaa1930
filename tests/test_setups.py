"""Setups on hand-made series."""

import datetime as dt

from barloom.plans.queries import add_setups


def test_each_setup_has_its_conditions(spark):
    first, rows = dt.date(2022, 1, 1), []
    for code, large in (("big", True), ("small", False), *((f"other{k}", False) for k in range(4))):
        for i in range(320):
            c, o, v = 100 + 0.1 * i, 100 + 0.1 * i, 100.0
            if i == 270:
                o, c, v = 127.0, 150.0, 1000.0  # over the year's high, and a reference bar
            if i == 271:
                c = o = 127.5  # quiet, over the reference bar's open and under the 5-day mean
            if i == 300:
                c = o = 125.0  # a sharp fall over the 200-day mean
            if i >= 310:
                c = o = 60.0
            nets = (1.0, 1.0) if 292 <= i < 298 else (1.0, -1.0)
            rows.append((code, first + dt.timedelta(days=i), o, max(o, c), min(o, c), c, v, large, *nets))
    rows = [*rows, *[("thin", d, o, h, low, c, 1e-3, True, a, b) for code, d, o, h, low, c, v, _, a, b in rows if code == "big"]]
    d = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, large boolean, net_a double, net_b double")
    got = {(r["code"], (r["date"] - first).days): r for r in add_setups(d).collect()}
    days = lambda code, key: [i for i in range(320) if got[code, i][key]]
    assert days("big", "dip") and days("big", "dip")[0] == 310 and not days("small", "dip")
    assert days("big", "high52") == [270]
    assert 271 in days("big", "pull") and 270 not in days("big", "pull") and max(days("big", "pull")) <= 279
    assert 300 in days("big", "rsi2") and 310 not in days("big", "rsi2")
    assert days("big", "flow") == [295, 296, 297, 298]
    assert not any(days("thin", k) for k in ("dip", "rsi2", "pull", "high52", "flow"))
