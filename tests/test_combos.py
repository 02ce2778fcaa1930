"""Rule mining against a brute force in plain Python."""

import datetime as dt
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from barloom.operators.conditions import CONDITIONS
from barloom.operators.studies import onset_combos, split_day


def test_all_conditions_are_mined_at_their_onsets(spark):
    rng = np.random.default_rng(1)
    first, flags = dt.date(2024, 1, 1), rng.random((2, 120, len(CONDITIONS))) < 0.25
    rets = [[None if i >= 110 else round(float(x), 4) for i, x in enumerate(rng.normal(0, 0.1, 120))] for _ in "ab"]
    rows = [(code, first + dt.timedelta(days=i), rets[k][i], *map(bool, flags[k, i])) for k, code in enumerate("ab") for i in range(120)]
    d = spark.createDataFrame(rows, "code string, date date, ret double, " + ", ".join(f"{c} boolean" for c in CONDITIONS))
    split = split_day(d.where("ret is not null"))
    assert split == first + dt.timedelta(days=71)
    want = {}
    for size in (1, 2, 3):
        for combo in combinations(range(len(CONDITIONS)), size):
            early, late = [], []
            for k in range(2):
                on = flags[k][:, combo].all(axis=1)
                for i in np.flatnonzero(on[:110]):
                    if not on[max(0, i - 5) : i].any():
                        (early if i < 71 else late).append(rets[k][i])
            if len(early) >= 3 and len(late) >= 2:
                want["+".join(CONDITIONS[c] for c in combo)] = (len(early), len(late), round(sum(early) / len(early), 4), round(sum(early + late) / len(early + late), 4))
    got = onset_combos(d, CONDITIONS, 3, F.lit(split), 3, 2).collect()
    assert {r["combo"]: (r["n_early"], r["n_late"], round(r["early_mean"], 4), round(r["mean_ret"], 4)) for r in got}.keys() == want.keys()
    for r in got:
        w = want[r["combo"]]
        assert (r["n_early"], r["n_late"]) == w[:2] and abs(r["early_mean"] - w[2]) < 1e-3 and abs(r["mean_ret"] - w[3]) < 1e-3
    assert split_day(d.limit(0)) is None
