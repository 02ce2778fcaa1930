"""DuckDB SQL for the queries on scores that SQL can express."""

from __future__ import annotations

from barloom.plans.oracle import BARS, MOVING, RECURSIVE, lag, lead

_EDGES = [*(k / 10 for k in range(9)), 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 1.0]
#: Days with ten codes and three tenths of the fullest day are the panel; its bars take the place of all bars.
_PANEL = f"""{BARS}, counted AS (SELECT date, count(*) AS k FROM bars GROUP BY 1), open_days AS (SELECT date FROM counted WHERE k >= greatest(10, 0.3::DOUBLE * (SELECT max(k) FROM counted))),
  traded AS (SELECT bars.* FROM bars JOIN open_days USING (date)), {MOVING.replace("FROM bars)", "FROM traded)")}, {RECURSIVE},
  g0 AS (SELECT code, date, close / {lag('close', 60)} - 1 AS mom, {lead('close', 20)} / {lead('open', 1)} - 1 AS fwd, atr_pct FROM ind),
  g1 AS (SELECT * FROM g0 WHERE mom IS NOT NULL AND abs(fwd) <= 3 AND atr_pct > 0),
  v AS (SELECT code, date, round((rank() OVER (PARTITION BY date ORDER BY mom) + (count(*) OVER (PARTITION BY date, mom) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date), 9) AS rank, fwd / greatest(atr_pct, 0.005::DOUBLE) AS value FROM g1)"""


def _calibration() -> str:
    edges = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))
    last = len(_EDGES) - 2

    def at(x: str) -> str:
        return f"""(SELECT CASE WHEN {x} <= min(k.x) THEN arg_min(k.y, k.x) WHEN {x} >= max(k.x) THEN arg_max(k.y, k.x)
      ELSE max(CASE WHEN k.x <= {x} AND {x} < k.x2 THEN k.y + ({x} - k.x) / (k.x2 - k.x) * (k.y2 - k.y) END) END FROM knots k)"""

    return f"""WITH {_PANEL},
  edges(bucket, lo, hi) AS (VALUES {edges}), b AS (SELECT bucket, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n, avg(value) AS mean FROM v JOIN edges ON rank >= lo AND (rank < hi OR bucket = {last}) GROUP BY 1 HAVING count(*) >= 30),
  runs AS (SELECT j.bucket AS j, k.bucket AS k, sum(x.n * x.mean) / sum(x.n) AS mean FROM b j JOIN b k ON k.bucket >= j.bucket JOIN b x ON x.bucket BETWEEN j.bucket AND k.bucket GROUP BY 1, 2),
  least_ AS (SELECT i.bucket, r.j, min(r.mean) AS m FROM b i JOIN runs r ON r.j <= i.bucket AND r.k >= i.bucket GROUP BY 1, 2), fitted AS (SELECT bucket, max(m) AS y FROM least_ GROUP BY 1),
  knots AS (SELECT bucket, (lo + hi) / 2 AS x, y, lead((lo + hi) / 2) OVER (ORDER BY bucket) AS x2, lead(y) OVER (ORDER BY bucket) AS y2 FROM b JOIN fitted USING (bucket))
SELECT bucket, lo, hi, n, round(mean, 6) AS mean, round(y, 6) AS fitted, round({at('b.lo')}, 6) AS at_lo, round({at('b.hi')}, 6) AS at_hi FROM b JOIN fitted USING (bucket)"""


_BANDS = f"""WITH {_PANEL}, days AS (SELECT date, row_number() OVER (ORDER BY date) <= floor(count(*) OVER () * (2 / 3.0::DOUBLE)) AS early FROM (SELECT DISTINCT date FROM v)),
  t AS (SELECT v.*, early, CAST(least(floor(rank * 10), 9) AS INT) AS tenth FROM v JOIN days USING (date)),
  every AS (SELECT quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM t WHERE early), own AS (SELECT tenth, count(*) AS n, quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM t WHERE early GROUP BY 1),
  late AS (SELECT value, CASE WHEN own.n > 200 THEN own.q ELSE every.q END AS q FROM t LEFT JOIN own USING (tenth) CROSS JOIN every WHERE NOT early)
SELECT count(*) AS n, round(avg(CASE WHEN value BETWEEN q[1] AND q[5] THEN 1.0::DOUBLE ELSE 0 END), 6) AS "outer", round(avg(CASE WHEN value BETWEEN q[2] AND q[4] THEN 1.0::DOUBLE ELSE 0 END), 6) AS "inner",
  round(avg(CASE WHEN value > q[3] THEN 1.0::DOUBLE ELSE 0 END), 6) AS over_median FROM late"""

SCORE_SQL = {"score_calibration": _calibration(), "band_coverage": _BANDS}
