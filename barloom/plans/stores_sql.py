"""DuckDB SQL for the queries on stored histories and the ledger."""

from __future__ import annotations

from barloom.plans.oracle import BARS, MOVING, RECURSIVE, lag, onset

_UPSERT = f"""WITH {BARS}, old AS (SELECT code, date, close * CASE WHEN code LIKE '%1' THEN 2 ELSE 1 END AS close FROM bars WHERE date < DATE '1999-01-01'), fresh AS (SELECT code, date, close, volume FROM bars WHERE date >= DATE '1998-12-20'),
  split AS (SELECT DISTINCT code FROM old JOIN fresh USING (code, date) WHERE abs(fresh.close / old.close - 1) > 0.005::DOUBLE),
  merged AS (SELECT b.code, b.date, b.volume, CASE WHEN b.code IN (SELECT code FROM split) OR f.close IS NOT NULL THEN b.close ELSE o.close END AS close FROM bars b LEFT JOIN fresh f USING (code, date) LEFT JOIN old o USING (code, date))
SELECT code, count(*) AS n, min(date) AS first_day, max(date) AS last_day, round(sum(close), 2) AS closes FROM merged WHERE close > 0 AND volume > 0 AND date >= DATE '1995-06-01' GROUP BY 1"""

_COLUMNAR = f"""WITH {BARS}, s AS (SELECT *, CASE WHEN median(close) OVER (PARTITION BY code) < 1000 THEN 100 ELSE 1 END AS scale FROM bars),
  i AS (SELECT code, scale, date, {", ".join(f"CAST(round_even({x} * scale, 0) AS BIGINT) AS {k}" for k, x in zip("ohlc", ("open", "high", "low", "close")))}, CAST(floor(volume) AS BIGINT) AS v, strftime(date, '%Y%m%d') AS t FROM s)
SELECT code, scale, {", ".join(f"string_agg(CAST({k} AS VARCHAR), ',' ORDER BY date) AS {k}" for k in "tohlcv")} FROM i GROUP BY 1, 2"""

_LEDGER = f"""WITH {BARS}, {MOVING}, {RECURSIVE}, a0 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS i, coalesce(ma5 > ma20 AND {lag('ma5')} <= {lag('ma20')}, false) AS up FROM ind),
  a1 AS (SELECT *, {onset('up')} AS ev FROM a0),
  p AS (SELECT code || '|' || strftime(date, '%Y-%m-%d') AS id, code, i, date, close * (1 + 2 * atr_pct) AS target, close * (1 - 1.5::DOUBLE * atr_pct) AS stop FROM a1 WHERE ev AND atr_pct IS NOT NULL),
  path AS (SELECT p.id, p.target, p.stop, b.i - p.i AS k, b.date, b.open AS o, b.high AS h, b.low AS l, b.close AS c FROM p JOIN a1 b ON b.code = p.code AND b.i BETWEEN p.i + 1 AND p.i + 20 AND b.date <= p.date + 80),
  g AS (SELECT id, arg_min(o, k) AS entry, max(k) AS n, arg_max(c, k) AS last_close, min(k) FILTER (l <= stop) AS down, min(k) FILTER (h >= target) AS up FROM path GROUP BY 1),
  x AS (SELECT p.id, p.target, p.stop, g.*EXCLUDE (id), CASE WHEN down <= coalesce(up, down) THEN down WHEN up IS NOT NULL THEN up WHEN n = 20 THEN 20 END AS k, down <= coalesce(up, down) AS stopped FROM p LEFT JOIN g USING (id)),
  y AS (SELECT x.*, e.date, CASE WHEN stopped THEN least(e.o, x.stop) WHEN up IS NOT NULL THEN greatest(e.o, x.target) ELSE e.c END AS price FROM x LEFT JOIN path e ON e.id = x.id AND e.k = x.k),
  z AS (SELECT id, CASE WHEN k IS NULL THEN 'open' WHEN price / entry - 1 - 0.0025::DOUBLE > 0 THEN 'win' ELSE 'loss' END AS status, entry, CASE WHEN k IS NOT NULL THEN date END AS exit_date, CASE WHEN k IS NOT NULL THEN price END AS exit,
    CASE WHEN k IS NOT NULL THEN price / entry - 1 - 0.0025::DOUBLE ELSE last_close / entry - 1 END AS ret, CAST(coalesce(k, n) AS INT) AS days FROM y)"""

STORE_SQL = {
    "incremental_upsert": _UPSERT,
    "columnar_history": _COLUMNAR,
    "pick_ledger": f"{_LEDGER} SELECT id, status, round(entry, 7) AS entry, exit_date, round(exit, 7) AS exit, round(ret, 6) AS ret, days FROM z",
    "pick_summary": f"{_LEDGER} SELECT count(*) AS total, count(*) FILTER (status <> 'open') AS closed, count(*) FILTER (status = 'open') AS open, round(avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (status <> 'open'), 6) AS win, round(avg(ret) FILTER (status <> 'open'), 6) AS mean, round(avg(days) FILTER (status <> 'open'), 6) AS days FROM z",
}
