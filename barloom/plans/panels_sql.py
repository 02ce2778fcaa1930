"""DuckDB SQL for the queries over panels of codes."""

from __future__ import annotations

from barloom.plans.oracle import BARS, LISTING, lag, lead, roll

_MOMENTUM = f"""mo AS (SELECT code, date, close, close / {lag('close', 60)} - 1 AS mom, {lead('close', 20)} / close - 1 AS fwd, {roll('avg(close)', 'close', 120)} AS ma120 FROM bars)"""
_SO_FAR = "OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)"
_SHORTS = f"""sold AS (SELECT p_brand AS code, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS sv FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2),
  shorts AS (SELECT *, {roll('sum(sv)', 'sv', 10, 1)} AS bal FROM sold),
  f0 AS (SELECT b.code, b.date, b.close, b.volume, s.sv, l.marcap / 1e6::DOUBLE AS shares, max(s.date) OVER (PARTITION BY b.code) AS last_day,
    coalesce(last_value(s.bal IGNORE NULLS) OVER (PARTITION BY b.code ORDER BY b.date ROWS UNBOUNDED PRECEDING), 0) AS bal
    FROM bars b JOIN listing l USING (code) LEFT JOIN shorts s ON s.code = b.code AND s.date = b.date),
  f1 AS (SELECT *, CASE WHEN date <= last_day THEN coalesce(sv, 0) / volume * 100 END AS r, CASE WHEN date <= last_day THEN coalesce(sv, 0) ELSE 0 END AS sold_qty, {lag('bal', 20)} AS was FROM f0 WHERE last_day IS NOT NULL),
  f2 AS (SELECT *, {roll('avg(r)', 'r', 20, 10)} AS r20, bal / shares * 100 AS b, CASE WHEN was > 0 THEN (bal / was - 1) * 100 END AS bch, {lead('close', 20)} / close - 1 AS fwd,
    coalesce(date NOT BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' AND {roll('sum(sold_qty)', 'sold_qty', 60, 20)} > 0 AND bal > 0, false) AS ok FROM f1),
  frame AS (SELECT * FROM f2 WHERE ok AND fwd IS NOT NULL)"""


def _rank(x: str) -> str:
    day = "OVER (PARTITION BY date)"
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0::DOUBLE) / count({x}) {day} END"


def _figures() -> str:
    return "count(*) AS n, avg(y) AS mean, quantile_cont(y, 0.1) AS p10, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.9) AS p90, avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS win"


def _period(unit: str) -> str:
    return f"""SELECT code, CAST(date_trunc('{unit}', date) AS DATE) AS period, '{unit}' AS unit, arg_max(close, date) AS c1, arg_min(close, date) AS c0 FROM bars GROUP BY 1, 2"""


_GROUPS = {"balance_top": "kb >= 0.9", "balance_low_half": "kb < 0.5", "rise_top": "kc >= 0.9", "fall_top": "kc <= 0.1", "sales_top": "kr >= 0.9"}

PANEL_SQL = {
    "market_returns": f"""WITH {BARS}, {LISTING}, n AS (SELECT date, count(*) AS k FROM bars WHERE close > 0 GROUP BY date),
  days AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM n WHERE k >= 10 AND k >= 0.3 * (SELECT max(k) FROM n)),
  p AS (SELECT b.code, d.date, d.day, CASE WHEN close > 0 THEN close END AS close, marcap FROM bars b JOIN days d ON d.date = b.date JOIN listing l ON l.code = b.code),
  x AS (SELECT a.date, a.close / b.close - 1 AS r, b.close * b.marcap AS w FROM p a LEFT JOIN p b ON a.code = b.code AND b.day = a.day - 1)
  SELECT date, count(r) AS n_codes, round(avg(r), 6) AS equal, round(coalesce(sum(r * w) / sum(w) FILTER (r IS NOT NULL), 0), 6) AS weighted FROM x GROUP BY date""",
    "equity_metrics": f"""WITH {BARS}, e AS (SELECT *, close / {lag('close')} - 1 AS r, close / max(close) {_SO_FAR} - 1 AS dd FROM bars),
  g AS (SELECT code, count(*) AS n, arg_max(close, date) / arg_min(close, date) AS growth, min(dd) AS mdd, stddev_pop(r) AS sd, avg(r) AS m FROM e GROUP BY code)
  SELECT code, n, round(growth - 1, 4) AS total, round(pow(growth, 252.0::DOUBLE / n) - 1, 4) AS cagr, round(mdd, 4) AS mdd, round(sd * sqrt(252), 4) AS vol,
    round(CASE WHEN sd > 0 THEN m / sd * sqrt(252) ELSE 0 END, 4) AS sharpe FROM g""",
    "periodic_returns": f"""WITH {BARS}, p AS ({_period('year')} UNION ALL {_period('month')})
  SELECT code, period, unit, round(c1 / coalesce(lag(c1) OVER (PARTITION BY code, unit ORDER BY period), c0) - 1, 6) AS ret FROM p""",
    "rank_ic_by_year": f"""WITH {BARS}, {_MOMENTUM}, k AS (SELECT date, {_rank('mom')} AS x, {_rank('fwd')} AS y FROM mo WHERE mom IS NOT NULL AND fwd IS NOT NULL),
  i AS (SELECT date, round(corr(x, y), 9) AS ic FROM k GROUP BY date HAVING count(*) >= 10)
  SELECT CAST(year(date) AS INT) AS year, count(ic) AS n_days, round(avg(ic), 5) AS mean_ic, round(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic <= 0 THEN 0.0 END), 5) AS positive FROM i GROUP BY 1""",
    "momentum_bands": f"""WITH {BARS}, {_MOMENTUM}, w AS (SELECT year(date) AS yr, quantile_cont(fwd, 0.01) AS lo, quantile_cont(fwd, 0.99) AS hi FROM mo GROUP BY 1),
  s AS (SELECT {_rank('mom')} AS score, close > ma120 AS up, CASE WHEN fwd IS NOT NULL THEN greatest(least(fwd, hi), lo) END AS y FROM mo JOIN w ON yr = year(date)),
  t AS (SELECT *, CAST(ceil(score * 10) - 1 AS INT) AS tenth FROM s WHERE score IS NOT NULL AND up IS NOT NULL AND y IS NOT NULL),
  c AS (SELECT tenth, up, {_figures()} FROM t GROUP BY 1, 2), d AS (SELECT tenth, {_figures()} FROM t GROUP BY 1),
  u AS (SELECT c.tenth, up, c.n AS n_cell, c.n < 1000 AS of_tenth, {", ".join(f"CASE WHEN c.n < 1000 THEN d.{k} ELSE c.{k} END AS {k}" for k in ("n", "mean", "p10", "p50", "p90", "win"))} FROM c JOIN d ON c.tenth = d.tenth)
  SELECT tenth, up, n_cell, of_tenth, n, {", ".join(f"round({k}, 5) AS {k}" for k in ("mean", "p10", "p50", "p90", "win"))},
    round((win + 1.64 * 1.64 / (2 * n) - 1.64 * sqrt(win * (1 - win) / n + 1.64 * 1.64 / (4 * n * n))) / (1 + 1.64 * 1.64 / n), 5) AS bound FROM u""",
    "capped_picks": f"""WITH {BARS}, {LISTING}, {_MOMENTUM}, c AS (SELECT date, code, market, mom FROM mo JOIN listing USING (code) WHERE mom IS NOT NULL),
  k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY date, market ORDER BY mom DESC, code) <= 3)
  SELECT date, CAST(row_number() OVER (PARTITION BY date ORDER BY mom DESC, code) AS INT) AS place, code, market, round(mom, 6) AS mom FROM k QUALIFY place <= 5""",
    "short_sale_study": f"""WITH {BARS}, {LISTING}, {_SHORTS}, a AS (SELECT * FROM frame QUALIFY count(*) OVER (PARTITION BY code) > 60),
  e AS (SELECT *, fwd - avg(fwd) OVER (PARTITION BY date) AS ex FROM a QUALIFY count(*) OVER (PARTITION BY date) >= 10),
  k AS (SELECT ex, {_rank('b')} AS kb, {_rank('bch')} AS kc, {_rank('r20')} AS kr FROM e),
  g AS ({" UNION ALL ".join(f"SELECT '{name}' AS key, ex FROM k WHERE {x}" for name, x in _GROUPS.items())})
  SELECT key, count(*) AS n, round(avg(ex), 5) AS excess, round(avg(CASE WHEN ex > 0 THEN 1.0 ELSE 0.0 END), 5) AS win FROM g GROUP BY key""",
    "short_sale_fifths": f"""WITH {BARS}, {LISTING}, {_SHORTS},
  q AS (SELECT code, count(*) AS rows_, list_sort(list_distinct([round(x, 6) for x in quantile_cont(bal, [0, 0.2, 0.4, 0.6, 0.8, 1])])) AS e FROM frame GROUP BY code),
  z AS (SELECT f.code, fwd, e, CAST(greatest(least(len([x for x in e if x <= f.bal]) - 1, len(e) - 2), 0) AS INT) AS fifth FROM frame f JOIN q ON q.code = f.code WHERE rows_ >= 200 AND len(e) >= 4)
  SELECT code, fifth, count(*) AS n, min(e[fifth + 1]) AS lo, min(e[fifth + 2]) AS hi, round(avg(fwd), 5) AS mean, round(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END), 5) AS win FROM z GROUP BY 1, 2""",
    "signal_overlap": f"""WITH {BARS}, s AS (SELECT code, coalesce(close > {roll('avg(close)', 'close', 20)}, false) AS a, coalesce(volume > 1.5 * {roll('avg(volume)', 'volume', 20)}, false) AS b FROM bars)
  SELECT code, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a OR b) AS either, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM s WHERE a OR b GROUP BY code""",
}
