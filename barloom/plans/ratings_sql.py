"""DuckDB SQL for the queries on sectors and opinions."""

from __future__ import annotations

from barloom.plans.oracle import BARS, LISTING, lag, roll

_PANEL = f"""{BARS}, {LISTING}, counted AS (SELECT date, count(*) AS k FROM bars GROUP BY 1),
  days AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM counted WHERE k >= greatest(10, 0.3::DOUBLE * (SELECT max(k) FROM counted))),
  t AS (SELECT b.*, d.day, l.marcap, substr(b.code, 7, 1) AS sector FROM bars b JOIN days d USING (date) JOIN listing l USING (code)),
  u AS (SELECT *, CASE WHEN {lag('day')} = day - 1 THEN close / {lag('close')} - 1 END AS ret, CASE WHEN {lag('day')} = day - 1 THEN marcap * {lag('close')} END AS w FROM t)"""

_BETA = f"""WITH {_PANEL}, m AS (SELECT date, coalesce(sum(ret * w) / nullif(sum(w) FILTER (ret IS NOT NULL), 0), 0) AS m FROM u GROUP BY 1), x AS (SELECT code, date, own * m AS rm, m * m AS mm FROM (SELECT code, date, close / {lag('close')} - 1 AS own FROM t) JOIN m USING (date)),
  y AS (SELECT code, date, {roll('avg(rm)', 'rm', 60, 40)} / nullif({roll('avg(mm)', 'mm', 60, 40)}, 0) AS beta FROM x)
SELECT code, CAST(date_trunc('month', date) AS DATE) AS month, round(arg_max(beta, date), 6) AS beta FROM y WHERE beta IS NOT NULL GROUP BY 1, 2"""


def _pct(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY date) END"


def _sectors() -> str:
    keys = ("r20", "r60", "breadth", "amount", "near_high")
    grown = lambda part: ", ".join(f"exp(lv - lag(lv, {n}) OVER ({part}ORDER BY date)) - 1 AS g{n}" for n in (5, 20, 60))
    return f"""WITH {_PANEL}, c AS (SELECT *, greatest(least(ret, 1.0::DOUBLE), -0.5::DOUBLE) + CASE WHEN ret IS NULL THEN NULL ELSE 0 END AS rc, close * volume AS amt FROM u),
  e AS (SELECT *, {roll('avg(amt)', 'amt', 5, 3)} AS a5, {roll('avg(amt)', 'amt', 60, 30)} AS a60, {roll('avg(close)', 'close', 20, 15)} AS m20, {roll('max(high)', 'high', 250, 120)} AS h250 FROM c),
  big AS (SELECT sector FROM listing JOIN (SELECT DISTINCT code, sector FROM t) USING (code) GROUP BY 1 HAVING count(*) >= 3),
  wi AS (SELECT date, coalesce(sum(rc * w) / nullif(sum(w) FILTER (rc IS NOT NULL), 0), 0) AS i, sum(a5) AS t5, sum(a60) AS t60 FROM e GROUP BY 1), wl AS (SELECT *, sum(ln(1 + i)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS lv FROM wi), wg AS (SELECT date, t5, t60, {grown('')} FROM wl),
  si AS (SELECT date, sector, coalesce(sum(rc * w) / nullif(sum(w) FILTER (rc IS NOT NULL), 0), 0) AS i, sum(a5) AS s5, sum(a60) AS s60, avg(CASE WHEN m20 IS NOT NULL THEN (close > m20)::INT::DOUBLE END) AS breadth, avg(CASE WHEN h250 IS NOT NULL THEN (close >= 0.95::DOUBLE * h250)::INT::DOUBLE END) AS near_high
    FROM e JOIN big USING (sector) GROUP BY 1, 2), sl AS (SELECT *, sum(ln(1 + i)) OVER (PARTITION BY sector ORDER BY date ROWS UNBOUNDED PRECEDING) AS lv FROM si), sg AS (SELECT *, {grown('PARTITION BY sector ')} FROM sl),
  z AS (SELECT sg.date, sector, sg.g5 - wg.g5 AS r5, sg.g20 - wg.g20 AS r20, sg.g60 - wg.g60 AS r60, breadth, (s5 / t5) / nullif(s60 / t60, 0) AS amount, near_high FROM sg JOIN wg USING (date)),
  q AS (SELECT *, {", ".join(f"round({k}, 9) AS q_{k}" for k in keys)} FROM z), s AS (SELECT *, ({" + ".join(f"({_pct('q_' + k)})" for k in keys)}) / 5 AS score FROM q)
SELECT date, sector, {", ".join(f"round({k}, 6) AS {k}" for k in ("r5", "r20", "r60", "breadth", "amount", "near_high", "score"))}, CASE WHEN score IS NOT NULL THEN CAST(rank() OVER (PARTITION BY date ORDER BY round(score, 9) DESC NULLS LAST) AS INT) END AS place FROM s"""


_OPINIONS = f"""WITH {_PANEL}, m AS (SELECT code, date, close / {lag('close', 60)} - 1 AS mom FROM t), p AS (SELECT code, date, {_pct('mom')} AS rank FROM m),
  s AS (SELECT code, date, round(avg(rank) OVER (PARTITION BY code ORDER BY date ROWS 4 PRECEDING), 9) AS s FROM p WHERE rank IS NOT NULL), o AS (SELECT code, date, round({_pct('s')}, 9) AS p FROM s),
  l AS (SELECT code, date, CASE WHEN p >= 0.95::DOUBLE THEN 2 WHEN p >= 0.75::DOUBLE THEN 1 WHEN p >= 0.25::DOUBLE THEN 0 WHEN p >= 0.05::DOUBLE THEN -1 ELSE -2 END AS opinion FROM o),
  i AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) - row_number() OVER (PARTITION BY code, opinion ORDER BY date) AS island FROM l),
  r AS (SELECT code, opinion, island, min(date) AS date, count(*) AS "rows" FROM i GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS k FROM r)
SELECT code, date, opinion, "rows" FROM k WHERE k <= 12"""

RATING_SQL = {"market_betas": _BETA, "sector_ranks": _sectors(), "opinion_changes": _OPINIONS}
