"""DuckDB SQL for the queries on the last bar of each code."""

from __future__ import annotations

from barloom.plans.oracle import _TICK, BARS, MOVING, RECURSIVE, lag, roll


def _tick(p: str) -> str:
    return f"(floor({p} / ({_TICK.replace('p <', f'{p} <')}) + 0.5::DOUBLE) * ({_TICK.replace('p <', f'{p} <')}))"


_SWING = f"""z0 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS rn, count(*) OVER (PARTITION BY code) AS n, {lag('ma20', 5)} AS ma20_5,
    max(high) OVER w20 AS h20, min(low) OVER w20 AS l20, max(high) OVER w60 AS h60, min(low) OVER w60 AS l60
    FROM moving WINDOW w20 AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING), w60 AS (PARTITION BY code ORDER BY date ROWS 59 PRECEDING)),
  top AS (SELECT code, max(rn) AS t, any_value(high) AS top FROM (SELECT *, rank() OVER (PARTITION BY code ORDER BY high DESC) AS k FROM z0 WHERE rn > n - 120) WHERE k = 1 GROUP BY 1),
  z1 AS (SELECT code, any_value(n) AS n, any_value(t) AS t, any_value(top) AS top, min(low) FILTER (rn BETWEEN t - 120 AND t) AS floor_, coalesce(min(low) FILTER (rn > t), max(low) FILTER (rn = t)) AS after,
    arg_max(close, rn) AS c, {", ".join(f"arg_max({k}, rn) AS {k}" for k in ("h20", "l20", "h60", "l60"))}, {", ".join(f"max({k}) FILTER (rn = n) AS {k}" for k in ("ma20", "ma60", "ma120", "ma20_5", "ma60_slope"))} FROM z0 JOIN top USING (code) GROUP BY 1),
  z2 AS (SELECT *, n - t AS days, c / top - 1 AS fall, CASE WHEN floor_ > 0 THEN top / floor_ - 1 ELSE 0 END AS rise, CASE WHEN top > floor_ THEN (top - c) / (top - floor_) ELSE 0 END AS back,
    CASE WHEN after > 0 THEN top / after - 1 ELSE 0 END AS span, CASE WHEN after > 0 THEN c / after - 1 ELSE 0 END AS rebound,
    CASE WHEN n > 70 THEN coalesce(ma60_slope, 0) ELSE 0 END AS s60, CASE WHEN n > 26 THEN coalesce(ma20 / ma20_5 - 1, 0) ELSE 0 END AS s20 FROM z1),
  z3 AS (SELECT *, CASE WHEN fall >= -0.06::DOUBLE AND ma20 > ma60 AND s60 > 0 THEN 'uptrend' WHEN rise >= 0.15::DOUBLE AND fall <= -0.12::DOUBLE AND rebound < 0.07::DOUBLE AND days <= 60 THEN 'price_corr'
    WHEN rise >= 0.15::DOUBLE AND after / top - 1 <= -0.12::DOUBLE AND rebound >= 0.07::DOUBLE AND days <= 90 AND fall <= -0.05::DOUBLE THEN 'price_corr_rb' WHEN rise >= 0.15::DOUBLE AND days >= 12 AND span <= 0.16::DOUBLE THEN 'time_corr'
    WHEN fall <= -0.25::DOUBLE AND c < ma120 AND h20 / l20 - 1 <= 0.14::DOUBLE AND abs(s20) < 0.02::DOUBLE THEN 'base' WHEN ma20 < ma60 AND s60 < 0 AND fall <= -0.15::DOUBLE THEN 'downtrend'
    WHEN h60 / l60 - 1 <= 0.25::DOUBLE THEN 'box' ELSE 'mixed' END AS phase FROM z2),
  z4 AS (SELECT *, CASE WHEN phase NOT IN ('downtrend', 'base') AND rise >= 0.15::DOUBLE THEN 'retr' WHEN phase IN ('downtrend', 'base') AND top / after - 1 >= 0.2::DOUBLE AND days > 0 THEN 'rebound' END AS kind FROM z3),
  fibs AS (SELECT code, i, {_tick('x')} AS price FROM (SELECT code, i, CASE kind WHEN 'retr' THEN top - (top - floor_) * ratio ELSE after + (top - after) * ratio END AS x
    FROM z4 CROSS JOIN (VALUES (1, 0.236::DOUBLE), (2, 0.382::DOUBLE), (3, 0.5::DOUBLE), (4, 0.618::DOUBLE), (5, 0.786::DOUBLE)) v(i, ratio) WHERE kind IS NOT NULL)),
  fib AS (SELECT code, string_agg(CAST(CAST(price AS DECIMAL(18,1)) AS VARCHAR), '|' ORDER BY i) AS fib FROM fibs GROUP BY 1)"""

_ZONES = f"""q0 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM bars), q1 AS (SELECT *, min(low) OVER (PARTITION BY code) AS lo, max(high) OVER (PARTITION BY code) AS hi FROM q0 WHERE back <= 120),
  q2 AS (SELECT code, bin, lo, hi, (hi - lo) / 24 AS step, volume * close * CASE WHEN high > low THEN greatest(0, least(high, lo + bin * ((hi - lo) / 24) + (hi - lo) / 24) - greatest(low, lo + bin * ((hi - lo) / 24))) / (high - low)
    ELSE CASE WHEN bin = least(23, floor((close - lo) / (hi - lo) * 24)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS w FROM q1 CROSS JOIN range(24) r(bin) WHERE hi > lo),
  q3 AS (SELECT code, bin, any_value(lo) AS lo, any_value(step) AS step, sum(w) AS w FROM q2 GROUP BY 1, 2), q4 AS (SELECT *, w / sum(w) OVER (PARTITION BY code) AS share FROM q3),
  q5 AS (SELECT q4.*, share >= greatest(1.25::DOUBLE / 24, quantile_cont(share, 0.7) OVER (PARTITION BY code)) AS heavy, c.close AS c FROM q4 JOIN (SELECT code, close FROM q0 WHERE back = 1) c USING (code)),
  q6 AS (SELECT code, min(bin) FILTER (heavy AND lo + bin * step > c) AS a0, max(bin) FILTER (heavy AND lo + (bin + 1) * step < c) AS b1 FROM q5 GROUP BY 1),
  q7 AS (SELECT code, any_value(lo) AS lo, any_value(step) AS step, any_value(a0) AS a0, any_value(b1) AS b1, coalesce(min(bin) FILTER (NOT heavy AND bin > a0) - 1, 23) AS a1, coalesce(max(bin) FILTER (NOT heavy AND bin < b1) + 1, 0) AS b0 FROM q5 JOIN q6 USING (code) GROUP BY 1),
  q8 AS (SELECT code, a0, b1, lo + a0 * step AS e1, lo + (a1 + 1) * step AS e2, lo + b0 * step AS e3, lo + (b1 + 1) * step AS e4 FROM q7),
  zones AS (SELECT code, CASE WHEN a0 IS NOT NULL THEN ({_tick('e1')} + {_tick('e2')}) / 2 END AS zone_above, CASE WHEN b1 IS NOT NULL THEN ({_tick('e3')} + {_tick('e4')}) / 2 END AS zone_below FROM q8)"""

_KINDS = "pivot_high pivot_low ma20 ma60 ma120 fib382 fib500 fib618 zone_above zone_below high250 low250".split()


def _levels() -> str:
    """Candidates in order walk through a recursion that remembers the first price of the level at hand."""
    k = {x: i for i, x in enumerate(_KINDS)}
    named = " WHEN ".join(f"{i} THEN '{x}'" for x, i in k.items())
    fixed = " UNION ALL ".join(f"SELECT code, {k[x]}, {x} FROM now" for x in ("ma20", "ma60", "ma120", "high250", "low250"))
    return f"""WITH RECURSIVE {BARS}, {MOVING}, {RECURSIVE}, {_SWING}, {_ZONES}, p0 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back, {lag('high', 8)} AS h8, {lag('high', 9)} AS h9, {lag('low', 8)} AS l8, {lag('low', 9)} AS l9,
    {roll('max(high)', 'high', 17)} AS h17, {roll('min(low)', 'low', 17)} AS l17, max(high) OVER y AS high250, min(low) OVER y AS low250 FROM ind WINDOW y AS (PARTITION BY code ORDER BY date ROWS 249 PRECEDING)),
  now AS (SELECT code, close, coalesce(atr_pct, 0.02::DOUBLE) AS a, ma20, ma60, ma120, high250, low250 FROM p0 WHERE back = 1),
  cand(code, k, price) AS (SELECT code, 0, h8 FROM p0 WHERE back <= 104 AND h8 = h17 AND h8 > h9 UNION ALL SELECT code, 1, l8 FROM p0 WHERE back <= 104 AND l8 = l17 AND l8 < l9 UNION ALL {fixed}
    UNION ALL SELECT code, i + 3, price FROM fibs WHERE i BETWEEN 2 AND 4 UNION ALL SELECT code, {k['zone_above']}, zone_above FROM zones UNION ALL SELECT code, {k['zone_below']}, zone_below FROM zones),
  sided AS (SELECT code, k, price, CASE WHEN price > close * (1 + greatest(0.012::DOUBLE, 0.4::DOUBLE * a)) THEN 1 WHEN price < close * (1 - greatest(0.012::DOUBLE, 0.4::DOUBLE * a)) THEN -1 END AS side FROM cand JOIN now USING (code) WHERE price IS NOT NULL),
  queue AS (SELECT *, row_number() OVER (PARTITION BY code, side ORDER BY price * side, k) AS i FROM sided WHERE side IS NOT NULL),
  walk AS (
    SELECT code, side, CAST(1 AS BIGINT) AS i, price AS first_price, 1 AS place, k FROM queue WHERE i = 1
    UNION ALL SELECT q.code, q.side, q.i, CASE WHEN abs(q.price / w.first_price - 1) <= 0.012::DOUBLE THEN w.first_price ELSE q.price END, w.place + CASE WHEN abs(q.price / w.first_price - 1) <= 0.012::DOUBLE THEN 0 ELSE 1 END, q.k
    FROM walk w JOIN queue q ON q.code = w.code AND q.side = w.side AND q.i = w.i + 1),
  members AS (SELECT *, row_number() OVER (PARTITION BY code, side, place ORDER BY i) AS m FROM walk WHERE place <= 3),
  kinds AS (SELECT code, side, place, first_price, k, min(i) AS i FROM members WHERE place < 3 OR m = 1 GROUP BY ALL), firsts AS (SELECT *, row_number() OVER (PARTITION BY code, side, place ORDER BY i) AS m FROM kinds)
SELECT code, CASE side WHEN 1 THEN 'resistance' ELSE 'support' END AS side, place, any_value({_tick('first_price')}) AS price, string_agg(CASE k WHEN {named} END, '+' ORDER BY i) FILTER (m <= 3) AS kinds FROM firsts GROUP BY code, side, place"""


REPORT_SQL = {
    "swing_phases": f"WITH {BARS}, {MOVING}, {_SWING} SELECT code, days, top AS high, floor_ AS low, after, {', '.join(f'round({k}, 6) AS {k}' for k in ('fall', 'rise', 'back', 'span', 'rebound'))}, phase, kind, fib FROM z4 LEFT JOIN fib USING (code)",
    "volume_zones": f"WITH {BARS}, {_ZONES} SELECT * FROM zones",
    "price_levels": _levels(),
}
