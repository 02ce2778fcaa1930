"""DuckDB SQL for the queries over paths, written from the rules rather than from the Spark plans."""

from __future__ import annotations

from itertools import combinations

from barloom.plans.oracle import BARS, CONDITIONS, FLOWS, LISTING, MOVING, RECURSIVE, _combos, _index, cond_rules, lag, lead, onset, roll

_NUMBERED = f"""n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS t, {lag('high')} AS h1, {lag('high', 2)} AS h2, {lag('low')} AS l1, {lag('low', 2)} AS l2, {lag('close')} AS c1 FROM bars)"""

_SAR = f"""WITH RECURSIVE {BARS}, {_NUMBERED},
  turn AS (
    SELECT code, CAST(1 AS BIGINT) AS t, 1 AS side, low AS sar, high AS extreme, 0.02::DOUBLE AS pace FROM n WHERE t = 1
    UNION ALL
    SELECT code, t, CASE WHEN flip THEN -side ELSE side END, CASE WHEN flip THEN extreme ELSE v END,
      CASE WHEN flip THEN CASE side WHEN 1 THEN low ELSE high END WHEN further THEN CASE side WHEN 1 THEN high ELSE low END ELSE extreme END,
      CASE WHEN flip THEN 0.02::DOUBLE WHEN further THEN least(pace + 0.02::DOUBLE, 0.2::DOUBLE) ELSE pace END
    FROM (SELECT *, CASE side WHEN 1 THEN low < v ELSE high > v END AS flip, CASE side WHEN 1 THEN high > extreme ELSE low < extreme END AS further
      FROM (SELECT n.code, n.t, n.low, n.high, s.side, s.extreme, s.pace,
          CASE s.side WHEN 1 THEN least(s.sar + s.pace * (s.extreme - s.sar), n.l1, coalesce(n.l2, n.l1)) ELSE greatest(s.sar + s.pace * (s.extreme - s.sar), n.h1, coalesce(n.h2, n.h1)) END AS v
        FROM turn s JOIN n ON n.code = s.code AND n.t = s.t + 1))),
  sar AS (SELECT n.code, n.date, n.close, n.c1, CASE WHEN n.t > 1 THEN turn.sar END AS sar FROM n JOIN turn USING (code, t)),
  was AS (SELECT *, {lag('sar')} AS sar1 FROM sar)
SELECT code, date, round(sar, 7) AS sar, coalesce(sar < close AND sar1 > c1, false) AS sar_buy, coalesce(sar > close AND sar1 < c1, false) AS sar_sell FROM was"""

_FLAGS = f"""WITH {BARS}, {_NUMBERED}, f0 AS (SELECT *, count(*) OVER (PARTITION BY code) AS total, min(low) OVER near AS foot, max(high) OVER near AS head, avg(volume) OVER near AS pole
    FROM n WINDOW near AS (PARTITION BY code ORDER BY t ROWS 10 PRECEDING)),
  pairs AS (SELECT a.code, a.t, b.t AS j, b.high, b.low, b.volume, b.foot, b.head, b.pole FROM (SELECT code, t, unnest(range(1, 17)) AS k FROM f0) a JOIN f0 b ON b.code = a.code AND b.t = a.t - a.k),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, t ORDER BY high DESC, j DESC) AS k FROM pairs) WHERE k = 1),
  after AS (SELECT p.code, p.t, min(p.low) AS low, avg(p.volume) AS volume FROM pairs p JOIN top USING (code, t) WHERE p.j > top.j GROUP BY 1, 2),
  bottom AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, t ORDER BY low, j) AS k FROM pairs WHERE t - j <= 5) WHERE k = 1)
SELECT f.code,
  count(*) FILTER (f.t > 30 AND f.t - 1 - top.j BETWEEN 4 AND 15 AND top.high / top.foot - 1 >= 0.15::DOUBLE AND after.low >= top.high - 0.5::DOUBLE * (top.high - top.foot)
    AND f.close > top.high AND f.c1 <= top.high AND after.volume < top.pole AND f.total >= 60) AS flag_bull,
  count(*) FILTER (f.t > 20 AND bottom.low / bottom.head - 1 <= -0.2::DOUBLE AND f.close >= bottom.low + 0.5::DOUBLE * (bottom.head - bottom.low) AND f.c1 < bottom.low + 0.5::DOUBLE * (bottom.head - bottom.low)
    AND f.total >= 60) AS v_rebound
FROM f0 f LEFT JOIN top USING (code, t) LEFT JOIN after USING (code, t) LEFT JOIN bottom USING (code, t) GROUP BY 1"""


def _necklines() -> str:
    """Pivots meet the last pivots of the other side in a join; a line's first crossing is a minimum over the bars until the next line."""
    keys = ("hs_top", "inv_hs", "dbl_bottom", "dbl_top", "bull_div", "bear_div", "triple_bottom", "prev_high_brk", "prev_low_brk")
    inner = "CASE side WHEN 1 THEN {0} ELSE {1} END"
    return f"""WITH {BARS}, {MOVING}, {RECURSIVE}, b AS (
    SELECT code, date, close, pc, row_number() OVER (PARTITION BY code ORDER BY date) AS t, count(*) OVER (PARTITION BY code) AS total, {lag('high', 5)} AS h5, {lag('high', 6)} AS h6, {lag('low', 5)} AS l5, {lag('low', 6)} AS l6,
      {lag('rsi', 5)} AS rsi5, {roll('max(high)', 'high', 11)} AS high11, {roll('min(low)', 'low', 11)} AS low11 FROM ind),
  turns AS (SELECT code, t, 1 AS side, t - 5 AS i, h5 AS p, rsi5 AS r FROM b WHERE h5 = high11 AND h5 > h6 UNION ALL SELECT code, t, -1, t - 5, l5, rsi5 FROM b WHERE l5 = low11 AND l5 < l6),
  own AS (SELECT *, {", ".join(f"lag({x}, {n}) OVER one AS {x}{n}" for x in ("i", "p", "r") for n in (1, 2))} FROM turns WINDOW one AS (PARTITION BY code, side ORDER BY t)),
  met AS (SELECT o.*, x.i AS j, x.p AS q, row_number() OVER (PARTITION BY o.code, o.side, o.t ORDER BY x.t DESC) AS back FROM own o JOIN turns x ON x.code = o.code AND x.side = -o.side AND (x.t < o.t OR (x.t = o.t AND o.side = -1))),
  mid AS (SELECT code, side, t, {", ".join(f"{agg}(q) FILTER (back <= {last} AND j > {i} AND j < i) AS {agg}_{i}_{last}" for agg in ("min", "max") for last, i in ((4, "i1"), (4, "i2"), (6, "i2")))} FROM met GROUP BY ALL),
  piv AS (SELECT own.*, {inner.format("min_i1_4", "max_i1_4")} AS mid1, {inner.format("min_i2_4", "max_i2_4")} AS mid2, max_i2_6 FROM own LEFT JOIN mid USING (code, side, t)),
  line AS (
    SELECT code, CASE side WHEN 1 THEN 'dbl_top' ELSE 'dbl_bottom' END AS key, t AS start, t AS since, mid1 AS level, t + 30 AS until, -side AS way FROM piv
      WHERE i - i1 >= 8 AND abs(p / p1 - 1) <= 0.03::DOUBLE AND CASE side WHEN 1 THEN mid1 < least(p, p1) * 0.95::DOUBLE ELSE mid1 > greatest(p, p1) * 1.05::DOUBLE END
    UNION ALL SELECT code, CASE side WHEN 1 THEN 'hs_top' ELSE 'inv_hs' END, t, t, mid2, t + 30, -side FROM piv
      WHERE CASE side WHEN 1 THEN p1 >= greatest(p2, p) * 1.03::DOUBLE ELSE p1 <= least(p2, p) * 0.97::DOUBLE END AND abs(p / p2 - 1) <= 0.06::DOUBLE AND i - i2 <= 90 AND mid2 IS NOT NULL
    UNION ALL SELECT code, 'triple_bottom', t, t, max_i2_6, t + 30, 1 FROM piv WHERE side = -1 AND greatest(p, p1, p2) <= least(p, p1, p2) * 1.04::DOUBLE AND i - i2 BETWEEN 20 AND 120 AND max_i2_6 IS NOT NULL
    UNION ALL SELECT code, CASE side WHEN 1 THEN 'prev_high_brk' ELSE 'prev_low_brk' END, t, i + 10, p, 1000000000, side FROM piv),
  valid AS (SELECT *, least(until, coalesce(lead(start) OVER (PARTITION BY code, key ORDER BY start) - 1, until)) AS stop FROM line),
  crossed AS (SELECT v.code, v.key, v.start, min(b.t) AS t FROM valid v JOIN b ON b.code = v.code AND b.t BETWEEN greatest(v.start, v.since) AND v.stop
      AND CASE v.way WHEN 1 THEN b.close > v.level AND b.pc <= v.level ELSE b.close < v.level AND b.pc >= v.level END
      AND (b.total >= 60 OR v.key NOT IN ('triple_bottom', 'prev_high_brk', 'prev_low_brk')) GROUP BY ALL),
  fired AS (SELECT code, key FROM crossed
    UNION ALL SELECT code, CASE side WHEN 1 THEN 'bear_div' ELSE 'bull_div' END FROM piv WHERE side * (p - p1) > 0 AND side * (r1 - r) > 3 AND i - i1 <= 40)
SELECT code, {", ".join(f"count(*) FILTER (key = '{k}') AS {k}" for k in keys)} FROM (SELECT DISTINCT code, NULL AS key FROM bars UNION ALL SELECT code, key FROM fired) GROUP BY 1"""


_FIGURES = """count(ret) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS win, round(avg(ret), 6) AS mean, round(median(ret), 6) AS median, round(max(ret), 6) AS best, round(min(ret), 6) AS worst,
  round(quantile_cont(ret, 0.05), 6) AS p5, round(sum(ret) FILTER (ret > 0) / sum(-ret) FILTER (ret < 0), 4) AS profit_factor, round(avg(days), 4) AS days"""


def _exits() -> str:
    """A trade's bars are joined on; the first bar that ends it is a minimum."""
    return f"""WITH {BARS}, {MOVING}, {RECURSIVE}, a0 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS t, close / pc - 1 AS ret1, coalesce(ma5 > ma20 AND {lag('ma5')} <= {lag('ma20')}, false) AS up FROM ind),
  a1 AS (SELECT *, {onset('up')} AS ev, {roll('stddev_samp(ret1)', 'ret1', 60, 40)} AS vol, {lead('open', 1)} AS e, {lead('close', 20)} AS final FROM a0),
  s AS (SELECT code, t, e, final, atr_pct, least(greatest(1.5::DOUBLE * vol * sqrt(20::DOUBLE), 0.08::DOUBLE), 0.2::DOUBLE) AS risk, 0.5::DOUBLE * vol * sqrt(20::DOUBLE) AS reach
    FROM a1 WHERE ev AND vol IS NOT NULL AND atr_pct IS NOT NULL AND final IS NOT NULL AND e > 0),
  path AS (SELECT s.*, k, b.open AS o, b.high AS h, b.low AS l, b.close AS c, CASE WHEN k < 20 THEN lead(b.open) OVER (PARTITION BY s.code, s.t ORDER BY k) END AS next
    FROM s CROSS JOIN range(1, 21) r(k) JOIN a1 b ON b.code = s.code AND b.t = s.t + k),
  half AS (SELECT *, min(k) FILTER (h >= e * (1 + reach)) OVER one AS touch, arg_min(o, k) FILTER (h >= e * (1 + reach)) OVER one AS touch_open FROM path WINDOW one AS (PARTITION BY code, t)),
  ends AS (SELECT *, h >= e * (1 + 2 * risk) AS won, c <= CASE WHEN k >= touch THEN e ELSE e * (1 - risk) END AS lost FROM half),
  sums AS (SELECT code, t, any_value(e) AS e, any_value(final) AS final, any_value(risk) AS risk, any_value(reach) AS reach, any_value(atr_pct) AS a, any_value(touch) AS touch, any_value(touch_open) AS touch_open,
      min(k) FILTER (c <= e * (1 - risk)) AS down, min(k) FILTER (h >= e * (1 + 2 * risk)) AS up, min(k) FILTER (won OR lost) AS over,
      min(k) FILTER (l <= e * (1 - 1.5::DOUBLE * atr_pct)) AS stop, min(k) FILTER (h >= e * (1 + 2 * atr_pct)) AS target FROM ends GROUP BY 1, 2),
  hits AS (SELECT x.*, d.next AS down_next, d.c AS down_close, u.o AS up_open, v.o AS over_open, v.next AS over_next, v.c AS over_close, v.won, st.o AS stop_open, ta.o AS target_open FROM sums x
    LEFT JOIN ends d ON d.code = x.code AND d.t = x.t AND d.k = x.down LEFT JOIN ends u ON u.code = x.code AND u.t = x.t AND u.k = x.up LEFT JOIN ends v ON v.code = x.code AND v.t = x.t AND v.k = x.over
    LEFT JOIN ends st ON st.code = x.code AND st.t = x.t AND st.k = x.stop LEFT JOIN ends ta ON ta.code = x.code AND ta.t = x.t AND ta.k = x.target),
  trades AS (
    SELECT 'hold' AS exit, final / e - 1 - 0.0025::DOUBLE AS ret, 20 AS days FROM hits
    UNION ALL SELECT 'volatility', CASE WHEN down < coalesce(up, 99) THEN coalesce(down_next, down_close) WHEN up IS NOT NULL THEN greatest(up_open, e * (1 + 2 * risk)) ELSE final END / e - 1 - 0.0025::DOUBLE,
      CASE WHEN down < coalesce(up, 99) THEN down WHEN up IS NOT NULL THEN up ELSE 20 END FROM hits
    UNION ALL SELECT 'half', CASE WHEN touch <= coalesce(over, 99) THEN 0.5::DOUBLE * (greatest(touch_open, e * (1 + reach)) / e - 1) ELSE 0 END + CASE WHEN touch <= coalesce(over, 99) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END
      * (CASE WHEN over IS NULL THEN final WHEN won THEN greatest(over_open, e * (1 + 2 * risk)) ELSE coalesce(over_next, over_close) END / e - 1) - 0.0025::DOUBLE, NULL FROM hits
    UNION ALL SELECT 'barrier', CASE WHEN stop <= coalesce(target, stop) THEN least(stop_open, e * (1 - 1.5::DOUBLE * a)) WHEN target IS NOT NULL THEN greatest(target_open, e * (1 + 2 * a)) ELSE final END / e - 1 - 0.0025::DOUBLE, NULL FROM hits)
SELECT exit, {_FIGURES} FROM trades GROUP BY 1"""


_GROUPS = {"frg": "BUILDING", "inst": "MACHINERY", "pen": "FURNITURE"}
_MARKET = f"""{FLOWS}, {LISTING}, {_index('')},
  up AS (SELECT date, coalesce(level > CASE WHEN n60 >= 60 THEN m60 END, false) AS up FROM (SELECT date, exp(log_level) AS level, avg(exp(log_level)) OVER w AS m60, count(*) OVER w AS n60 FROM idx WINDOW w AS (ORDER BY date ROWS 59 PRECEDING))),
  nets AS (SELECT code, date, {", ".join(f"sum(net) FILTER (investor = '{g}') AS {k}" for k, g in _GROUPS.items())} FROM flows GROUP BY 1, 2),
  k0 AS (SELECT c.*, frg, inst, pen, up FROM cond c LEFT JOIN nets USING (code, date) LEFT JOIN up USING (date)),
  k1 AS (SELECT *, last_value(up IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS mkt_up, {", ".join(f"{roll(f'sum({k})', k, 5)} AS {k}5" for k in _GROUPS)},
    CASE WHEN ret120 IS NOT NULL THEN round((rank() OVER (PARTITION BY date ORDER BY ret120 NULLS LAST) + (count(ret120) OVER (PARTITION BY date, ret120) - 1) / 2.0::DOUBLE) / count(ret120) OVER (PARTITION BY date), 9) END AS strength FROM k0),
  full27 AS (SELECT *, coalesce(strength >= 0.7::DOUBLE, false) AS f_rs, coalesce(mkt_up, false) AS f_mkt, coalesce(frg5 > 0 AND frg > 0, false) AS f_frg, coalesce(inst5 > 0 AND inst > 0, false) AS f_inst,
    coalesce(pen5 > 0, false) AS f_pen, coalesce(frg > 0 AND inst > 0, false) AS f_dual FROM k1)"""


def _rules() -> str:
    names = [*cond_rules(), "rs", "mkt", "frg", "inst", "pen", "dual"]
    _, bits = _combos(names)
    masks = ", ".join(str(sum(1 << i for i in c)) for k in (1, 2, 3) for c in combinations(range(len(names)), k))
    named = ", ".join(f"CASE WHEN mask & {1 << i} <> 0 THEN '{x}' END" for i, x in enumerate(names))
    before = " AND ".join(f"coalesce(b{n} & mask, 0) <> mask" for n in range(1, 6))
    part = lambda x, f: f"round(avg({x}) FILTER ({f}), 6)"
    gain = "CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""WITH {BARS}, {MOVING}, {RECURSIVE}, {CONDITIONS}, {_MARKET},
  g0 AS (SELECT dense_rank() OVER (ORDER BY code) AS series, date, {bits} AS bits, {", ".join(f"{lag(bits, n)} AS b{n}" for n in range(1, 6))}, row_number() OVER (PARTITION BY code ORDER BY date) AS i, open, high, low, ma120, {lead('open', 1)} AS entry, {lead('close', 20)} AS final, atr_pct FROM full27),
  g1 AS (SELECT *, entry * (1 + 2 * atr_pct) AS tgt, entry * (1 - 1.5::DOUBLE * atr_pct) AS stp FROM g0),
  steps AS (SELECT a.series, a.i, min(k) FILTER (f.low <= a.stp) AS d, min(k) FILTER (f.high >= a.tgt) AS u, arg_min(f.open, k) FILTER (f.low <= a.stp) AS d_open, arg_min(f.open, k) FILTER (f.high >= a.tgt) AS u_open
    FROM g1 a CROSS JOIN range(1, 21) r(k) JOIN g1 f ON f.series = a.series AND f.i = a.i + k GROUP BY 1, 2),
  trade AS (SELECT series, date, bits, b1, b2, b3, b4, b5, u IS NOT NULL AND (d IS NULL OR u < d) AS hit, CASE WHEN i > 130 AND ma120 IS NOT NULL AND tgt IS NOT NULL AND final IS NOT NULL THEN
      CASE WHEN d <= coalesce(u, d) THEN least(d_open, stp) WHEN u IS NOT NULL THEN greatest(u_open, tgt) ELSE final END / entry - 1 - 0.0025::DOUBLE END AS ret FROM g1 LEFT JOIN steps USING (series, i)),
  dated AS (SELECT *, dense_rank() OVER (ORDER BY date) AS d FROM trade WHERE ret IS NOT NULL), parted AS (SELECT bits, b1, b2, b3, b4, b5, ret, hit, d <= floor(0.65::DOUBLE * max(d) OVER ()) AS early FROM dated),
  masks AS (SELECT unnest(CAST([{masks}] AS BIGINT[])) AS mask),
  mined AS (SELECT mask, count(*) AS n, count(*) FILTER (early) AS n_early, count(*) FILTER (NOT early) AS n_late, round(avg({gain}), 6) AS win, round(avg(ret), 6) AS mean, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit,
      {part(gain, 'early')} AS win_early, {part('ret', 'early')} AS mean_early, {part(gain, 'NOT early')} AS win_late, {part('ret', 'NOT early')} AS mean_late, round(avg(ret) - 1.64::DOUBLE * stddev_pop(ret) / sqrt(count(*)), 6) AS score
    FROM parted JOIN masks ON (bits & mask) = mask WHERE {before} GROUP BY mask
    HAVING count(*) FILTER (early) >= 60 AND count(*) FILTER (NOT early) >= 30 AND avg(ret) FILTER (early) > 0 AND avg(ret) FILTER (NOT early) > 0)
SELECT concat_ws('+', {named}) AS rule, mined.* EXCLUDE (mask) FROM mined"""


PATH_SQL = {
    "parabolic_sar": _SAR,
    "flag_counts": _FLAGS,
    "neckline_counts": _necklines(),
    "exit_study": _exits(),
    "market_condition_counts": f"WITH {BARS}, {MOVING}, {RECURSIVE}, {CONDITIONS}, {_MARKET} SELECT code, " + ", ".join(f"count(*) FILTER (f_{k}) AS {k}" for k in ("rs", "mkt", "frg", "inst", "pen", "dual")) + " FROM full27 GROUP BY 1",
    "rule_mining": _rules(),
}
