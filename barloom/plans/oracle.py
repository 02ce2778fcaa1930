"""DuckDB SQL for the market queries, written independently of the Spark plans."""

from __future__ import annotations

BARS = """bars AS (
  SELECT p_brand AS code, CAST(l_shipdate AS DATE) AS date,
    arg_min(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    arg_max(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS close,
    sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY 1, 2)"""
LISTING = """listing AS (
  SELECT p_brand AS code, max(CASE WHEN CAST(right(p_brand, 1) AS INT) % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END) AS market,
    min(p_type) AS theme, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT) * p_size) AS BIGINT) AS marcap
  FROM part GROUP BY 1)"""
FLOWS = """flows AS (
  SELECT p_brand AS code, CAST(l_shipdate AS DATE) AS date, c_mktsegment AS investor,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS net
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2, 3)"""


def roll(agg: str, x: str, n: int, least: int | None = None, shift: int = 0) -> str:
    w = f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) {w} >= {least or n} THEN {agg} {w} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY code ORDER BY date)"


def lead(x: str, n: int) -> str:
    return f"lead({x}, {n}) OVER (PARTITION BY code ORDER BY date)"


def ema(x: str, a: str) -> str:
    so_far = "OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN {x} IS NOT NULL THEN pow(1 - {a}, t_{x}) * sum(CASE WHEN t_{x} = 0 THEN 1.0 ELSE {a} END * {x} * pow(1 - {a}, -t_{x})) {so_far} END"


def since(x: str) -> str:
    return f"count({x}) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS t_{x}"


def horizon(h: int, cost: float = 0.0025) -> str:
    return f"{lead('close', h)} / {lead('open', 1)} - 1 - {cost}"


def stats(by: str) -> str:
    return f"""SELECT {by}, count(ret) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(ret), 6) AS mean_ret,
  round(avg(ret) - 1.64 * stddev_pop(ret) / sqrt(count(ret)), 6) AS lower_bound,
  round(sum(ret) FILTER (ret > 0) / sum(-ret) FILTER (ret < 0), 4) AS profit_factor"""


def onset(f: str) -> str:
    return f"{f} AND coalesce(max(CAST({f} AS INT)) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) = 0"


MOVING = f"""m0 AS (SELECT *, {", ".join(f"{roll('avg(close)', 'close', n)} AS ma{n}" for n in (5, 20, 60, 120))},
    {roll('stddev_samp(close)', 'close', 20)} AS sd, {roll('min(low)', 'low', 14)} AS ll, {roll('max(high)', 'high', 14)} AS hh,
    {roll('avg(volume)', 'volume', 20)} AS vol_ma20, {roll('max(high)', 'high', 20, None, 1)} AS hh20_prev, {roll('max(close)', 'close', 252, 120)} AS hh252,
    close / {lag('close', 60)} - 1 AS ret60, close / {lag('close', 120)} - 1 AS ret120, coalesce(sign(close - {lag('close')}), 0) * volume AS signed,
    {lag('close')} AS pc FROM bars),
  m1 AS (SELECT *, ma60 / {lag('ma60', 5)} - 1 AS ma60_slope, ma20 + 2 * sd AS bb_upper, ma20 - 2 * sd AS bb_lower,
    100 * (close - ll) / nullif(hh - ll, 0) AS fast, sum(signed) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv FROM m0),
  m2 AS (SELECT *, (bb_upper - bb_lower) / ma20 AS bb_width, {roll('avg(fast)', 'fast', 3)} AS sto_k FROM m1),
  moving AS (SELECT *, {roll('avg(sto_k)', 'sto_k', 3)} AS sto_d FROM m2)"""
RECURSIVE = f"""r0 AS (SELECT *, close - pc AS delta, {lag('high')} AS ph, {lag('low')} AS pl FROM moving),
  r1 AS (SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END AS gain, CASE WHEN delta IS NOT NULL THEN greatest(-delta, 0) END AS loss,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS plus, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS minus FROM r0),
  r2 AS (SELECT *, {", ".join(since(x) for x in ("gain", "loss", "tr", "close", "plus", "minus"))} FROM r1),
  r3 AS (SELECT *, {ema('gain', '(1/14.0::DOUBLE)')} AS eg, {ema('loss', '(1/14.0::DOUBLE)')} AS el, {ema('tr', '(1/14.0::DOUBLE)')} AS atr, {ema('close', '(2/13.0::DOUBLE)')} AS e12,
    {ema('close', '(2/27.0::DOUBLE)')} AS e26, {ema('plus', '(1/14.0::DOUBLE)')} AS ep, {ema('minus', '(1/14.0::DOUBLE)')} AS em FROM r2),
  r4 AS (SELECT *, 100 - 100 / (1 + eg / nullif(el, 0)) AS rsi, e12 - e26 AS macd, atr / close AS atr_pct, 100 * ep / nullif(atr, 0) AS pdi, 100 * em / nullif(atr, 0) AS mdi FROM r3),
  r5 AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM r4),
  r6 AS (SELECT *, {since('macd')}, {since('dx')} FROM r5),
  r7 AS (SELECT *, {ema('macd', '0.2::DOUBLE')} AS macd_signal, {ema('dx', '(1/14.0::DOUBLE)')} AS adx FROM r6),
  ind AS (SELECT *, macd - macd_signal AS macd_hist FROM r7)"""


def cond_rules() -> dict[str, str]:
    up = lambda x, y: f"{x} > {y} AND p_{x} <= p_{y}"
    return {
        "align": "ma5 > ma20 AND ma20 > ma60 AND ma60 > ma120",
        "ma60up": "close > ma60 AND ma60_slope > 0",
        "ma20_60": "ma20 > ma60",
        "ma120": "close > ma120",
        "adx_up": "adx > 25 AND pdi > mdi",
        "mom3m": "ret60 > 0.10",
        "hi52": "close >= 0.95::DOUBLE * hh252",
        "brk20": "close > hh20_prev",
        "sqz": "tight5 = 1 AND close > bb_upper",
        "rsi_pb": "rsi BETWEEN 40 AND 55",
        "near20": "close / ma20 - 1 BETWEEN -0.03 AND 0.02",
        "rsi_os": "rsi < 30",
        "sto": up("sto_k", "sto_d") + " AND p_sto_k < 25",
        "bb_rev": "low < bb_lower AND close > bb_lower",
        "gc": up("ma5", "ma20"),
        "macd_x": up("macd", "macd_signal"),
        "macd_h": "macd_hist < 0 AND macd_hist > p_macd_hist AND p_macd_hist > p2_macd_hist",
        "vol": "volume > 2 * vol_ma20 AND close > open AND close > pc",
        "obv_hi": "obv >= obv20",
        "bigc": "(close - open) / nullif(open, 0) > 0.03 AND high - close < (close - open) * 0.3::DOUBLE",
        "up3": "close > pc AND pc > p2_close AND p2_close > p3_close",
    }


_PREV = ", ".join(f"{lag(x)} AS p_{x}" for x in ("sto_k", "sto_d", "ma5", "ma20", "macd", "macd_signal", "macd_hist"))
CONDITIONS = f"""c0 AS (SELECT *, coalesce(bb_width <= {roll('quantile_cont(bb_width, 0.2)', 'bb_width', 120)}, false)::INT AS tight, {_PREV},
    {lag('macd_hist', 2)} AS p2_macd_hist, {lag('close', 2)} AS p2_close, {lag('close', 3)} AS p3_close, {roll('max(obv)', 'obv', 20)} AS obv20 FROM ind),
  c1 AS (SELECT *, {roll('max(tight)', 'tight', 5)} AS tight5 FROM c0),
  cond AS (SELECT *, {", ".join(f"coalesce({v}, false) AS f_{k}" for k, v in cond_rules().items())} FROM c1)"""


def candle_rules() -> dict[str, str]:
    p = lambda x, n=1: f"b{n}_{x}"
    streak = lambda op: " AND ".join(f"{'close' if i == 0 else p('close', i)} {op} {p('close', i + 1)}" for i in range(5))
    bar = lambda n: (lambda x: x if n == 0 else p(x, n))
    three = lambda op: " AND ".join(f"{bar(n)('close')} {op} {bar(n)('open')} AND abs({bar(n)('close')} - {bar(n)('open')}) >= 0.3 * {bar(n)('atr')} AND {bar(n)('close')} {op} {p('close', n + 1)}" for n in range(3))
    down = lambda x, y: f"{x} < {y} AND {p(x)} >= {p(y)}"
    up = lambda x, y: f"{x} > {y} AND {p(x)} <= {p(y)}"
    return {
        "vol_bull": f"up AND big AND vr >= 2 AND close > {p('close')} AND ut <= 0.5 * body",
        "vol_bear": f"dn AND big AND vr >= 2 AND close < {p('close')}",
        "hammer": "lt >= 2 * body AND ut <= 0.3 * span AND r5 < -0.03 AND low <= low10",
        "shooting": "ut >= 2 * body AND lt <= 0.3 * span AND r5 > 0.03 AND high >= high10",
        "bull_engulf": f"up AND {p('dn')} AND close >= {p('open')} AND open <= {p('close')} AND r5 < 0",
        "bear_engulf": f"dn AND {p('up')} AND close <= {p('open')} AND open >= {p('close')} AND r5 > 0",
        "morning_star": f"b2_close < b2_open AND b2_open - b2_close >= 0.6 * atr AND abs(b1_close - b1_open) <= 0.3 * abs(b2_open - b2_close) AND close > open AND close >= (b2_open + b2_close) / 2",
        "evening_star": f"b2_close > b2_open AND b2_close - b2_open >= 0.6 * atr AND abs(b1_close - b1_open) <= 0.3 * abs(b2_open - b2_close) AND close < open AND close <= (b2_open + b2_close) / 2",
        "three_white": three(">"),
        "three_black": three("<"),
        "gap_up": f"low > {p('high')}",
        "gap_down": f"high < {p('low')}",
        "doji_top": "body <= 0.1 * span AND r5 > 0.05 AND high >= high20",
        "harami_bull": "b1_close < b1_open AND b1_open - b1_close >= 0.8 * atr AND close > open AND close <= b1_open AND open >= b1_close AND close - open <= 0.5 * (b1_open - b1_close) AND r5 < -0.03",
        "harami_bear": "b1_close > b1_open AND b1_close - b1_open >= 0.8 * atr AND close < open AND open <= b1_close AND close >= b1_open AND open - close <= 0.5 * (b1_close - b1_open) AND r5 > 0.03",
        "piercing": "b1_close < b1_open AND b1_open - b1_close >= 0.8 * atr AND close > open AND open < b1_close AND close > (b1_open + b1_close) / 2 AND close < b1_open",
        "dark_cloud": "b1_close > b1_open AND b1_close - b1_open >= 0.8 * atr AND close < open AND open > b1_close AND close < (b1_open + b1_close) / 2 AND close > b1_open",
        "upper_tail": "ut >= 0.55 * span AND span >= 1.2 * atr",
        "lower_tail": "lt >= 0.55 * span AND span >= 1.2 * atr",
        "up_streak": streak(">"),
        "dn_streak": streak("<"),
        "ma20_up": up("close", "ma20") + " AND vr >= 1.5",
        "ma20_dn": down("close", "ma20"),
        "ma60_up": up("close", "ma60"),
        "ma60_dn": down("close", "ma60"),
        "gc_long": up("ma20", "ma60"),
        "dc_long": down("ma20", "ma60"),
        "hi52_brk": "close > p52h",
        "lo52_brk": "close < p52l",
        "overheat": "close > 1.15 * ma20",
        "oversold": "close < 0.88 * ma20",
        "bb_up": up("close", "bb_upper"),
        "bb_dn": down("close", "bb_lower"),
        "env_low": "low <= 0.8 * ma20",
        "half_off": "close <= 0.5 * high250",
        "box_up": f"bh / bl - 1 <= 0.25 AND close > bh AND {p('close')} <= bh AND vr >= 1.5",
        "box_dn": f"bh / bl - 1 <= 0.25 AND close < bl AND {p('close')} >= bl",
        "vol_dry": "vol5 < 0.5 * vol60",
        "ma_conv": "(greatest(ma5, ma20, ma60) - least(ma5, ma20, ma60)) / close <= 0.03",
        "pivot_hi": f"{p('high', 5)} = high11 AND {p('high', 5)} > {p('high', 6)}",
        "pivot_lo": f"{p('low', 5)} = low11 AND {p('low', 5)} < {p('low', 6)}",
    }


def _doubles(sql: str) -> str:
    """Decimal literals as doubles, as Spark's Python literals are."""
    import re

    return re.sub(r"(?<![\w.])(\d+\.\d+)(?!::)(?![\w.])", r"\1::DOUBLE", sql)


_BACK = {1: "open high low close up dn big body mid atr ma20 ma60 bb_upper bb_lower", 2: "open close up dn big body mid atr", 3: "close", 4: "close", 5: "close high low", 6: "high low"}
CANDLES = f"""k0 AS (SELECT *, abs(close - open) AS body, close > open AS up, close < open AS dn, high - greatest(close, open) AS ut, least(close, open) - low AS lt, nullif(high - low, 0) AS span,
    volume / nullif(vol_ma20, 0) AS vr, close / {lag('close', 5)} - 1 AS r5, (open + close) / 2 AS mid, {roll('max(close)', 'close', 252, 200, 1)} AS p52h, {roll('min(close)', 'close', 252, 200, 1)} AS p52l,
    {roll('max(high)', 'high', 60, None, 1)} AS bh, {roll('min(low)', 'low', 60, None, 1)} AS bl, {roll('min(low)', 'low', 10)} AS low10, {roll('max(high)', 'high', 10)} AS high10,
    {roll('max(high)', 'high', 20)} AS high20, {roll('max(high)', 'high', 250, 120)} AS high250, {roll('max(high)', 'high', 11)} AS high11, {roll('min(low)', 'low', 11)} AS low11,
    {roll('avg(volume)', 'volume', 5)} AS vol5, {roll('avg(volume)', 'volume', 60)} AS vol60 FROM ind),
  k1 AS (SELECT *, coalesce(body >= 0.6::DOUBLE * atr, false) AS big FROM k0),
  k2 AS (SELECT *, {", ".join(f"{lag(x, n)} AS b{n}_{x}" for n, xs in _BACK.items() for x in xs.split())} FROM k1),
  candle AS (SELECT *, {", ".join(f"coalesce({_doubles(v)}, false) AS f_{k}" for k, v in candle_rules().items())} FROM k2)"""


OSCILLATORS = ["ma10", "ma240", "conversion", "base", "span_a", "span_b", "cloud_top", "cloud_bottom", "cci", "mfi", "wr", "vwap120"]


def _oscillators(source: str) -> str:
    mid = lambda n: f"({roll('max(high)', 'high', n)} + {roll('min(low)', 'low', n)}) / 2"
    return f"""o0 AS (SELECT *, {roll('avg(close)', 'close', 10)} AS ma10, {roll('avg(close)', 'close', 240)} AS ma240, {mid(9)} AS conversion, {mid(26)} AS base, {mid(52)} AS span_b,
    (high + low + close) / 3 AS tp, close * volume AS cv, {roll('max(high)', 'high', 14)} AS h14, {roll('min(low)', 'low', 14)} AS l14 FROM {source}),
  o1 AS (SELECT *, (conversion + base) / 2 AS span_a, {roll('avg(tp)', 'tp', 20)} AS tpm, {lag('tp')} AS tpb FROM o0),
  o2 AS (SELECT *, abs(tp - tpm) AS dev, CASE WHEN tp > tpb THEN tp * volume ELSE 0.0 END AS pos, CASE WHEN tp < tpb THEN tp * volume ELSE 0.0 END AS neg, {lag('span_a', 26)} AS ca, {lag('span_b', 26)} AS cb FROM o1),
  osc AS (SELECT *, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN greatest(ca, cb) END AS cloud_top, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN least(ca, cb) END AS cloud_bottom,
    (tp - tpm) / nullif(0.015::DOUBLE * ({roll('avg(dev)', 'dev', 20)}), 0) AS cci, 100 - 100 / (1 + ({roll('sum(pos)', 'pos', 14)}) / nullif({roll('sum(neg)', 'neg', 14)}, 0)) AS mfi,
    -100 * (h14 - close) / nullif(h14 - l14, 0) AS wr, ({roll('sum(cv)', 'cv', 120)}) / nullif({roll('sum(volume)', 'volume', 120)}, 0) AS vwap120 FROM o2)"""


def oscillator_rules() -> dict[str, str]:
    up = lambda x, y: f"{x} > {y} AND y_{x} <= y_{y}"
    down = lambda x, y: f"{x} < {y} AND y_{x} >= y_{y}"
    over = lambda x, n: f"{x} > {n} AND y_{x} <= {n}"
    under = lambda x, n: f"{x} < {n} AND y_{x} >= {n}"
    return {
        "sto_gc": up("sto_k", "sto_d") + " AND y_sto_k <= 20", "sto_dc": down("sto_k", "sto_d") + " AND y_sto_k >= 80", "macd_zero_up": over("macd", 0), "macd_zero_dn": under("macd", 0),
        "rsi_os_exit": over("rsi", 30), "rsi_ob_exit": under("rsi", 70), "rsi50_up": over("rsi", 50), "cci_up": over("cci", -100), "cci_dn": under("cci", 100), "mfi_os": "mfi <= 20", "mfi_ob": "mfi >= 80",
        "wr_os_exit": over("wr", -80), "dmi_gc": up("pdi", "mdi") + " AND adx >= 20", "dmi_dc": down("pdi", "mdi") + " AND adx >= 20", "adx25_up": over("adx", 25) + " AND pdi > mdi", "adx25_dn": over("adx", 25) + " AND pdi < mdi",
        "bb_rebound": "y_close < y_bb_lower AND close > bb_lower", "ichi_cloud_up": up("close", "cloud_top"), "ichi_cloud_dn": down("close", "cloud_bottom"), "ichi_tk_gc": up("conversion", "base"),
        "ichi_tk_dc": down("conversion", "base"), "ichi_chikou": "close > c26 AND y_close <= c27", "ichi_twist": up("span_a", "span_b"), "vwap_up": up("close", "vwap120"), "vwap_dn": down("close", "vwap120"),
    }


_BEFORE = ", ".join(f"{lag(x)} AS y_{x}" for x in "sto_k sto_d macd rsi cci wr pdi mdi adx close bb_lower cloud_top cloud_bottom conversion base span_a span_b vwap120".split())


def _resample(unit: str) -> str:
    return f"res AS (SELECT code, CAST(date_trunc('{unit}', date) AS DATE) AS period, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)"


def _index(by: str) -> str:
    extra, part = (f", {by}", f"PARTITION BY {by}") if by else ("", "")
    return f"""x0 AS (SELECT *, close / {lag('close')} - 1 AS ret FROM bars),
  x1 AS (SELECT date{extra}, sum(ret * marcap) / sum(marcap) AS ret, count(*) AS n FROM x0 JOIN listing USING (code) WHERE ret IS NOT NULL GROUP BY ALL),
  idx AS (SELECT date{extra}, round(ret, 6) AS ret, n, round(sum(ln(1 + ret)) OVER ({part} ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS log_level FROM x1)"""


_BREADTH = f"""w0 AS (SELECT *, {roll('avg(close)', 'close', 20)} AS ma20, close - {lag('close')} AS chg FROM bars),
  breadth AS (SELECT date, count(*) FILTER (chg > 0) AS n_up, count(*) FILTER (chg < 0) AS n_down, count(*) FILTER (chg = 0) AS n_flat,
    round(avg(CASE WHEN ma20 IS NOT NULL THEN CASE WHEN close > ma20 THEN 1.0 ELSE 0.0 END END), 6) AS above_ma20 FROM w0 GROUP BY 1)"""
_COMBO = ["align", "ma60up", "ma120", "mom3m", "hi52", "brk20", "near20", "gc", "vol", "bigc", "up3", "bb_rev"]
_TICK = "CASE WHEN p < 2000 THEN 1 WHEN p < 5000 THEN 5 WHEN p < 20000 THEN 10 WHEN p < 50000 THEN 50 WHEN p < 200000 THEN 100 WHEN p < 500000 THEN 500 ELSE 1000 END"


_SPLIT = """days AS (SELECT DISTINCT date FROM (SELECT date, {ret} AS ret FROM bars) WHERE abs(ret) <= 3),
  split AS (SELECT date AS split FROM (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM days) WHERE i = floor(n * 0.65::DOUBLE) + 1)"""


def _combos(names: list[str]) -> tuple[str, str]:
    """Values (combination, bit mask) of one to three names, and the bits of a row."""
    from itertools import combinations

    rows = ", ".join(f"('{'+'.join(c)}', {sum(1 << names.index(x) for x in c)})" for k in (1, 2, 3) for c in combinations(names, k))
    return rows, " + ".join(f"CASE WHEN f_{x} THEN {1 << i} ELSE 0 END" for i, x in enumerate(names))


def _combo_sql() -> str:
    rows, bits = _combos(_COMBO)
    return f"""WITH {BARS}, {MOVING}, {RECURSIVE}, {CONDITIONS}, {_SPLIT.format(ret=horizon(20))}, b AS (SELECT date, {bits} AS bits, {horizon(20)} AS ret FROM cond), combos(combo, mask) AS (VALUES {rows})
SELECT combo, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(avg(ret) - 1.64 * stddev_pop(ret) / sqrt(count(*)), 6) AS lower_bound,
  round(avg(ret) FILTER (date < split), 6) AS early_mean, round(avg(ret) FILTER (date >= split), 6) AS late_mean
FROM b JOIN combos ON (bits & mask) = mask CROSS JOIN split WHERE abs(ret) <= 3 GROUP BY combo HAVING count(*) >= 60"""


def _combo_all_sql() -> str:
    rows, bits = _combos(list(cond_rules()))
    before = " AND ".join(f"coalesce(b{n} & mask, 0) <> mask" for n in range(1, 6))
    return f"""WITH {BARS}, {MOVING}, {RECURSIVE}, {CONDITIONS}, {_SPLIT.format(ret=horizon(20))}, b0 AS (SELECT code, date, {bits} AS bits, {horizon(20)} AS ret FROM cond),
  b AS (SELECT *, {", ".join(f"{lag('bits', n)} AS b{n}" for n in range(1, 6))} FROM b0), combos(combo, mask) AS (VALUES {rows})
SELECT combo, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(avg(ret) - 1.64 * stddev_pop(ret) / sqrt(count(*)), 6) AS lower_bound,
  count(*) FILTER (date < split) AS n_early, round(avg(ret) FILTER (date < split), 6) AS early_mean, count(*) FILTER (date >= split) AS n_late, round(avg(ret) FILTER (date >= split), 6) AS late_mean
FROM b JOIN combos ON (bits & mask) = mask CROSS JOIN split WHERE abs(ret) <= 3 AND {before} GROUP BY combo HAVING count(*) FILTER (date < split) >= 60 AND count(*) FILTER (date >= split) >= 30"""


def _setups_sql() -> str:
    keys = ("dip", "rsi2", "pull", "high52", "flow", "base")
    rules = {
        "dip": "large AND close <= 0.88::DOUBLE * ma20",
        "rsi2": "close > ma200 AND 100 - 100 / (1 + eg / nullif(el, 0)) < 10",
        "pull": "ma20 > ma60 AND kb10 AND NOT kb AND close < ma5 AND close > kb_open AND volume < kb_vol / 3",
        "high52": "close > top AND amt >= 1.5::DOUBLE * y_amt20 AND body > 0",
        "flow": "pair5 >= 4 AND close > ma20",
        "base": "substr(md5(code || '|' || strftime(date, '%Y-%m-%d')), 1, 3) < '19a'",
    }
    near = "(PARTITION BY code ORDER BY date ROWS 9 PRECEDING)"
    events_ = " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS key, year(date) AS year, ret, {onset('s_' + k)} AS ev FROM flagged) WHERE ev" for k in keys)
    means = ", ".join(f"{roll('avg(close)', 'close', n)} AS ma{n}" for n in (5, 20, 60, 200))
    return f"""WITH {BARS}, {LISTING}, {FLOWS}, sizes AS (SELECT code, percent_rank() OVER (ORDER BY marcap) >= 0.5 AS large FROM listing),
  nets AS (SELECT code, date, sum(net) FILTER (investor = 'BUILDING') AS net_a, sum(net) FILTER (investor = 'MACHINERY') AS net_b FROM flows GROUP BY 1, 2),
  s0 AS (SELECT *, close * volume AS amt, close / {lag('close')} - 1 AS ret1, (close - open) / nullif(open, 0) AS body, close - {lag('close')} AS d, {means}, {roll('avg(volume)', 'volume', 20, 15)} AS vol20,
    {roll('max(high)', 'high', 250, 200, 1)} AS top, {horizon(10, 0.003)} AS r10 FROM bars JOIN sizes USING (code) LEFT JOIN nets USING (code, date)),
  s1 AS (SELECT *, greatest(d, 0) + CASE WHEN d IS NULL THEN NULL ELSE 0 END AS gain, greatest(-d, 0) + CASE WHEN d IS NULL THEN NULL ELSE 0 END AS loss, {roll('avg(amt)', 'amt', 20, 15)} AS amt20,
    coalesce(ret1 >= 0.07 AND body >= 0.05 AND volume >= 3 * {lag('vol20')}, false) AS kb, CASE WHEN net_a IS NOT NULL THEN (net_a > 0 AND coalesce(net_b > 0, false))::INT END AS pair FROM s0),
  s2 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM s1),
  avgs AS (SELECT a.code, a.date, sum(w * f.gain) AS eg, sum(w * f.loss) AS el FROM (SELECT code, date, i FROM s2) a JOIN s2 f ON f.code = a.code AND f.i BETWEEN greatest(a.i - 90, 2) AND a.i
    CROSS JOIN LATERAL (SELECT CASE WHEN f.i = 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * pow(0.5::DOUBLE, a.i - f.i) AS w) GROUP BY 1, 2),
  s3 AS (SELECT s2.*, eg, el, {lag('amt20')} AS y_amt20, bool_or(kb) OVER {near} AS kb10, last_value(CASE WHEN kb THEN open END IGNORE NULLS) OVER {near} AS kb_open,
    last_value(CASE WHEN kb THEN volume END IGNORE NULLS) OVER {near} AS kb_vol, {roll('sum(pair)', 'pair', 5)} AS pair5,
    CASE WHEN amt20 IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY amt20 NULLS LAST) + (count(amt20) OVER (PARTITION BY date, amt20) - 1) / 2.0::DOUBLE) / count(amt20) OVER (PARTITION BY date) END > 0.2::DOUBLE AS liq
    FROM s2 LEFT JOIN avgs USING (code, date)),
  flagged AS (SELECT code, date, CASE WHEN abs(r10) <= 3 THEN r10 END AS ret, {", ".join(f"coalesce(liq AND {v}, false) AS s_{k}" for k, v in rules.items())} FROM s3), e AS ({events_})
{stats('key, year')} FROM e WHERE ret IS NOT NULL GROUP BY key, year"""


def _study_sql() -> str:
    keys = [("f_" + k, k) for k in candle_rules()] + [("w_" + k, k) for k in window_rules()]
    listed = ", ".join(f"CASE WHEN {f} THEN '{k}' END" for f, k in keys)
    flags = ", ".join(f for f, _ in keys)
    figures = ", ".join(
        f"count(r{h}) AS n{h}, round(CASE WHEN count(r{h}) >= 30 OR key = '_base' THEN avg(r{h}) END, 5) AS mean{h}, round(CASE WHEN count(r{h}) >= 30 AND key <> '_base' THEN avg(x{h}) END, 5) AS excess{h}, "
        f"round(CASE WHEN count(r{h}) >= 30 OR key = '_base' THEN avg(CASE WHEN r{h} > 0 THEN 1.0::DOUBLE WHEN r{h} IS NOT NULL THEN 0.0::DOUBLE END) END, 5) AS win{h}"
        for h in (5, 20)
    )
    source = _windows().replace("FROM ind)", "FROM candle)", 1)
    return f"""WITH {BARS}, {LISTING}, {MOVING}, {RECURSIVE}, {CANDLES}, {source}, third AS (SELECT code, CASE ntile(3) OVER (ORDER BY marcap DESC, code) WHEN 1 THEN 'L' WHEN 2 THEN 'M' ELSE 'S' END AS size FROM listing),
  q AS (SELECT code, date, rn, total, {flags}, {horizon(5)} AS q5, {horizon(20)} AS q20 FROM windowed),
  h AS (SELECT *, CASE WHEN rn > 130 AND total >= 160 AND abs(q5) <= 3 THEN q5 END AS r5, CASE WHEN rn > 130 AND total >= 160 AND abs(q20) <= 3 THEN q20 END AS r20 FROM q),
  x AS (SELECT *, r5 - avg(r5) OVER (PARTITION BY date) AS x5, r20 - avg(r20) OVER (PARTITION BY date) AS x20 FROM h),
  long AS (SELECT code, rn, unnest(list_filter([{listed}], lambda k: k IS NOT NULL)) AS key FROM x),
  first AS (SELECT *, lag(rn) OVER (PARTITION BY code, key ORDER BY rn) AS last FROM long),
  e AS (SELECT code, rn, key FROM first WHERE last IS NULL OR rn - last > 5 UNION ALL SELECT code, rn, '_base' FROM x)
SELECT key, size, count(*) AS n, {figures} FROM e JOIN x USING (code, rn) JOIN third USING (code) WHERE rn > 130 AND total >= 160 GROUP BY GROUPING SETS ((key), (key, size))"""


def _moved(x: str, a: int, b: int) -> str:
    """Frame of rows from a to b before the current one."""
    return f"(PARTITION BY code ORDER BY date ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"


def window_rules() -> dict[str, str]:
    up = lambda x, y: f"{x} > {y} AND y_{x} <= y_{y}"
    down = lambda x, y: f"{x} < {y} AND y_{x} >= y_{y}"
    support = lambda m, k, n: f"y_close > y_{m} AND low <= {m} * {k} AND close >= {m} AND {m} > y{n}_{m}"
    reject = lambda m: f"y_close < y_{m} AND high >= {m} * 0.995 AND close < {m} AND {m} < y3_{m}"
    inner = "high3 <= y4_high AND low3 >= y4_low AND body3 <= 0.6 * abs(y4_close - y4_open) AND abs(close - open) >= 0.8 * atr"
    swing = "whole AND "
    return {
        **{f"{m}_{k}": f(m) for m in ("ma5", "ma20", "ma60") for k, f in (("sup", lambda m: support(m, "1.005", 3)), ("rej", reject))},
        "gc": up("ma5", "ma20"),
        "dc": down("ma5", "ma20"),
        "align_on": "rising AND NOT coalesce(y_rising, false)",
        "align_off": "falling AND NOT coalesce(y_falling, false)",
        "pullback": "ma20 > ma60 AND ma60 > y5_ma60 AND close / y40_close - 1 > 0.05 AND close / ma20 - 1 BETWEEN -0.02 AND 0.025 AND v5 < 0.8 * vol_ma20 AND close < c10 * 0.97",
        "squeeze": "tight10",
        "rsi_os": "rsi < 30",
        "rsi_ob": "rsi > 70",
        "macd_gc": up("macd", "macd_signal"),
        "macd_dc": down("macd", "macd_signal"),
        "obv_lead": "obv >= obv60 AND close < c60 * 0.97",
        "inv_hammer": "abs(close - open) <= 0.35 * rng AND high - greatest(open, close) >= 2 * abs(close - open) AND least(open, close) - low <= 0.15 * rng AND close / y5_close - 1 < -0.04 AND low <= l10",
        "hanging": "abs(close - open) <= 0.35 * rng AND least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= 0.15 * rng AND close / y5_close - 1 > 0.05 AND high >= h10",
        "rising3": f"y4_close - y4_open >= 0.8 * y4_atr AND {inner} AND close > open AND close > y4_close",
        "falling3": f"y4_open - y4_close >= 0.8 * y4_atr AND {inner} AND close < open AND close < y4_close",
        "bear_recover": "close > bear AND y_close <= bear",
        "limit_up": "limited",
        "limit_dn": "close / y_close - 1 <= -lim",
        "limit_up_pull": "low <= lmid * 1.01 AND close >= lmid AND y_low > lmid * 1.01",
        "ma10_sup": support("ma10", "1.005", 3),
        **{f"{m}_{k}": f for m in ("ma120", "ma240") for k, f in (("up", up("close", m)), ("dn", down("close", m)), ("sup", support(m, "1.01", 5)))},
        "gc_120": up("ma60", "ma120"),
        "dc_120": down("ma60", "ma120"),
        "ma20_turn": "ma20 > y_ma20 AND falls = 10",
        "ma_conv_up": "converged5 AND close > 1.02 * top3 AND y_close <= 1.02 * y_top3 AND volume / nullif(y_vol_ma20, 0) >= 1.5",
        "env_high": "close > 1.2 * ma20 AND y_close <= 1.2 * y_ma20",
        "vol_max_up": "volume >= v250 AND close > open",
        "vol_bottom_brk": "quiet10 AND volume / nullif(y_vol_ma20, 0) >= 3 AND close > open AND close / y_close - 1 > 0.03",
        "squeeze_brk": f"tight5 AND {up('close', 'bb_upper')}",
        "ath": "rn > 250 AND close > top",
        "price_corr": swing + "peak_high / peak_low - 1 >= 0.2 AND close / peak_high - 1 <= -0.15 AND days BETWEEN 3 AND 40",
        "time_corr": swing + "peak_high / peak_low - 1 >= 0.2 AND days BETWEEN 15 AND 80 AND peak_high / after_low - 1 <= 0.15",
        "fib_zone": swing + "peak_high / peak_low - 1 >= 0.25 AND (peak_high - close) / nullif(peak_high - peak_low, 0) BETWEEN 0.45 AND 0.66 AND days >= 3",
        "near_high": swing + "days >= 10 AND close / peak_high - 1 >= -0.03 AND close / peak_high - 1 < 0 AND after_low / peak_high - 1 <= -0.08",
        "fib_bounce": swing + "peak_high / peak_low - 1 >= 0.2 AND (peak_high - close) / nullif(peak_high - peak_low, 0) BETWEEN 0.382 AND 0.618 AND days >= 5 AND close > open AND close > y_close AND close - open >= 0.5 * (high - low)",
        "island_bot": "isl_bot",
        "island_top": "isl_top",
    }


def _windows() -> str:
    back = {1: "close low ma5 ma20 ma60 ma10 ma120 ma240 macd macd_signal bb_upper rising falling vol_ma20 top3 v5 v60q", 3: "ma5 ma20 ma60 ma10", 4: "open high low close atr", 5: "close ma60 ma120 ma240", 40: "close"}
    lags = ", ".join(f"{lag(x, n)} AS y{'' if n == 1 else n}_{x}" for n, xs in back.items() for x in xs.split())
    return _doubles(f"""n0 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS rn, count(*) OVER (PARTITION BY code) AS total, {roll('avg(close)', 'close', 10)} AS ma10, {roll('avg(close)', 'close', 240)} AS ma240,
    nullif(high - low, 0) AS rng, greatest(ma5, ma20, ma60) AS top3, coalesce((greatest(ma5, ma20, ma60) - least(ma5, ma20, ma60)) / close <= 0.03, false) AS converged,
    coalesce(ma5 > ma20 AND ma20 > ma60 AND ma60 > ma120, false) AS rising, coalesce(ma5 < ma20 AND ma20 < ma60 AND ma60 < ma120, false) AS falling,
    {roll('avg(volume)', 'volume', 5)} AS v5, {roll('quantile_cont(volume, 0.15)', 'volume', 60)} AS v60q, {roll('max(volume)', 'volume', 250, 120)} AS v250,
    {roll('max(close)', 'close', 10)} AS c10, {roll('max(close)', 'close', 60)} AS c60, {roll('max(obv)', 'obv', 60)} AS obv60, {roll('min(low)', 'low', 10)} AS l10, {roll('max(high)', 'high', 10)} AS h10,
    {roll('max(high)', 'high', 3, None, 1)} AS high3, {roll('min(low)', 'low', 3, None, 1)} AS low3, coalesce(bb_width <= {roll('quantile_cont(bb_width, 0.1)', 'bb_width', 120, 60)}, false) AS tight10,
    {roll('min(low)', 'low', 120, 20)} AS least120, max(high) OVER {_moved('high', 119, 0).replace('0 PRECEDING', 'CURRENT ROW')} AS peak_high,
    max(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, abs(close - open) AS body, close < open AND abs(close - open) >= 1.2 * atr AS bearish FROM ind),
  n1 AS (SELECT *, {lags}, {roll('max(body)', 'body', 3, None, 1)} AS body3, CASE WHEN date < DATE '2015-06-15' THEN 0.145 ELSE 0.295 END AS lim,
    last_value(CASE WHEN bearish THEN open END IGNORE NULLS) OVER {_moved('', 6, 1)} AS bear, bool_or(converged) OVER {_moved('', 5, 1)} AS converged5, bool_or(tight10) OVER {_moved('', 5, 1)} AS tight5 FROM n0),
  n2 AS (SELECT *, coalesce(close / y_close - 1 >= lim, false) AS limited, coalesce(y_v5 <= y_v60q, false) AS quiet, coalesce(ma20 < y_ma20, false)::INT AS fell FROM n1),
  n3 AS (SELECT *, last_value(CASE WHEN limited THEN (open + close) / 2 END IGNORE NULLS) OVER {_moved('', 11, 1)} AS lmid, sum(fell) OVER {_moved('', 10, 1)} AS falls,
    bool_or(quiet) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS quiet10, total >= 240 AND rn >= 120 AS whole FROM n2),
  p0 AS (SELECT a.code, a.rn, max(f.rn) AS peak FROM n3 a JOIN n3 f ON f.code = a.code AND f.rn BETWEEN a.rn - 119 AND a.rn AND f.high = a.peak_high GROUP BY 1, 2),
  p1 AS (SELECT p0.code, p0.rn, p0.peak, any_value(b.least120) AS peak_low, min(f.low) AS lowest_since FROM p0 JOIN n3 b ON b.code = p0.code AND b.rn = p0.peak LEFT JOIN n3 f ON f.code = p0.code AND f.rn > p0.peak AND f.rn <= p0.rn GROUP BY 1, 2, 3),
  g0 AS (SELECT code, rn, date, low > lag(high) OVER (PARTITION BY code ORDER BY date) AS gap_up, high < lag(low) OVER (PARTITION BY code ORDER BY date) AS gap_dn, lag(low) OVER (PARTITION BY code ORDER BY date) AS low0, lag(high) OVER (PARTITION BY code ORDER BY date) AS high0, high, low FROM n0),
  g1 AS (SELECT t.code, t.rn, a.rn AS arn, any_value(t.gap_up AND a.gap_dn) AS bot, any_value(t.gap_dn AND a.gap_up) AS top, max(m.high) AS mh, min(m.low) AS ml, any_value(least(a.low0, t.low)) AS under, any_value(greatest(a.high0, t.high)) AS over
    FROM g0 t JOIN g0 a ON a.code = t.code AND a.rn BETWEEN greatest(2, t.rn - 10) AND t.rn - 1 JOIN g0 m ON m.code = t.code AND m.rn BETWEEN a.rn AND t.rn - 1 WHERE (t.gap_up AND a.gap_dn) OR (t.gap_dn AND a.gap_up) GROUP BY 1, 2, 3),
  g2 AS (SELECT code, rn, bool_or(bot AND mh < under) AS isl_bot, bool_or(top AND ml > over) AS isl_top FROM g1 GROUP BY 1, 2),
  n4 AS (SELECT n3.*, n3.rn - peak AS days, peak_low, coalesce(lowest_since, peak_high) AS after_low, isl_bot, isl_top FROM n3 JOIN p1 USING (code, rn) LEFT JOIN g2 USING (code, rn)),
  windowed AS (SELECT *, {", ".join(f"coalesce({v}, false) AS w_{k}" for k, v in window_rules().items())} FROM n4)""")


ORACLE_SQL = {
    "bars_daily": f"WITH {BARS} SELECT code, date, open, high, low, close, volume, round(amount, 2) AS amount FROM bars",
    "resample_weekly": f"WITH {BARS}, {_resample('week')} SELECT * FROM res",
    "resample_monthly": f"WITH {BARS}, {_resample('month')} SELECT * FROM res",
    "listing_filter": f"WITH {LISTING} SELECT code, market, theme, marcap, row_number() OVER (PARTITION BY market ORDER BY marcap DESC, code) AS size_rank FROM listing",
    "market_breadth": f"WITH {BARS}, {_BREADTH} SELECT * FROM breadth",
    "moving_indicators": f"WITH {BARS}, {MOVING} SELECT code, date, obv, hh20_prev, hh252, "
    + ", ".join(f"round({k}, {n}) AS {k}" for k, n in {"ma5": 2, "ma20": 2, "ma60": 2, "ma120": 2, "ma60_slope": 4, "bb_upper": 2, "bb_width": 4, "sto_k": 2, "sto_d": 2, "vol_ma20": 4, "ret60": 4, "ret120": 4}.items())
    + " FROM moving",
    "recursive_indicators": f"WITH {BARS}, {MOVING}, {RECURSIVE} SELECT code, date, " + ", ".join(f"round({k}, 2) AS {k}" for k in ("rsi", "macd", "macd_signal", "atr", "pdi", "mdi", "adx")) + " FROM ind",
    "condition_counts": f"WITH {BARS}, {MOVING}, {RECURSIVE}, {CONDITIONS} SELECT code, count(*) AS n_bars, " + ", ".join(f"count(*) FILTER (f_{k}) AS {k}" for k in cond_rules()) + " FROM cond GROUP BY 1",
    "candle_counts": f"WITH {BARS}, {MOVING}, {RECURSIVE}, {CANDLES} SELECT code, " + ", ".join(f"count(*) FILTER (f_{k}) AS {k}" for k in candle_rules()) + " FROM candle GROUP BY 1",
    "window_pattern_counts": f"WITH {BARS}, {MOVING}, {RECURSIVE}, {_windows()} SELECT code, " + ", ".join(f"count(*) FILTER (w_{k}) AS {k}" for k in window_rules()) + " FROM windowed GROUP BY 1",
    "oscillator_indicators": f"WITH {BARS}, {_oscillators('bars')} SELECT code, date, " + ", ".join(k if k in OSCILLATORS[2:8] else f"round({k}, 2) AS {k}" for k in OSCILLATORS) + " FROM osc",
    "oscillator_counts": f"WITH {BARS}, {MOVING}, {RECURSIVE}, {_oscillators('ind')}, oy AS (SELECT *, {_BEFORE}, {lag('close', 26)} AS c26, {lag('close', 27)} AS c27 FROM osc) SELECT code, "
    + ", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in oscillator_rules().items())
    + " FROM oy GROUP BY 1",
    "golden_cross_study": f"""WITH {BARS}, g0 AS (SELECT *, {roll('avg(close)', 'close', 5)} AS ma5, {roll('avg(close)', 'close', 20)} AS ma20, {horizon(20)} AS ret FROM bars),
  g1 AS (SELECT *, coalesce(ma5 > ma20 AND {lag('ma5')} <= {lag('ma20')}, false) AS gc FROM g0), g2 AS (SELECT *, {onset('gc')} AS ev FROM g1)
{stats('code')} FROM g2 WHERE ev AND abs(ret) <= 3 GROUP BY code""",
    "horizon_stats": f"WITH {BARS}, h AS ({' UNION ALL '.join(f'SELECT code, {h} AS h, {horizon(h)} AS ret FROM bars' for h in (1, 5, 20, 60))}) {stats('code, h')} FROM h WHERE abs(ret) <= 3 GROUP BY code, h",
    "barrier_sim": f"""WITH {BARS}, {MOVING}, {RECURSIVE}, b0 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS i, coalesce(ma5 > ma20 AND {lag('ma5')} <= {lag('ma20')}, false) AS gc FROM ind),
  b1 AS (SELECT *, {onset('gc')} AS ev, {lead('open', 1)} AS entry, {lead('close', 20)} AS final FROM b0),
  b2 AS (SELECT *, entry * (1 + 3.0::DOUBLE * least(atr_pct, 0.08::DOUBLE)) AS tgt, entry * (1 - 2.0::DOUBLE * least(atr_pct, 0.08::DOUBLE)) AS stp FROM b1 WHERE ev AND final IS NOT NULL),
  b3 AS (SELECT a.code, a.date, any_value(a.entry) AS entry, any_value(a.final) AS final, any_value(a.tgt) AS tgt, any_value(a.stp) AS stp, min(f.i - a.i) FILTER (f.low <= a.stp) AS d, min(f.i - a.i) FILTER (f.high >= a.tgt) AS u,
    arg_min(f.open, f.i) FILTER (f.low <= a.stp) AS d_open, arg_min(f.open, f.i) FILTER (f.high >= a.tgt) AS u_open
    FROM b2 a JOIN b1 f ON f.code = a.code AND f.i BETWEEN a.i + 1 AND a.i + 20 GROUP BY 1, 2),
  b4 AS (SELECT *, CASE WHEN d IS NOT NULL AND d <= coalesce(u, 99) THEN 'stop' WHEN u IS NOT NULL THEN 'target' ELSE 'time' END AS outcome FROM b3)
SELECT code, outcome, count(*) AS n, round(avg(CASE outcome WHEN 'stop' THEN least(d_open, stp) WHEN 'target' THEN greatest(u_open, tgt) ELSE final END / entry - 1 - 0.0025::DOUBLE), 4) AS mean_ret,
  CAST(sum(CASE outcome WHEN 'stop' THEN d WHEN 'target' THEN u ELSE 20 END) AS BIGINT) AS days FROM b4 GROUP BY 1, 2""",
    "cross_rank": f"""WITH {BARS}, c AS (SELECT code, date, close / {lag('close', 60)} - 1 AS x FROM bars), d AS (SELECT * FROM c WHERE x IS NOT NULL)
SELECT code, date, round((rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date), 6) AS rank FROM d""",
    "index_capweighted": f"WITH {BARS}, {LISTING}, {_index('')} SELECT * FROM idx",
    "sector_index": f"WITH {BARS}, {LISTING}, {_index('market')} SELECT * FROM idx",
    "sector_leaders": f"""WITH {BARS}, {LISTING}, {_resample('month')}, s AS (SELECT market, period, code, close / open - 1 AS ret, row_number() OVER (PARTITION BY market, period ORDER BY close / open - 1 DESC, code) AS rank FROM res JOIN listing USING (code))
SELECT market, period, rank, code, round(ret, 6) AS ret FROM s WHERE rank <= 3""",
    "drawdown_metrics": f"""WITH {BARS}, d AS (SELECT code, close / max(close) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd, close / {lag('close')} - 1 AS ret FROM bars)
SELECT code, round(min(dd), 6) AS max_drawdown, round(stddev_pop(ret), 6) AS vol, round(avg(ret), 6) AS mean_ret, round(avg(ret) / stddev_pop(ret), 4) AS sharpe_day FROM d GROUP BY 1""",
    "monthly_table": f"""WITH {BARS}, {_resample('month')}, m AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY period) AS before FROM res)
SELECT year(period) AS year, month(period) AS month, count(before) AS n, round(avg(close / before - 1), 6) AS mean_ret FROM m GROUP BY 1, 2""",
    "return_histogram": f"""WITH {BARS}, h AS (SELECT {horizon(20)} AS ret FROM bars), x AS (SELECT greatest(-0.5::DOUBLE, least(0.5::DOUBLE, round(ret, 9))) AS x FROM h WHERE abs(ret) <= 3)
SELECT least(20, CAST(floor(20 * (x + 0.5::DOUBLE) / 1.0::DOUBLE) AS BIGINT) + 1) AS bin, count(*) AS n FROM x GROUP BY 1""",
    "flow_streak": f"""WITH {FLOWS}, s0 AS (SELECT *, CAST(sign(net) AS INT) AS s, row_number() OVER (PARTITION BY code, investor ORDER BY date DESC) AS back FROM flows),
  s1 AS (SELECT code, investor, arg_max(s, date) AS s, arg_max(net, date) AS net, max(date) AS date FROM s0 GROUP BY 1, 2),
  s2 AS (SELECT code, investor, min(back) FILTER (s <> last) AS cut, max(back) AS len FROM (SELECT s0.*, s1.s AS last FROM s0 JOIN s1 USING (code, investor)) GROUP BY 1, 2)
SELECT code, investor, date, net, s * coalesce(cut - 1, len) AS streak FROM s1 JOIN s2 USING (code, investor)""",
    "net_buy_rank": f"""WITH {FLOWS}, m AS (SELECT investor, code, CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(net) AS BIGINT) AS net FROM flows GROUP BY 1, 2, 3),
  k AS (SELECT *, row_number() OVER (PARTITION BY investor, month ORDER BY net DESC, code) AS rank FROM m) SELECT investor, month, rank, code, net FROM k WHERE rank <= 3""",
    "investor_study": f"""WITH {BARS}, {FLOWS}, b AS (SELECT *, close * volume AS traded, {", ".join(f"{lead('close', h)} / nullif({lead('open', 1)}, 0) - 1 AS fw{h}" for h in (5, 20, 60))} FROM bars),
  b2 AS (SELECT *, {roll('avg(traded)', 'traded', 60, 30)} AS amt, {", ".join(f"fw{h} - avg(fw{h}) OVER (PARTITION BY date) AS fx{h}" for h in (5, 20, 60))} FROM b),
  g AS (SELECT b2.*, i.investor, f.net FROM b2 CROSS JOIN (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) i(investor) LEFT JOIN flows f ON f.code = b2.code AND f.date = b2.date AND f.investor = i.investor),
  x AS (SELECT *, CASE WHEN count(net) OVER w >= 12 THEN sum(net) OVER w / nullif(amt * 20, 0) END AS x, CASE WHEN net > 0 THEN 1.0::DOUBLE WHEN net IS NOT NULL THEN 0.0::DOUBLE END AS buys FROM g WINDOW w AS (PARTITION BY code, investor ORDER BY date ROWS 19 PRECEDING)),
  y AS (SELECT *, CASE WHEN lead(date, 19) OVER s IS NOT NULL AND count(buys) OVER w >= 10 THEN avg(buys) OVER w END AS after,
    CASE WHEN x IS NOT NULL THEN round((rank() OVER (PARTITION BY investor, date ORDER BY x NULLS LAST) + (count(x) OVER (PARTITION BY investor, date, x) - 1) / 2.0::DOUBLE) / count(x) OVER (PARTITION BY investor, date), 9) END AS rank
    FROM x WINDOW s AS (PARTITION BY code, investor ORDER BY date), w AS (PARTITION BY code, investor ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))
SELECT investor, count(*) FILTER (rank >= 0.9::DOUBLE) AS n, {", ".join(f"round(avg(fx{h}) FILTER (rank >= 0.9::DOUBLE), 6) AS excess{h}, round(avg(CASE WHEN fw{h} > 0 THEN 1.0::DOUBLE WHEN fw{h} IS NOT NULL THEN 0.0::DOUBLE END) FILTER (rank >= 0.9::DOUBLE), 6) AS win{h}" for h in (5, 20, 60))},
  round(avg(after) FILTER (buys = 1), 6) AS persistence FROM y GROUP BY 1""",
    "asof_fundamentals": f"""WITH {BARS}, {_resample('month')}, facts AS (SELECT code, CAST(last_day(period) + INTERVAL 1 DAY AS DATE) AS date, close AS book FROM res)
SELECT b.code, count(*) AS n, round(avg(b.close / f.book), 6) AS price_to_book, max(f.book) AS max_book FROM bars b ASOF JOIN facts f ON b.code = f.code AND b.date >= f.date GROUP BY 1""",
    "volume_profiles": f"""WITH {BARS}, v0 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM bars), v1 AS (SELECT *, min(low) OVER (PARTITION BY code) AS lo, max(high) OVER (PARTITION BY code) AS hi FROM v0 WHERE rn <= 120),
  v2 AS (SELECT *, (hi - lo) / 24 AS width, lo + bin * ((hi - lo) / 24) AS a FROM v1, range(24) t(bin) WHERE hi > lo)
SELECT code, CAST(bin AS INT) AS bin, round(sum(volume * close * CASE WHEN high > low THEN greatest(0, least(high, a + width) - greatest(low, a)) / (high - low) WHEN least(23, floor((close - lo) / (hi - lo) * 24)) = bin THEN 1 ELSE 0 END), 2) AS value FROM v2 GROUP BY 1, 2""",
    "tick_rounding": f"""WITH {BARS}, t0 AS (SELECT close * 100 AS p FROM bars), t1 AS (SELECT p, {_TICK} AS t FROM t0)
SELECT t, count(*) AS n, CAST(sum(CAST(floor(p / t) * t AS BIGINT)) AS BIGINT) AS down, CAST(sum(CAST(ceil(p / t) * t AS BIGINT)) AS BIGINT) AS up FROM t1 GROUP BY 1""",
    "top_movers": f"""WITH {BARS}, c AS (SELECT code, date, round(close / {lag('close')} - 1, 6) AS chg FROM bars),
  k AS (SELECT date, code, chg, row_number() OVER (PARTITION BY date ORDER BY chg DESC, code) AS up_rank, row_number() OVER (PARTITION BY date ORDER BY chg, code) AS down_rank FROM c WHERE chg IS NOT NULL)
SELECT * FROM k WHERE up_rank <= 5 OR down_rank <= 5""",
    "pattern_event_study": _study_sql(),
    "combo_mine": _combo_sql(),
    "combo_mine_all": _combo_all_sql(),
    "setup_stats_by_year": _setups_sql(),
    "regime_lamps": f"""WITH {BARS}, {LISTING}, {_index('')}, {_BREADTH}, l0 AS (SELECT date, exp(log_level) AS level, exp(log_level) / lag(exp(log_level)) OVER (ORDER BY date) - 1 AS r FROM idx),
  l1 AS (SELECT *, row_number() OVER (ORDER BY date) AS i, CASE WHEN count(*) OVER w60 >= 60 THEN avg(level) OVER w60 END AS m60, CASE WHEN count(*) OVER w20 >= 20 THEN avg(level) OVER w20 END AS m20, CASE WHEN count(r) OVER w20 >= 20 THEN round(stddev_samp(r) OVER w20 * sqrt(252), 9) END AS vol
  FROM l0 WINDOW w60 AS (ORDER BY date ROWS 59 PRECEDING), w20 AS (ORDER BY date ROWS 19 PRECEDING)),
  v AS (SELECT a.i, (count(*) FILTER (b.vol < a.vol) + (count(*) FILTER (b.vol = a.vol) + 1) / 2.0::DOUBLE) / count(b.vol) AS rank, count(b.vol) AS n FROM l1 a JOIN l1 b ON b.i BETWEEN a.i - 249 AND a.i WHERE a.vol IS NOT NULL GROUP BY 1),
  f AS (SELECT l1.date, coalesce(level > m60, false) AS over60, coalesce(level > m20, false) AS over20, coalesce(above_ma20 >= 0.4::DOUBLE, false) AS broad, CASE WHEN n >= 120 THEN rank END AS rank FROM l1 LEFT JOIN breadth USING (date) LEFT JOIN v USING (i))
SELECT date, over60, over20, broad, coalesce(rank < 0.85::DOUBLE, false) AS calm, round(rank, 6) AS vol_rank, over60 AND over20 AND broad AND coalesce(rank < 0.85::DOUBLE, false) AS on FROM f""",
    "price_alerts": f"""WITH {BARS}, a AS (SELECT code, date, round(close / first_value(close) OVER (PARTITION BY code ORDER BY date), 9) AS x FROM bars),
  b AS (SELECT *, CASE WHEN x >= 1.1::DOUBLE THEN 'above' WHEN x <= 0.9::DOUBLE THEN 'below' END AS side FROM a)
SELECT code, side, count(*) AS n, min(date) AS first_day, max(date) AS last_day FROM b WHERE side IS NOT NULL GROUP BY 1, 2""",
    "portfolio_value": f"""WITH {BARS}, px AS (SELECT code, arg_max(close, date) AS px FROM bars GROUP BY 1), h AS (SELECT o_custkey AS custkey, p_brand AS code, sum(l_quantity) AS qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cost
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), v AS (SELECT *, qty * px AS value FROM h JOIN px USING (code))
SELECT custkey, code, qty, cost, value, round(value * 100 / cost - 1, 4) AS gain, round(value / sum(value) OVER (PARTITION BY custkey), 4) AS weight FROM v""",
    "valuation_median": "SELECT p_type, round(median(p_retailprice), 4) AS median_price, count(DISTINCT p_brand) AS n_codes, round(quantile_cont(p_retailprice, 0.9), 4) AS p90_price FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 3",
    "screen_metrics": f"""WITH {BARS}, {MOVING}, s AS (SELECT *, close / pc - 1 AS chg, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM moving)
SELECT code, date, close, round(chg, 6) AS chg, round(close / ma20 - 1, 6) AS gap20, round(close / hh252 - 1, 6) AS gap_high, round(volume / nullif(vol_ma20, 0), 6) AS vr,
  coalesce(close > ma5, false)::INT + coalesce(close > ma20, false)::INT + coalesce(close > ma60, false)::INT AS trend FROM s WHERE rn = 1""",
    "quotes_hourly": "SELECT event_type AS code, date_trunc('hour', ts) AS start, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2",
}
