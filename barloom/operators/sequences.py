"""Patterns that hang on all that came before: pivots and their necklines, trend lines, reference bars, gaps, parabolic SAR.

A code's bars stand in date order in one partition; a task feeds them one by
one to a ``Memory``, which holds a bounded part of the past and goes on from
batch to batch, so no series is ever held as a whole. What a bar fires hangs
on earlier bars only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.expr import by_code, flag, highest, lag, lowest

SEQUENCES = [
    "hs_top", "inv_hs", "dbl_bottom", "dbl_top", "tri_up", "tri_dn", "bull_div", "bear_div", "tl_dn_brk", "tl_dn_rej",
    "tl_up_sup", "tl_up_brk", "base_mid", "base_hi", "base_lo", "prev_high_brk", "prev_low_brk", "prev_low_sup", "retest",
    "n_wave", "cup_handle", "wedge_fall", "wedge_rise", "triple_bottom", "gap_sup", "gap_fill_up", "period_brk",
]
FLAGS = ["flag_bull", "v_rebound"]
TURNS = ["sar_buy", "sar_sell"]

#: Bars on either side of a pivot: it is known so many bars later.
SIDE = 5
#: Bars that a memory keeps: what the longest look back (a trend line) needs.
KEPT = 170
#: Price-structure patterns need so many bars of a code.
WHOLE = 60


@dataclass
class Line:
    """A level or a sloping line that a close may cross upwards (side 1) or downwards (side -1) until a bar."""

    side: int
    level: float
    until: int
    slope: float = 0.0
    start: int = 0

    def at(self, t: int) -> float:
        return self.level + self.slope * (t - self.start)

    def crossed(self, t: int, close: float, before: float) -> bool:
        return t <= self.until and self.side * (close - self.at(t)) > 0 and self.side * (before - self.at(t - 1)) <= 0


@dataclass
class Trend:
    """A line through two pivots. ``broken`` ends it; ``touched`` is the last bar that leaned on it."""

    first: int
    second: int
    price: float
    slope: float
    made: int
    broken: bool = False
    touched: int = -99

    def at(self, t: int) -> float:
        return self.price + self.slope * (t - self.first)


class Sar:
    """Parabolic stop and reverse: acceleration from 0.02 by 0.02 up to 0.2."""

    STEP, MOST = 0.02, 0.2

    def __init__(self):
        self.past: list[tuple[float, float]] = []
        self.side, self.value, self.extreme, self.pace = 1, 0.0, 0.0, self.STEP

    def step(self, high: float, low: float) -> float | None:
        if not self.past:
            self.value, self.extreme, self.past = low, high, [(high, low)]
            return None
        # with side -1 highs and lows change places and signs
        s = self.side
        reach, back = (high, low) if s > 0 else (-low, -high)
        guard = min(low if s > 0 else -high for high, low in self.past)
        value = min(s * (self.value + self.pace * (self.extreme - self.value)), guard)
        if back < value:
            self.side, self.value, self.extreme, self.pace = -s, self.extreme, s * back, self.STEP
        else:
            self.value = s * value
            if reach > s * self.extreme:
                self.extreme, self.pace = s * reach, min(self.pace + self.STEP, self.MOST)
        self.past = [*self.past[-1:], (high, low)]
        return self.value


class Memory:
    """What has to be known of one code's past, fed bar by bar."""

    def __init__(self):
        self.t, self.base = -1, 0
        self.high: list[float] = []
        self.low: list[float] = []
        self.close: list[float] = []
        #: Pivots of either side, oldest first: (bar, price, RSI).
        self.pivots: dict[int, list[tuple]] = {1: [], -1: []}
        self.recent: dict[int, list[tuple]] = {1: [], -1: []}
        self.lines: dict[str, Line] = {}
        self.trends: dict[int, Trend | None] = {1: None, -1: None}
        self.levels: dict[int, list | None] = {1: None, -1: None}
        self.lowest_since = 0.0  # from the last high pivot to the bar before
        self.run_up = 0.0  # the last high pivot over the low of the 60 bars before it
        self.supported, self.broke = -99, None
        self.cups: list[tuple] = []
        self.gaps: dict[int, list[tuple]] = {1: [], -1: []}
        self.bar: dict | None = None
        self.sar = Sar()

    def lows(self, first: int, last: int) -> float:
        """The lowest low of the bars first .. last."""
        return min(self.low[max(0, first - self.base) : last - self.base + 1])

    def step(self, o, h, low, c, v, rsi, usual, pivots: tuple[bool, bool], whole: bool) -> tuple[float | None, list[str]]:
        """The SAR and what fires on the next bar. ``rsi``: of SIDE bars ago; ``usual``: volume before the bar; ``pivots``: whether SIDE bars ago was a high, a low."""
        self.t += 1
        self.high.append(h), self.low.append(low), self.close.append(c)
        if len(self.high) > 2 * KEPT:
            self.base += KEPT
            for x in (self.high, self.low, self.close):
                del x[:KEPT]
        fired: list[str] = []
        for side, is_pivot in zip((1, -1), pivots):
            if is_pivot:
                self._pivot(side, rsi, fired)
        if any(pivots):
            self._pairs(whole)
        if self.t:
            before = self.close[-2]
            self._crossings(c, before, whole, fired)
            for side in (1, -1):
                self._trend(side, h, low, c, before, fired)
            self._reference_bar(o, h, low, c, before, v, usual, fired)
            if whole:
                self._previous_levels(o, low, c, before, fired)
                self._cups(c, before, fired)
                self._gap_rules(h, low, c, before, fired)
        self.lowest_since = min(self.lowest_since, low)
        return self.sar.step(h, low), fired

    def _pivot(self, side: int, rsi, fired: list[str]) -> None:
        """A pivot of SIDE bars ago is known: divergence, double and triple forms, level, trend line."""
        t, i = self.t, self.t - SIDE
        p = (self.high if side > 0 else self.low)[i - self.base]
        inner, outer = (min, max) if side > 0 else (max, min)
        own = self.pivots[side] = [*self.pivots[side], (i, p, rsi)][-6:]
        other = self.pivots[-side]

        def between(a: int, b: int, last: int) -> list[float]:
            return [q for j, q, _ in other[-last:] if a < j < b]

        if len(own) > 1:
            i1, p1, r1 = own[-2]
            if side * (p - p1) > 0 and i - i1 <= 40 and None not in (rsi, r1) and side * (r1 - rsi) > 3:
                fired.append("bear_div" if side > 0 else "bull_div")
            mid = between(i1, i, 4)
            if i - i1 >= 8 and abs(p / p1 - 1) <= 0.03 and mid and side * (inner(p1, p) * (1 - 0.05 * side) - inner(mid)) > 0:
                self.lines["dbl_top" if side > 0 else "dbl_bottom"] = Line(-side, inner(mid), t + 30)
        if len(own) > 2:
            (i1, p1, _), (_, p2, _) = own[-3:-1]
            mid = between(i1, i, 4)
            if side * (p2 - outer(p1, p) * (1 + 0.03 * side)) >= 0 and abs(p / p1 - 1) <= 0.06 and i - i1 <= 90 and mid:
                self.lines["hs_top" if side > 0 else "inv_hs"] = Line(-side, inner(mid), t + 30)
            mid = between(i1, i, 6)
            if side < 0 and max(p1, p2, p) <= 1.04 * min(p1, p2, p) and 20 <= i - i1 <= 120 and mid:
                self.lines["triple_bottom"] = Line(1, max(mid), t + 30)
        self.levels[side] = [p, i, False]
        if side > 0:
            self.lowest_since = self.lows(i, t - 1)
            self.run_up = p / self.lows(max(0, i - 60), i) - 1
            self.cups = [z for z in self.cups if t - z[1] <= 25]
            for j, rim, _ in own[:-1]:
                if 30 <= i - j <= 150 and abs(p / rim - 1) <= 0.05 and 0.55 * rim <= self.lows(j, i) <= 0.85 * rim:
                    self.cups.append((max(rim, p), i, p))
                    break
        self._fit(side, i, p)

    def _fit(self, side: int, i: int, p: float) -> None:
        """A trend line from the outermost pivot of 160 bars through the newest one that closes have respected since."""
        t = self.t
        points = self.recent[side] = [z for z in self.recent[side] if t - z[0] <= 160] + [(i, p)]
        i1, p1 = max(points, key=lambda z: (side * z[1], -side * z[0]))
        closes = self.close[i1 - self.base :]
        for i2, p2 in sorted(points, reverse=True):
            if i2 - i1 < 10:
                return
            slope = (p2 - p1) / (i2 - i1)
            inside = side * (p2 - p1 * (1 - 0.02 * side)) < 0
            if inside and all(side * (c - (p1 + slope * k) * (1 + 0.01 * side)) <= 0 for k, c in enumerate(closes)):
                now = self.trends[side]
                if now is None or (now.first, now.second) != (i1, i2):
                    self.trends[side] = Trend(i1, i2, p1, slope, t)
                return

    def _pairs(self, whole: bool) -> None:
        """Triangles and wedges from the last two pivots of both sides."""
        t, highs, lows = self.t, self.pivots[1][-2:], self.pivots[-1][-2:]
        if len(highs) < 2 or len(lows) < 2:
            return
        (a1, h1, _), (a2, h2, _) = highs
        (b1, l1, _), (b2, l2, _) = lows
        age = t - min(a1, b1)
        if h2 < h1 and l2 > l1 and age <= 60:
            self.lines |= {"tri_up": Line(1, h2, t + 20), "tri_dn": Line(-1, l2, t + 20)}
        self.lines.pop("wedge_fall", None), self.lines.pop("wedge_rise", None)
        if whole and age <= 70:
            above, below = (h2 - h1) / (a2 - a1), (l2 - l1) / (b2 - b1)
            if above < below < 0:
                self.lines["wedge_fall"] = Line(1, h2, t + 20, above, a2)
            if below > above > 0:
                self.lines["wedge_rise"] = Line(-1, l2, t + 20, below, b2)

    def _crossings(self, c: float, before: float, whole: bool, fired: list[str]) -> None:
        """Lines that this close crosses; each is crossed once, of a triangle's two sides one."""
        for key in [k for k, line in self.lines.items() if line.crossed(self.t, c, before)]:
            if key not in self.lines or key == "triple_bottom" and not whole:
                continue
            fired.append(key)
            for k in ("tri_up", "tri_dn") if key.startswith("tri_") else (key,):
                self.lines.pop(k, None)

    def _trend(self, side: int, h: float, low: float, c: float, before: float, fired: list[str]) -> None:
        line, t = self.trends[side], self.t
        if line is None or line.broken or t <= line.made:
            return
        if t - line.second > 90:
            self.trends[side] = None
            return
        now, was = line.at(t), line.at(t - 1)
        if side > 0:
            through, leans = c > 1.005 * now and before <= 1.005 * was, h >= 0.995 * now and c < now
        else:
            through, leans = c < 0.98 * now and before >= 0.98 * was, low <= 1.01 * now and c >= now and before > was
        if through:
            line.broken = True
            fired.append("tl_dn_brk" if side > 0 else "tl_up_brk")
        elif leans and t - line.touched >= 5:
            line.touched = t
            fired.append("tl_dn_rej" if side > 0 else "tl_up_sup")

    def _reference_bar(self, o, h, low, c, before, v, usual, fired: list[str]) -> None:
        """A bar of three times the usual volume, 8 % up with a body of 5 %: its open, middle and high count for 60 bars."""
        if usual and usual > 0 and before > 0 and o > 0 and v >= 3 * usual and c / before - 1 >= 0.08 and c / o - 1 >= 0.05:
            self.bar = {"t": self.t, "open": o, "high": h, "middle": (o + c) / 2, "low": float("inf"), "left": {"base_lo", "base_mid", "base_hi"}}
            return
        bar = self.bar
        if bar is None or self.t - bar["t"] > 60:
            self.bar = None
            return
        age, left, middle = self.t - bar["t"], bar["left"], bar["middle"]
        if age >= 2:
            lost = "base_lo" in left and c < bar["open"] <= before
            held = left >= {"base_lo", "base_mid"} and low <= 1.01 * middle and c >= middle and bar["low"] > 1.01 * middle
            over = "base_hi" in left and age >= 5 and before <= bar["high"] < c
            for key, on in (("base_lo", lost), ("base_mid", held and not lost), ("base_hi", over)):
                if on:
                    left.discard(key)
                    fired.append(key)
        bar["low"] = min(bar["low"], low)

    def _previous_levels(self, o, low, c, before, fired: list[str]) -> None:
        """The last pivots as levels, ten bars old at least: broken once, held, tested again."""
        t, high, floor = self.t, self.levels[1], self.levels[-1]
        old = lambda level: level is not None and not level[2] and t - level[1] >= 10
        if old(high) and before <= high[0] < c:
            high[2], self.broke = True, (high[0], t)
            fired.append("prev_high_brk")
            if len(self.pivots[-1]) > 1:
                (a, start, _), (b, back, _) = self.pivots[-1][-2:]
                if a < high[1] < b and back > start and high[0] / start - 1 >= 0.15 and 0.3 <= (high[0] - back) / (high[0] - start) <= 0.7:
                    fired.append("n_wave")
            if t - high[1] >= 12 and high[0] / self.lowest_since - 1 <= 0.16 and self.run_up >= 0.15:
                fired.append("period_brk")
        if old(floor) and c < floor[0] <= before:
            floor[2] = True
            fired.append("prev_low_brk")
        if old(floor) and t - self.supported >= 5 and 0.98 * floor[0] <= low <= 1.02 * floor[0] and c > o and c > floor[0]:
            self.supported = t
            fired.append("prev_low_sup")
        if self.broke and 2 <= t - self.broke[1] <= 12 and low <= 1.015 * self.broke[0] and c >= self.broke[0]:
            self.broke = None
            fired.append("retest")

    def _cups(self, c: float, before: float, fired: list[str]) -> None:
        """A close over the rim of a cup whose handle of 5 to 25 bars stayed near the right rim; it ends all cups."""
        if any(5 <= self.t - i <= 25 and before <= rim < c and self.lows(i, self.t - 1) >= 0.88 * right for rim, i, right in self.cups):
            self.cups = []
            fired.append("cup_handle")

    def _gap_rules(self, h: float, low: float, c: float, before: float, fired: list[str]) -> None:
        """Gaps of the last 20 bars: an upward one that holds when touched, a downward one that a close fills."""
        t, above, below = self.t, self.high[-2], self.low[-2]
        if low > above:
            self.gaps[1].append((t, above, low))
        if h < below:
            self.gaps[-1].append((t, h, below))
        up = self.gaps[1] = [g for g in self.gaps[1] if t - g[0] <= 20 and low >= g[1]]
        down = self.gaps[-1] = [g for g in self.gaps[-1] if t - g[0] <= 20]
        if any(t - g[0] >= 2 and low <= g[2] < below and c >= g[1] for g in up):
            fired.append("gap_sup")
        filled = next((g for g in down if t > g[0] and before < g[2] <= c), None)
        if filled:
            down.remove(filled)
            fired.append("gap_fill_up")


def add_sequences(d: DataFrame) -> DataFrame:
    """``d`` with ``sar`` and ``fired``, the keys of SEQUENCES that a bar fires. Needs ``rsi`` and ``vol_ma20``.

    Bars without a high, low or close fire nothing and are passed over. Codes
    of any number and length: each code is one task's, its memory is bounded.
    """
    pivots = {
        "__ph": flag((lag("high", SIDE) == highest("high", 2 * SIDE + 1)) & (lag("high", SIDE) > lag("high", SIDE + 1))),
        "__pl": flag((lag("low", SIDE) == lowest("low", 2 * SIDE + 1)) & (lag("low", SIDE) < lag("low", SIDE + 1))),
    }
    inputs = ["open", "high", "low", "close", "volume", "__rsi", "__usual", "__ph", "__pl", "__whole"]
    rows = d.withColumns(pivots | {"__rsi": lag("rsi", SIDE), "__usual": lag("vol_ma20"), "__whole": F.count(F.lit(1)).over(W.partitionBy("code")) >= WHOLE})
    kept = d.columns
    rows = rows.repartition("code").sortWithinPartitions("code", "date").select(*kept, *[F.col(x).alias(f"__in_{k}") for k, x in enumerate(inputs)])

    def run(batches):
        import pyarrow as pa

        code, memory = None, Memory()
        for b in batches:
            values = [b.column(len(kept) + k).to_pylist() for k in range(len(inputs))]
            sar, keys = [], []
            for c, (o, h, low, close, v, rsi, usual, ph, pl, whole) in zip(b.column(kept.index("code")).to_pylist(), zip(*values)):
                if c != code:
                    code, memory = c, Memory()
                if None in (h, low, close):
                    s, f = None, []
                else:
                    s, f = memory.step(close if o is None else o, h, low, close, v or 0.0, rsi, usual, (ph, pl), whole)
                sar.append(s)
                keys.append(f)
            columns = [*b.columns[: len(kept)], pa.array(sar, pa.float64()), pa.array(keys, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sar", "fired"])

    out = T.StructType([*d.schema.fields, T.StructField("sar", T.DoubleType()), T.StructField("fired", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(run, out)


def sar_turns(d: DataFrame) -> DataFrame:
    """TURNS as columns: the stop has changed sides of the close."""
    c, s = F.col("close"), F.col("sar")
    return d.withColumns({"sar_buy": flag((s < c) & (lag("sar") > lag("close"))), "sar_sell": flag((s > c) & (lag("sar") < lag("close")))})


def add_flags(d: DataFrame) -> DataFrame:
    """FLAGS as columns: a flag after a pole of 15 %, and a V after a fall of 20 %, both over half-way marks of at most 26 bars."""
    names = set(d.columns)
    c, low = F.col("close"), F.col("low")
    d = d.withColumns({"__t": F.row_number().over(by_code()) - 1, "__whole": F.count(F.lit(1)).over(W.partitionBy("code")) >= WHOLE})
    d = d.withColumns(
        {
            "__foot": F.min("low").over(by_code(-10, 0)),
            "__head": F.max("high").over(by_code(-10, 0)),
            "__sum": F.sum("volume").over(by_code(W.unboundedPreceding)),
            "__pole_volume": F.avg("volume").over(by_code(-10, 0)),
        }
    )
    # the latest of the highest bars and the first of the lowest bars before today
    top = F.max(F.struct("high", "__t", "__foot", "__sum", "__pole_volume")).over(by_code(-16, -1))
    bottom = F.min(F.struct("low", "__t", "__head")).over(by_code(-5, -1))
    d = d.withColumns({"__top": top, "__bottom": bottom, "__lows": F.collect_list("low").over(by_code(-16, -1)), "__sold": F.sum("volume").over(by_code(W.unboundedPreceding, -1))})
    age = (F.col("__t") - 1 - F.col("__top.__t")).cast("int")
    after = F.array_min(F.slice("__lows", F.greatest(F.size("__lows") - age + 1, F.lit(1)), F.greatest(age, F.lit(1))))
    pole, high = F.col("__top.high") - F.col("__top.__foot"), F.col("__top.high")
    quiet = F.try_divide(F.col("__sold") - F.col("__top.__sum"), age) < F.col("__top.__pole_volume")
    half = F.col("__bottom.low") + 0.5 * (F.col("__bottom.__head") - F.col("__bottom.low"))
    rules = {
        "flag_bull": (F.col("__t") >= 30) & age.between(4, 15) & (high / F.col("__top.__foot") - 1 >= 0.15) & (after >= high - 0.5 * pole) & (c > high) & (lag("close") <= high) & quiet,
        "v_rebound": (F.col("__t") >= 20) & (F.col("__bottom.low") / F.col("__bottom.__head") - 1 <= -0.2) & (c >= half) & (lag("close") < half),
    }
    d = d.withColumns({k: flag(F.col("__whole") & x) for k, x in rules.items()})
    return d.drop(*[x for x in d.columns if x.startswith("__") and x not in names])
