"""A ledger of picks scored bar by bar: in one batch, and in a stream with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import by_code
from barloom.operators.studies import asof_backward
from barloom.operators.trades import COST

#: Calendar days for each bar of a pick's time; later bars are not looked at.
DAYS_A_BAR = 4
SCORED = "id string, code string, status string, entry double, exit_date date, exit double, ret double, days int"


def score_picks(picks: DataFrame, bars: DataFrame, cost: float = COST) -> DataFrame:
    """``picks (id, code, date, target, stop, h)`` with ``status, entry, exit_date, exit, ret, days``.

    A pick is bought at the open of the first bar after its day. On each of
    ``h`` bars the stop comes before the target; a gap fills at the open; the
    close of the last bar ends it: 'win' or 'loss' by the return after cost.
    Until then it is 'open', with its value at the last close. Picks without a
    later bar, with an entry that isn't positive or of an unknown code are
    'open' with nulls. The bars of a pick are found by number: an equi-join.
    """
    b = bars.select("code", "date", "open", "high", "low", "close").withColumn("rn", F.row_number().over(by_code()))
    p = asof_backward(picks.select("id", "code", "date", "target", "stop", "h"), b.select("code", "date", F.col("rn").alias("at")), "at")
    p = p.withColumnRenamed("date", "picked").withColumn("at", F.coalesce("at", F.lit(0)))
    path = p.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("h")))).withColumn("rn", F.col("at") + F.col("k")).join(b, ["code", "rn"])
    path = path.where(F.col("date") <= F.date_add("picked", F.col("h") * DAYS_A_BAR))
    first = lambda on: F.min(F.when(on, F.struct("k", "open", "close", "date")))
    g = path.groupBy("id").agg(
        F.min_by("open", "k").alias("entry"), F.count(F.lit(1)).cast("int").alias("n"), first(F.col("low") <= F.col("stop")).alias("down"), first(F.col("high") >= F.col("target")).alias("up"),
        first(F.col("k") == F.col("h")).alias("end"), F.max_by("close", "k").alias("last"),
    )
    x = p.select("id", "code", "target", "stop", "h").join(g, "id", "left").withColumn("entry", F.when(F.col("entry") > 0, F.col("entry")))
    down, up = F.col("down"), F.col("up")
    stopped = down.isNotNull() & (down["k"] <= F.coalesce(up["k"], down["k"]))
    at = F.when(stopped, down).when(up.isNotNull(), up).otherwise(F.col("end"))
    price = F.when(stopped, F.least(down["open"], F.col("stop"))).when(up.isNotNull(), F.greatest(up["open"], F.col("target"))).otherwise(F.col("end.close"))
    x = x.withColumns({"__at": at, "__price": price}).withColumn("__ret", F.col("__price") / F.col("entry") - 1 - cost)
    done = F.col("entry").isNotNull() & F.col("__at").isNotNull()
    return x.select(
        "id", "code", F.when(done, F.when(F.col("__ret") > 0, "win").otherwise("loss")).otherwise("open").alias("status"), "entry",
        F.when(done, F.col("__at.date")).alias("exit_date"), F.when(done, F.col("__price")).alias("exit"),
        F.when(done, F.col("__ret")).when(F.col("entry").isNotNull(), F.col("last") / F.col("entry") - 1).alias("ret"),
        F.when(F.col("entry").isNotNull(), F.when(done, F.col("__at.k")).otherwise(F.col("n"))).cast("int").alias("days"),
    )


def ledger_summary(scored: DataFrame) -> DataFrame:
    """Picks in all, closed and open, with the share of wins, mean return and days of the closed ones."""
    closed = F.col("status") != "open"
    of = lambda x: F.avg(F.when(closed, x))
    return scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(closed).alias("closed"), F.count_if(~closed).alias("open"), of((F.col("ret") > 0).cast("double")).alias("win"), of(F.col("ret")).alias("mean"), of(F.col("days").cast("double")).alias("days"))


def stream_scores(bars: DataFrame, picks: DataFrame, cost: float = COST, late: str = "1 day") -> DataFrame:
    """Closed picks, as ``score_picks`` has them, from a stream of ``bars`` (with ``ts``, the day as a timestamp).

    The stream meets the picks in a stream-static join; a pick's state is its
    entry, bars so far and whether it is over. Bars of a code must come in day
    order from batch to batch (within one they are sorted). A timer past the
    pick's last day drops its state.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    own = picks.select("id", "code", F.col("date").alias("picked"), "target", "stop", "h")
    rows = bars.withWatermark("ts", late).join(own, "code").where((F.col("date") > F.col("picked")) & (F.col("date") <= F.date_add("picked", F.col("h") * DAYS_A_BAR)))

    def score(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        bars_ = pd.concat(list(frames)).sort_values("date")
        entry, days, over = state.get if state.exists else (None, 0, False)
        out = None
        for r in bars_.itertuples():
            if over:
                break
            days += 1
            entry = float(r.open) if days == 1 else entry
            if not entry > 0:
                over = True
                break
            price = min(r.open, r.stop) if r.low <= r.stop else max(r.open, r.target) if r.high >= r.target else r.close if days == r.h else None
            if price is not None:
                ret, over = float(price) / entry - 1 - cost, True
                out = (key[0], r.code, "win" if ret > 0 else "loss", entry, r.date, float(price), ret, days)
        state.update((entry, days, over))
        last = bars_.iloc[0]
        state.setTimeoutTimestamp(int((pd.Timestamp(last.picked) + pd.Timedelta(days=int(last.h) * DAYS_A_BAR + 2)).value // 1_000_000))
        if out:
            yield pd.DataFrame([out], columns=["id", "code", "status", "entry", "exit_date", "exit", "ret", "days"])

    return rows.groupBy("id").applyInPandasWithState(score, SCORED, "entry double, days int, over boolean", "append", GroupStateTimeout.EventTimeTimeout)
