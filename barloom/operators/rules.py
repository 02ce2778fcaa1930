"""Choice of trading rules: conjunctions of conditions, their duplicates, their exits, and today's signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.expr import by_code
from barloom.operators.exits import barrier_grid

#: Rows of a code before its rules count.
WARM = 130
#: Targets and stops in ATR, in the order in which equal results are preferred.
TARGETS, STOPS = (1.5, 2.0, 2.5, 3.0, 4.0), (1.0, 1.5, 2.0, 2.5)


def condition_bits(names: list[str]) -> Column:
    """The conditions of a row as a bit mask, in their order."""
    if len(names) > 62:
        raise ValueError("at most 62 conditions")
    zero = F.lit(0).cast("long")
    return sum((F.when(F.col(x), F.lit(1 << i).cast("long")).otherwise(zero) for i, x in enumerate(names)), zero)


def rule_name(mask: Column, names: list[str]) -> Column:
    return F.concat_ws("+", *[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(x)) for i, x in enumerate(names)])


def onset_masks(d: DataFrame, most: int = 3, quiet: int = 5, warm: int = WARM) -> DataFrame:
    """A row for each row and mask of one to ``most`` conditions of ``bits`` that begins there: not all set in the ``quiet`` rows before.

    Only conditions that hold are combined, in the row itself. The first
    ``quiet`` + 1 rows of a code and the rows before ``warm`` begin nothing.
    """
    if not 1 <= most <= 3:
        raise ValueError("one to three conditions")
    bits = F.col("bits")
    d = d.withColumns({"__before": F.collect_list("bits").over(by_code(-quiet, -1)), "__rn": F.row_number().over(by_code())})
    d = d.where((bits != 0) & (F.col("__rn") > max(quiet + 1, warm)))
    d = d.withColumn("__one", F.filter(F.transform(F.sequence(F.lit(0), F.lit(61)), lambda i: F.pow(F.lit(2.0), i).cast("long")), lambda m: m.bitwiseAND(bits) != 0))
    wider = lambda below: F.flatten(F.transform(below, lambda c: F.transform(F.filter("__one", lambda m: m > c), lambda m: m.bitwiseOR(c))))
    levels = ["__one"]
    for k in range(1, most):
        d = d.withColumn(f"__l{k}", wider(F.col(levels[-1])))
        levels.append(f"__l{k}")
    new = F.filter(F.concat(*levels), lambda m: ~F.exists("__before", lambda b: b.bitwiseAND(m) == m))
    return d.withColumn("mask", F.explode(new)).drop("__before", "__rn", *levels)


def rule_stats(d: DataFrame, by: list[str]) -> DataFrame:
    """Counts, shares of gains, means and lower bounds of ``ret`` by rule; ``early`` parts the days that rules are chosen on."""
    early, r = F.col("early"), F.col("ret")
    gain, n = (r > 0).cast("double"), F.count(F.lit(1))
    part = lambda x: F.when(early, x)
    late = lambda x: F.when(~early, x)
    return d.groupBy(*by).agg(
        n.alias("n"), F.avg(gain).alias("win"), F.avg(r).alias("mean"), F.avg(F.col("hit").cast("double")).alias("hit"),
        F.count_if(early).alias("n_early"), F.avg(part(gain)).alias("win_early"), F.avg(part(r)).alias("mean_early"),
        F.count_if(~early).alias("n_late"), F.avg(late(gain)).alias("win_late"), F.avg(late(r)).alias("mean_late"),
        (F.avg(r) - 1.64 * F.stddev_pop(r) / F.sqrt(n)).alias("score"),
    )


def distinct_rules(stats: DataFrame, most: int = 10) -> DataFrame:
    """The best rules by ``score`` of which none holds another's conditions or has its very results; ``place`` from 1.

    The list of rules is bounded by the number of conjunctions, not by the
    data, so it is folded as one array: a rule is taken if no taken one is a
    subset or superset, until there are ``most``.
    """
    rule = F.struct((-F.round("score", 12)).alias("key"), "mask", F.concat_ws("|", "n", F.round("win", 4), F.round("mean", 5)).alias("same"))
    listed = stats.agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    none = F.array().cast("array<struct<key:double,mask:bigint,same:string>>")

    def take(taken, x):
        both = lambda t: t["mask"].bitwiseAND(x["mask"])
        clash = F.exists(taken, lambda t: (both(t) == t["mask"]) | (both(t) == x["mask"]) | (t["same"] == x["same"]))
        return F.when((F.size(taken) >= most) | clash, taken).otherwise(F.array_append(taken, x))

    return listed.select(F.posexplode(F.aggregate("rules", none, take)).alias("place", "rule")).select((F.col("place") + 1).alias("place"), F.col("rule.mask").alias("mask"))


def exit_grid() -> Column:
    return F.array(*[F.struct(F.lit(t).alias("target"), F.lit(s).alias("stop")) for t in TARGETS for s in STOPS])


def tuned_rules(events: DataFrame, rules: DataFrame, h: int, least_early: int, cost: float) -> DataFrame:
    """``rules (place, mask)`` with the cell of the exit grid that earns most on early days, and their results under it.

    ``events`` are the rules' signals with the bars ahead; each meets the grid
    in its row, and all cells of a rule meet in one aggregation.
    """
    cells = barrier_grid(events, h, exit_grid(), cost=cost)
    stats = rule_stats(cells.join(F.broadcast(rules), "mask"), ["place", "mask", "kt", "ks"])
    order = [F.desc(F.round("mean_early", 12)), "kt", "ks"]
    best = stats.where(F.col("n_early") >= least_early).withColumn("__k", F.row_number().over(W.partitionBy("place").orderBy(*order))).where("__k = 1").drop("__k")
    # equal results under the best exits: the better place stays
    same = W.partitionBy("n", F.round("win", 4), F.round("mean", 5)).orderBy("place")
    best = best.withColumn("__k", F.row_number().over(same)).where("__k = 1 and mean_early > 0 and mean_late > 0").drop("__k")
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("mean_late", 12)), F.desc(F.round("mean", 12)), "place")))


def fresh_signals(d: DataFrame, chosen: DataFrame, fresh: int = 3, quiet: int = 5, warm: int = WARM) -> DataFrame:
    """Codes whose last bar is the last day and holds a chosen rule that began in the last ``fresh`` bars; the first rule by ``rank`` wins.

    ``chosen`` is a list of rules of bounded length. Returns ``code, date, rank, mask, days_ago``.
    """
    past = fresh + quiet
    d = d.withColumns({"__bits": F.collect_list("bits").over(by_code(-(past - 1), 0)), "__rn": F.row_number().over(by_code()), "__left": F.row_number().over(W.partitionBy("code").orderBy(F.desc("date")))})
    last = d.where("__left = 1").withColumn("__day", F.max("date").over(W.partitionBy())).where("date = __day").drop("__day", "__left")
    rows = last.join(F.broadcast(chosen.select("rank", "mask")), F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    held = lambda n: F.get("__bits", n).bitwiseAND(F.col("mask")) == F.col("mask")
    size = F.size("__bits")
    # of the last bars, those that hold the rule after ``quiet`` bars without it
    began = F.filter(
        F.sequence(F.lit(0), F.lit(fresh - 1)),
        lambda ago: (F.col("__rn") - ago > max(quiet + 1, warm)) & (size - 1 - ago >= quiet) & held(size - 1 - ago) & ~F.exists(F.slice("__bits", size - ago - quiet, quiet), lambda b: b.bitwiseAND(F.col("mask")) == F.col("mask")),
    )
    rows = rows.withColumn("days_ago", F.array_min(began)).where("days_ago is not null")
    rows = rows.withColumn("__k", F.row_number().over(W.partitionBy("code").orderBy("rank"))).where("__k = 1")
    return rows.select("code", "date", "rank", "mask", "days_ago")
