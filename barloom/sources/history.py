"""Stored histories: merging new bars with split detection, a partitioned store, and columnar rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = ["code", "date", "open", "high", "low", "close", "volume"]
#: A close that differs by more than this on a day both sides have means that the past was adjusted.
TOLERANCE = 0.005
#: Histories whose median close is under this are kept in hundredths.
SMALL = 1000.0


def merge_bars(old: DataFrame, recent: DataFrame, full: DataFrame, since: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``old`` bars brought up to date with ``recent`` ones, code by code.

    Where a day of both differs by more than ``tolerance`` in its close, the
    code's past was adjusted (a split) and all its bars come from ``full``.
    Elsewhere a day's recent bar replaces the old one. Bars before ``since``
    and those without a positive close and volume are left out; null codes and
    days too. Codes of ``full`` that neither side has stay out.
    """
    old, recent, full = (d.select(*BARS).where("code is not null and date is not null") for d in (old, recent, full))
    overlap = old.select("code", "date", "close").join(recent.select("code", "date", F.col("close").alias("__now")), ["code", "date"])
    split = overlap.where(F.abs(F.try_divide("__now", "close") - 1) > tolerance).select("code").distinct()
    # one row a code: the join is broadcast or not by its measured size
    both = old.withColumn("__new", F.lit(0)).unionByName(recent.withColumn("__new", F.lit(1))).join(split, "code", "left_anti")
    last = both.groupBy("code", "date").agg(F.max_by(F.struct(*BARS[2:]), "__new").alias("__b")).select("code", "date", "__b.*")
    out = last.unionByName(full.join(split, "code", "left_semi").dropDuplicates(["code", "date"])).where("close > 0 and volume > 0")
    return out.where(F.col("date") >= F.lit(since).cast("date")) if since else out


def write_history(bars: DataFrame, path: str) -> None:
    """A folder a code, each sorted by day: a code's bars are read without the others'. Replaces the codes that ``bars`` has."""
    ordered = bars.select(*BARS).repartition("code").sortWithinPartitions("code", "date")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("code").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("open double, high double, low double, close double, volume double, date date, code string").parquet(path).select(*BARS)


def upsert_history(spark: SparkSession, path: str, recent: DataFrame, full: DataFrame, staging: str, since: str | None = None) -> None:
    """Merge ``recent`` into the store at ``path``; only the codes it has are read and written.

    The merged bars are written to ``staging`` (a new path in a shared folder)
    first: a job that is lost half-way leaves the store as it was or replaces
    each code as a whole, and may simply be run again.
    """
    codes = recent.select("code").distinct()
    old = read_history(spark, path).join(codes, "code", "left_semi")
    merge_bars(old, recent, full, since).write.parquet(staging)
    write_history(spark.read.parquet(staging), path)


def stream_upserts(stream: DataFrame, path: str, full, staging_folder: str):
    """A writer that merges each micro-batch of bars; ``full`` is called for the whole source. Batches may repeat: the merge is idempotent."""

    def each(batch: DataFrame, number: int) -> None:
        import uuid

        if not batch.isEmpty():
            upsert_history(batch.sparkSession, path, batch, full(batch.sparkSession), f"{staging_folder.rstrip('/')}/batch-{number}-{uuid.uuid4().hex}")

    return stream.writeStream.foreachBatch(each)


def columnar(bars: DataFrame) -> DataFrame:
    """One row a code: ``scale``, days as integers (yyyymmdd) and prices and volumes as integer arrays in day order.

    Prices are rounded (halves to the even neighbour) to wholes, or to
    hundredths where the median close is under SMALL (``scale`` 100). A missing
    or non-positive open, high or low is the close; bars without a finite close
    or volume are left out. A code's series is bounded by its calendar.
    """
    finite = lambda x: F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    price = lambda x: F.when(finite(x) & (F.col(x) > 0), F.col(x)).otherwise(F.col("close"))
    d = bars.where(finite("close") & finite("volume")).select("code", "date", *[price(x).alias(x) for x in ("open", "high", "low")], "close", "volume")
    scales = d.groupBy("code").agg(F.when(F.median("close") < SMALL, F.lit(100)).otherwise(F.lit(1)).alias("scale"))
    number = lambda x: F.bround(F.col(x) * F.col("scale")).cast("long")
    row = F.struct(F.date_format("date", "yyyyMMdd").cast("int").alias("t"), number("open").alias("o"), number("high").alias("h"), number("low").alias("l"), number("close").alias("c"), F.col("volume").cast("long").alias("v"))
    g = d.join(scales, "code").groupBy("code", "scale").agg(F.sort_array(F.collect_list(row)).alias("r"))
    return g.select("code", "scale", *[F.col(f"r.{k}").alias(k) for k in "tohlcv"])


def from_columnar(rows: DataFrame) -> DataFrame:
    """The bars of ``columnar`` rows, to the digits that were kept."""
    r = rows.select("code", "scale", F.inline(F.arrays_zip(*"tohlcv")))
    day = F.to_date(F.col("t").cast("string"), "yyyyMMdd")
    return r.select("code", day.alias("date"), *[(F.col(k) / F.col("scale")).alias(x) for k, x in zip("ohlc", ("open", "high", "low", "close"))], F.col("v").cast("double").alias("volume"))


def write_json(d: DataFrame, path: str, by: str) -> None:
    """JSON lines in a folder for each value of ``by``; numbers that JSON can't hold are null."""
    for name, kind in d.dtypes:
        if kind in ("double", "float"):
            d = d.withColumn(name, F.when(~F.isnan(name) & (F.abs(name) < float("inf")), F.col(name)))
    d.repartition(by).write.mode("overwrite").partitionBy(by).json(path)
