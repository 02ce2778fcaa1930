"""Helpers shared by the operators of this subpackage.

Work that has to be cut from its lineage goes to the folder that the session
names in ``spark.checkpoint.dir``; a folder of our own is set only where that
setting is absent and driver and tasks are one process (local tests).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
#: Edges that one task contracts, about.
TASK_EDGES = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, what: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but compressed and with column
    pruning for whoever reads it next.
    """
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint (shared folder), for small intermediate tables."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make):
    """``make()``, kept in a Python worker for its next tasks, until another key is asked for.

    One operator's tables at a time: a worker outlives the stages of a
    pipeline and would otherwise hold those of all of them.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda variable is the one public way to name an intermediate value
    inside a single expression, which keeps Catalyst from inlining it twice.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all other characters unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _stars(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars ``(u, v)`` around the smallest nodes of their components there."""

    def contract(batches):
        import numpy as np
        import pyarrow as pa

        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        stars = np.array([(x, root(x)) for x in list(parent)], np.int64).reshape(-1, 2)
        stars = stars[stars[:, 0] != stars[:, 1]]
        for at in range(0, len(stars), 1 << 16):
            some = stars[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some[:, 0].copy()), pa.array(some[:, 1].copy())], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(contract, "u long, v long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a long, b long)``.

    The edges are contracted to stars in partitions of about TASK_EDGES of
    them, which saves most of the rounds (and the stages and tasks that the
    driver keeps account of). Then alternating large-star and small-star rounds: every round is one min
    aggregation (partial sums before the shuffle) and one equi-join, so a hot
    centre is split by the adaptive skew join and no component is ever
    gathered in one task or on the driver.

    Returns ``(node long, component long)`` for every node of an edge, the
    component being its smallest node. Null ends and self loops are ignored.
    An empty input gives an empty result. Raises if ``max_rounds`` rounds do
    not reach the fixed point (components need O(log^2 n) rounds).
    """
    now = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    tasks = max(1, -(-now.count() // TASK_EDGES))
    now = stored(_stars(now.coalesce(tasks)), "edges")
    state = _fingerprint(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now = stored(small, "edges")
        after = _fingerprint(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("connected components did not converge")
    centres = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return int(row["n"]), int(row["s"] or 0)
