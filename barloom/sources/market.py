"""Market tables derived from the given star schema: bars, listing, flows, index.

``bars (code, date, open, high, low, close, volume, amount)`` is one row for
each brand and shipping day; a line's unit price is a trade, in line order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars. The parts join on their key; days and codes are aggregated with partial sums."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        line.where("l_quantity > 0")
        .join(part, line["l_partkey"] == part["p_partkey"])
        .groupBy(F.col("p_brand").alias("code"), F.to_date("l_shipdate").alias("date"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
        )
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each code: market, theme and size."""
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_brand").alias("code")).agg(
        F.max(F.when(F.substring("p_brand", -1, 1).cast("int") % 2 == 0, "KOSPI").otherwise("KOSDAQ")).alias("market"),
        F.min("p_type").alias("theme"),
        F.sum(F.round(F.col("p_retailprice") * 100).cast("long") * F.col("p_size")).alias("marcap"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net buying of each investor group: code, date, investor, net (returned lines are sales), in cents."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return (
        line.join(part, line["l_partkey"] == part["p_partkey"])
        .join(orders, line["l_orderkey"] == orders["o_orderkey"])
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("p_brand").alias("code"), F.to_date("l_shipdate").alias("date"), F.col("c_mktsegment").alias("investor"))
        .agg(F.sum(F.when(F.col("l_returnflag") == "R", -cents).otherwise(cents)).alias("net"))
    )
