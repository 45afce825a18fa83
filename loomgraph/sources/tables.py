"""Graphs derived from relational tables: (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's user after the user of the event before, in order of time.

    A lag over one global order would put all events into one task. Events are dealt by day instead, and the first of
    a day follows the last of the latest earlier day, of which there is one row a day.
    """
    e = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", F.to_date("ts").alias("day"))
    inner = Window.partitionBy("day").orderBy("ts", "event_id")
    last = e.groupBy("day").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    before = last.select("day", F.lag("last").over(Window.orderBy("day")).alias("earlier"))
    linked = e.withColumn("prev", F.lag("user_id").over(inner)).join(before, "day")
    return linked.select(F.coalesce("prev", "earlier").alias("src"), F.col("user_id").alias("dst"),
                         (F.floor("value").cast("long") % 128 + 1).alias("weight")).where("src is not null")


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to suppliers, whose ids follow those of the parts: bipartite."""
    high = _table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    return part_supp_raw(spark, sf_dir).withColumn("dst", F.col("dst") + F.lit(high + 1))


def part_supp_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").cast("long").alias("weight"))


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("weight"))


def order_cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), (F.col("o_orderkey") % 128 + 1).alias("weight"))
