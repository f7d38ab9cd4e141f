"""Ranks and dense numbers that no single task computes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivaq.session import saved


def dense_numbers(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the number, from 0, of each row in the order: rows are range-partitioned, numbered within, and shifted by the counts of the partitions before."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = saved(parts.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m"), "numbered")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_c"))  # a row for each partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    return parts.join(F.broadcast(start), "_p").withColumn(name, F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


def last_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key that comes last; a partial aggregate, so copies are dropped before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*keys, *[F.col("_v").getField(c).alias(c) for c in rest])


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first k rows of each group with their rank from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
