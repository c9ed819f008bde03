"""Numbering, batching and limits in a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.sources.tables import materialised


def numbered(df: DataFrame, *order: str, into: str = "nth") -> DataFrame:
    """df with each row's rank from 1. Ranges of the order are ranked in parallel; only their sizes, one row a range, are summed in one task."""
    ranged = materialised(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_range").withColumn(into, F.col("_start") + within).drop("_range", "_start")  # as many rows as partitions


def limited(df: DataFrame, ordinal: str, n: int = 0) -> DataFrame:
    """Rows whose ordinal, counted from 0, is below n; all for 0. Unlike limit(), reruns agree."""
    return df.filter(F.col(ordinal) < n) if n else df


def limited_by(df: DataFrame, group: str, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")


def named(df: DataFrame, key: str, names: str | None) -> DataFrame:
    """Rows whose key is in a comma-separated list; spaces around names don't count, no list keeps all."""
    wanted = [n.strip() for n in (names or "").split(",") if n.strip()]
    return df.filter(F.col(key).isin(wanted)) if wanted else df


def batches(df: DataFrame, key: str, size: int, seed: int | None = None, drop_last: bool = False) -> DataFrame:
    """With batch from 0 and place in it: in the order of key, or with a seed in an order that depends on seed and key only. drop_last leaves out a last batch that isn't full."""
    if seed is not None:
        df = df.withColumn("_order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    out = numbered(df, *(["_order", key] if seed is not None else [key]), into="_nth")
    out = out.withColumns({"batch": F.floor((F.col("_nth") - 1) / size), "place": (F.col("_nth") - 1) % size})
    if drop_last:
        full = out.groupBy("batch").count().filter(F.col("count") == size)
        out = out.join(full.select("batch"), "batch", "left_semi")
    return out.drop("_nth", "_order")
