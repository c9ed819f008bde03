"""Pixel measures: counts, rollups, histograms, threshold curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.measures import at_least, confusion, ratios

ALL = "ALL"


def counted(cells: DataFrame, *keys: str, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn of cells (byte, truth) by keys."""
    return cells.groupBy(*keys).agg(*confusion(at_least(F.col("byte"), threshold), F.col("truth")))


def finished(counts: DataFrame) -> DataFrame:
    return counts.withColumns(ratios(F.col("tp"), F.col("fp"), F.col("fn")))


def summarised(counts: DataFrame, group: str) -> DataFrame:
    """Pooled counts of every group and of ALL, with their ratios: counts are summed first."""
    sums = [F.sum(c).cast("long").alias(c) for c in counts.columns if c in ("tp", "fp", "fn", "tn")]
    rolled = counts.rollup(group).agg(F.grouping(group).alias("g"), *sums)
    return finished(rolled.withColumn("grp", F.when(F.col("g") == 1, ALL).otherwise(F.col(group))).drop("g", group))


def histogram(cells: DataFrame, group: str) -> DataFrame:
    """grp, bin, pos, neg: all 256 bins of every group and of ALL."""
    return binned(cells.groupBy(group, "byte").agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg")), group)


def binned(counts: DataFrame, group: str) -> DataFrame:
    """histogram() of counts (group, byte, pos, neg)."""
    twice = counts.select(F.explode(F.array(F.col(group), F.lit(ALL))).alias("grp"), "byte", "pos", "neg")
    merged = twice.groupBy("grp", F.col("byte").alias("bin")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    bins = merged.select("grp").distinct().select("grp", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("bin"))
    return bins.join(merged, ["grp", "bin"], "left").fillna(0, ["pos", "neg"])


def curve(bins: DataFrame) -> DataFrame:
    """One row for each threshold bin: suffix sums over one pass of the histogram instead of 256 scans."""
    down = Window.partitionBy("grp").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("grp")
    tp = F.sum("pos").over(down)
    out = bins.select("grp", "bin", (F.col("bin") / 255.0).alias("threshold"), tp.alias("tp"), F.sum("neg").over(down).alias("fp"), (F.sum("pos").over(whole) - tp).alias("fn"))
    return finished(out)


def best(curves: DataFrame, default_bin: int = 128) -> DataFrame:
    """The threshold of the highest IoU of each group, the lowest on a tie, and the IoU at default_bin."""
    top = F.max_by(F.struct("bin", "iou"), F.struct("iou", -F.col("bin")))
    return curves.groupBy("grp").agg(top.alias("top"), F.max(F.when(F.col("bin") == default_bin, F.col("iou"))).alias("iou_default")).select(
        "grp", F.col("top.bin").alias("best_bin"), F.col("top.iou").alias("best_iou"), "iou_default", (F.col("top.iou") - F.col("iou_default")).alias("gain")
    )


def macro(counts: DataFrame, group: str, value: str = "iou") -> DataFrame:
    """Per group the mean of its units' ratios next to the ratio of its pooled counts."""
    units = finished(counts).groupBy(group).agg(F.count("*").alias("units"), F.avg(value).alias("macro"))
    pooled = finished(counts.groupBy(group).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])).select(group, F.col(value).alias("micro"))
    return units.join(pooled, group)
