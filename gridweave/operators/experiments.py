"""Experiment tables: upserts, deltas, ladders, schedules, losses and report text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.measures import focal, tversky_index
from gridweave.operators.ordering import numbered


def upserted(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with those of new, which replace rows of the same key."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def remaining(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti")


def deltas(rows: DataFrame, key: str, baseline: str, value: str) -> DataFrame:
    """value less that of the baseline row; no rows if there is none."""
    base = rows.filter(F.col(key) == baseline).select(F.col(value).alias("base")).limit(1)
    return rows.crossJoin(F.broadcast(base)).withColumn("delta", F.col(value) - F.col("base")).drop("base")  # one row


def by_place(rows: DataFrame, key: str, order: list[str], unknown: int = 99) -> DataFrame:
    """With place: the key's position in order, unknown if it isn't there."""
    at = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(key))
    return rows.withColumn("place", F.when(at > 0, at - 1).otherwise(F.lit(unknown)).cast("int"))


def cumulative(rows: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """With items: all items of the group up to each row, joined by a comma."""
    so_far = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("items", F.array_join(F.collect_list(item).over(so_far), ","))


def warmup_cosine(step: Column, warmup: int, total: int) -> Column:
    """Share of the learning rate: linear up to warmup, then half a cosine down to 0 at total."""
    along = F.least(F.lit(1.0), (step - warmup).cast("double") / max(1, total - warmup))
    return F.when(step < warmup, step.cast("double") / max(1, warmup)).otherwise(F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * along)))


def running_best(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """With best (so far) and improved (strictly above all before)."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    was = F.max(value).over(before)
    return rows.withColumn("improved", was.isNull() | (F.col(value) > was)).withColumn("best", F.greatest(F.col(value), F.coalesce(was, F.col(value))))


def round_robin(rows: DataFrame, group: str, order: str) -> DataFrame:
    """With turn: rows taken from the groups in turns, groups by name."""
    return numbered(rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(order))), "nth", group, into="turn")


def soft_dice(p: Column, y: Column) -> Column:
    """Aggregate: 1 - (2 sum py + 1) / (sum p + sum y + 1)."""
    return 1 - (2 * F.sum(p * y) + 1) / (F.sum(p) + F.sum(y) + 1)


def focal_tversky(p: Column, y: Column, alpha: float = 0.3, beta: float = 0.7, gamma: float = 4 / 3) -> Column:
    """Aggregate: the focal Tversky loss of one tile and channel."""
    return focal(tversky_index(F.sum(p * y), F.sum(p * (1 - y)), F.sum((1 - p) * y), alpha, beta), gamma)


def markdown_cell(value: Column) -> Column:
    return F.format_string("%.4f", value)


def markdown(df: DataFrame, columns: list[str]) -> str:
    """A small result as a Markdown table: floats to 4 places, the rest as text; missing columns are left out."""
    names = [c for c in columns if c in df.columns]
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    for row in df.select(*names).collect():
        lines.append("| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in row) + " |")
    return "\n".join(lines)
