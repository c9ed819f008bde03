"""Raster operators over cells (scene, row, col), windows and bands."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators.graphs import least_ids
from gridweave.operators.kernels import labels
from gridweave.sources.tables import materialised

CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
SQUARE = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1))


def ellipse(d: int) -> tuple[tuple[int, int], ...]:
    """Offsets of the (2 d + 1)^2 elliptical structuring element: in row r, columns up to round(d sqrt(1 - r^2 / d^2))."""
    return tuple((r, c) for r in range(-d, d + 1) for w in [round(d * math.sqrt(max(0.0, 1 - (r / d) ** 2))) if d else 0] for c in range(-w, w + 1))


def eroded(cells: DataFrame, element: tuple[tuple[int, int], ...] = SQUARE) -> DataFrame:
    """Cells (scene, row, col) all of whose neighbours by element are there; outside is background.

    Every cell votes for the cells it could keep, and those with all votes stay: one hash
    aggregation, no self-join.
    """
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in element])
    votes = cells.select("scene", "row", "col", F.explode(moves).alias("m")).select("scene", (F.col("row") - F.col("m.r")).alias("row"), (F.col("col") - F.col("m.c")).alias("col"))
    return votes.groupBy("scene", "row", "col").count().filter(F.col("count") == len(element)).drop("count")


def boundary_band(cells: DataFrame, element: tuple[tuple[int, int], ...]) -> DataFrame:
    """Cells that erosion takes away."""
    return cells.join(eroded(cells, element), ["scene", "row", "col"], "left_anti")


def band_counts(pred: DataFrame, truth: DataFrame, d: int) -> DataFrame:
    """scene, d, tp, fp, fn of the boundary bands of width d."""
    a = boundary_band(pred, ellipse(d)).withColumn("p", F.lit(True))
    b = boundary_band(truth, ellipse(d)).withColumn("t", F.lit(True))
    both = a.join(b, ["scene", "row", "col"], "full")
    return both.groupBy("scene").agg(F.lit(d).alias("d"), F.count_if(F.col("p") & F.col("t")).alias("tp"), F.count_if(F.col("p") & F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull() & F.col("t")).alias("fn"))


def components(cells: DataFrame, eight: bool = False, size: int = 1024) -> DataFrame:
    """Cells with label: the least row * 2^31 + col of their 4- or 8-connected component.

    Squares of size x size cells are labelled each in a task; only labels that touch across the edge of
    a square are linked, and graphs.least_ids() follows the links in few rounds.
    """

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        top, left = rows["row"].min(), rows["col"].min()
        at = (rows["row"] - top).to_numpy(), (rows["col"] - left).to_numpy()
        mask = np.zeros((at[0].max() + 1, at[1].max() + 1), bool)
        mask[at] = True
        found = labels.components(mask, eight)
        ids = np.full(found.max() + 1, np.iinfo(np.int64).max)
        own = found[at]
        np.minimum.at(ids, own, rows["row"].to_numpy(np.int64) * (1 << 31) + rows["col"].to_numpy(np.int64))
        return rows[["scene", "row", "col"]].assign(id=ids[own])

    kinds = dict(cells.dtypes)
    square = [F.floor(F.col(c) / size).alias(f"{c}_square") for c in ("row", "col")]
    runs = cells.select("scene", "row", "col", *square).groupBy("scene", "row_square", "col_square").applyInPandas(label, f"scene {kinds['scene']}, row {kinds['row']}, col {kinds['col']}, id long")
    runs = materialised(runs)
    last = lambda c: F.pmod(F.col(c), F.lit(size)) == size - 1
    step = lambda r, c: F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col"))
    sides = (-1, 0, 1) if eight else (0,)
    to = F.concat(F.when(last("row"), F.array(*[step(1, c) for c in sides])).otherwise(F.array()), F.when(last("col"), F.array(*[step(r, 1) for r in sides])).otherwise(F.array()), *([F.when(F.pmod(F.col("col"), F.lit(size)) == 0, F.array(step(1, -1), step(-1, -1))).otherwise(F.array())] if eight else []))
    ways = runs.filter(last("row") | last("col") | (F.pmod(F.col("col"), F.lit(size)) == 0)).select("scene", F.col("id").alias("b"), F.explode(to).alias("t")).select("scene", "t.row", "t.col", "b")
    links = runs.join(ways, ["scene", "row", "col"]).select("scene", F.col("id").alias("a"), "b")
    moved = least_ids(links).withColumnRenamed("least", "label")
    return runs.join(moved, ["scene", "id"], "left").select("scene", "row", "col", F.coalesce("label", "id").alias("label"))


def without_small(labelled: DataFrame, least: int = 16) -> DataFrame:
    """Labelled cells of components of at least that many cells."""
    large = labelled.groupBy("scene", "label").count().filter(F.col("count") >= least)
    return labelled.join(large, ["scene", "label"], "left_semi")


def mean_pool(cells: DataFrame, value: str, size: int) -> DataFrame:
    return cells.groupBy("scene", F.floor(F.col("row") / size).cast("int").alias("row"), F.floor(F.col("col") / size).cast("int").alias("col")).agg(F.avg(value).alias("mean"))


def top_window(pooled: DataFrame) -> DataFrame:
    """Of each scene the pooled cell of the highest mean above 0, the first by row and column on a tie."""
    order = Window.partitionBy("scene").orderBy(F.desc("mean"), "row", "col")
    return pooled.filter("mean > 0").withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def densest_window(pooled: DataFrame, side: int) -> DataFrame:
    """scene, row, col, mean of the side x side window of pooled cells of the highest mean above 0, the first by row and column on a tie.

    Windows start at every half side and end before the last cell; cells that aren't there count as 0.
    Each cell goes to the at most nine windows that hold it, in one aggregation.
    """
    step = max(1, side // 2)
    sizes = pooled.groupBy("scene").agg(F.max("row").alias("bottom"), F.max("col").alias("right"))

    def starts(at: str, end: str) -> Column:
        least = F.greatest(F.lit(0), F.ceil((F.col(at) - side + 1) / step).cast("int"))
        every = F.transform(F.sequence(least, F.floor(F.col(at) / step).cast("int")), lambda k: k * step)
        return F.filter(every, lambda s: (s == 0) | (s < F.col(end) + 1 - side))

    held = pooled.join(sizes, "scene").select("scene", "mean", F.explode(starts("row", "bottom")).alias("row"), "col", "right").select("scene", "mean", "row", F.explode(starts("col", "right")).alias("col"))
    return top_window(held.groupBy("scene", "row", "col").agg(F.round(F.sum("mean") / (side * side), 9).alias("mean")))


def visible(ring: Column, top: Column, left: Column, size: int) -> Column:
    """Whether a ring's box, in pixels, meets the crop of size x size at top, left."""
    side = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return (side(F.array_max, "x") >= left) & (side(F.array_min, "x") <= left + size) & (side(F.array_max, "y") >= top) & (side(F.array_min, "y") <= top + size)


def window_starts(total: Column, tile: int, stride: int) -> Column:
    """Starts of windows along an axis: regular ones, and one flush with the end if they don't reach it; 0 if one window covers all."""
    regular = F.sequence(F.lit(0), F.greatest(total - tile, F.lit(0)), F.lit(stride))
    return F.when(total <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, F.array((total - tile).cast("int")))))


def taper(size: int, overlap: int, symmetric: bool = True) -> np.ndarray:
    """Weights along one axis of a window, at least 1e-3.

    A half cosine rises over 2 * overlap samples from 0 to pi; its first half weighs the leading edge, and mirrored
    the trailing one. Without symmetric its second half weighs the trailing edge, as published.
    """
    w = np.ones(size)
    if overlap > 0:
        ramp = 0.5 - 0.5 * np.cos(np.linspace(0, np.pi, 2 * overlap))
        w[:overlap] = ramp[:overlap]
        w[-overlap:] = ramp[:overlap][::-1] if symmetric else ramp[overlap:]
    return np.maximum(w, 1e-3)


def taper_column(offset: Column, size: int, overlap: int) -> Column:
    """taper() with symmetric as an expression of the offset in a window."""
    edge = F.least(offset, F.lit(size - 1) - offset)
    rise = 0.5 - 0.5 * F.cos(F.lit(math.pi) * edge / (2 * overlap - 1))
    return F.greatest(F.lit(1e-3), F.when(edge < overlap, rise).otherwise(F.lit(1.0)))


def blended(windows: DataFrame, *keys: str) -> DataFrame:
    """Overlap-weighted mean of (value, weight) by keys, clipped to [0, 1]."""
    mean = F.sum(F.col("value") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-6))
    return windows.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("blend"), F.count("*").alias("windows"))


def turned(n: int, op: int, row: Column, col: Column) -> tuple[Column, Column]:
    """Where a cell of an n x n tile goes under op 0..7: flip columns if op >= 4, then op % 4 quarter turns against the clock."""
    if op >= 4:
        col = n - 1 - col
    for _ in range(op % 4):
        row, col = n - 1 - col, row
    return row, col


def unturned(n: int, op: int, row: Column, col: Column) -> tuple[Column, Column]:
    """The inverse of turned()."""
    for _ in range(op % 4):
        row, col = col, n - 1 - row
    if op >= 4:
        col = n - 1 - col
    return row, col


def standardised(values: DataFrame, tile: list[str], bands: list[str], eps: float = 1e-6) -> DataFrame:
    """Each band less its mean over the tile, by its population deviation."""
    over = Window.partitionBy(*tile)
    return values.withColumns({b: (F.col(b) - F.avg(b).over(over)) / (F.stddev_pop(b).over(over) + eps) for b in bands})


def excess_green(r: Column, g: Column, b: Column) -> Column:
    return 2 * g - r - b
