"""Kernels over raster blocks.

Cells are counted where their block is read, so only sums are shuffled. What needs neighbours gets
them as a halo: each block sends every target window the part that lies inside it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.sources.blocks import SIZE

#: A target window and the place of a part inside the scene.
PIECE = "scene string, top int, left int, bottom int, right int, row0 int, col0 int, h int, w int"
_PLACE = ["scene", "top", "left", "bottom", "right", "row0", "col0", "h", "w"]


def windows(rows: Column, cols: Column, tall: int, wide: int) -> Column:
    """Targets of all pairs of starts."""
    one = lambda r, c: F.struct(r.cast("int").alias("top"), c.cast("int").alias("left"), (r + tall).cast("int").alias("bottom"), (c + wide).cast("int").alias("right"))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: one(r, c))))


def with_halo(size: int, reach: int) -> Column:
    """Targets of a block (row0, col0, h, w): the squares of a size x size lattice, wider by reach on all sides, that it meets."""

    def along(start: Column, length: Column) -> Column:
        first, last = F.floor((start - reach) / size), F.floor((start + length - 1 + reach) / size)
        return F.transform(F.sequence(F.greatest(first, F.lit(0)), last), lambda i: i * size - reach)

    return windows(along(F.col("row0"), F.col("h")), along(F.col("col0"), F.col("w")), size + 2 * reach, size + 2 * reach)


def dealt(blocks: DataFrame, targets: Column, planes: Callable[[dict], list[np.ndarray]], names: list[str], keep: dict[str, str] | None = None) -> DataFrame:
    """PIECE, names and keep: the parts of each block's planes (h x w bytes) inside its targets. keep: other columns and their types."""
    keep = keep or {}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                r0, c0, h, w = row["row0"], row["col0"], row["h"], row["w"]
                made, out = planes(row), []
                for t in row["targets"]:
                    top, left, bottom, right = max(t["top"], r0), max(t["left"], c0), min(t["bottom"], r0 + h), min(t["right"], c0 + w)
                    if top < bottom and left < right:
                        parts = [p[top - r0 : bottom - r0, left - c0 : right - c0].tobytes() for p in made]
                        out.append((row["scene"], t["top"], t["left"], t["bottom"], t["right"], top, left, bottom - top, right - left, *parts, *(row[k] for k in keep)))
                if out:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[*_PLACE, *names, *keep]), schema, preserve_index=False)

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([("scene", pa.string()), *((n, pa.int32()) for n in _PLACE[1:]), *((n, pa.binary()) for n in names), *((k, kinds[v]) for k, v in keep.items())])
    ddl = ", ".join([PIECE, *(f"{n} binary" for n in names), *(f"{k} {v}" for k, v in keep.items())])
    return blocks.withColumn("targets", targets).mapInArrow(cut, ddl)


def assembled(pieces: pd.DataFrame, band: str) -> np.ndarray:
    """The target window of pieces; what no piece covers is 0."""
    top, left = int(pieces["top"].iloc[0]), int(pieces["left"].iloc[0])
    out = np.zeros((int(pieces["bottom"].iloc[0]) - top, int(pieces["right"].iloc[0]) - left), np.uint8)
    for r, c, h, w, data in zip(pieces["row0"], pieces["col0"], pieces["h"], pieces["w"], pieces[band], strict=True):
        out[r - top : r - top + h, c - left : c - left + w] = np.frombuffer(data, np.uint8).reshape(h, w)
    return out


def paired(prob: DataFrame, label: DataFrame) -> DataFrame:
    """Blocks with interior and v, joined by place; kernels refuse pairs of different sizes."""
    labels = label.select("scene", "row0", "col0", F.col("h").alias("label_h"), F.col("w").alias("label_w"), "v")
    return prob.select("scene", "row0", "col0", "h", "w", "interior").join(labels, ["scene", "row0", "col0"])


def _planes(row: dict) -> tuple[np.ndarray, np.ndarray]:
    if (row["h"], row["w"]) != (row["label_h"], row["label_w"]):
        raise ValueError(f"label and prediction differ in size at {row['scene']}, {row['row0']}, {row['col0']}")
    shape = row["h"], row["w"]
    return np.frombuffer(row["interior"], np.uint8).reshape(shape), np.frombuffer(row["v"], np.uint8).reshape(shape)


def graded_bytes(prob: DataFrame, label: DataFrame) -> DataFrame:
    """scene, byte, pos, neg: cells by predicted byte and truth, at most 256 rows a block before they are summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                byte, truth = _planes(row)
                pos = np.bincount(byte[truth > 127], minlength=256)
                neg = np.bincount(byte.ravel(), minlength=256) - pos
                seen = np.flatnonzero(pos + neg)
                yield pa.RecordBatch.from_arrays([pa.array([row["scene"]] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(pos[seen].astype(np.int64)), pa.array(neg[seen].astype(np.int64))], ["scene", "byte", "pos", "neg"])

    found = paired(prob, label).mapInArrow(count, "scene string, byte int, pos long, neg long")
    return found.groupBy("scene", "byte").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def disc_eroded(mask: np.ndarray, d: int) -> np.ndarray:
    """Erosion by the ellipse of raster.ellipse(d), outside being background: one running sum along rows, then a comparison a row of the disc."""
    h, w = mask.shape
    sums = np.zeros((h + 2 * d, w + 2 * d + 1), np.int32)
    np.cumsum(np.pad(mask, d), 1, out=sums[:, 1:])
    out = mask.copy()
    for r in range(-d, d + 1):
        half = round(d * math.sqrt(max(0.0, 1 - (r / d) ** 2))) if d else 0
        line = sums[d + r : d + r + h]
        out &= line[:, d + half + 1 : d + half + 1 + w] - line[:, d - half : d - half + w] == 2 * half + 1
    return out


def band_counts(prob: DataFrame, label: DataFrame, widths: tuple[int, ...], threshold: float = 0.5, size: int = SIZE) -> DataFrame:
    """scene, d, tp, fp, fn of the boundary bands of all widths, from one pass over size x size squares with a halo of the largest."""
    reach = max(widths)
    least = next((b for b in range(256) if b / 255 >= threshold), 256)

    def coded(row: dict) -> list[np.ndarray]:
        byte, truth = _planes(row)
        return [(byte >= least).astype(np.uint8) | (truth > 127).astype(np.uint8) << 1]

    def count(pieces: pd.DataFrame) -> pd.DataFrame:
        code = assembled(pieces, "code")
        middle = (slice(reach, -reach or None),) * 2
        out = []
        for d in widths:
            p, t = ((m & ~disc_eroded(m, d))[middle] for m in ((code & 1) > 0, (code & 2) > 0))
            out.append((pieces["scene"].iloc[0], d, int((p & t).sum()), int((p & ~t).sum()), int((t & ~p).sum())))
        return pd.DataFrame(out, columns=["scene", "d", "tp", "fp", "fn"])

    parts = dealt(paired(prob, label), with_halo(size, reach), coded, ["code"])
    counts = parts.groupBy("scene", "top", "left").applyInPandas(count, "scene string, d int, tp long, fp long, fn long")
    return counts.groupBy("scene", "d").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def confusion_of(bytes_: DataFrame, *keys: str, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn by keys from graded_bytes()."""
    least = next((b for b in range(256) if b / 255 >= threshold), 256)
    over = F.col("byte") >= least
    pick = lambda c, side: F.sum(F.when(side, F.col(c)).otherwise(F.lit(0)))
    return bytes_.groupBy(*keys).agg(pick("pos", over).alias("tp"), pick("neg", over).alias("fp"), pick("pos", ~over).alias("fn"), pick("neg", ~over).alias("tn"))
