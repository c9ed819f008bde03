"""Scene inference with a pluggable scorer: windows, eight-fold views, overlap-weighted blending."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators import tiles
from gridweave.operators.raster import taper, window_starts
from gridweave.sources.blocks import KEY, SIZE

#: A scorer takes chips (n x h x w x 3 bytes) and gives interior and boundary probabilities (n x 2 x h x w).
Scorer = Callable[[np.ndarray], np.ndarray]


def excess_green_scorer(chips: np.ndarray) -> np.ndarray:
    """A deterministic scorer for tests: what is bright and not green is interior, its edges are boundary."""
    c = chips.astype(np.float32) / 255
    p = np.clip(c.mean(3) - np.maximum(0, 2 * c[..., 1] - c[..., 0] - c[..., 2]), 0, 1)
    edge = np.abs(np.diff(p, axis=2, append=p[:, :, -1:])) + np.abs(np.diff(p, axis=1, append=p[:, -1:]))
    return np.stack([p, np.clip(edge, 0, 1)], 1)


def viewed(chips: np.ndarray, scorer: Scorer, views: int = 8) -> np.ndarray:
    """Mean of the scorer's maps over flips and quarter turns, each undone."""
    total = 0
    for op in range(views):
        x = np.rot90(chips[:, :, ::-1] if op >= 4 else chips, op % 4, (1, 2))
        y = np.rot90(scorer(np.ascontiguousarray(x)), -(op % 4), (2, 3))
        total = total + (y[:, :, :, ::-1] if op >= 4 else y)
    return total / views


def starts(total: int, tile: int, stride: int) -> list[int]:
    out = list(range(0, max(total - tile, 0) + 1, stride))
    return out if total <= tile or out[-1] == total - tile else [*out, total - tile]


def scene_probabilities(image: np.ndarray, scorer: Scorer, tile: int = 512, overlap: int = 128, views: int = 8, symmetric: bool = True) -> np.ndarray:
    """2 x h x w bytes; images smaller than a tile are padded."""
    h, w = image.shape[:2]
    padded = np.pad(image, ((0, max(0, tile - h)), (0, max(0, tile - w)), (0, 0)))
    edge = taper(tile, overlap // 2, symmetric)
    weight = np.outer(edge, edge)
    total, seen = np.zeros((2, *padded.shape[:2])), np.zeros(padded.shape[:2])
    for r in starts(padded.shape[0], tile, tile - overlap):
        for c in starts(padded.shape[1], tile, tile - overlap):
            p = viewed(padded[None, r : r + tile, c : c + tile], scorer, views)[0]
            total[:, r : r + tile, c : c + tile] += p * weight
            seen[r : r + tile, c : c + tile] += weight
    return np.rint(np.clip(total / np.maximum(seen, 1e-6), 0, 1) * 255).astype(np.uint8)[:, :h, :w]


def scored_blocks(images: DataFrame, scorer: Scorer, tile: int = 512, overlap: int = 128, views: int = 8, symmetric: bool = True, size: int = SIZE, chips_at_once: int = 8) -> DataFrame:
    """Blocks (size x size) with interior and boundary from image blocks with r, g and b: what scene_probabilities() gives for the whole scene.

    A task streams its windows and scores chips_at_once of them together, the scorer being sent to it once; then the few
    windows that meet a block are one group: scenes may be of any size.
    """
    sizes = images.groupBy("scene").agg(F.max(F.col("row0") + F.col("h")).alias("height"), F.max(F.col("col0") + F.col("w")).alias("width"))
    meets = lambda total, start, length: F.filter(window_starts(F.col(total), tile, tile - overlap), lambda s: (s < F.col(start) + F.col(length)) & (s + tile > F.col(start)))
    targets = tiles.windows(meets("height", "row0", "h"), meets("width", "col0", "w"), tile, tile)
    bands = lambda row: [np.frombuffer(row[b], np.uint8).reshape(row["h"], row["w"]) for b in "rgb"]
    chips = tiles.dealt(images.join(sizes, "scene"), targets, bands, list("rgb"), {"height": "int", "width": "int"})
    edge = taper(tile, overlap // 2, symmetric)
    weight = np.outer(edge, edge)

    def parts_of(where: tuple, p: np.ndarray) -> list[tuple]:
        scene, top, left, height, width = where
        out = []
        for r in range(top // size * size, min(top + tile, height), size):
            for c in range(left // size * size, min(left + tile, width), size):
                a, b, z, y = max(r, top), max(c, left), min(r + size, top + tile, height), min(c + size, left + tile, width)
                part = np.ascontiguousarray(p[:, a - top : z - top, b - left : y - left])
                out.append((scene, r, c, min(size, height - r), min(size, width - c), top, left, a, b, z, y, part.dtype.str, part.tobytes()))
        return out

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[tuple, np.ndarray]] = []

        def scored() -> pa.RecordBatch:
            maps = viewed(np.stack([chip for _, chip in waiting]), scorer, views)
            rows = [row for (where, _), p in zip(waiting, maps, strict=True) for row in parts_of(where, p)]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for row in (row for batch in batches for row in batch.to_pylist()):  # sorted, so a window's pieces follow each other
            where = tuple(row[k] for k in ("scene", "top", "left", "height", "width"))
            if not waiting or waiting[-1][0] != where:
                if len(waiting) == chips_at_once:
                    yield scored()
                waiting.append((where, np.zeros((tile, tile, 3), np.uint8)))
            at = (slice(row["row0"] - row["top"], row["row0"] - row["top"] + row["h"]), slice(row["col0"] - row["left"], row["col0"] - row["left"] + row["w"]))
            for k, band in enumerate("rgb"):
                waiting[-1][1][*at, k] = np.frombuffer(row[band], np.uint8).reshape(row["h"], row["w"])
        if waiting:
            yield scored()

    names = ["scene", "row0", "col0", "h", "w", "top", "left", "r0", "c0", "r1", "c1", "kind", "p"]

    def blend(parts: pd.DataFrame) -> pd.DataFrame:
        scene, row0, col0, h, w = parts[names[:5]].iloc[0]
        total, seen = np.zeros((2, h, w)), np.zeros((h, w))
        for _, _, _, _, _, top, left, a, b, z, y, kind, data in parts.sort_values(["top", "left"]).itertuples(index=False):
            p, by = np.frombuffer(data, kind).reshape(2, z - a, y - b), weight[a - top : z - top, b - left : y - left]
            total[:, a - row0 : z - row0, b - col0 : y - col0] += p * by
            seen[a - row0 : z - row0, b - col0 : y - col0] += by
        planes = np.rint(np.clip(total / np.maximum(seen, 1e-6), 0, 1) * 255).astype(np.uint8)
        return pd.DataFrame([(scene, row0, col0, h, w, planes[0].tobytes(), planes[1].tobytes())], columns=[*names[:5], "interior", "boundary"])

    kinds = [pa.string(), *[pa.int32()] * 10, pa.string(), pa.binary()]
    parts = int(chips.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not coalesced by size
    sorted_ = chips.repartition(parts, "scene", "top", "left").sortWithinPartitions("scene", "top", "left")
    scored = sorted_.mapInArrow(score, f"{KEY}, top int, left int, r0 int, c0 int, r1 int, c1 int, kind string, p binary")
    return scored.groupBy("scene", "row0", "col0").applyInPandas(blend, f"{KEY}, interior binary, boundary binary")
