"""Rasters as tables of square blocks: one row a block, one binary column a band of bytes.

A block is the unit of scan, pruning (min and max of row0, col0) and parallelism; bands that a query
doesn't name are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 512
KEY = "scene string, row0 int, col0 int, h int, w int"


def to_rows(scene: str, size: int = SIZE, **bands: np.ndarray) -> list[tuple]:
    """Block rows (KEY and the bands in their order) of one scene's byte arrays."""
    first = next(iter(bands.values()))
    rows = []
    for r in range(0, first.shape[0], size):
        for c in range(0, first.shape[1], size):
            parts = [np.ascontiguousarray(b[r : r + size, c : c + size], np.uint8) for b in bands.values()]
            rows.append((scene, r, c, *parts[0].shape, *(p.tobytes() for p in parts)))
    return rows


def from_rows(rows, band: str) -> np.ndarray:
    """One band of one scene from its block rows (dicts or Rows)."""
    rows = list(rows)
    out = np.zeros((max(r["row0"] + r["h"] for r in rows), max(r["col0"] + r["w"] for r in rows)), np.uint8)
    for r in rows:
        out[r["row0"] : r["row0"] + r["h"], r["col0"] : r["col0"] + r["w"]] = np.frombuffer(r[band], np.uint8).reshape(r["h"], r["w"])
    return out


def block_table(spark: SparkSession, rows: list[tuple], *bands: str) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join([KEY, *(f"{b} binary" for b in bands)]))


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Partitioned by scene; a scene that is written again replaces itself only."""
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("scene").parquet(path)


def write_block_table(blocks: DataFrame, name: str, buckets: int) -> None:
    """A table bucketed and sorted by place: layers of as many buckets are joined by place without an exchange. Each bucket is one file."""
    placed = blocks.repartition(buckets, "scene", "row0", "col0").sortWithinPartitions("scene", "row0", "col0")
    placed.write.mode("overwrite").option("compression", "zstd").bucketBy(buckets, "scene", "row0", "col0").sortBy("scene", "row0", "col0").saveAsTable(name)


def read_window(spark: SparkSession, path: str, scene: str, row0: int, col0: int, h: int, w: int) -> DataFrame:
    """Blocks that meet a window: partition and row-group statistics prune all others."""
    meets = (F.col("row0") < row0 + h) & (F.col("col0") < col0 + w) & (F.col("row0") + F.col("h") > row0) & (F.col("col0") + F.col("w") > col0)
    return spark.read.parquet(path).filter((F.col("scene") == scene) & meets)


def scenes_of(spark: SparkSession, folder: str, suffix: str = "_prob.tif") -> DataFrame:
    """Scenes that have a file with the suffix in a folder, in order of name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    return files.select(F.regexp_extract("path", rf"([^/]*){suffix.replace('.', '[.]')}$", 1).alias("scene")).orderBy("scene")


def cells(blocks: DataFrame, *bands: str) -> DataFrame:
    """The pixel view (scene, row, col, bands as int) of blocks, inside the JVM."""
    at = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)))
    row, col = F.col("row0") + F.floor(F.col("i") / F.col("w")).cast("int"), F.col("col0") + F.col("i") % F.col("w")
    byte = lambda b: F.conv(F.hex(F.substr(F.col(b), F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
    return at.select("scene", row.alias("row"), col.alias("col"), *[byte(b).alias(b) for b in bands])
