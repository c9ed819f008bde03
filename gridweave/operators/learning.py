"""What training needs around a network: losses, normalisation, batches of tiles, augmentation, saved states."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.measures import sigmoid
from gridweave.operators.experiments import focal_tversky, soft_dice
from gridweave.operators.ordering import numbered
from gridweave.sources.tables import materialised

# Means and deviations of red, green and blue in the published ImageNet statistics.
IMAGENET = {"r": (0.485, 0.229), "g": (0.456, 0.224), "b": (0.406, 0.225)}


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce(logit: Column, y: Column, pos_weight: float = 1.0) -> Column:
    """Aggregate: mean binary cross-entropy of logits, positives weighted."""
    return F.avg(F.lit(pos_weight) * y * softplus(-logit) + (1 - y) * softplus(logit))


def head_loss(logit: Column, y: Column, bce_weight: float = 0.5, region_weight: float = 0.5, region: str = "bce_dice", pos_weight: float = 1.0, alpha: float = 0.3, beta: float = 0.7, gamma: float = 4 / 3) -> Column:
    """Aggregate: weighted cross-entropy plus a region loss, soft Dice or focal Tversky."""
    p = sigmoid(logit)
    if region not in ("bce_dice", "focal_tversky"):
        raise ValueError(f"no such loss: {region}")
    shape = soft_dice(p, y) if region == "bce_dice" else focal_tversky(p, y, alpha, beta, gamma)
    return bce_weight * bce(logit, y, pos_weight) + region_weight * shape


def total_loss(interior: Column, boundary: Column, interior_weight: float = 1.0, boundary_weight: float = 0.5) -> Column:
    return interior_weight * interior + boundary_weight * boundary


def epoch_means(batches: DataFrame, epoch: str, *metrics: str) -> DataFrame:
    """Means over an epoch's batches, whatever their sizes."""
    return batches.groupBy(epoch).agg(*[F.avg(m).alias(m) for m in metrics])


def normalised(band: str, statistics: dict[str, tuple[float, float]] = IMAGENET) -> Column:
    """A byte band by fixed statistics of values from 0 to 1."""
    mean, deviation = statistics[band]
    return (F.col(band) / 255.0 - mean) / deviation


def parameter_count(parameters: DataFrame) -> DataFrame:
    """n of parameters (name, shape array, trainable): elements of the trainable ones; a shape without sizes is one element."""
    size = F.aggregate(F.transform("shape", lambda v: v.cast("long")), F.lit(1).cast("long"), lambda a, b: a * b)
    return parameters.agg(F.coalesce(F.sum(F.when(F.col("trainable"), size)), F.lit(0)).alias("n"))


def seeded(seed: int) -> np.random.Generator:
    """Seeds the driver's generators and gives one for numpy; orders in Spark take the seed as an argument."""
    random.seed(seed)
    np.random.seed(seed)
    return np.random.default_rng(seed)


def amplitude_swapped(chip: np.ndarray, other: np.ndarray, share: float = 0.01) -> np.ndarray:
    """chip (h x w x bands, bytes) with the low frequencies' amplitudes of other, and its own phases."""
    a, b = (np.fft.fftshift(np.fft.fft2(x.astype(np.float64), axes=(0, 1)), axes=(0, 1)) for x in (chip, other))
    h, w = chip.shape[:2]
    reach = int(min(h, w) * share)
    middle = (slice(h // 2 - reach, h // 2 + reach + 1), slice(w // 2 - reach, w // 2 + reach + 1))
    size = np.abs(a)
    size[middle] = np.abs(b)[middle]
    back = np.fft.ifft2(np.fft.ifftshift(size * np.exp(1j * np.angle(a)), axes=(0, 1)), axes=(0, 1)).real
    return np.clip(np.rint(back), 0, 255).astype(np.uint8)


def augmented(chip: np.ndarray, rng: np.random.Generator, scale: tuple[float, float] = (0.75, 1.35), p_scale: float = 0.5, p_photo: float = 0.8, p_blur: float = 0.2) -> np.ndarray:
    """One random view of a chip (h x w x bands, bytes): zoom by nearest cells, contrast and brightness, mean of 3 x 3."""
    h, w = chip.shape[:2]
    out = chip
    if rng.random() < p_scale:
        zoom = rng.uniform(*scale)
        rows, cols = (np.clip(((np.arange(n) - n / 2) / zoom + n / 2).astype(int), 0, n - 1) for n in (h, w))
        out = out[rows][:, cols]
    if rng.random() < p_photo:
        out = np.clip((out - 127.5) * rng.uniform(0.8, 1.2) + 127.5 + rng.uniform(-20, 20), 0, 255).astype(np.uint8)
    if rng.random() < p_blur:
        padded = np.pad(out, ((1, 1), (1, 1), (0, 0)), mode="edge").astype(np.uint16)
        out = (sum(padded[r : r + h, c : c + w] for r in range(3) for c in range(3)) // 9).astype(np.uint8)
    return out


def partnered(blocks: DataFrame, seed: int, intra: bool = False) -> DataFrame:
    """blocks (scene, row0, col0, city, h, w, r, g, b, ...) with partner_h, partner_w, partner_r, partner_g, partner_b of another block, or of itself where there is no other.

    All blocks, with intra those of each city, are put in an order that depends on the seed and on their places only; a block's
    partner is the next one, the last one's the first. The order is numbered by ranges; pixels are joined once.
    """
    group = F.col("city") if intra else F.lit("")
    name = F.md5(F.concat_ws(":", F.lit(str(seed)), "scene", F.col("row0").cast("string"), F.col("col0").cast("string")))
    keys = ["scene", "row0", "col0"]
    order = materialised(numbered(blocks.select(*keys, group.alias("group"), name.alias("name")), "group", "name", *keys))
    sizes = order.groupBy("group").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    after = order.join(sizes, order["group"].eqNullSafe(sizes["group"])).select(*keys, (F.col("first") + (F.col("nth") - F.col("first") + 1) % F.col("n")).alias("nth"))
    to = after.join(order.select("nth", *[F.col(k).alias(f"to_{k}") for k in keys]), "nth").drop("nth")
    others = blocks.select(*[F.col(k).alias(f"to_{k}") for k in keys], *[F.col(c).alias(f"partner_{c}") for c in ("h", "w", "r", "g", "b")])
    return blocks.join(to, keys).join(others, [f"to_{k}" for k in keys]).drop(*[f"to_{k}" for k in keys])


def zoomed(planes: np.ndarray, zoom: float) -> np.ndarray:
    """planes (h x w x bands) around their middle, by nearest cells; cells beyond repeat the edge."""
    rows, cols = (np.clip(((np.arange(n) - n / 2) / zoom + n / 2).astype(int), 0, n - 1) for n in planes.shape[:2])
    return planes[rows][:, cols]


def tile_set(blocks: DataFrame, seed: int | None = None, normalization: str = "imagenet", green: bool = False, p_zoom: float = 0.0, zooms: tuple[float, float] = (0.75, 1.35), p_swap: float = 0.0) -> DataFrame:
    """scene, row0, col0, x, y of blocks with r, g, b, interior, boundary: flat float tensors, bands first. A seed augments, the same way in every run.

    imagenet scales by fixed statistics, per_tile by the tile's own; green adds excess green as a band. With a seed, p_zoom is
    the chance that picture and labels are zoomed together, and p_swap, for blocks of partnered(), that the low frequencies'
    amplitudes come from the partner, if it has the same size.
    """
    swaps = ["partner_h", "partner_w", "partner_r", "partner_g", "partner_b"] if p_swap else []
    if normalization not in ("imagenet", "per_tile"):
        raise ValueError(f"no such normalization: {normalization}")

    def tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shape = row["h"], row["w"]
                planes = np.stack([np.frombuffer(row[b], np.uint8).reshape(shape) for b in ("r", "g", "b", "interior", "boundary")], 2)
                if seed is not None:
                    rng = np.random.default_rng([seed, row["row0"], row["col0"], *row["scene"].encode()])
                    colours = rng.integers(0, 2**31)
                    turns, flip = int(rng.integers(0, 4)), bool(rng.integers(0, 2))
                    more = np.random.default_rng(colours + 1)
                    if p_swap and more.random() < p_swap and (row["partner_h"], row["partner_w"]) == shape:
                        other = np.stack([np.frombuffer(row[f"partner_{b}"], np.uint8).reshape(shape) for b in "rgb"], 2)
                        planes = np.concatenate([amplitude_swapped(planes[..., :3], other), planes[..., 3:]], 2)
                    if p_zoom and more.random() < p_zoom:
                        planes = zoomed(planes, more.uniform(*zooms))
                    planes = np.rot90(planes[:, ::-1] if flip else planes, turns)
                    planes = np.concatenate([augmented(planes[..., :3], np.random.default_rng(colours), p_scale=0.0), planes[..., 3:]], 2)
                x = planes[..., :3].astype(np.float32) / 255
                if green:
                    x = np.concatenate([x, 2 * x[..., 1:2] - x[..., :1] - x[..., 2:3]], 2)
                if normalization == "per_tile":
                    x = (x - x.mean((0, 1))) / (x.std((0, 1)) + 1e-6)
                else:
                    x[..., :3] = (x[..., :3] - [IMAGENET[b][0] for b in "rgb"]) / [IMAGENET[b][1] for b in "rgb"]
                y = (planes[..., 3:] > 127).astype(np.float32)
                flat = [pa.array([v.transpose(2, 0, 1).ravel().astype(np.float32)], pa.list_(pa.float32())) for v in (x, y)]
                yield pa.RecordBatch.from_arrays([pa.array([row["scene"]]), pa.array([row["row0"]], pa.int32()), pa.array([row["col0"]], pa.int32()), *flat], ["scene", "row0", "col0", "x", "y"])

    return blocks.select("scene", "row0", "col0", "h", "w", "r", "g", "b", "interior", "boundary", *swaps).mapInArrow(tensors, "scene string, row0 int, col0 int, x array<float>, y array<float>")


def save_state(spark: SparkSession, state: dict[str, np.ndarray], path: str) -> None:
    """Named arrays of a model as a table (name, kind, shape, data), replaced as a whole."""
    rows = [(name, a.dtype.str, list(a.shape), a.tobytes()) for name, a in state.items()]
    spark.createDataFrame(rows, "name string, kind string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """A model's arrays on the driver, which tasks get as a broadcast: its size is the model's, not the data's."""
    return {r["name"]: np.frombuffer(r["data"], r["kind"]).reshape(r["shape"]).copy() for r in spark.read.parquet(path).collect()}
