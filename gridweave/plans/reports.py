"""Composite plans: evaluation, threshold sweep, experiment scoring, ladders and the report."""

from __future__ import annotations

import importlib.util
import platform
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.measures import orthogonality
from gridweave.operators import experiments, matching, pixels, tiles
from gridweave.plans import vectorise
from gridweave.sources.tables import materialised


@dataclass
class Evaluation:
    """Frames of one evaluation; skipped counts scenes that lack a layer."""

    pixels: DataFrame
    instances: DataFrame
    shapes: DataFrame
    displacement: DataFrame
    skipped: int


def pixel_summary(prob: DataFrame, label: DataFrame, cities: DataFrame, widths: tuple[int, ...] = (3, 7, 10)) -> DataFrame:
    """grp, counts, ratios, and b{d}_iou of each boundary width; cities maps scene to city."""
    counts = tiles.confusion_of(tiles.graded_bytes(prob, label), "scene").join(cities, "scene")
    out = pixels.summarised(counts.drop("scene"), "city")
    bands = tiles.band_counts(prob, label, widths).join(cities, "scene").groupBy("city", "d").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    bands = materialised(bands)  # one row a city and width: read once for each width
    for d in widths:
        band = bands.filter(F.col("d") == d).drop("d").withColumn("tn", F.lit(0))
        out = out.join(pixels.summarised(band, "city").select("grp", F.col("iou").alias(f"b{d}_iou")), "grp", "left")
    return out


def shape_table(variants: dict[str, DataFrame | None], tolerances: dict[str, float] | None = None) -> DataFrame:
    """variant, buildings, vertices, orthogonality: means over scenes of each scene's means, of the layers that are there.

    A layer with a tolerance is simplified first; polygons that this leaves nothing of aren't counted.
    """
    parts = []
    for name, layer in variants.items():
        if layer is not None:
            tolerance = (tolerances or {}).get(name, 0.0)
            rows = vectorise.simplified_layer(layer, tolerance) if tolerance > 0 else layer
            ring = F.get("rings", F.lit(0))
            parts.append(rows.filter(F.size(F.coalesce(ring, F.array())) > 2).select(F.lit(name).alias("variant"), "scene", F.size(ring).alias("v"), orthogonality(ring).alias("o")))
    scenes = reduce(DataFrame.unionByName, parts).groupBy("variant", "scene").agg(F.count("*").alias("n"), F.avg("v").alias("v"), F.avg("o").alias("o"))
    return scenes.groupBy("variant").agg(F.sum("n").alias("buildings"), F.avg("v").alias("vertices"), F.avg("o").alias("orthogonality"))


def evaluated(preds: DataFrame, gts: DataFrame, prob: DataFrame, label: DataFrame, cities: DataFrame, thresholds: tuple[float, ...] = (0.25, 0.5, 0.75), widths: tuple[int, ...] = (3, 7, 10), raw: DataFrame | None = None, tolerance: float = 0.5) -> Evaluation:
    """Everything about predicted and true layers of the scenes that have both; raw, the layer before it was squared, may be missing."""
    both = preds.select("scene").distinct().join(gts.select("scene").distinct(), "scene", "left_semi")
    skipped = cities.join(both, "scene", "left_anti").count()
    preds, gts = preds.join(both, "scene", "left_semi"), gts.join(both, "scene", "left_semi")
    found = vectorise.candidates(preds, gts)
    ids = lambda df: df.select("scene", F.col("seq").alias("id"))
    strict = matching.scored(matching.mutual_best(found.select("scene", "pred", "gt", "iou")), ids(preds), ids(gts), thresholds).withColumn("matching", F.lit("strict"))
    merged = matching.merge_scored(vectorise.merged_unions(found, preds, gts), ids(preds), ids(gts), thresholds).withColumn("matching", F.lit("merge_tolerant"))
    sums = strict.unionByName(merged).groupBy("matching", "threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    best = matching.best_match(found.select("scene", "pred", "gt", "iou"))
    rings = lambda df, side: df.select("scene", F.col("seq").alias(side), F.get("rings", F.lit(0)).alias(f"{side}_ring"))
    polis = best.join(rings(preds, "pred"), ["scene", "pred"]).join(rings(gts, "gt"), ["scene", "gt"]).select(matching.ring_displacement(F.col("pred_ring"), F.col("gt_ring")).alias("polis"))
    quantiles = polis.agg(F.count("polis").alias("n"), F.avg("polis").alias("mean"), F.percentile("polis", 0.5).alias("median"), F.percentile("polis", 0.9).alias("p90"))
    raw = raw.join(both, "scene", "left_semi") if raw is not None else None
    shapes = shape_table({"pred_reg": preds, "pred_raw": raw, "gt_traced": gts, "gt_simplified": gts}, {"gt_simplified": tolerance})
    return Evaluation(pixel_summary(prob, label, cities, widths), pixels.finished(sums), shapes, quantiles, skipped)


def swept(prob: DataFrame, label: DataFrame, cities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All threshold curves by city and ALL, and the best threshold of each."""
    curves = pixels.curve(pixels.binned(tiles.graded_bytes(prob, label).join(cities, "scene").groupBy("city", "byte").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "city"))
    return curves, pixels.best(curves)


def experiment_row(prob: DataFrame, label: DataFrame, tag: str, **settings) -> DataFrame:
    """One result row of a run, to be upserted by tag."""
    counts = tiles.confusion_of(tiles.graded_bytes(prob, label)).withColumn("tag", F.lit(tag))
    scenes = prob.select("scene").distinct().count()
    return pixels.finished(counts).select("tag", F.lit(scenes).alias("scenes"), "iou", "f1", "precision", "recall", *[F.lit(v).alias(k) for k, v in settings.items()])


def climbed(ladder: list[tuple[str, list[str]]], done: set[str], run: Callable[[str, list[str]], None], cumulative: bool = True, from_rung: str | None = None, only: str | None = None, force: bool = False, dry: bool = False) -> list[str]:
    """Runs the rungs of a ladder that aren't done, with their own changes or with all up to them; returns the tags that ran (or would)."""
    ran, changes, reached = [], [], from_rung is None
    for tag, own in ladder:
        changes = [*changes, *own] if cumulative else own
        reached = reached or tag == from_rung
        if not reached or (only and tag != only) or (tag in done and not force):
            continue
        if not dry:
            run(tag, changes)
        ran.append(tag)
    return ran


def compared(rows: DataFrame, order: list[str], baseline: str) -> DataFrame:
    """Rows in the ladder's order with the change of IoU against the baseline."""
    return experiments.deltas(experiments.by_place(rows, "tag", order), "tag", baseline, "iou").orderBy("place", "tag")


def report(title: str, sections: dict[str, tuple[DataFrame | None, list[str]]], in_domain_iou: float | None = None, iou: float | None = None, gain: float | None = None) -> str:
    """A Markdown report; a section without a frame is left out, and prose follows the figures only."""
    lines = [f"# {title}", "", date.today().isoformat(), ""]
    for name, (frame, columns) in sections.items():
        if frame is not None:
            lines += [f"## {name}", "", experiments.markdown(frame, columns), ""]
    if in_domain_iou is not None and iou is not None:
        gap = in_domain_iou - iou
        lines += [f"The gap between seen and unseen regions is {gap:.4f}" + (", which generalisation should close first." if gap > 0.02 else "."), ""]
    if gain is not None:
        lines += [f"The best threshold of its own would add {gain:.4f} IoU" + (": thresholds are not what holds it back." if gain < 0.05 else ", so thresholds should be set by region."), ""]
    return "\n".join(lines)


def environment(packages: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy", "yaml")) -> dict[str, str | None]:
    """Versions of what the engine needs; None if missing."""
    out: dict[str, str | None] = {"python": platform.python_version()}
    for name in packages:
        module = importlib.import_module(name) if importlib.util.find_spec(name) else None
        out[name] = getattr(module, "__version__", "?") if module else None
    return out


def scene_cities(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "scene string, city string")
