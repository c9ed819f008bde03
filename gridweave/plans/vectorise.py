"""Probability or label blocks to polygon layers, and their evaluation against labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.operators import matching, scenes
from gridweave.operators.kernels import arrangement, polygons
from gridweave.operators.kernels import batches as batches_
from gridweave.sources.tables import materialised
from gridweave.sources.vectors import LAYER


#: Polygons, or groups of them, that kernels take at a time.
TOGETHER = 2048


def lengths(lists: pa.Array) -> np.ndarray:
    """Of lists without nulls."""
    return np.diff(lists.offsets.to_numpy())


def rings_of(column: pa.Array) -> arrangement.Rings:
    """Polygons of a column of arrays of rings without nulls, end to end."""
    rings = column.flatten()
    points = rings.flatten()
    xy = np.stack([points.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")], 1)
    return arrangement.Rings(xy, lengths(rings), np.repeat(np.arange(len(column)), lengths(column)))


def _offsets(sizes) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.fromiter(sizes, np.int64))]).astype(np.int32))


def nested(found: list[list[np.ndarray]]) -> pa.Array:
    """Polygons as a column of arrays of rings."""
    rings = [r for p in found for r in p]
    xy = np.concatenate(rings) if rings else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], ["x", "y"])
    return pa.ListArray.from_arrays(_offsets(map(len, found)), pa.ListArray.from_arrays(_offsets(map(len, rings)), points))


def _layer(pieces: DataFrame, transform: tuple[float, ...], variant: str, many: Callable[[list[list[np.ndarray]]], list[dict | None]]) -> DataFrame:
    """LAYER of pieces of labels: many makes polygons' attributes, or None, of their rings on the ground, some polygons at a time. seq counts a scene's polygons by their first cells."""
    fields = [T.StructField("scene", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), *LAYER.fields[2:]]
    attributes = {"area_m2": pa.float64(), "perimeter_m": pa.float64(), "n_vertices": pa.int32(), "raw_vertices": pa.int32(), "orthogonality": pa.float64()}
    a, b, c, d, e, f = transform

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                rows = batch.slice(at, TOGETHER)
                walks = rows["rings"].flatten()
                xy = np.stack([walks.field(k).flatten().to_numpy(zero_copy_only=False) for k in ("xs", "ys")], 1).astype(float)
                rings = batches_.arranged(arrangement.Rings(xy, lengths(walks.field("xs")), np.repeat(np.arange(len(rows)), lengths(rows["rings"]))))
                x, y = rings.xy[rings.starts[np.diff(rings.polygon, prepend=-1) != 0]].astype(np.int32).T
                polygons_: list[list[np.ndarray]] = [[] for _ in range(len(rows))]
                for k, ring in zip(rings.polygon.tolist(), rings.moved(np.stack([a * rings.xy[:, 0] + b * rings.xy[:, 1] + c, d * rings.xy[:, 0] + e * rings.xy[:, 1] + f], 1)).each(), strict=True):
                    polygons_[k].append(ring)
                found = many(polygons_)
                kept = [k for k, p in enumerate(found) if p]
                found = [found[k] for k in kept]
                columns = [rows["scene"].take(pa.array(kept, pa.int64())), pa.array(y[kept]), pa.array(x[kept]), pa.array([variant] * len(kept), pa.string()), nested([p["rings"] for p in found])]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([p.get(k) for p in found], kind) for k, kind in attributes.items())], names)

    names = [f.name for f in fields]
    assert names == ["scene", "y", "x", "variant", "rings", *attributes]
    found = scenes.outlines(pieces)
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not coalesced by size
    found = found.select("scene", "rings").repartition(parts).mapInArrow(build, T.StructType(fields))
    nth = F.row_number().over(Window.partitionBy("scene").orderBy("y", "x"))
    return found.withColumn("seq", (nth - 1).cast("int")).select(*LAYER.fieldNames())


def prediction_layer(blocks: DataFrame, transform=(0.3, 0.0, 0.0, 0.0, -0.3, 0.0), regularise: bool = True, thresholds: dict[str, float] | None = None, **options) -> DataFrame:
    """LAYER of blocks with bytes interior and boundary: instances, traced and cleaned. thresholds: see scenes.instance_pieces(); options: see polygons.cleaned().

    A task holds a square of a scene, the cells of one part of the mask that several seeds share, or some polygons; a
    scene without instances gives no rows.
    """
    clean = lambda many: batches_.cleaned(many, regularise=regularise, **options)
    return _layer(scenes.instance_pieces(blocks, **thresholds or {}), transform, "regularized" if regularise else "simplified", clean)


def label_layer(blocks: DataFrame, transform=(0.3, 0.0, 0.0, 0.0, -0.3, 0.0), area_least: float = 20.0) -> DataFrame:
    """LAYER of label blocks (v): 8-connected components as traced, without simplification."""

    def whole(many: list[list[np.ndarray]]) -> list[dict | None]:
        found = batches_.valid(many)
        there = [k for k, p in enumerate(found) if p is not None]
        rings = arrangement.Rings.of_polygons([found[k] for k in there])
        out: list[dict | None] = [None] * len(many)
        for k, area, length in zip(there, batches_.areas(rings, len(there)).tolist(), batches_.lengths(rings, len(there)).tolist(), strict=True):
            if area >= area_least:
                out[k] = {"rings": found[k], "area_m2": round(area, 2), "perimeter_m": round(length, 2), "n_vertices": len(found[k][0])}
        return out

    return _layer(scenes.component_pieces(blocks), transform, "ground_truth", whole)


def simplified_layer(layer: DataFrame, tolerance: float) -> DataFrame:
    """scene, rings of a layer after simplification; polygons that it leaves nothing of are dropped."""

    def simplify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for scene, rings in zip(rows["scene"], rows["rings"], strict=True):
                found = polygons.simplified([np.array([[p["x"], p["y"]] for p in r]) for r in rings], tolerance)
                if found is not None and len(found) and len(found[0]) > 2:
                    out.append((scene, [[{"x": float(x), "y": float(y)} for x, y in r] for r in found]))
            yield pd.DataFrame(out, columns=["scene", "rings"])

    return layer.select("scene", "rings").filter(F.col("rings").isNotNull()).mapInPandas(simplify, "scene string, rings array<array<struct<x:double,y:double>>>")


def boxed(layer: DataFrame) -> DataFrame:
    """scene, id, rings and the box of each polygon."""
    shell = F.get("rings", F.lit(0))
    side = lambda f, k: f(F.transform(shell, lambda p: p[k]))
    return layer.select("scene", F.col("seq").alias("id"), "rings", side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))


def candidates(preds: DataFrame, gts: DataFrame, cell: float = 64.0) -> DataFrame:
    """scene, pred, gt, iou, overlap, pred_area, gt_area of all pairs that share area: a join of boxes by cells, then exact overlay."""
    pairs = matching.adaptive_join(materialised(boxed(preds)), materialised(boxed(gts)), cell, "scene")  # read several times

    def overlaid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                rows = batch.slice(at, TOGETHER)
                n = len(rows)
                sides = [rings_of(rows[c]) for c in ("l_rings", "r_rings")]
                order = np.argsort(np.concatenate([s.polygon for s in sides]), kind="stable")
                layer = np.repeat([0, 1], [len(s.sizes) for s in sides])[order]
                areas = batches_.overlays(batches_.joined(sides), layer, n)
                share = areas[:, 2] / (areas[:, 0] + areas[:, 1] - areas[:, 2] + 1e-9)
                out = pa.RecordBatch.from_arrays([rows["scene"], rows["l_id"], rows["r_id"], *map(pa.array, (share, areas[:, 2].copy(), areas[:, 0].copy(), areas[:, 1].copy()))], ["scene", "pred", "gt", "iou", "overlap", "pred_area", "gt_area"])
                yield out.filter(pa.array(areas[:, 2] > 0))

    parts = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not coalesced by size
    return pairs.select("scene", "l_id", "r_id", "l_rings", "r_rings").repartition(parts, "scene", "l_id").mapInArrow(overlaid, "scene string, pred int, gt int, iou double, overlap double, pred_area double, gt_area double")


def merged_unions(found: DataFrame, preds: DataFrame, gts: DataFrame) -> DataFrame:
    """scene, gt, preds, members, iou of each gt with the union of its members, which may overlap; found is that of candidates().

    One row of a gt and its members at a time: as many as have over half their area inside it.
    """
    shape = lambda df, side: df.select("scene", F.col("seq").alias(side), F.col("rings").alias(f"{side}_rings"))
    inside = matching.members(found).select("scene", "gt", "pred").join(shape(preds, "pred"), ["scene", "pred"])
    rows = inside.groupBy("scene", "gt").agg(F.collect_set("pred").alias("preds"), F.collect_list("pred_rings").alias("shapes")).join(shape(gts, "gt"), ["scene", "gt"])

    def united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_polygon = lambda rings: [np.array([[p["x"], p["y"]] for p in r]) for r in rings]
        for part in batches:
            values = [polygons.iou([as_polygon(s) for s in shapes], [as_polygon(g)]) for shapes, g in zip(part["shapes"], part["gt_rings"], strict=True)]
            yield part[["scene", "gt", "preds"]].assign(members=part["preds"].map(len).astype("int64"), iou=np.array(values, float))

    kind = dict(found.dtypes)
    return rows.select("scene", "gt", "preds", "shapes", "gt_rings").mapInPandas(united, f"scene {kind['scene']}, gt {kind['gt']}, preds array<{kind['pred']}>, members long, iou double")


def united_layer(layer: DataFrame, *keys: str) -> DataFrame:
    """keys, parts (arrays of rings, largest first), area of the union of each group's polygons (rings); one row of a group and its polygons, some rows at a time."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                rows = batch.slice(at, TOGETHER)
                shapes = rows["shapes"]
                polygon, rings = lengths(shapes.flatten()), rings_of(shapes.flatten())
                of, nth = arrangement.spread(lengths(shapes))
                found = arrangement.united_many(arrangement.Rings(rings.xy, rings.sizes, np.repeat(of, polygon)), np.repeat(nth, polygon), len(rows))
                parts = nested([p for polygons_ in found for p in polygons_])
                parts = pa.ListArray.from_arrays(_offsets(map(len, found)), parts)
                area = np.array([sum(map(polygons.area, p)) for p in found], float)
                yield pa.RecordBatch.from_arrays([*(rows[k] for k in keys), parts, pa.array(area)], [*keys, "parts", "area"])

    shapes = layer.filter(F.col("rings").isNotNull()).groupBy(*keys).agg(F.collect_list("rings").alias("shapes"))
    kinds = dict(shapes.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return scenes.spread(shapes, *keys).mapInArrow(unite, f"{schema}, parts array<array<array<struct<x:double,y:double>>>>, area double")


def by_scene(blocks: DataFrame):
    """Blocks grouped by scene, dealt to all tasks: scenes are few bytes but much work, so they aren't coalesced by size."""
    return blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scene").groupBy("scene")


def summary(layer: DataFrame) -> DataFrame:
    """Per scene: buildings, median area, mean vertices and orthogonality."""
    return layer.groupBy("scene").agg(
        F.count("*").alias("n_buildings"), F.median("area_m2").alias("median_area_m2"), F.avg("n_vertices").alias("mean_vertices"),
        F.avg("raw_vertices").alias("mean_raw_vertices"), F.avg("orthogonality").alias("mean_orthogonality"),
    )
