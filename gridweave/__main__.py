"""Command lines: python -m gridweave predict | vectorize | evaluate | sweep | score | report.

Rasters are block tables (or folders of GeoTIFF files for predict), layers are Parquet by scene, and
manifests are CSV files with scene, city, image_path and gt_path.
"""

from __future__ import annotations

import argparse
import importlib
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from gridweave.operators import experiments, ordering, scoring
from gridweave.plans import reports, vectorise
from gridweave.sources import blocks, config, geotiff, vectors


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridweave", description=__doc__.splitlines()[0])
    add = top.add_subparsers(dest="command", required=True).add_parser

    def command(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        out = add(name, help=text)
        for path in (*paths, "out"):
            out.add_argument(f"--{path}", required=True)
        out.add_argument("--limit", type=int, default=0, help="the first scenes only; 0 takes all")
        out.add_argument("--config", help="a YAML file whose sections inference, vectorize and evaluate replace the defaults")
        out.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="changes a name of the configuration")
        return out

    p = command("predict", "probability blocks of images", "images")
    p.add_argument("--scenes", help="names, separated by commas")
    p.add_argument("--scorer", default="gridweave.operators.scoring:excess_green_scorer", help="module:function")
    p.add_argument("--tta", action="store_true", help="mean over eight flips and turns")
    p = command("vectorize", "polygon layers of blocks", "blocks")
    p.add_argument("--no-regularize", action="store_true")
    p.add_argument("--ground-truth", action="store_true", help="trace label blocks instead")
    p.add_argument("--suffix", help="folder below out")
    p = command("evaluate", "tables of pixels, instances, shapes and displacement", "blocks", "labels", "manifest", "pred-vectors", "gt-vectors")
    p.add_argument("--raw-vectors")
    p.add_argument("--max-instance-scenes", type=int, default=0, help="polygons of the first scenes of the manifest only; 0 takes all")
    command("sweep", "threshold curves by city", "blocks", "labels", "manifest")
    p = command("score", "one row of an experiment table, replaced if its tag is there", "blocks", "labels", "tag")
    p.add_argument("--baseline", default="", help="tag that prints the changes of all rows")
    p = command("report", "a Markdown report of result tables")
    p.add_argument("--title", default="Results")
    p.add_argument("--section", action="append", default=[], metavar="NAME=CSV")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("gridweave").getOrCreate()
    globals()[f"_{a.command}"](spark, a)


def _settings(a: argparse.Namespace, section: str, **names: str) -> dict[str, Any]:
    """Arguments from a section of the configuration, for the names that it has; names maps arguments to its names."""
    if a.set and not a.config:
        raise ValueError("--set needs --config")
    found = config.overridden(config.load(a.config), a.set).get(section) or {} if a.config else {}
    return {argument: found[name] for argument, name in names.items() if name in found}


def _first(df: DataFrame, n: int) -> DataFrame:
    """Blocks of the first n scenes by name."""
    if not n:
        return df
    scenes = ordering.numbered(df.select("scene").distinct(), "scene").filter(f"nth <= {n}").select("scene")
    return df.join(scenes, "scene", "left_semi")


def _predict(spark: SparkSession, a: argparse.Namespace) -> None:
    module, _, name = a.scorer.partition(":")
    images = _first(ordering.named(geotiff.read_geotiff(spark, a.images, ("r", "g", "b")), "scene", a.scenes), a.limit)
    options = _settings(a, "inference", tile="tile_size", overlap="overlap", chips_at_once="batch_size")
    blocks.write_blocks(scoring.scored_blocks(images, getattr(importlib.import_module(module), name), views=8 if a.tta else 1, **options), a.out)


def _vectorize(spark: SparkSession, a: argparse.Namespace) -> None:
    source = _first(spark.read.parquet(a.blocks), a.limit)
    least = _settings(a, "vectorize", area_least="min_area_m2")
    if a.ground_truth:
        layer = vectorise.label_layer(source, **least)
    else:
        shape = _settings(a, "vectorize", regularise="regularize", tolerance="simplify_tolerance_m", snap_degrees="angle_snap_deg", edge_least="min_edge_m", hole_least="hole_min_area_m2")
        thresholds = _settings(a, "inference", t_interior="threshold_interior", t_boundary="threshold_boundary")
        layer = vectorise.prediction_layer(source, **least | shape | ({"regularise": False} if a.no_regularize else {}), thresholds=thresholds)
    vectors.write_layer(layer, f"{a.out}/{a.suffix}" if a.suffix else a.out)


def _inputs(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    cities = ordering.limited(vectors.read_manifest(spark, a.manifest), "ord", a.limit).select("scene", "city")
    kept = lambda path: spark.read.parquet(path).join(cities, "scene", "left_semi")
    return kept(a.blocks), kept(a.labels), cities


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    prob, label, cities = _inputs(spark, a)
    raw = spark.read.parquet(a.raw_vectors) if a.raw_vectors else None
    layers = [spark.read.parquet(a.pred_vectors), spark.read.parquet(a.gt_vectors)]
    if a.max_instance_scenes:
        kept = ordering.limited(vectors.read_manifest(spark, a.manifest), "ord", a.max_instance_scenes).select("scene")
        layers = [layer.join(kept, "scene", "left_semi") for layer in layers]
    options = _settings(a, "evaluate", thresholds="iou_thresholds") | _settings(a, "vectorize", tolerance="simplify_tolerance_m")
    found = reports.evaluated(*layers, prob, label, cities, raw=raw, **{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()})
    for name in ("pixels", "instances", "shapes", "displacement"):
        vectors.write_csv(getattr(found, name), f"{a.out}/{name}")
    print(f"{found.skipped} scenes skipped")


def _sweep(spark: SparkSession, a: argparse.Namespace) -> None:
    curves, best = reports.swept(*_inputs(spark, a))
    vectors.write_csv(curves, f"{a.out}/curves")
    vectors.write_csv(best, f"{a.out}/best")


def _score(spark: SparkSession, a: argparse.Namespace) -> None:
    row = reports.experiment_row(_first(spark.read.parquet(a.blocks), a.limit), spark.read.parquet(a.labels), a.tag)
    before = vectors.read_optional_csv(spark, a.out, ", ".join(f"{n} {t}" for n, t in row.dtypes))
    rows = experiments.upserted(before, row, "tag") if before is not None else row
    vectors.write_csv(spark.createDataFrame(rows.collect(), row.schema), a.out)  # one row an experiment; the table is read before it is replaced
    if a.baseline:
        print(experiments.markdown(experiments.deltas(spark.read.option("header", True).schema(row.schema).csv(a.out), "tag", a.baseline, "iou"), ["tag", "iou", "delta"]))


def _report(spark: SparkSession, a: argparse.Namespace) -> None:
    sections = {}
    for part in a.section:
        name, _, path = part.partition("=")
        frame = spark.read.option("header", True).option("inferSchema", True).csv(path) if vectors.there(spark, path) else None
        sections[name] = (frame, frame.columns if frame is not None else [])
    with open(a.out, "w") as f:
        f.write(reports.report(a.title, sections))


if __name__ == "__main__":
    main()
