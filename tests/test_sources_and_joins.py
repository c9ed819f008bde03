"""GeoPackage folders by their data source, WKB from arrays, and joins of boxes of any density."""

import numpy as np
from pyspark.sql import functions as F

from gridweave.operators import matching
from gridweave.sources import vectors


def layer_rows(scene, n, shift=0.0):
    ring = lambda x, s: [{"x": x, "y": 0.0}, {"x": x + s, "y": 0.0}, {"x": x + s, "y": s}, {"x": x, "y": s}]
    return [(scene, k, "regularized", [ring(10.0 * k + shift, 4.0), ring(10.0 * k + shift + 1, 1.0)], 15.0, 20.0, 4, 9, 1.0) for k in range(n)]


def test_geopackages_of_scenes(spark, tmp_path):
    folder = str(tmp_path)
    layer = spark.createDataFrame(layer_rows("a", 30) + layer_rows("b", 1) + layer_rows("c", 5, 1e6), vectors.LAYER).repartition(7)
    vectors.write_packages(layer, folder, 32633)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.gpkg", "b.gpkg", "c.gpkg"]
    back = vectors.read_packages(spark, folder)
    assert back.rdd.getNumPartitions() == 3
    key = lambda df: sorted((r["scene"], r["seq"], str(r["rings"]), r["area_m2"], r["n_vertices"], r["orthogonality"]) for r in df.collect())
    assert key(back) == key(layer)
    assert len(vectors.read_geopackage(tmp_path / "a.gpkg")) == 30
    vectors.write_packages(spark.createDataFrame(layer_rows("b", 2), vectors.LAYER), folder, 32633)  # replaces one scene only
    (tmp_path / "d.gpkg").write_bytes(b"no database")
    assert {r["scene"]: r["count"] for r in vectors.read_packages(spark, folder).groupBy("scene").count().collect()} == {"a": 30, "b": 2, "c": 5}
    assert vectors.read_packages(spark, folder, "other").count() == 0
    assert vectors.read_packages(spark, str(tmp_path / "missing")).count() == 0


def test_wkb_of_columns(spark, tmp_path):
    rows = layer_rows("a", 3) + [("a", 3, "regularized", None, None, None, None, None, None), ("a", 4, "regularized", [], None, None, None, None, None)]
    vectors.write_layer(spark.createDataFrame(rows, vectors.LAYER), str(tmp_path / "layer"))
    for r in spark.read.parquet(str(tmp_path / "layer")).collect():
        if r["rings"] is None:
            assert r["geometry"] is None
        else:
            assert bytes(r["geometry"]) == vectors.to_wkb(r["rings"])


def layer_of(spark, rng, n, clustered):
    middle = np.where((rng.random(n) < clustered)[:, None], rng.normal(500, 6, (n, 2)), rng.uniform(0, 1000, (n, 2)))
    size = np.where(rng.random(n) < 0.01, rng.uniform(40, 300, n), rng.uniform(0.2, 2, n))[:, None]
    return spark.createDataFrame([(int(i), "s", *map(float, (*(m - s), *(m + s)))) for i, (m, s) in enumerate(zip(middle, size, strict=True))], "id long, scene string, x0 double, y0 double, x1 double, y1 double")


def test_adaptive_join_equals_grid_join(spark):
    rng = np.random.default_rng(6)
    a, b = (layer_of(spark, rng, 1500, 0.9).repartition(4) for _ in range(2))
    pairs = lambda df: sorted(map(tuple, df.select("l_id", "r_id").collect()))
    want = pairs(matching.grid_join(a, b, 20.0, "scene"))
    got = pairs(matching.adaptive_join(a, b, 20.0, "scene", most=500))
    assert len(want) > 1000 and got == want
    assert matching.adaptive_join(a.limit(0), b, 20.0, "scene").count() == 0


def test_adaptive_join_spreads_clusters(spark):
    rng = np.random.default_rng(7)
    n = 4000
    middle = np.where((rng.random(n) < 0.9)[:, None], rng.uniform(480, 519, (n, 2)), rng.uniform(0, 1000, (n, 2)))
    rows = [(int(i), *map(float, (*(m - 0.3), *(m + 0.3)))) for i, m in enumerate(middle)]
    layer = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "16", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        work = {}
        for name, join in (("grid", matching.grid_join), ("adaptive", lambda *x: matching.adaptive_join(*x, most=2000))):
            found = join(layer, layer, 40.0).groupBy(F.spark_partition_id().alias("p")).count().collect()
            work[name] = sorted(r["count"] for r in found)
            assert sum(work[name]) == sum(work["grid"])
        assert work["adaptive"][-1] <= 4 * np.median(work["adaptive"]) < work["grid"][-1]
        assert len(work["grid"]) < len(work["adaptive"]) or work["grid"][-1] > 4 * np.median(work["grid"])
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
