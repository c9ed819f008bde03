"""Sources, plans, streaming and the catalogue on Spark."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridweave.operators import experiments, matching, pixels, raster, scoring
from gridweave.operators.kernels import labels, polygons
from gridweave.plans import catalogue, vectorise
from gridweave.sources import blocks, config, vectors
from gridweave.streaming import counters

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scene():
    """Six buildings: label mask, byte planes with walls between two that touch."""
    mask = np.zeros((120, 160), np.uint8)
    wall = np.zeros_like(mask)
    for r, c, h, w in ((10, 10, 24, 30), (10, 40, 24, 30), (50, 20, 30, 40), (60, 90, 40, 24), (10, 100, 30, 40)):
        mask[r : r + h, c : c + w] = 255
        wall[r : r + h, c : c + w] = 230
        wall[r + 2 : r + h - 2, c + 2 : c + w - 2] = 10
    return mask, np.where(mask > 0, 220, 5).astype(np.uint8), wall


def test_scene_to_polygons_to_measures(spark, scene):
    mask, interior, wall = scene
    rows = blocks.to_rows("a", 64, interior=interior, boundary=wall) + blocks.to_rows("empty", 64, interior=interior * 0, boundary=wall * 0)
    table = blocks.block_table(spark, rows, "interior", "boundary")
    preds = vectorise.prediction_layer(table).cache()
    assert preds.count() == 5
    assert {r["orthogonality"] for r in preds.collect()} == {1.0}
    truth = np.zeros_like(mask)
    truth[mask > 0] = 255
    truth[:, 40] = 0
    gts = vectorise.label_layer(blocks.block_table(spark, blocks.to_rows("a", 64, v=truth), "v")).cache()
    found = vectorise.candidates(preds, gts)
    matches = matching.mutual_best(found)
    ids = lambda df: df.select("scene", F.col("seq").alias("id"))
    counts = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in matching.scored(matches, ids(preds), ids(gts), (0.25, 0.75)).collect()}
    n = gts.count()
    assert counts[0.25] == (5, 0, n - 5)
    assert vectorise.summary(preds).collect()[0]["n_buildings"] == 5


def test_blocks_and_layers(spark, scene, tmp_path):
    mask, interior, wall = scene
    table = blocks.block_table(spark, blocks.to_rows("a", 64, interior=interior, boundary=wall), "interior", "boundary")
    blocks.write_blocks(table, str(tmp_path / "b"))
    window = blocks.read_window(spark, str(tmp_path / "b"), "a", 0, 0, 10, 10)
    assert window.count() == 1
    assert (blocks.from_rows([r.asDict() for r in spark.read.parquet(str(tmp_path / "b")).collect()], "interior") == interior).all()
    view = blocks.cells(window, "interior").toPandas()
    assert (view.sort_values(["row", "col"])["interior"].to_numpy() == interior[:64, :64].ravel()).all()
    layer = vectorise.prediction_layer(table)
    rows = [r.asDict(recursive=True) for r in layer.collect()]
    for r in rows:
        r["rings"] = [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]
    vectors.write_geopackage(rows, tmp_path / "x.gpkg", 32633)
    back = vectors.read_geopackage(tmp_path / "x.gpkg")
    assert [b["area_m2"] for b in back] == [r["area_m2"] for r in rows]
    assert polygons.area(back[0]["rings"]) == pytest.approx(rows[0]["area_m2"], abs=0.01)
    assert vectors.read_geopackage(tmp_path / "none.gpkg") is None
    vectors.write_layer(layer, str(tmp_path / "l"))
    assert len(vectors.from_wkb(spark.read.parquet(str(tmp_path / "l")).first()["geometry"])) == 1


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("experiment:\n  mode: a\n  a: {train_cities: [x, y], n: 1}\nk: 2\n")
    c = config.load(tmp_path / "c.yaml")
    assert config.overridden(c, ["experiment.a.n=[3, 4]"])["experiment"]["a"]["n"] == [3, 4]
    assert c["experiment"]["a"]["n"] == 1
    for bad, error in (("nope=1", KeyError), ("experiment.z.n=1", KeyError), ("k", ValueError)):
        with pytest.raises(error):
            config.overridden(c, [bad])
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.yaml")
    s = config.mode_settings(c)
    assert s["mode"] == "a" and s["oodval_cities"] == []
    assert len(config.validation_scenes(s)) == 12


def test_scored_blocks(spark):
    image = np.random.default_rng(0).integers(0, 255, (40, 50, 3)).astype(np.uint8)
    table = blocks.block_table(spark, blocks.to_rows("s", 32, r=image[..., 0], g=image[..., 1], b=image[..., 2]), "r", "g", "b")
    rows = scoring.scored_blocks(table, scoring.excess_green_scorer, tile=32, overlap=8).collect()
    got = blocks.from_rows([r.asDict() for r in rows], "interior")
    assert (got == scoring.scene_probabilities(image, scoring.excess_green_scorer, 32, 8)[0]).all()


def test_greedy_equals_mutual_best(spark):
    rng = np.random.default_rng(4)
    rows = [(int(s), int(p), int(g), float(v)) for s, p, g, v in zip(rng.integers(0, 3, 300), rng.integers(0, 25, 300), rng.integers(0, 25, 300), np.round(rng.random(300), 1), strict=True)]
    rows = list({r[:3]: r for r in rows}.values())
    want = set()
    used_p, used_g = set(), set()
    for s, p, g, v in sorted(rows, key=lambda r: (r[3], r[1], r[2]), reverse=True):
        if v > 0 and (s, p) not in used_p and (s, g) not in used_g:
            used_p.add((s, p))
            used_g.add((s, g))
            want.add((s, p, g, v))
    frame = spark.createDataFrame(rows, "scene int, pred int, gt int, iou double")
    for most in (1000, 100, 0):  # by scene, mixed, all in rounds
        assert {tuple(r) for r in matching.mutual_best(frame, most).collect()} == want


def test_raster_cells_match_kernels(spark):
    mask = np.random.default_rng(8).random((25, 30)) < 0.5
    cells = spark.createDataFrame([(0, int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)], "scene int, row int, col int")
    for eight in (False, True):
        for size in (1024, 4):
            got = raster.components(cells, eight, size).toPandas()
            want = labels.components(mask, eight)
            pairs = set(zip(got["label"], want[got["row"], got["col"]], strict=True))
            assert len(pairs) == got["label"].nunique() == want.max() and len(got) == mask.sum()
            assert (got.groupby("label").apply(lambda g: (g["row"].astype("int64") * (1 << 31) + g["col"]).min()) == got.groupby("label")["label"].first()).all()
    for d in (1, 2, 3):
        kept = {(r["row"], r["col"]) for r in raster.eroded(cells, raster.ellipse(d)).collect()}
        assert kept == set(zip(*map(list, map(np.ndarray.tolist, np.nonzero(labels.eroded(mask, raster.ellipse(d))))), strict=True))


def test_published_arithmetic(spark):
    # fixed values: published pooled counts of two regions and their ratios
    rows = [("kitsap", 34497620, 8267962, 9195938), ("tyrol-w", 47380482, 5286805, 5210742)]
    got = {r["grp"]: r for r in pixels.summarised(spark.createDataFrame(rows, "city string, tp long, fp long, fn long"), "city").collect()}
    for grp, iou, f1 in (("ALL", 0.7454, 0.8542), ("kitsap", 0.6639, 0.7980), ("tyrol-w", 0.8186, 0.9003)):
        assert round(got[grp]["iou"], 4) == iou and round(got[grp]["f1"], 4) == f1


def test_experiment_tables(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.625)], "tag string, iou double")
    assert {tuple(r) for r in experiments.upserted(rows, spark.createDataFrame([("b", 1.0), ("c", 2.0)], rows.schema), "tag").collect()} == {("a", 0.5), ("b", 1.0), ("c", 2.0)}
    assert {r["tag"]: r["delta"] for r in experiments.deltas(rows, "tag", "a", "iou").collect()} == {"a": 0.0, "b": 0.125}
    assert experiments.deltas(rows, "tag", "none", "iou").count() == 0
    assert experiments.markdown(rows.orderBy("tag"), ["tag", "missing", "iou"]).splitlines()[2] == "| a | 0.5000 |"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(g, b, b % 3 == 0) for g in ("x", "y") for b in range(0, 256, 5)], "grp string, byte int, truth boolean")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counters.started(counters.running_counts(stream, "grp"), "running", str(tmp_path / "ck")).awaitTermination(120)
    last = spark.table("running").groupBy("grp").agg(F.max(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"))
    assert {tuple(r) for r in last.collect()} == {("x", 52), ("y", 52)}


FAST = ["confusion_by_region", "threshold_sweep", "strict_match", "merge_match", "ring_metrics", "erode_band", "blend_overlaps", "focal_tversky", "running_best", "components8", "boundary_counts", "mean_pool_top_window", "densest_half_stride", "first_in_group", "name_filter", "loss_total", "epoch_means", "fixed_normalize", "shuffled_batches", "round_robin_pick", "crop_visibility", "polygon_filter", "parameter_count", "block_counts", "scene_inference"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", FAST)
def test_catalogue_equals_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    want, got = con.sql(catalogue.ORACLE_SQL[name]).df(), catalogue.QUERIES[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(want), order(got), check_dtype=False, atol=1e-9)


def test_every_query_has_a_function():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_reports(spark, scene):
    from gridweave.plans import reports

    mask, interior, wall = scene
    prob = blocks.block_table(spark, blocks.to_rows("a", 64, interior=interior, boundary=wall), "interior", "boundary")
    truth = mask.copy()
    truth[10:14] = 0
    label = blocks.block_table(spark, blocks.to_rows("a", 64, v=truth), "v")
    cities = reports.scene_cities(spark, [("a", "x"), ("b", "x")])
    out = reports.evaluated(vectorise.prediction_layer(prob), vectorise.label_layer(label), prob, label, cities, widths=(1,))
    rows = {r["grp"]: r for r in out.pixels.collect()}
    p, g = interior >= 128, truth > 127
    assert rows["ALL"]["tp"] == (p & g).sum() and rows["x"]["fp"] == (p & ~g).sum()
    ring = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
    bp, bg = p & ~labels.eroded(p, ring), g & ~labels.eroded(g, ring)
    assert rows["ALL"]["b1_iou"] == pytest.approx((bp & bg).sum() / (bp | bg).sum())
    assert out.skipped == 1
    assert {r["matching"] for r in out.instances.collect()} == {"strict", "merge_tolerant"}
    assert out.displacement.first()["n"] >= 3
    curves, best = reports.swept(prob, label, cities)
    assert curves.count() == 512 and best.count() == 2
    row = reports.experiment_row(prob, label, "A", loss="dice")
    text = reports.report("R", {"Runs": (row, ["tag", "iou", "none"]), "Missing": (None, [])}, 0.9, 0.8)
    assert "| A | 0." in text and "Missing" not in text and "0.1000" in text
    ran = []
    ladder = [("A", []), ("B", ["x=1"]), ("C", ["y=2"])]
    assert reports.climbed(ladder, {"B"}, lambda t, c: ran.append((t, c))) == ["A", "C"]
    assert ran[-1] == ("C", ["x=1", "y=2"])
    assert reports.climbed(ladder, set(), None, from_rung="B", dry=True) == ["B", "C"]
    assert reports.environment()["pyspark"]


def test_sql_functions(spark):
    from gridweave.functions.registry import register

    register(spark)
    ring = "array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 10D, 'y', 0D), named_struct('x', 10D, 'y', 10D), named_struct('x', 0D, 'y', 10D)))"
    got = spark.sql(f"select gw_area(r) a, gw_length(r) l, gw_iou(r, r) i, gw_orthogonality(r) o, gw_area(gw_from_wkb(gw_to_wkb(r))) w, gw_area(gw_regularize(r)) g, gw_area(null) n from (select {ring} as r)").first()
    assert (got["a"], got["l"], got["o"], got["w"], got["n"]) == (100, 40, 1, 100, None)
    assert got["i"] == pytest.approx(1) and got["g"] == pytest.approx(100)
    assert [r[0] for r in spark.sql("select start from gw_window_starts(1000, 512, 384)").collect()] == [0, 384, 488]
    assert [tuple(r) for r in spark.sql("select * from gw_block_cells(2, 3, 2, X'0A0B0C')").collect()] == [(2, 3, 10), (2, 4, 11), (3, 3, 12)]


def test_manifest_order(spark, tmp_path):
    for n, name in enumerate(("a.csv", "b.csv", "c.csv")):
        lines = [f"s{n}{i},city,i,g" for i in range((5, 300, 2)[n])]
        (tmp_path / name).write_text("scene,city,image_path,gt_path\n" + "\n".join(lines) + "\n")
    got = vectors.read_manifest(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(307))
    assert [r["scene"] for r in got[:6]] == ["s00", "s01", "s02", "s03", "s04", "s10"]
    assert vectors.read_optional_csv(spark, str(tmp_path / "none.csv"), "a string") is None
    assert vectors.read_optional_csv(spark, str(tmp_path / "a.csv"), "scene string, city string, image_path string, gt_path string").count() == 5


def test_merge_tolerant_unions(spark):
    box = lambda x0, y0, x1, y1: [[{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]
    schema = "scene string, seq int, rings array<array<struct<x:double,y:double>>>"
    gts = spark.createDataFrame([("s", 1, box(0, 0, 10, 10)), ("s", 2, box(0, 0, 10, 6))], schema)
    preds = spark.createDataFrame([("s", 1, box(0, 0, 10, 6)), ("s", 2, box(0, 0, 10, 6)), ("s", 3, box(20, 20, 21, 21))], schema)
    found = vectorise.candidates(preds, gts)
    groups = vectorise.merged_unions(found, preds, gts)
    got = {r["gt"]: (sorted(r["preds"]), round(r["iou"], 6)) for r in groups.collect()}
    assert got == {1: ([1, 2], 0.6), 2: ([1, 2], 1.0)}
    ids = lambda df: df.select("scene", df["seq"].alias("id"))
    scored = matching.merge_scored(groups, ids(preds), ids(gts), (0.5,)).collect()
    assert [tuple(r) for r in scored] == [("s", 0.5, 1, 1, 1)]  # both labels want the same predictions: the better one gets them


def test_block_kernels_equal_cells(spark):
    from gridweave.operators import tiles

    rng = np.random.default_rng(5)
    byte = np.repeat(np.repeat(rng.integers(0, 256, (14, 17)), 8, 0), 8, 1)[:110, :133].astype(np.uint8)
    truth = np.where(np.roll(byte, 3, 1) > 120, 255, 0).astype(np.uint8)
    prob = blocks.block_table(spark, blocks.to_rows("a", 32, interior=byte, boundary=byte), "interior", "boundary")
    label = blocks.block_table(spark, blocks.to_rows("a", 32, v=truth), "v")
    for size in (48, 512):
        got = {r["d"]: (r["tp"], r["fp"], r["fn"]) for r in tiles.band_counts(prob, label, (1, 3, 5), size=size).collect()}
        for d in (1, 3, 5):
            p, t = byte >= 128, truth > 127
            bp, bt = p & ~labels.eroded(p, raster.ellipse(d)), t & ~labels.eroded(t, raster.ellipse(d))
            assert got[d] == ((bp & bt).sum(), (bp & ~bt).sum(), (bt & ~bp).sum())
    bytes_ = tiles.graded_bytes(prob, label)
    assert {(r["byte"], r["pos"]) for r in bytes_.collect() if r["pos"]} == set(zip(*(x.tolist() for x in np.unique(byte[truth > 127], return_counts=True)), strict=True))
    counts = tiles.confusion_of(bytes_, "scene").first()
    assert counts["tp"] == (p & t).sum() and counts["tn"] == (~p & ~t).sum()
    small = blocks.block_table(spark, blocks.to_rows("a", 32, v=truth[:100]), "v")
    with pytest.raises(Exception, match="differ in size"):
        tiles.graded_bytes(prob, small).collect()


def test_windows_of_large_scenes(spark):
    image = np.random.default_rng(1).integers(0, 255, (70, 90, 3)).astype(np.uint8)
    table = blocks.block_table(spark, blocks.to_rows("s", 25, r=image[..., 0], g=image[..., 1], b=image[..., 2]), "r", "g", "b")
    out = scoring.scored_blocks(table, scoring.excess_green_scorer, tile=32, overlap=8, size=40).collect()
    want = scoring.scene_probabilities(image, scoring.excess_green_scorer, 32, 8)
    for band, plane in zip(("interior", "boundary"), want, strict=True):
        assert (blocks.from_rows([r.asDict() for r in out], band) == plane).all()
    assert len(out) == 6


def test_geotiff(spark, tmp_path):
    from gridweave.sources import geotiff

    rng = np.random.default_rng(2)
    planes = np.repeat(rng.integers(0, 255, (70, 20, 2)), 3, 1).astype(np.uint8)
    affine = (0.3, 0.0, 500000.0, 0.0, -0.3, 4000000.0)
    (tmp_path / "b_prob.tif").write_bytes(geotiff.encoded(planes, affine, 32))
    (tmp_path / "a_prob.tif").write_bytes(geotiff.encoded(planes[:9, :9], None, 4))
    rows = geotiff.read_geotiff(spark, str(tmp_path), ("interior", "boundary"), "_prob.tif", 32).collect()
    for scene, part in (("a", planes[:9, :9]), ("b", planes)):
        mine = [r.asDict() for r in rows if r["scene"] == scene]
        for i, band in enumerate(("interior", "boundary")):
            assert (blocks.from_rows(mine, band) == part[..., i]).all()
        assert mine[0]["affine"] == (list(affine) if scene == "b" else None)
    assert [r[0] for r in blocks.scenes_of(spark, str(tmp_path)).collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="TIFF"):
        geotiff.tags(b"GIF89a__")


def big_tiff(path, planes, side, start):
    """A file with 64-bit offsets and deflated tiles, the first of which begins at start; what lies before stays unwritten."""
    import struct
    import zlib

    h, w, n = planes.shape
    tiles = []
    for r in range(0, h, side):
        for c in range(0, w, side):
            tile = np.zeros((side, side, n), np.uint8)
            part = planes[r : r + side, c : c + side]
            tile[: part.shape[0], : part.shape[1]] = part
            tiles.append(zlib.compress(tile.tobytes()))
    offsets = [start + sum(map(len, tiles[:i])) for i in range(len(tiles))]
    after = offsets[-1] + len(tiles[-1])
    entries = [(256, "Q", [w]), (257, "Q", [h]), (258, "H", [8] * n), (259, "H", [8]), (277, "H", [n]), (322, "I", [side]), (323, "I", [side]), (324, "Q", offsets), (325, "Q", [len(t) for t in tiles])]
    at, extra = after + 8 + 20 * len(entries) + 8, b""
    body = struct.pack("<Q", len(entries))
    for tag, form, values in entries:
        packed = struct.pack(f"<{len(values)}{form}", *values)
        kind = {"H": 3, "I": 4, "Q": 16}[form]
        body += struct.pack("<HHQ", tag, kind, len(values))
        body += packed.ljust(8, b"\0") if len(packed) <= 8 else struct.pack("<Q", at + len(extra))
        extra += packed if len(packed) > 8 else b""
    with path.open("wb") as file:
        file.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, after))
        file.seek(start)
        file.write(b"".join(tiles) + body + b"\0" * 8 + extra)


def test_windows_of_raster_files(spark, tmp_path, monkeypatch):
    from gridweave.sources import geotiff

    rng = np.random.default_rng(8)
    planes = np.repeat(rng.integers(0, 255, (200, 60, 2)), 5, 1).astype(np.uint8)  # 200 x 300
    big_tiff(tmp_path / "big_prob.tif", planes, 32, (2 << 30) + 12345)
    assert (tmp_path / "big_prob.tif").stat().st_size > 2 << 30
    (tmp_path / "other_prob.tif").write_bytes(geotiff.encoded(planes[:50], None, 16))
    whole = geotiff.read_geotiff(spark, str(tmp_path), ("a", "b"), "_prob.tif", 64)
    rows = [r.asDict() for r in whole.filter("scene = 'big'").collect()]
    assert all((blocks.from_rows(rows, band) == planes[..., i]).all() for i, band in enumerate("ab"))
    assert whole.select("scene").distinct().count() == 2
    part = geotiff.read_geotiff(spark, str(tmp_path), ("a", "b"), "_prob.tif", 64, "big", (70, 130, 20, 30))
    assert [(r["scene"], r["row0"], r["col0"]) for r in part.collect()] == [("big", 64, 128)]
    # the same window, decoded here: a block of 64 meets four tiles of 32, and nothing else is decoded
    reader = geotiff.RasterReader({"path": str(tmp_path), "bands": "a,b", "suffix": "_prob.tif", "size": "64", "scene": "big", "window": "70,130,20,30"})
    monkeypatch.setattr(geotiff, "SPLIT", 64 * 300 * 2)  # a partition a row of blocks
    decoded = []
    monkeypatch.setattr(geotiff, "unpacked", lambda data, kind, real=geotiff.unpacked: decoded.append(1) or real(data, kind))
    (one,) = reader.partitions()
    assert (one.first, one.stop) == (1, 2)
    (batch,) = reader.read(one)
    assert len(decoded) == 4 and batch.num_rows == 1
    assert (np.frombuffer(batch["b"][0].as_py(), np.uint8).reshape(64, 64) == planes[64:128, 128:192, 1]).all()
    with pytest.raises(Exception, match="bands"):
        geotiff.read_geotiff(spark, str(tmp_path), ("a", "b", "c"), "_prob.tif").collect()


def test_scorer_gets_batches_of_chips(spark):
    rng = np.random.default_rng(9)
    image = rng.integers(0, 255, (130, 170, 3)).astype(np.uint8)
    rows = blocks.to_rows("a", 50, r=image[..., 0], g=image[..., 1], b=image[..., 2])

    def scorer(chips):
        if len(chips) > 3:
            raise ValueError("more chips than asked for")
        return scoring.excess_green_scorer(chips) * (1.0 if len(chips) > 1 else 0.5)  # a lone chip would show

    sizes = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = [r.asDict() for r in scoring.scored_blocks(blocks.block_table(spark, rows, "r", "g", "b"), scorer, tile=40, overlap=10, size=64, chips_at_once=3).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", sizes)
    want = scoring.scene_probabilities(image, scoring.excess_green_scorer, 40, 10)
    windows = len(scoring.starts(130, 40, 30)) * len(scoring.starts(170, 40, 30))
    assert windows % 3 != 1
    assert all((blocks.from_rows(got, band) == want[k]).all() for k, band in enumerate(("interior", "boundary")))


def test_lzw_decoding():
    from gridweave.sources import geotiff

    def packed(data: bytes) -> bytes:  # a plain encoder: codes grow one entry early, a clear code before the table is full
        known, width, bits = {bytes([i]): i for i in range(256)}, 9, "100000000"
        size, word = 258, b""
        for value in data:
            longer = word + bytes([value])
            if longer in known:
                word = longer
                continue
            bits += format(known[word], f"0{width}b")
            known[longer] = size
            size += 1
            if size == 4094:
                bits += format(256, f"0{width}b")
                known, size = {bytes([i]): i for i in range(256)}, 258
            width = max(9, (size + 1 - 1).bit_length())
            word = bytes([value])
        bits += format(known[word], f"0{width}b")
        size += 1
        bits += format(257, f"0{max(9, size.bit_length())}b")
        return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))

    for data in (b"aaaaaaa", bytes(range(256)) * 3, np.random.default_rng(3).integers(0, 9, 30000).astype(np.uint8).tobytes()):
        assert geotiff.unpacked(packed(data), geotiff.LZW) == data


def test_ordering(spark):
    from gridweave.operators import ordering

    rows = spark.range(1000).withColumn("k", F.col("id") * 7 % 1000).repartition(5)
    got = ordering.numbered(rows, "k").collect()
    assert {(r["k"] + 1, r["nth"]) for r in got} == {(i, i) for i in range(1, 1001)}
    assert ordering.limited(rows, "k", 3).count() == 3 and ordering.limited(rows, "k").count() == 1000
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "scene string")
    assert ordering.named(names, "scene", " a, c ,").count() == 2 and ordering.named(names, "scene", None).count() == 3
    one, two = (ordering.batches(rows, "id", 64, seed=s, drop_last=True).collect() for s in (1, 1))
    assert {(r["id"], r["batch"], r["place"]) for r in one} == {(r["id"], r["batch"], r["place"]) for r in two}
    assert len(one) == 960 and max(r["batch"] for r in one) == 14
    assert ordering.numbered(rows.filter("false"), "k").count() == 0


def test_learning(spark, tmp_path, scene):
    from gridweave.operators import learning
    from gridweave.sources import config as c

    rng = learning.seeded(3)
    x, y = rng.normal(size=50) * 9, (rng.random(50) < 0.4).astype(float)
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    got = frame.agg(learning.bce(F.col("x"), F.col("y"), 3.0).alias("bce"), learning.head_loss(F.col("x"), F.col("y"), 0.25, 0.75).alias("head")).first()
    p = 1 / (1 + np.exp(-x))
    assert got["bce"] == pytest.approx(-(3 * y * np.log(p) + (1 - y) * np.log1p(-p)).mean(), rel=1e-6)
    dice = 1 - (2 * (p * y).sum() + 1) / (p.sum() + y.sum() + 1)
    assert got["head"] == pytest.approx(-0.25 * (y * np.log(p) + (1 - y) * np.log1p(-p)).mean() + 0.75 * dice, rel=1e-6)
    with pytest.raises(ValueError):
        learning.head_loss(F.col("x"), F.col("y"), region="none")
    shapes = spark.createDataFrame([("a", [3, 4], True), ("b", [5], False), ("c", [], True)], "name string, shape array<int>, trainable boolean")
    assert learning.parameter_count(shapes).first()["n"] == 13
    state = {"w": rng.normal(size=(3, 2)).astype(np.float32), "n": np.array(7)}
    learning.save_state(spark, state, str(tmp_path / "state"))
    back = learning.load_state(spark, str(tmp_path / "state"))
    assert set(back) == set(state) and all((back[k] == state[k]).all() and back[k].dtype == state[k].dtype for k in state)
    c.snapshot({"a": {"b": [1, 2]}}, tmp_path / "c.yaml")
    assert c.load(tmp_path / "c.yaml") == {"a": {"b": [1, 2]}}
    chip = rng.integers(0, 255, (16, 16, 3)).astype(np.uint8)
    assert (learning.amplitude_swapped(chip, chip, 0.2) == chip).all()
    assert (learning.augmented(chip, np.random.default_rng(1)) == learning.augmented(chip, np.random.default_rng(1))).all()
    _, interior, wall = scene
    bands = {"r": interior, "g": wall, "b": interior, "interior": interior, "boundary": wall}
    table = blocks.block_table(spark, blocks.to_rows("a", 64, **bands), *bands)
    plain = {(r["row0"], r["col0"]): r for r in learning.tile_set(table, normalization="per_tile", green=True).collect()}
    first = np.array(plain[(0, 0)]["x"]).reshape(4, 64, 64)
    assert np.allclose(first.mean((1, 2)), 0, atol=1e-4) and np.allclose(first.std((1, 2)), 1, atol=1e-3)
    assert (np.array(plain[(0, 0)]["y"]).reshape(2, 64, 64)[0] == (interior[:64, :64] > 127)).all()
    one, two = (sorted(learning.tile_set(table, seed=5).collect()) for _ in range(2))
    assert one == two


def test_partners_and_zoom(spark):
    from gridweave.operators import learning

    rng = np.random.default_rng(12)
    rows = []
    for k in range(14):
        planes = rng.integers(0, 255, (5, 16, 16)).astype(np.uint8)
        rows += [(*r, "north" if k % 3 else "south") for r in blocks.to_rows(f"t{k}", 16, **dict(zip(("r", "g", "b", "interior", "boundary"), planes, strict=True)))]
    table = spark.createDataFrame([*rows, (*rows[0][:5], *rows[0][5:10], None)][:14], blocks.KEY + ", r binary, g binary, b binary, interior binary, boundary binary, city string").repartition(3)
    of = {bytes(r["r"]): (r["scene"], r["city"]) for r in table.collect()}
    for intra in (False, True):
        pairs = {r["scene"]: (r["city"], *of[bytes(r["partner_r"])]) for r in learning.partnered(table, 5, intra).collect()}
        assert len(pairs) == 14 and {p[1] for p in pairs.values()} == set(pairs) and all(p[1] != s for s, p in pairs.items())
        assert pairs == {r["scene"]: (r["city"], *of[bytes(r["partner_r"])]) for r in learning.partnered(table.repartition(5), 5, intra).collect()}
        assert all(a == b for a, _, b in pairs.values()) == intra
    assert pairs != {r["scene"]: (r["city"], *of[bytes(r["partner_r"])]) for r in learning.partnered(table, 6, True).collect()}
    key = lambda df: {r["scene"]: (r["x"], r["y"]) for r in df.collect()}
    both = learning.partnered(table, 5)
    once, again = (key(learning.tile_set(both.repartition(n), 5, p_zoom=0.5, p_swap=0.5)) for n in (2, 4))
    plain, swapped = key(learning.tile_set(both, 5)), key(learning.tile_set(both, 5, p_swap=1.0))
    assert once == again and once != plain
    assert all(plain[s][1] == swapped[s][1] and plain[s][0] != swapped[s][0] for s in plain)  # labels aren't swapped
    mask = np.zeros((16, 16, 4), np.uint8)
    mask[4:12, 4:12] = 255
    assert (learning.zoomed(mask, 2.0)[..., 0] == learning.zoomed(mask, 2.0)[..., 3]).all() and learning.zoomed(mask, 2.0).all() and (learning.zoomed(mask, 1.0) == mask).all()


def test_bucketed_layers_join_without_exchange(spark):
    from gridweave.operators import tiles

    plane = np.random.default_rng(13).integers(0, 255, (64, 64)).astype(np.uint8)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, band in (("prob_blocks", "interior"), ("label_blocks", "v")):
            blocks.write_block_table(blocks.block_table(spark, blocks.to_rows("a", 16, **{band: plane}), band), name, 4)
        prob, label = spark.table("prob_blocks"), spark.table("label_blocks")
        joined = tiles.paired(prob, label)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        got = {(r["byte"]): (r["pos"], r["neg"]) for r in tiles.graded_bytes(prob, label).collect()}
        assert sum(p + n for p, n in got.values()) == plane.size and all(p == 0 or b > 127 for b, (p, n) in got.items())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in ("prob_blocks", "label_blocks"):
            spark.sql(f"drop table if exists {name}")


def test_wkb_types(spark):
    wkb = [(vectors.to_wkb([[(0, 0), (1, 0), (1, 1)]]),), (bytes.fromhex("0101000000") + bytes(16),), (None,)]
    assert [r[0] for r in spark.createDataFrame(wkb, "g binary").select(vectors.is_polygon(F.col("g"))).collect()] == [True, False, False]


def test_command_lines(spark, scene, tmp_path, capsys):
    from gridweave.__main__ import main
    from gridweave.sources import geotiff

    mask, interior, wall = scene
    at = lambda name: str(tmp_path / name)
    (tmp_path / "images").mkdir()
    for name in ("a", "b"):
        (tmp_path / "images" / f"{name}.tif").write_bytes(geotiff.encoded(np.stack([mask] * 3, 2)))
    main(["predict", "--images", at("images"), "--out", at("own"), "--limit", "1"], spark)
    assert [r["scene"] for r in spark.read.parquet(at("own")).select("scene").distinct().collect()] == ["a"]
    blocks.write_blocks(blocks.block_table(spark, blocks.to_rows("a", 64, interior=interior, boundary=wall), "interior", "boundary"), at("prob"))
    blocks.write_blocks(blocks.block_table(spark, blocks.to_rows("a", 64, v=mask), "v"), at("label"))
    main(["vectorize", "--blocks", at("prob"), "--out", at("pred")], spark)
    main(["vectorize", "--blocks", at("prob"), "--out", at("raw"), "--no-regularize"], spark)
    main(["vectorize", "--blocks", at("label"), "--out", at("gt"), "--ground-truth"], spark)
    (tmp_path / "c.yaml").write_text("inference: {threshold_interior: 0.5}\nvectorize: {min_area_m2: 20.0}\nevaluate: {iou_thresholds: [0.5]}\n")
    main(["vectorize", "--blocks", at("prob"), "--out", at("none"), "--suffix", "large", "--config", at("c.yaml"), "--set", "vectorize.min_area_m2=1000000000.0"], spark)
    assert spark.read.schema(vectors.LAYER).parquet(at("none/large")).count() == 0 < spark.read.parquet(at("pred")).count()
    with pytest.raises(KeyError):
        main(["vectorize", "--blocks", at("prob"), "--out", at("none"), "--config", at("c.yaml"), "--set", "vectorize.nothing=1"], spark)
    (tmp_path / "m.csv").write_text("scene,city,image_path,gt_path\na,x,i,g\nb,x,i,g\n")
    inputs = ["--blocks", at("prob"), "--labels", at("label")]
    main(["evaluate", *inputs, "--manifest", at("m.csv"), "--pred-vectors", at("pred"), "--gt-vectors", at("gt"), "--raw-vectors", at("raw"), "--out", at("ev")], spark)
    shapes = {r["variant"]: r for r in spark.read.option("header", True).option("inferSchema", True).csv(at("ev/shapes")).collect()}
    assert set(shapes) == {"pred_reg", "pred_raw", "gt_traced", "gt_simplified"} and shapes["gt_simplified"]["vertices"] <= shapes["gt_traced"]["vertices"]
    assert "1 scenes skipped" in capsys.readouterr().out
    main(["evaluate", *inputs, "--manifest", at("m.csv"), "--pred-vectors", at("pred"), "--gt-vectors", at("gt"), "--out", at("ev1"), "--config", at("c.yaml"), "--max-instance-scenes", "1"], spark)
    assert {r["threshold"] for r in spark.read.option("header", True).option("inferSchema", True).csv(at("ev1/instances")).collect()} == {0.5}
    main(["sweep", *inputs, "--manifest", at("m.csv"), "--out", at("sw")], spark)
    assert spark.read.option("header", True).csv(at("sw/best")).count() == 2
    for _ in range(2):
        main(["score", *inputs, "--tag", "A", "--out", at("runs"), "--baseline", "A"], spark)
    assert "| A |" in capsys.readouterr().out and spark.read.option("header", True).csv(at("runs")).count() == 1
    main(["report", "--out", at("r.md"), "--section", f"Runs={at('runs')}", "--section", f"None={at('nowhere')}"], spark)
    text = (tmp_path / "r.md").read_text()
    assert "## Runs" in text and "## None" not in text


def test_displacement_kernel_equals_expression(spark):
    from gridweave.functions import measures

    rng = np.random.default_rng(9)
    ring = lambda n: [{"x": float(x), "y": float(y)} for x, y in rng.normal(size=(n, 2))]
    rows = [(ring(5), ring(9)), (ring(1), ring(3)), (ring(3)[:1] * 3, ring(4)), ([], ring(3)), (None, ring(3))]
    frame = spark.createDataFrame(rows, "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    a, b = F.col("a"), F.col("b")
    for r in frame.select(matching.ring_displacement(a, b).alias("k"), measures.displacement(a, b).alias("e")).collect():
        assert (r["k"] is None) == (r["e"] is None) and (r["k"] is None or r["k"] == pytest.approx(r["e"]))


def test_flooding_of_shared_parts():
    rng = np.random.default_rng(12)
    for _ in range(20):
        mask = rng.random((18, 21)) < 0.7
        surface = rng.integers(0, 6, mask.shape).astype(np.uint8)
        markers = np.where(rng.random(mask.shape) < 0.04, np.arange(mask.size).reshape(mask.shape) % 7 + 1, 0)
        out, queue, age = np.where(mask, markers, 0), [], 0
        for r, c in zip(*np.nonzero(out), strict=True):
            queue.append((surface[r, c], age, r, c))
            age += 1
        while queue:  # cell by cell, over everything
            queue.sort()
            _, _, r, c = queue.pop(0)
            for y, x in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
                if 0 <= y < 18 and 0 <= x < 21 and mask[y, x] and not out[y, x]:
                    out[y, x] = out[r, c]
                    queue.append((surface[y, x], age, y, x))
                    age += 1
        assert (labels.flooded(surface, markers, mask) == out).all()
