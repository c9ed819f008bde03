"""Scenes in squares: the same instances, outlines and components as whole scenes; graphs in few rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import graphs, raster, scenes
from gridweave.operators.kernels import labels as L
from gridweave.plans import vectorise
from gridweave.sources.blocks import block_table, to_rows


def textured(rng, h, w, passes):
    a = rng.random((h, w))
    for _ in range(passes):
        p = np.pad(a, 1, mode="edge")
        a = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] + p[1:-1, 1:-1]) / 5
    return ((a - a.min()) / (a.max() - a.min()) * 255).astype(np.uint8)


def shapes(rings):
    return sorted(tuple(map(tuple, r.astype(int).tolist())) for r in L.arranged(rings))


def whole(plane):
    return sorted(shapes(rings) for _, rings in L.traced(plane))


def collected(found):
    out = {}
    for row in found.collect():
        out.setdefault(row["scene"], []).append(shapes([np.stack([w["xs"], w["ys"]], 1).astype(float) for w in row["rings"]]))
    return {k: sorted(v) for k, v in out.items()}


def test_arcs_of_blocks_make_the_rings_of_the_scene():
    rng = np.random.default_rng(1)
    for _ in range(60):
        h, w = rng.integers(1, 14, 2)
        plane = L.components(rng.random((h, w)) < rng.uniform(0.2, 0.9), eight=True)
        want = sorted((v, s) for v, rings in L.traced(plane) for s in shapes(rings))
        assert want == sorted((v, *shapes([np.stack([x, y], 1)])) for v, _, _, x, y in L.arcs(np.pad(plane, 1)))
        padded, walks, got = np.pad(plane, 4), {}, []
        for r in range(0, h, 4):
            for c in range(0, w, 4):
                for v, start, on, x, y in L.arcs(padded[r + 3 : r + 9, c + 3 : c + 9], r, c):
                    walks[start] = (v, start if on is None else on, np.stack([x, y], 1))
        while walks:
            start = next(iter(walks))
            v, on, line = walks.pop(start)
            lines = [line]
            while on != start:
                _, on, line = walks.pop(on)
                lines.append(line)
            got.append((v, *shapes([np.concatenate(lines)])))
        assert sorted(got) == want


def test_pieces_of_equal_values():
    rng = np.random.default_rng(2)
    for eight in (False, True):
        values = rng.integers(0, 4, (25, 31))
        found = L.pieces(values, eight)
        assert (found > 0).tolist() == (values > 0).tolist()
        parts = [L.components(values == v, eight) for v in (1, 2, 3)]
        assert found.max() == sum(p.max() for p in parts)
        assert all(len(np.unique(values[found == k])) == 1 and any((p[found == k] == p[found == k][0]).all() and p[found == k][0] for p in parts) for k in range(1, found.max() + 1))
        firsts = [int(np.flatnonzero(found.ravel() == k)[0]) for k in range(1, found.max() + 1)]
        assert firsts == sorted(firsts)


def test_instances_of_squares_equal_those_of_scenes(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k, (h, w) in enumerate([(150, 200), (64, 64), (70, 130), (10, 300)]):
        inside, wall = textured(rng, h, w, 6), (textured(rng, h, w, 2) * 0.6).astype(np.uint8)
        inside = np.clip(inside.astype(int) + 40, 0, 255).astype(np.uint8)
        rows += to_rows(f"s{k}", 100, interior=inside, boundary=wall)
        found = L.instances(inside, wall, seed_least=3)
        parts = L.components(inside >= 128)
        assert k or len(np.unique(found[parts == np.bincount(parts[parts > 0]).argmax()])) > 5  # many seeds share a part
        want[f"s{k}"] = whole(found)
    got = scenes.outlines(scenes.instance_pieces(block_table(spark, rows, "interior", "boundary"), seed_least=3, size=64), size=64)
    assert collected(got) == want


@pytest.mark.parametrize("eight", [False, True])
def test_components_of_squares_equal_those_of_scenes(spark, eight):
    rng = np.random.default_rng(5)
    planes = {f"m{k}": (rng.random((90 + 30 * k, 140)) < 0.6).astype(np.uint8) * 255 for k in range(2)}
    blocks = block_table(spark, [r for n, p in planes.items() for r in to_rows(n, 50, v=p)], "v")
    pieces = scenes.component_pieces(blocks, eight=eight, size=64)
    if eight:
        assert collected(scenes.outlines(pieces, size=64)) == {n: whole(L.components(p > 127, True)) for n, p in planes.items()}
    sizes = {}
    for r in pieces.collect():
        for code, n in zip(*np.unique(scenes.unpacked(r["codes"], r["h"], r["w"]), return_counts=True), strict=True):
            if code:
                key = r["scene"], r["values"][code - 1]
                sizes[key] = sizes.get(key, 0) + int(n)
    for n, p in planes.items():
        assert sorted(v for (s, _), v in sizes.items() if s == n) == sorted(np.bincount(L.components(p > 127, eight).ravel())[1:].tolist())


def test_a_ring_over_many_squares_and_empty_scenes(spark):
    plane = np.zeros((200, 260), np.uint8)
    plane[5:195, 7:250] = 255
    plane[30:170, 40:200] = 0  # one hole over many squares, with an island
    plane[90:110, 90:100] = 255
    blocks = block_table(spark, [*to_rows("a", 64, v=plane), *to_rows("none", 64, v=plane * 0)], "v")
    assert collected(scenes.outlines(scenes.component_pieces(blocks, size=16), size=16)) == {"a": whole(L.components(plane > 0, True))}
    layer = vectorise.label_layer(blocks, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)).orderBy("seq").collect()
    assert [(r["scene"], r["seq"], r["area_m2"], len(r["rings"])) for r in layer] == [("a", 0, 190 * 243 - 140 * 160, 2), ("a", 1, 200, 1)]
    assert vectorise.prediction_layer(block_table(spark, to_rows("none", 64, interior=plane * 0, boundary=plane * 0), "interior", "boundary")).count() == 0


def test_chains_need_few_rounds(spark, monkeypatch):
    chain = spark.range(200).select(F.lit("c").alias("scene"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1, 60).select(F.lit("s").alias("scene"), F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    links = chain.unionByName(star).unionByName(spark.createDataFrame([("c", 900, 901), ("s", 5, 5)], "scene string, a long, b long"))
    written = []
    monkeypatch.setattr(graphs, "materialised", lambda df, real=graphs.materialised: written.append(1) or real(df))
    slow = graphs.least_ids(links, small=0)
    assert len(written) <= 3 + 3 * 15
    got = {(r["scene"], r["id"]): r["least"] for r in slow.collect()}
    assert got == {(r["scene"], r["id"]): r["least"] for r in graphs.least_ids(links).collect()}
    assert got == {**{("c", i): 0 for i in range(201)}, **{("s", i): 1 for i in [*range(1, 60), 1000]}, ("c", 900): 900, ("c", 901): 900}
    assert graphs.least_ids(links.limit(0), small=0).collect() == []


def test_a_snake_over_squares(spark):
    lanes = [(r, c) for r in range(0, 40, 2) for c in range(40)] + [(r, 39 if r % 4 == 1 else 0) for r in range(1, 39, 2)]
    cells = spark.createDataFrame([("a", r, c) for r, c in lanes], "scene string, row int, col int")
    got = raster.components(cells, size=4).collect()
    assert len(got) == len(lanes) and {r["label"] for r in got} == {0}


def test_cycles_in_order(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for n in (1, 2, 3, 17, 64, 101):
        ids = (rng.permutation(n) + 1000 * n).tolist()
        rows += [("a", x, y) for x, y in zip(ids, ids[1:] + ids[:1], strict=True)]
        least = ids.index(min(ids))
        want |= {x: (min(ids), (least - i) % n) for i, x in enumerate(ids)}
    got = graphs.ordered_cycles(spark.createDataFrame(rows, "scene string, id long, next long"))
    assert {r["id"]: (r["cycle"], r["off"]) for r in got.collect()} == want
