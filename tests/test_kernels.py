"""Polygon, label and scoring kernels: hand-solved cases and properties."""

import math
import random
import time

import numpy as np
import pytest

from gridweave.operators import scoring
from gridweave.operators.kernels import arrangement as A
from gridweave.operators.kernels import labels as L
from gridweave.operators.kernels import polygons as P
from gridweave.operators.raster import ellipse, taper

SQUARE = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
ELL = np.array([[0, 0], [10, 0], [10, 4], [4, 4], [4, 10], [0, 10]], float)


def star(rng, cx, cy, n=12):
    angles = np.sort(rng.uniform(0, 2 * math.pi, n))
    r = rng.uniform(2, 8, n)
    return np.stack([cx + r * np.cos(angles), cy + r * np.sin(angles)], 1)


def test_measures():
    hole = SQUARE * 0.2 + 2
    assert P.area([SQUARE, hole]) == pytest.approx(96)
    assert P.length([SQUARE, hole]) == pytest.approx(48)
    assert P.orthogonality(ELL) == 1.0
    assert P.corner_angles(ELL) == pytest.approx([90] * 6)
    assert P.displacement(SQUARE, SQUARE + [1, 0]) == pytest.approx(0.5)


def test_overlay_properties():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = star(rng, 0, 0), star(rng, *rng.uniform(-4, 4, 2))
        if not (P.is_simple(a) and P.is_simple(b)):
            continue
        one, two, both, every = P.overlay([[a]], [[b]])
        assert one == pytest.approx(abs(P.ring_area(a)))
        assert one + two == pytest.approx(both + every)
        assert P.iou([[a]], [[b]]) == pytest.approx(P.iou([[b]], [[a]]))
        assert 0 <= P.iou([[a]], [[b]]) <= 1
    one, two, both, every = P.overlay([[SQUARE, SQUARE * 0.2 + 2]], [[SQUARE + 5]])
    assert (one, two, both) == (pytest.approx(96), pytest.approx(100), pytest.approx(25))
    merged = P.overlay([[SQUARE], [SQUARE + [5, 0]]], [[ELL]])
    assert merged[0] == pytest.approx(150)


def test_simplify_and_square():
    noisy = np.array([[0, 0], [5, 0.1], [10, 0], [10.1, 5], [10, 10], [5, 9.9], [0, 10], [-0.1, 5]])
    assert len(P.simplified([noisy], 0.5)[0]) == 4
    theta = math.radians(31)
    turned = P.turned(SQUARE, theta, np.zeros(2))
    assert P.dominant_angle(turned) == pytest.approx(theta)
    skewed = turned + np.array([[0.2, 0], [0, 0.3], [-0.2, 0], [0, 0]])
    out = P.regularised([skewed])
    assert P.orthogonality(out[0]) == 1.0
    assert abs(P.area(out) - 100) < 5
    again = P.regularised(out)
    assert np.allclose(again[0], out[0], atol=1e-6)
    for ring in (SQUARE, ELL):
        assert P.area(P.regularised([ring])) == pytest.approx(abs(P.ring_area(ring)))
    assert P.cleaned([SQUARE * 0.1]) is None
    assert P.cleaned([ELL])["n_vertices"] == 6


def test_repair_of_whole_polygons():
    bow = np.array([[0, 0], [10, 10], [10, 0], [0, 10]], float)
    assert not P.is_simple(bow)
    assert [P.area(p) for p in A.repaired([bow])] == pytest.approx([25, 25])
    shell = np.array([[0, 0], [20, 0], [18.2, 10], [20, 20], [0, 20]])
    hole = np.array([[10, 0.3], [19.7, 0.3], [19.3, 3], [10, 3]])  # squaring moves the wall into it
    out = P.regularised([shell, hole])
    assert P.is_valid(out) and P.area(out) == pytest.approx(357.43)
    assert P.cleaned([shell, hole])["area_m2"] == 357.43
    assert P.cleaned([bow + 5], area_least=1, tolerance=0, regularise=False) is None  # two parts
    touching = np.array([[0, 0], [6, 0], [6, 6], [0, 6], [0, 0], [3, 1], [5, 3], [3, 3]], float)  # a ring that comes back to its first corner
    (whole,) = A.repaired([touching])
    assert [len(r) for r in whole] == [4, 4] and P.area(whole) == pytest.approx(31)
    inner = [SQUARE, SQUARE * 0.5 + 2, SQUARE * 0.5 + 4]
    (cut,) = A.repaired(inner)
    assert P.area(cut) == pytest.approx(100 - 41) and len(cut) == 2
    assert A.repaired([]) == [] and A.repaired([SQUARE * 0]) == [] and A.repaired([SQUARE[:2]]) == [] and not P.is_valid([])
    assert not P.is_valid([SQUARE, SQUARE * 0.2 + 20]) and not P.is_valid([SQUARE, SQUARE * 0.6 + 1, SQUARE * 0.2 + 3]) and P.is_valid([SQUARE, SQUARE * 0.2 + 2])


def test_arrangements_equal_sweeps():
    rng = np.random.default_rng(0)
    for t in range(150):
        drawn = (lambda k: rng.integers(0, 7, (k, 2)).astype(float)) if t % 2 else (lambda k: rng.random((k, 2)) * 10)
        polygon = [drawn(rng.integers(3, 9)), *(drawn(rng.integers(3, 6)) for _ in range(rng.integers(0, 3)))]
        (want,) = P.areas_where([[r] for r in polygon], [lambda i: i[0] & ~i[1:].any(0)])
        far = np.array([5e5, 4e6]) if t % 3 == 0 else np.zeros(2)
        parts = A.repaired([r + far for r in polygon])
        assert sum(map(P.area, parts)) == pytest.approx(want, abs=1e-5)
        for p in parts:  # shells one way, holes the other, and none across another
            assert P.ring_area(p[0]) > 0 and all(P.ring_area(h) < 0 for h in p[1:])
            assert P.areas_where([[r - far] for r in p], [lambda i: i[0] & ~i[1:].any(0)])[0] == pytest.approx(P.area(p), abs=1e-4)
        shapes = [[drawn(4)] for _ in range(4)]
        assert sum(map(P.area, A.united(shapes))) == pytest.approx(P.areas_where(shapes, [lambda i: i.any(0)])[0], abs=1e-6)


def test_sets_are_arranged_together():
    rng = np.random.default_rng(5)
    sets = [[[rng.integers(0, 9, (4, 2)).astype(float)] for _ in range(rng.integers(1, 5))] for _ in range(2000)]
    rings = A.Rings.of_polygons([[r for p in s for r in p] for s in sets])
    layer = np.concatenate([np.arange(len(s)) for s in sets])
    began = time.process_time()
    found = A.united_many(rings, layer, len(sets))
    assert time.process_time() - began < 10  # a set at a time takes over 30 s
    for k in range(0, len(sets), 20):
        alone = A.united(sets[k])
        assert [[r.tolist() for r in p] for p in alone] == [[r.tolist() for r in p] for p in found[k]]
        assert sum(map(P.area, alone)) == pytest.approx(P.areas_where(sets[k], [lambda i: i.any(0)])[0], abs=1e-6)


def test_rings_are_simplified_together():
    wave = np.array([[x, 0.45 * (x % 2)] for x in range(21)] + [[20, 10], [0, 10]], float)
    near = np.array([[4.4, 0.3], [5.6, 0.3], [5.6, 3], [4.4, 3]])[[0, 3, 2, 1]]  # in a notch of the wall, which thinning would fill
    near[:, 1] += 0.16
    polygon = [wave, near]
    assert P.is_valid(polygon)
    out = P.simplified(polygon, 0.5)
    assert P.is_valid(out) and len(out[0]) <= len(wave)
    rng = np.random.default_rng(7)
    for _ in range(40):
        angles = np.linspace(0, 2 * math.pi, 80, endpoint=False)
        shell = np.stack([np.cos(angles), np.sin(angles)], 1) * (10 + rng.uniform(-0.4, 0.4, 80))[:, None]
        hole = shell[::-2] * rng.uniform(0.93, 0.96)
        if P.is_valid([shell, hole]):
            thin = P.simplified([shell, hole], 0.8)
            assert P.is_valid(thin) and len(thin[0]) < 80
    assert len(P.simplified([SQUARE, SQUARE * 0.2 + 2], 0.5)[1]) == 4


def test_components_and_erosion():
    rng = np.random.default_rng(3)
    for eight in (False, True):
        mask = rng.random((30, 40)) < 0.45
        found = L.components(mask, eight)
        seen = np.zeros_like(found)
        n = 0
        for r, c in zip(*np.nonzero(mask), strict=True):
            if not seen[r, c]:
                n += 1
                stack = [(r, c)]
                while stack:
                    y, x = stack.pop()
                    if 0 <= y < 30 and 0 <= x < 40 and mask[y, x] and not seen[y, x]:
                        seen[y, x] = n
                        stack += [(y + a, x + b) for a, b in (L.EIGHT if eight else L.FOUR)]
        assert (found == seen).all()
    assert L.eroded(np.ones((5, 5), bool), [(0, 0), *L.EIGHT]).sum() == 9
    assert set(ellipse(1)) == {(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)}


def test_watershed_is_exact_per_component():
    rng = np.random.default_rng(5)
    mask = rng.random((40, 40)) < 0.7
    surface = rng.integers(0, 6, (40, 40))
    markers = np.where(mask & (rng.random((40, 40)) < 0.03), np.arange(1600).reshape(40, 40) + 1, 0)
    whole = L.flooded(surface, markers, mask)
    parts = L.components(mask)
    for k in range(1, parts.max() + 1):
        part = parts == k
        assert (L.flooded(surface, np.where(part, markers, 0), part)[part] == whole[part]).all()
    for k in range(1, parts.max() + 1):
        assert (whole[parts == k] > 0).all() == bool(markers[parts == k].any())


def test_traced_outlines():
    mask = np.zeros((6, 8), bool)
    mask[1:5, 1:5] = True
    mask[2, 2] = False
    mask[5, 5] = True
    ((_, rings),) = L.traced(mask.astype(int))
    assert len(rings) == 2
    assert P.area(rings) == pytest.approx(mask.sum())
    rng = random.Random(2)
    for _ in range(20):
        m = np.array([[rng.random() < 0.55 for _ in range(12)] for _ in range(9)])
        got = L.traced(m.astype(int))
        assert len(got) == L.components(m, eight=True).max()
        assert sum(P.area(r) for _, r in got) == pytest.approx(m.sum())


def test_blend_of_a_constant_is_that_constant():
    flat = lambda chips: np.full((len(chips), 2, *chips.shape[1:3]), 0.4)
    out = scoring.scene_probabilities(np.zeros((50, 70, 3), np.uint8), flat, tile=32, overlap=8)
    assert out.shape == (2, 50, 70)
    assert (out == 102).all()
    assert scoring.starts(5000, 512, 384)[-1] == 4488
    assert len(scoring.starts(5000, 512, 384)) == 13
    assert taper(512, 64).tolist() == taper(512, 64)[::-1].tolist() != taper(512, 64, False).tolist()
    chips = np.random.default_rng(0).integers(0, 255, (1, 16, 16, 3)).astype(np.uint8)
    point = lambda c: np.stack([c[..., 0], c[..., 1]], 1) / 255.0
    assert np.allclose(scoring.viewed(chips, point), point(chips))
