"""Kernels over many polygons at once give what those over one polygon give."""

import math
import time

import numpy as np

from gridweave.operators.kernels import arrangement as A
from gridweave.operators.kernels import batches as B
from gridweave.operators.kernels import labels as L
from gridweave.operators.kernels import polygons as P


def turned_walls(n: int) -> list[list[np.ndarray]]:
    """Turned rectangles with a bent wall and a hole near it, as in rect_regularize."""
    out = []
    for k in range(n):
        w, h, bend = 10.0 + k % 50 + 1, 10.0 + k % 23, (0.0, 0.1, 0.2, 0.3, 0.4, 0.56, 0.66)[k % 7]
        rings = [[0, 0], [w / 2, bend], [w, 0], [w, h], [0, h]], [[w - 2.5, 0.31], [w - 2.5, 6.31], [w - 0.5, 6.31], [w - 0.5, 0.31]]
        out.append([P.turned(np.array(r), math.radians(k % 90), np.zeros(2)) for r in rings])
    return out


def same(many: list, **options) -> None:
    for polygon, got in zip(many, B.cleaned(many, **options), strict=True):
        want = P.cleaned(polygon, **options)
        assert (want is None) == (got is None)
        if want:
            assert {k: v for k, v in want.items() if k != "rings"} == {k: v for k, v in got.items() if k != "rings"}
            assert len(want["rings"]) == len(got["rings"])
            assert all(a.shape == b.shape and np.allclose(a, b, atol=1e-8) for a, b in zip(want["rings"], got["rings"], strict=True))


def test_cleaned_together():
    same(turned_walls(210), edge_least=1.0)
    rng = np.random.default_rng(3)
    drawn = [[rng.random((rng.integers(3, 9), 2)) * 30, *(rng.random((4, 2)) * 30 for _ in range(rng.integers(0, 3)))] for _ in range(150)]
    for options in ({}, {"tolerance": 0}, {"regularise": False, "area_least": 1.0}):
        same(drawn, **options)
    traced = []
    for _ in range(12):
        mask = np.zeros((50, 50), bool)
        for r, c, h, w in rng.integers((0, 0, 3, 3), (35, 35, 18, 18), (5, 4)):
            mask[r : r + h, c : c + w] ^= True
        traced += [[r * 0.9 for r in rings] for _, rings in L.traced(mask.astype(int))]
    same(traced, area_least=1.0)
    same([[np.zeros((1, 2))], [np.zeros((5, 2))], *turned_walls(1)], area_least=0.0)
    assert B.cleaned([]) == []


def test_cleaning_together_is_fast():
    many = turned_walls(3000)
    began = time.process_time()
    B.cleaned(many, edge_least=1.0)
    assert time.process_time() - began < 5  # one by one takes over 20 s


def test_overlays_together():
    rng = np.random.default_rng(4)
    pairs = [[[rng.integers(0, 9, (rng.integers(3, 7), 2)).astype(float) if t % 2 else rng.random((rng.integers(3, 7), 2)) * 9 for _ in range(rng.integers(1, 3))] for _ in range(2)] for t in range(300)]
    rings = A.Rings.of_polygons([[*p, *g] for p, g in pairs])
    layer = np.concatenate([np.repeat([0, 1], [len(p), len(g)]) for p, g in pairs])
    for (p, g), got in zip(pairs, B.overlays(rings, layer, len(pairs)), strict=True):
        assert np.allclose(got, P.overlay([p], [g])[:3], atol=1e-9)
    # walls that are level but for rounding
    near = [[24.0, -1.7763568394002505e-15], [32.4, -2.6645352591003757e-15], [32.4, -4.199999999999998], [24.0, -4.1999999999999975]]
    level = [[24.0, 0.0], [32.4, 0.0], [32.4, -4.2], [24.0, -4.2]]
    rings = A.Rings.of_polygons([[np.array(near), np.array(level)]] * 2)
    assert np.allclose(B.overlays(rings, np.array([0, 1, 0, 1]), 2), 35.28)


def test_arranged_together():
    rng = np.random.default_rng(5)
    many = [[r for _, rings in L.traced((rng.random((12, 12)) < 0.6).astype(int)) for r in rings] for _ in range(30)]
    many = [[np.roll(r, rng.integers(len(r)), 0) for r in rng.permutation(np.array(rings, object))] for rings in many]
    got = B.picked(B.arranged(A.Rings.of_polygons(many)), np.ones(len(many), bool))
    for k, rings in enumerate(many):
        assert [r.tolist() for r in L.arranged([np.asarray(r, float) for r in rings])] == [r.tolist() for r in got[k]]
