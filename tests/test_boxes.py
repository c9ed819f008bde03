"""Matching of boxes without all their pairs."""

import numpy as np
import pandas as pd
import pytest

from gridweave.operators import matching
from gridweave.operators.kernels import boxes


def drawn(rng: np.random.Generator, n: int, whole: bool) -> np.ndarray:
    corner, side = rng.random((n, 2)) * 200, rng.random((n, 2)) * rng.choice([5, 40], (n, 1))
    both = np.concatenate([corner, corner + side], 1) - 60
    return np.round(both) if whole else both


def shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    side = lambda k: np.maximum(np.minimum(a[:, None, k + 2], b[None, :, k + 2]) - np.maximum(a[:, None, k], b[None, :, k]), 0)
    size = [(c[:, 2] - c[:, 0]) * (c[:, 3] - c[:, 1]) for c in (a, b)]
    both = side(0) * side(1)
    return both / (size[0][:, None] + size[1][None, :] - both + 1e-9)


@pytest.mark.parametrize("whole", [False, True])
def test_pairs_by_brute_force(whole):
    rng = np.random.default_rng(1)
    for least in (0.75, 0.5, 0.1, 0.01):
        a, b = drawn(rng, 300, whole), drawn(rng, 400, whole)
        want = shares(a, b)
        found = [np.concatenate(c) for c in zip(*boxes.alike(a, b, least), strict=True)]
        assert set(zip(*np.nonzero(want >= least), strict=True)) == set(zip(found[0].tolist(), found[1].tolist(), strict=True)) and len(found[0]) == (want >= least).sum()
        assert (want[found[0], found[1]] == found[2]).all()
        ids = rng.permutation(400) + 7
        rows, who, iou = boxes.best(a, b, ids, least)
        top = want.max(1)
        assert rows.tolist() == np.flatnonzero(top >= least).tolist() and (iou == top[rows]).all()
        assert who.tolist() == [ids[want[r] == top[r]].min() for r in rows]
    assert list(boxes.alike(a[:0], b, 0.5)) == [] and len(boxes.best(a, b[:0], ids[:0], 0.5)[0]) == 0


def test_greedy_in_bands(spark, monkeypatch):
    rng = np.random.default_rng(2)
    frames = []
    for n in (700, 600):
        box = drawn(rng, n, True)
        frames.append(pd.DataFrame({"scene": rng.integers(0, 3, n), "id": np.arange(n), **dict(zip(matching.BOX, box.T, strict=True))}))
    preds, gts = (spark.createDataFrame(f) for f in frames)
    pairs = matching.grid_join(preds, gts, 32.0, "scene").select("scene", matching.F.col("l_id").alias("pred"), matching.F.col("r_id").alias("gt"), matching.box_iou().alias("iou"))
    order = lambda df: sorted(map(tuple, df.select("scene", "pred", "gt", "iou").collect()))
    want = [r for r in order(matching.mutual_best(pairs)) if r[3] >= 0.25]
    rows = []
    monkeypatch.setattr(matching, "mutual_best", lambda found, f=matching.mutual_best: (rows.append(found.count()), f(found, most=50))[1])  # in rounds
    assert order(matching.matched_boxes(preds, gts, 48.0, (0.25, 0.5, 0.75))) == want
    assert sum(rows) < pairs.count() / 2
    assert order(matching.best_boxes(preds, gts, 48.0, 0.1, "scene")) == order(matching.best_match(pairs, 0.1))
