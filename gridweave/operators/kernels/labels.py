"""Label kernels on one raster: erosion, components, marker watershed, polygon tracing."""

from __future__ import annotations

import heapq

import numpy as np

FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))
EIGHT = (*FOUR, (-1, -1), (-1, 1), (1, -1), (1, 1))


def eroded(mask: np.ndarray, offsets) -> np.ndarray:
    """Cells whose neighbours at all offsets are set; outside isn't."""
    reach = max((max(abs(r), abs(c)) for r, c in offsets), default=0)
    padded = np.pad(mask, reach)
    out = np.ones_like(mask)
    h, w = mask.shape
    for r, c in offsets:
        out &= padded[reach + r : reach + r + h, reach + c : reach + c + w]
    return out


def least_members(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of 0..n-1 the least member of its set under the links a[i] - b[i]: higher roots are hung under lower ones, then paths are halved until flat."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while ((up := root[root]) != root).any():
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def pieces(values: np.ndarray, eight: bool = False) -> np.ndarray:
    """Labels 1, 2, ... of the 4- or 8-connected pieces of equal values above 0, in the order of first cells by row. Runs of rows are linked to those they touch in the next row."""
    h, w = values.shape
    padded = np.zeros((h, w + 2), values.dtype)
    padded[:, 1:-1] = values
    step = padded[:, 1:] != padded[:, :-1]
    rows, starts = np.nonzero(step & (padded[:, 1:] > 0))
    stops = np.nonzero(step & (padded[:, :-1] > 0))[1]
    slack, wide = int(eight), w + 2
    first = np.searchsorted(rows * wide + stops, (rows + 1) * wide + starts - slack, "right")
    after = np.searchsorted(rows * wide + starts, (rows + 1) * wide + stops + slack, "left")
    many = np.maximum(after - first, 0)
    above = np.repeat(np.arange(len(rows)), many)
    below = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(above))
    if values.dtype != bool:
        of = values[rows, starts]
        alike = of[above] == of[below]
        above, below = above[alike], below[alike]
    number = np.unique(least_members(above, below, len(rows)), return_inverse=True)[1] + 1
    change = np.zeros((h, wide), np.int32)
    change[rows, starts] = number
    np.add.at(change, (rows, stops), -number)
    return np.cumsum(change, 1, dtype=np.int32)[:, :w]


def components(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """Labels 1, 2, ... of a mask's components in the order of first cells by row."""
    return pieces(mask.astype(bool), eight)


def flooded(surface: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Marker watershed: labels grow over the mask from the lowest cells up, 4-connected, ties by arrival; parts of the mask without a marker stay 0.

    A part with one marker is all that marker's; only parts with several are walked cell by cell.
    """
    h, w = mask.shape
    parts = components(mask)
    seeds = np.where(mask, markers, 0).astype(np.int32)
    at = seeds > 0
    low, high = np.full(parts.max() + 1, np.iinfo(np.int32).max, np.int32), np.zeros(parts.max() + 1, np.int32)
    np.minimum.at(low, parts[at], seeds[at])
    np.maximum.at(high, parts[at], seeds[at])
    out = np.where((low == high)[parts], low[parts], seeds)
    shared = (low < high)[parts]
    queue, age = [], 0
    for r, c in zip(*np.nonzero(at & shared), strict=True):
        queue.append((surface[r, c], age, int(r), int(c)))
        age += 1
    heapq.heapify(queue)
    while queue:
        _, _, r, c = heapq.heappop(queue)
        for dr, dc in FOUR:
            y, x = r + dr, c + dc
            if 0 <= y < h and 0 <= x < w and mask[y, x] and not out[y, x]:
                out[y, x] = out[r, c]
                heapq.heappush(queue, (surface[y, x], age, y, x))
                age += 1
    return out


def instances(interior: np.ndarray, boundary: np.ndarray, t_interior: float = 0.5, t_boundary: float = 0.4, seed_least: int = 16) -> np.ndarray:
    """Instance labels of byte planes: seeds inside and off the walls, eroded, small ones dropped, then flooded over the wall plane."""
    inside = np.arange(256) / 255 >= t_interior
    sure = (np.arange(256) / 255 >= max(t_interior, 0.6))[interior] & (np.arange(256) / 255 < t_boundary)[boundary]
    seeds = components(eroded(sure, [(0, 0), *EIGHT]))
    sizes = np.bincount(seeds.ravel())
    large = sizes >= seed_least
    large[0] = False
    seeds = components(large[seeds])
    return flooded(boundary, seeds, inside[interior])


def boxes(labels: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(label, top, bottom, left, right) of each label, with one sort of all its cells; bottom and right are outside."""
    rows, cols = np.nonzero(labels > 0)
    values = labels[rows, cols]
    order = np.argsort(values, kind="stable")
    rows, cols, values = rows[order], cols[order], values[order]
    at = np.flatnonzero(np.diff(values, prepend=-1))
    if not len(at):
        return []
    ends = [f.reduceat(v, at) for f, v in ((np.minimum, rows), (np.maximum, rows), (np.minimum, cols), (np.maximum, cols))]
    return list(zip(values[at].tolist(), ends[0].tolist(), (ends[1] + 1).tolist(), ends[2].tolist(), (ends[3] + 1).tolist(), strict=True))


def traced(labels: np.ndarray) -> list[tuple[int, list[np.ndarray]]]:
    """(label, rings in pixel corners as x, y) of each 8-connected piece of each label, in the order of first cells by row.

    Only the boxes of labels, and then of their pieces, are looked at, so time follows the cells.
    """
    out = []
    for value, top, bottom, left, right in boxes(labels):
        pieces = components(labels[top:bottom, left:right] == value, eight=True)
        for k, r0, r1, c0, c1 in boxes(pieces):
            crop = pieces[r0:r1, c0:c1] == k
            first = (top + r0, left + c0 + int(crop[0].argmax()))
            out.append((first, value, [ring + (left + c0, top + r0) for ring in outline(crop)]))
    out.sort(key=lambda x: x[0])
    return [(v, rings) for _, v, rings in out]


def outline(mask: np.ndarray) -> list[np.ndarray]:
    """Rings around one 8-connected mask, the outer one first; only corners are kept.

    Unit edges run with the mask on their right. Where four cells meet like a chessboard, the walk turns
    to the left, into the other diagonal cell, so both stay in one ring.
    """
    p = np.pad(mask, 1)
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def add(rows: np.ndarray, cols: np.ndarray, a: tuple[int, int], step: tuple[int, int]) -> None:
        for r, c in zip(rows.tolist(), cols.tolist(), strict=True):
            edges.setdefault((c - 1 + a[0], r - 1 + a[1]), []).append(step)

    add(*np.nonzero(p & ~np.roll(p, 1, 0)), (0, 0), (1, 0))  # nothing above: along the top to the right
    add(*np.nonzero(p & ~np.roll(p, -1, 1)), (1, 0), (0, 1))
    add(*np.nonzero(p & ~np.roll(p, -1, 0)), (1, 1), (-1, 0))
    add(*np.nonzero(p & ~np.roll(p, 1, 1)), (0, 1), (0, -1))
    rings = []
    while edges:
        start = min(edges, key=lambda q: (q[1], q[0]))
        at, step, ring = start, edges[start][0], []
        while at in edges:
            ways = edges[at]
            left = (step[1], -step[0])
            turn = left if ring and left in ways and len(ways) > 1 else ways[0]
            if turn != step or not ring:
                ring.append(at)
            ways.remove(turn)
            if not ways:
                del edges[at]
            step = turn
            at = (at[0] + step[0], at[1] + step[1])
        rings.append(np.array(ring, float))
    rings.sort(key=lambda r: -abs(float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum())))
    return rings


#: Steps along the sides of a cell, top, right, bottom, left, with the cell on the right, as columns and rows; what is outside lies along the side before.
_DX, _DY = np.array([1, 0, -1, 0]), np.array([0, 1, 0, -1])


def arcs(plane: np.ndarray, top: int = 0, left: int = 0) -> list[tuple[int, int, int | None, np.ndarray, np.ndarray]]:
    """(label, start, next, xs, ys) of the walks along the borders of labels, inside a window with a rim of one cell of its neighbours.

    A walk has its label on the right; xs and ys are the corners it passes. At a vertex where a
    label meets itself like a chessboard it turns to the left. A closed walk has no next; an open one
    goes on in a neighbour, with the side next, and start and next are sides' numbers in the whole
    raster, so that walks can be put together. top and left are the place of the window's inner cells.
    """
    h, w = plane.shape[0] - 2, plane.shape[1] - 2
    inner = plane[1:-1, 1:-1]
    found = [np.nonzero((inner != plane[1 + _DY[s - 1] : 1 + _DY[s - 1] + h, 1 + _DX[s - 1] : 1 + _DX[s - 1] + w]) & (inner != 0)) for s in range(4)]
    r, c = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    s = np.repeat(np.arange(4), [len(f[0]) for f in found])
    key = (r * w + c) * 4 + s
    order = np.argsort(key)
    r, c, s, key = r[order], c[order], s[order], key[order]
    n, v, out = len(r), inner[r, c], (s + 3) % 4

    def mine(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return plane[rows + 1, cols + 1] == v

    ahead, beside = (r + _DY[s], c + _DX[s]), (r + _DY[s] + _DY[out], c + _DX[s] + _DX[out])
    turns, straight = mine(*beside), mine(*ahead)
    to_r, to_c = (np.where(turns, beside[k], np.where(straight, ahead[k], (r, c)[k])) for k in (0, 1))
    to_s = np.where(turns, out, np.where(straight, s, (s + 1) % 4))
    corner = mine(r - _DY[s] + _DY[out], c - _DX[s] + _DX[out]) | ~mine(r - _DY[s], c - _DX[s])
    here = (to_r >= 0) & (to_r < h) & (to_c >= 0) & (to_c < w)
    follows = np.searchsorted(key, ((to_r * w + to_c) * 4 + to_s)[here])
    before = np.arange(n)
    before[follows] = np.flatnonzero(here)
    head = before == np.arange(n)
    # a side of a closed walk sees no head however far it looks back; such walks are cut at their least side
    rounds = range(max(1, int(n).bit_length()))
    back, least = before.copy(), np.arange(n)
    for _ in rounds:
        least, back = np.minimum(least, least[back]), back[back]
    closed = ~head[back]
    cut = closed & (least == np.arange(n))
    before[cut] = np.flatnonzero(cut)
    back, far = before.copy(), (before != np.arange(n)).astype(np.int64)
    for _ in rounds:
        far, back = far + far[back], back[back]
    order = np.lexsort((far, back))
    begins = np.flatnonzero(np.diff(back[order], prepend=-1)) if n else np.zeros(0, np.int64)
    x, y = c + (s == 1) + (s == 2) + left, r + (s >= 2) + top
    number = lambda rows, cols, sides: ((rows + top) << 33) | ((cols + left) << 2) | sides
    walks = []
    for a, b in zip(begins.tolist(), np.append(begins, n)[1:].tolist(), strict=True):
        sides = order[a:b]
        first, last = sides[0], sides[-1]
        kept = sides[corner[sides]]
        on = None if closed[first] else int(number(to_r[last], to_c[last], to_s[last]))
        walks.append((int(v[first]), int(number(r[first], c[first], s[first])), on, x[kept], y[kept]))
    return walks


def arranged(rings: list[np.ndarray]) -> list[np.ndarray]:
    """The rings of one piece in the form of outline(): each from its first corner by row, the outer one first, then by area."""
    turned = [np.roll(r, -int(np.lexsort((r[:, 0], r[:, 1]))[0]), 0) for r in rings]
    turned.sort(key=lambda r: (-abs(float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum())), r[0, 1], r[0, 0]))
    return turned
