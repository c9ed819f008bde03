"""Polygon kernels over many polygons at once: what polygons.cleaned() does, as arrays of all their corners.

Each step equals the function of its name in polygons. What few polygons need (rings that conflict after thinning, walls shorter
than the least, polygons of very many corners) is left to that function.
"""

from __future__ import annotations

import math

import numpy as np

from gridweave.operators.kernels import polygons
from gridweave.operators.kernels.arrangement import Polygon, Rings, repaired_many, spans, spread

#: Corners of a polygon beyond which its pairs of edges are looked at by itself.
LARGE = 96


def _rings_with(flags: np.ndarray, rings: Rings, n: int) -> np.ndarray:
    """Which of n polygons have a ring with the flag."""
    return np.bincount(rings.polygon[flags], minlength=n) > 0


def _shells(rings: Rings) -> np.ndarray:
    return np.diff(rings.polygon, prepend=-1) != 0


def joined(parts: list[Rings]) -> Rings:
    """Rings of different polygons, in the order of polygons."""
    polygon = np.concatenate([p.polygon for p in parts])
    sizes, order = np.concatenate([p.sizes for p in parts]), np.argsort(polygon, kind="stable")
    starts = np.cumsum(sizes) - sizes
    which, nth = spread(sizes[order])
    return Rings(np.concatenate([p.xy for p in parts])[starts[order][which] + nth], sizes[order], polygon[order])


def replaced(rings: Rings, gone: np.ndarray, found: dict[int, Polygon]) -> Rings:
    """With other rings for the polygons that gone flags; those that found lacks have none."""
    if not gone.any():
        return rings
    new = Rings.of_polygons(list(found.values()))
    new.polygon = np.array(list(found), np.int64)[new.polygon] if found else new.polygon
    return joined([rings.only(~gone[rings.polygon]), new])


def picked(rings: Rings, chosen: np.ndarray) -> dict[int, Polygon]:
    """The polygons that chosen flags, each a list of rings."""
    some = rings.only(chosen[rings.polygon])
    out: dict[int, Polygon] = {}
    for k, r in zip(some.polygon.tolist(), some.each(), strict=True):
        out.setdefault(k, []).append(r)
    return out


def areas(rings: Rings, n: int) -> np.ndarray:
    size = np.abs(rings.signed())
    return np.bincount(rings.polygon, np.where(_shells(rings), size, -size), n)


def lengths(rings: Rings, n: int) -> np.ndarray:
    """Of all rings, holes too."""
    d = rings.xy[rings.nxt] - rings.xy
    return np.bincount(rings.polygon[rings.of], np.hypot(d[:, 0], d[:, 1]), n)


def misplaced(rings: Rings, n: int) -> np.ndarray:
    """Of each ring: see polygons.misplaced()."""
    short = rings.sizes < 3
    skip = _rings_with(short, rings, n)
    bad = short.copy()
    corners = np.bincount(rings.polygon[rings.of], minlength=n)
    large = (corners > LARGE) & ~skip
    if large.any():
        bad[large[rings.polygon]] = np.concatenate([polygons.misplaced(p) for p in picked(rings, large).values()])
        skip |= large
    of, ends = rings.polygon[rings.of], np.cumsum(corners)
    counts = np.where(skip[of], 0, ends[of] - 1 - np.arange(len(of)))
    xy, to = rings.xy, rings.xy[rings.nxt]
    low, high = np.minimum(xy, to), np.maximum(xy, to)

    def side(p, q, r):
        return np.sign((q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]))

    for first, stop in spans(counts):
        i, nth = spread(counts[first:stop])
        i += first
        j = i + 1 + nth
        away = (rings.nxt[i] != j) & (rings.nxt[j] != i)
        near = away & (low[i] <= high[j]).all(1) & (low[j] <= high[i]).all(1)
        i, j = i[near], j[near]
        a, b, c, d = xy[i], to[i], xy[j], to[j]
        meet = (side(a, b, c) * side(a, b, d) <= 0) & (side(c, d, a) * side(c, d, b) <= 0)
        bad[rings.of[i[meet]]] = bad[rings.of[j[meet]]] = True
    # holes by their first corners: in the shell, and in no other hole
    holes = np.flatnonzero(~_shells(rings) & ~skip[rings.polygon])
    if len(holes):
        shell = np.searchsorted(rings.polygon, np.arange(n))
        owner, corner = rings.polygon[holes], rings.xy[rings.starts[holes]]
        within = np.zeros((len(holes), int(np.bincount(rings.polygon).max())), bool)
        for first, stop in spans(corners[owner]):
            which, nth = spread(corners[owner[first:stop]])
            which += first
            e = (ends - corners)[owner[which]] + nth
            other = rings.of[e] != holes[which]
            which, e = which[other], e[other]
            p, a, b = corner[which], xy[e], to[e]
            with np.errstate(divide="ignore", invalid="ignore"):
                x = a[:, 0] + (p[:, 1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
            hit = ((a[:, 1] > p[:, 1]) != (b[:, 1] > p[:, 1])) & (x > p[:, 0])
            np.logical_xor.at(within, (which[hit], (rings.of[e] - shell[owner[which]])[hit]), True)
        out = ~within[:, 0]
        bad[holes[out]] = bad[shell[owner[out]]] = True
        bad[holes[within[:, 1:].any(1)]] = True
    return bad


def _first_largest(values: np.ndarray, starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each stretch and the first place where it is; no stretch is empty."""
    most = np.maximum.reduceat(values, starts)
    at = np.flatnonzero(values == most[of])
    place = np.empty(len(starts), np.int64)
    place[of[at][::-1]] = at[::-1]
    return most, place


def thinned(rings: Rings, tolerance: float) -> Rings:
    some = np.flatnonzero(rings.sizes > 0)
    starts, sizes = rings.starts[some], rings.sizes[some]
    of = np.repeat(np.arange(len(some)), sizes)
    away = rings.xy - rings.xy[starts[of]]
    far, half = _first_largest(np.hypot(away[:, 0], away[:, 1]), starts, of) if len(some) else (np.zeros(0), starts)
    keep = (half == starts)[of]
    real = half != starts
    keep[starts], keep[half] = True, True
    ring = np.concatenate([np.flatnonzero(real)] * 2)
    a = np.concatenate([np.zeros(real.sum(), np.int64), (half - starts)[real]])
    b = np.concatenate([(half - starts)[real], sizes[real]])
    while True:
        long = b - a > 1
        ring, a, b = ring[long], a[long], b[long]
        if not len(ring):
            return rings.kept(keep)
        which, nth = spread(b - a - 1)
        begin, end = rings.xy[starts[ring] + a], rings.xy[starts[ring] + b % sizes[ring]]
        d, inner = end - begin, rings.xy[starts[ring][which] + a[which] + 1 + nth] - begin[which]
        size = (d * d).sum(1)
        t = np.zeros(len(which))
        np.divide((inner * d[which]).sum(1), size[which], out=t, where=size[which] > 0)
        off = inner - np.clip(t, 0, 1)[:, None] * d[which]
        first = np.cumsum(b - a - 1) - (b - a - 1)
        far, at = _first_largest(np.hypot(off[:, 0], off[:, 1]), first, which)
        split = far > tolerance
        middle = (a + 1 + at - first)[split]
        ring, a, b = ring[split], a[split], b[split]
        keep[starts[ring] + middle] = True
        ring, a, b = np.concatenate([ring, ring]), np.concatenate([a, middle]), np.concatenate([middle, b])


def simplified(rings: Rings, n: int, tolerance: float) -> Rings:
    out = thinned(rings, tolerance)
    again = _rings_with(misplaced(out, n), out, n)
    return replaced(out, again, {k: polygons.simplified(p, tolerance) for k, p in picked(rings, again).items()})


def without_flats(rings: Rings, degrees: float) -> Rings:
    into, out = rings.xy - rings.xy[rings.prv], rings.xy[rings.nxt] - rings.xy
    sizes = np.hypot(into[:, 0], into[:, 1]), np.hypot(out[:, 0], out[:, 1])
    real = (sizes[0] >= 1e-9) & (sizes[1] >= 1e-9)
    cos = np.ones(len(rings.xy))
    np.divide((into * out).sum(1), sizes[0] * sizes[1], out=cos, where=real)
    keep = real & (np.arccos(np.clip(cos, -1, 1)) > math.radians(degrees))
    asis = (rings.sizes < 4) | (rings.sums(keep) < 3)
    return rings.kept(keep | asis[rings.of])


def spaced(rings: Rings, least: float) -> Rings:
    d = rings.xy[rings.nxt] - rings.xy
    near = np.bincount(rings.of[np.hypot(d[:, 0], d[:, 1]) < least], minlength=len(rings.sizes)) > 0
    near &= rings.sizes >= 4
    if least <= 0 or not near.any():
        return rings
    keep = np.ones(len(rings.xy), bool)
    for r in np.flatnonzero(near).tolist():
        at, n = int(rings.starts[r]), int(rings.sizes[r])
        points = rings.xy[at : at + n].tolist()
        far = lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1]) >= least
        walk = [0]
        for k in range(1, n):
            if far(points[k], points[walk[-1]]):
                walk.append(k)
        if len(walk) >= 3:
            last = max((i for i, k in enumerate(walk) if far(points[k], points[0])), default=0)
            keep[at : at + n] = False
            keep[[at + k for k in walk[: max(3, last + 1)]]] = True
    return rings.kept(keep)


def squared(rings: Rings, snap: float, least: float = 0.0, passes: int = 3) -> Rings:
    done, number = [], np.arange(len(rings.sizes))  # rings stand for themselves: polygon holds their numbers
    polygon, rings = rings.polygon, Rings(rings.xy, rings.sizes, number)
    for _ in range(passes):
        rings = spaced(rings, least)
        few = rings.sizes < 4
        done.append(rings.only(few))
        rings = rings.only(~few)
        if not len(rings.sizes):
            break
        n, at = rings.sizes[rings.of], rings.starts[rings.of]
        d, middle = rings.xy[rings.nxt] - rings.xy, (rings.xy + rings.xy[rings.nxt]) / 2
        tilt = np.arctan2(d[:, 1], d[:, 0]) % math.pi
        from_x, from_y = np.minimum(tilt, math.pi - tilt), np.abs(tilt - math.pi / 2)
        kind = np.where((from_x <= snap) & (from_x <= from_y), 0, np.where(from_y <= snap, 1, 2))
        kind[(np.abs(d) < 1e-12).all(1)] = 2
        begins = kind != kind[rings.prv]
        # edges from the start of a run on; a ring of one kind is one run
        where = np.flatnonzero(begins)
        first = rings.starts.copy()
        first[rings.of[where][::-1]] = where[::-1]
        order = at + (first[rings.of] + np.arange(len(n)) - 2 * at) % n
        run = np.cumsum(begins[order] | (np.arange(len(n)) == at)) - 1
        size = np.hypot(d[order, 0], d[order, 1])
        weight = np.bincount(run, size)
        axis = 1 - kind[order]  # a line along x has one y
        counts = (kind[order] != 2) & (weight[run] > 0)
        value = np.bincount(run, size * np.where(axis == 1, middle[order, 1], middle[order, 0])) / np.where(weight > 0, weight, 1)
        moved = rings.xy.copy()
        edge, axis, value = order[counts], axis[counts], value[run[counts]]
        moved[edge, axis] = value
        moved[rings.nxt[edge], axis] = value
        rings = without_flats(rings.moved(moved), 5.0)
    out = joined([*done, rings])
    out.polygon = polygon
    return out


def _turned(rings: Rings, theta: np.ndarray, origin: np.ndarray) -> Rings:
    """Each polygon turned by its angle around its origin."""
    of = rings.polygon[rings.of]
    p = rings.xy - origin[of]
    z = (p[:, 0] + 1j * p[:, 1]) * np.exp(1j * theta)[of]
    return rings.moved(np.stack([z.real, z.imag], 1) + origin[of])


def regularised(rings: Rings, n: int, snap_degrees: float, hole_least: float, edge_least: float) -> Rings:
    """Polygons of which nothing is left have no rings."""
    shell = _shells(rings)
    sizes = np.zeros(n, np.int64)
    sizes[rings.polygon[shell]] = rings.sizes[shell]
    left = rings.only(((sizes > 0) & (sizes < 4))[rings.polygon])
    rings = rings.only((sizes >= 4)[rings.polygon])
    shell = _shells(rings)
    d = rings.xy[rings.nxt] - rings.xy
    size = np.hypot(d[:, 0], d[:, 1])
    outer = shell[rings.of]
    turns = np.where(size > 1e-9, size, 0) * np.exp(4j * np.arctan2(d[:, 1], d[:, 0]))
    of = rings.polygon[rings.of]
    total = np.bincount(of[outer], turns.real[outer], n) + 1j * np.bincount(of[outer], turns.imag[outer], n)
    theta = np.where((np.abs(total.real) < 1e-12) & (np.abs(total.imag) < 1e-12), 0.0, np.angle(total) / 4 % (math.pi / 2))
    origin = np.stack([np.bincount(of[outer], rings.xy[outer, k], n) for k in (0, 1)], 1) / np.maximum(sizes, 1)[:, None]
    wanted = rings.only(shell | ((rings.sizes >= 4) & (np.abs(rings.signed()) >= hole_least)))
    framed = without_flats(squared(_turned(wanted, -theta, origin), math.radians(snap_degrees), edge_least), 2.0)
    lost = np.zeros(n, bool)
    lost[framed.polygon[_shells(framed) & (framed.sizes < 3)]] = True
    out = _turned(framed.only((framed.sizes >= 3) & ~lost[framed.polygon]), theta, origin)
    broken = _rings_with(misplaced(out, n), out, n)
    again = picked(out, broken)
    found = {k: parts[0] for k, parts in zip(again, repaired_many(list(again.values())), strict=True) if parts}
    out = joined([replaced(out, broken, found), left])
    return out.only((areas(out, n) > 0)[out.polygon] | np.isin(out.polygon, left.polygon))


def orthogonality(shells: Rings, tolerance: float = 10.0) -> np.ndarray:
    a, b = shells.xy[shells.prv] - shells.xy, shells.xy[shells.nxt] - shells.xy
    one, two = np.hypot(a[:, 0], a[:, 1]), np.hypot(b[:, 0], b[:, 1])
    real = (one > 1e-9) & (two > 1e-9) & (shells.sizes >= 3)[shells.of]
    cos = np.zeros(len(a))
    np.divide((a * b).sum(1), one * two, out=cos, where=real)
    angles = np.degrees(np.arccos(np.clip(cos, -1, 1)))
    good = real & ((np.abs(angles - 90) <= tolerance) | (np.abs(angles - 180) <= tolerance))
    return shells.sums(good) / np.maximum(shells.sums(real), 1)


def cleaned(many: list[Polygon], area_least: float = 20.0, tolerance: float = 0.5, regularise: bool = True, snap_degrees: float = 20.0, hole_least: float = 10.0, edge_least: float = 2.0) -> list[dict | None]:
    """polygons.cleaned() of each."""
    n = len(many)
    whole = Rings.of_polygons(many)
    large = lambda rings: rings.only((areas(rings, n) >= area_least)[rings.polygon])
    rings = large(whole)
    if tolerance > 0:
        rings = simplified(rings, n, tolerance)
    if regularise:
        out = regularised(rings, n, snap_degrees, hole_least, edge_least)
        before = areas(rings, n)
        there = np.bincount(out.polygon, minlength=n) > 0
        scale = np.maximum(before, 1e-9)
        back = there & ~(np.abs(areas(out, n) / scale - before / scale) < 0.25)
        rings = replaced(out, back, picked(rings, back))
    broken = _rings_with(misplaced(rings, n), rings, n)
    again = picked(rings, broken)
    found = {k: parts[0] for k, parts in zip(again, repaired_many(list(again.values())), strict=True) if len(parts) == 1}
    rings = large(replaced(rings, broken, found))
    shells = rings.only(_shells(rings))
    length = lengths(rings, n)
    area = areas(rings, n).tolist()
    result: list[dict | None] = [None] * n
    for (k, polygon), vertices, square in zip(picked(rings, np.ones(n, bool)).items(), shells.sizes.tolist(), orthogonality(shells).tolist(), strict=True):
        result[k] = {"rings": polygon, "area_m2": round(area[k], 2), "perimeter_m": round(float(length[k]), 2), "n_vertices": vertices, "raw_vertices": len(many[k][0]), "orthogonality": round(square, 4)}
    return result


def valid(many: list[Polygon]) -> list[Polygon | None]:
    """Each polygon as it is, or repaired if it isn't valid; None if that leaves no part or several."""
    rings = Rings.of_polygons(many)
    broken = np.flatnonzero(_rings_with(misplaced(rings, len(many)), rings, len(many))).tolist()
    out: list[Polygon | None] = list(many)
    for k, parts in zip(broken, repaired_many([many[k] for k in broken]), strict=True):
        out[k] = parts[0] if len(parts) == 1 else None
    return out


def arranged(rings: Rings) -> Rings:
    """labels.arranged() of each polygon: rings from their first corners by row, the outer one first, then by area."""
    first = np.lexsort((rings.xy[:, 0], rings.xy[:, 1], rings.of))[rings.starts]
    at = rings.starts[rings.of]
    n = rings.sizes[rings.of]
    xy = rings.xy[at + (first[rings.of] + np.arange(len(n)) - 2 * at) % n]
    q = xy[rings.nxt]
    size = np.abs(rings.sums(xy[:, 0] * q[:, 1] - xy[:, 1] * q[:, 0]))
    corner = xy[rings.starts]
    order = np.lexsort((corner[:, 0], corner[:, 1], -size, rings.polygon))
    which, nth = spread(rings.sizes[order])
    return Rings(xy[rings.starts[order][which] + nth], rings.sizes[order], rings.polygon[order])


def overlays(rings: Rings, layer: np.ndarray, n: int) -> np.ndarray:
    """Of each of n sets (rings.polygon) of rings the areas inside layer 0, inside layer 1, and inside both, by parity; a row a set.

    The plane is cut into slabs at the heights of all corners and crossings of a set. In a slab edges are ordered and don't cross.
    """
    a, b = rings.xy, rings.xy[rings.nxt]
    keep = a[:, 1] != b[:, 1]
    a, b, of, who = a[keep], b[keep], rings.polygon[rings.of][keep], layer[rings.of][keep]
    down = (a[:, 1] > b[:, 1])[:, None]
    a, b = np.where(down, b, a), np.where(down, a, b)
    many = np.bincount(of, minlength=n)
    ends = np.cumsum(many)
    out = np.zeros((n, 3))
    for first, stop in spans(many * many):
        edges = slice(int(ends[first] - many[first]), int(ends[stop - 1]))
        _overlaid(a[edges], b[edges], of[edges] - first, who[edges], out[first:stop])
    return out


def _overlaid(a: np.ndarray, b: np.ndarray, of: np.ndarray, who: np.ndarray, out: np.ndarray) -> None:
    many = np.bincount(of, minlength=len(out))
    ends = np.cumsum(many)
    i, nth = spread(ends[of] - 1 - np.arange(len(of)))
    j = i + 1 + nth
    low, high = np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0])
    near = (a[i, 1] < b[j, 1]) & (a[j, 1] < b[i, 1]) & (low[j] <= high[i]) & (low[i] <= high[j])
    i, j = i[near], j[near]
    d, e, w = b[i] - a[i], b[j] - a[j], a[j] - a[i]
    cross = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / cross, (w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) / cross
    real = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    ys, sets = np.concatenate([a[:, 1], b[:, 1], (a[i, 1] + t * d[:, 1])[real]]), np.concatenate([of, of, of[i][real]])
    order = np.lexsort((ys, sets))
    ys, sets = ys[order], sets[order]
    slab = np.flatnonzero((sets[1:] == sets[:-1]) & (ys[1:] != ys[:-1]))
    bottom, top, sets = ys[slab], ys[slab + 1], sets[slab]
    for first, stop in spans(many[sets]):
        which, nth = spread(many[sets[first:stop]])
        which += first
        e = (ends - many)[sets[which]] + nth
        middle = ((bottom + top) / 2)[which]
        on = (a[e, 1] < middle) & (b[e, 1] > middle)
        which, e, middle = which[on], e[on], middle[on]
        x = a[e, 0] + (middle - a[e, 1]) / (b[e, 1] - a[e, 1]) * (b[e, 0] - a[e, 0])
        order = np.lexsort((x, which))
        which, x, layer = which[order], x[order], who[e[order]]
        begins = np.flatnonzero(np.diff(which, prepend=-1))
        sizes = np.diff(np.append(begins, len(which)))

        def inside_of(k: int) -> np.ndarray:
            seen = np.cumsum(layer == k)
            return (seen - np.repeat((seen - (layer == k))[begins], sizes))[:-1] % 2 == 1  # anew in each slab: in the thinnest, rounding can miss an edge

        one, two = inside_of(0), inside_of(1)
        size = np.where(which[1:] == which[:-1], np.diff(x) * (top - bottom)[which[1:]], 0)
        for k, on in enumerate((one, two, one & two)):
            out[:, k] += np.bincount(sets[which[1:][on]], size[on], len(out))
