"""Polygons from the arrangement of edges: repair of whole polygons, and unions with their geometry.

All edges are cut where they meet. A piece of an edge stays if what is wanted lies on exactly one of its
sides; directed with the inside on the left, the pieces that stay are walked into rings, which never
cross themselves or each other, and rings are put together to polygons with holes. Many sets of polygons
are arranged at once, as arrays of all their edges: edges only meet those of their own set.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Ring = np.ndarray
Polygon = list[np.ndarray]

#: Coordinates are rounded to this part of the largest extent before edges are compared, or to that part of the largest coordinate.
GRID, FINEST = 2.0**-40, 2.0**-50
#: Pairs of edges, or of points and edges, that are looked at together.
PAIRS = 1 << 20


class Rings:
    """Rings of many polygons end to end: corners xy, sizes and polygon of each ring, polygons in ascending order; of, nxt and prv are each corner's ring and neighbours."""

    def __init__(self, xy: np.ndarray, sizes: np.ndarray, polygon: np.ndarray):
        self.xy, self.sizes, self.polygon = xy, sizes, polygon
        self.starts = np.cumsum(sizes) - sizes
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.nxt, self.prv = np.arange(len(xy)) + 1, np.arange(len(xy)) - 1
        some = sizes > 0
        first, last = self.starts[some], (self.starts + sizes - 1)[some]
        self.nxt[last], self.prv[first] = first, last

    @classmethod
    def of_polygons(cls, polygons: list[Polygon]) -> Rings:
        rings = [r for p in polygons for r in p]
        xy = np.concatenate([np.asarray(r, float).reshape(-1, 2) for r in rings]) if rings else np.zeros((0, 2))
        return cls(xy, np.array([len(r) for r in rings], np.int64), np.repeat(np.arange(len(polygons)), [len(p) for p in polygons]))

    def kept(self, corners: np.ndarray) -> Rings:
        """With some of the corners; all rings stay."""
        return Rings(self.xy[corners], np.bincount(self.of[corners], minlength=len(self.sizes)), self.polygon)

    def only(self, rings: np.ndarray) -> Rings:
        return Rings(self.xy[rings[self.of]], self.sizes[rings], self.polygon[rings])

    def moved(self, xy: np.ndarray) -> Rings:
        return Rings(xy, self.sizes, self.polygon)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of a value a corner, for each ring."""
        return np.bincount(self.of, values, len(self.sizes))

    def signed(self) -> np.ndarray:
        """Area of each ring, negative if it runs clockwise."""
        p = self.xy - self.xy[self.starts[self.of]]
        q = p[self.nxt]
        return self.sums(p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]) / 2

    def each(self) -> list[np.ndarray]:
        return [self.xy[a : a + n] for a, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True)]


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For things with so many parts: of each part the thing, and which of its parts it is."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def spans(counts: np.ndarray, most: int = PAIRS) -> list[tuple[int, int]]:
    """Ranges of things that together have about most parts at most, or are single."""
    stops = np.cumsum(counts)
    out, at = [], 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + most, "right")))
        out.append((at, to))
        at = to
    return out


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each different row, in order (first column first), and of each row the number of its like."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def signed(ring: Ring) -> float:
    """Area of a ring, negative if it runs clockwise."""
    if not len(ring):
        return 0.0
    x, y = (ring - ring[0]).T  # far from the origin, products of whole coordinates would lose the area
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _cut(a: np.ndarray, b: np.ndarray, owner: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (lower end, upper end, owner, set) of the edges a-b of sets on the grid, cut where edges of a set meet.

    Edges are cut at crossings, rounded to the grid, and where an end lies on another edge; since
    rounding can bend a piece across a corner, this is done until nothing changes in a set.
    """
    done = []
    while True:
        flip = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
        a, b = np.where(flip[:, None], b, a), np.where(flip[:, None], a, b)
        at_first, which = _distinct(of, a[:, 0], a[:, 1], b[:, 0], b[:, 1])
        low, high = a[at_first], b[at_first]
        at, where = _meetings(low, high, of[at_first])
        inner = (where != low[at]).any(1) & (where != high[at]).any(1)
        at, where = at[inner], where[inner]
        again = np.isin(of, of[at_first][at])
        done.append((a[~again], b[~again], owner[~again], of[~again]))
        if not len(at):
            return tuple(np.concatenate(c) for c in zip(*done, strict=True))
        a, b, owner, of, which = a[again], b[again], owner[again], of[again], which[again]
        cuts, _ = _distinct(at, where[:, 0], where[:, 1])
        edge, where = at[cuts], where[cuts]
        many = np.bincount(edge, minlength=len(low))
        own, nth = spread(many[which])
        points = where[np.searchsorted(edge, which)[own] + nth]
        far = ((points - a[own]) * (b - a)[own]).sum(1)
        edges = np.concatenate([np.arange(len(a)), own, np.arange(len(a))])
        points = np.concatenate([a, points, b])
        order = np.lexsort((np.concatenate([np.full(len(a), -np.inf), far, np.full(len(a), np.inf)]), edges))
        edges, points = edges[order], points[order]
        same = (edges[1:] == edges[:-1]) & (points[1:] != points[:-1]).any(1)
        a, b, owner, of = points[:-1][same], points[1:][same], owner[edges[:-1][same]], of[edges[:-1][same]]


def _meetings(a: np.ndarray, b: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges and the grid points inside them where another edge of the set crosses or ends; edges are sorted by set, then by their left ends."""
    n = len(a)
    query = np.repeat([False, True], n)
    order = np.lexsort((query, np.concatenate([a[:, 0], b[:, 0]]), np.concatenate([of, of])))
    stops = np.empty(2 * n, np.int64)
    stops[order] = np.cumsum(~query[order])
    counts = stops[n:] - np.arange(n) - 1  # edges of the set that begin before this one ends
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    ahead = b - a
    sizes = np.hypot(ahead[:, 0], ahead[:, 1])
    found_at, found = [np.zeros(0, np.int64)], [np.zeros((0, 2))]
    for first, stop in spans(counts):
        i, nth = spread(counts[first:stop])
        i += first
        j = i + 1 + nth
        meet = (low[j] <= high[i]) & (high[j] >= low[i])
        i, j = i[meet], j[meet]
        u, v, w = ahead[i], ahead[j], a[j] - a[i]
        cross = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, s = (w[:, 0] * v[:, 1] - w[:, 1] * v[:, 0]) / cross, (w[:, 0] * u[:, 1] - w[:, 1] * u[:, 0]) / cross
        hit = (cross != 0) & (t >= 0) & (t <= 1) & (s >= 0) & (s <= 1)
        points = np.round(a[i[hit]] + t[hit, None] * u[hit])
        found_at += [i[hit], j[hit]]
        found += [points, points]
        for one, other in ((j, i), (i, j)):
            # an end of one within half a step of the other, which also finds what lies on one line
            d, size = ahead[other], sizes[other]
            for p in (a[one], b[one]):
                q = p - a[other]
                along = (q * d).sum(1)
                near = (np.abs(d[:, 0] * q[:, 1] - d[:, 1] * q[:, 0]) <= 0.5 * size) & (along > 0) & (along < size * size)
                found_at.append(other[near])
                found.append(p[near])
    return np.concatenate(found_at), np.concatenate(found)


def crossed(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether an odd number of the edges a-b lies to the right of each point."""
    out = np.zeros(len(points), bool)
    step = max(1, (1 << 20) // max(1, len(a)))
    for at in range(0, len(points), step):
        p = points[at : at + step]
        spans = (a[:, 1] > p[:, 1, None]) != (b[:, 1] > p[:, 1, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[:, 0] + (p[:, 1, None] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
        out[at : at + step] = (spans & (x > p[:, 0, None])).sum(1) % 2 == 1
    return out


def inside(points: np.ndarray, ring: Ring) -> np.ndarray:
    return crossed(points, ring, np.roll(ring, -1, 0))


def _layers(points: np.ndarray, of: np.ndarray, a: np.ndarray, b: np.ndarray, owner: np.ndarray, edges_of: np.ndarray) -> np.ndarray:
    """Whether each point is inside each layer (owner) of its set, by the parity of the edges a-b to its right; a row a point."""
    order = np.argsort(edges_of, kind="stable")
    a, b, owner, edges_of = a[order], b[order], owner[order], edges_of[order]
    first, many = np.searchsorted(edges_of, of), np.searchsorted(edges_of, of, "right")
    many -= first
    width = int(owner.max(initial=0)) + 1
    out = np.zeros((len(points), width), bool)
    for at, to in spans(many):
        which, nth = spread(many[at:to])
        e, p = first[at:to][which] + nth, points[at:to][which]
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[e, 0] + (p[:, 1] - a[e, 1]) / (b[e, 1] - a[e, 1]) * (b[e, 0] - a[e, 0])
        hit = ((a[e, 1] > p[:, 1]) != (b[e, 1] > p[:, 1])) & (x > p[:, 0])
        out[at:to] = (np.bincount(which[hit] * width + owner[e[hit]], minlength=(to - at) * width) % 2 == 1).reshape(-1, width)
    return out


def assembled_many(rings: Rings, layer: np.ndarray, n: int, wanted: Callable[[np.ndarray], np.ndarray]) -> list[list[Polygon]]:
    """Of each of n sets (rings.polygon) of rings, each of a layer of its set, the polygons of what wanted describes, largest first.

    wanted gets a row a point of whether it is inside each layer, by parity, and says whether the point belongs to
    the set. Shells run counterclockwise, holes clockwise; parts that only touch at a corner are polygons of their own.
    """
    out: list[list[Polygon]] = [[] for _ in range(n)]
    if not len(rings.xy):
        return out
    of = rings.polygon[rings.of]
    sets, first = np.unique(of, return_index=True)
    origin, step = np.zeros((n, 2)), np.ones(n)
    origin[sets] = np.minimum.reduceat(rings.xy, first)
    extent = (np.maximum.reduceat(rings.xy, first) - origin[sets]).max(1)
    step[sets] = np.maximum(np.maximum(extent * GRID, np.maximum.reduceat(np.abs(rings.xy), first).max(1) * FINEST), 1e-300)
    grid = rings.moved(np.round((rings.xy - origin[of]) / step[of, None]))
    grid = grid.kept((grid.xy != grid.xy[grid.prv]).any(1))  # repeated corners go
    a, b, owner, of = _cut(grid.xy, grid.xy[grid.nxt], layer[grid.of], grid.polygon[grid.of])
    # what is inside is told by the pieces, which rounding may have moved off the edges
    pieces = (a, b, owner, of)
    at, _ = _distinct(of, a[:, 0], a[:, 1], b[:, 0], b[:, 1])
    a, b, of = a[at], b[at], of[at]
    middle, aside = (a + b) / 2, _left_of(b - a)
    left, right = (wanted(_layers(p, of, *pieces)) for p in (middle + aside, middle - aside))
    stay = left != right
    a, b, left, of = a[stay], b[stay], left[stay], of[stay]
    found = _walked(np.where(left[:, None], a, b), np.where(left[:, None], b, a), of)
    if not len(found.sizes):
        return out
    sizes = found.signed()
    flat, placed = found.each(), found.moved(found.xy * step[found.polygon][found.of, None] + origin[found.polygon][found.of]).each()
    which, begins = np.unique(found.polygon, return_index=True)
    sizes = sizes.tolist()
    for k, begin, end in zip(which.tolist(), begins.tolist(), np.append(begins[1:], len(flat)).tolist(), strict=True):
        shells = sorted((r for r in range(begin, end) if sizes[r] > 0), key=lambda r: -sizes[r])
        parts = [[r] for r in shells]
        for hole in (r for r in range(begin, end) if sizes[r] < 0):
            if len(parts) > 1:
                ring = flat[hole]
                beside = (ring[:1] + ring[1:2]) / 2 + _left_of(ring[1:2] - ring[:1])  # where the polygon is
                next(p for p in reversed(parts) if inside(beside, flat[p[0]])[0]).append(hole)
            else:
                parts[0].append(hole)
        parts.sort(key=lambda p: -sum(sizes[r] for r in p))
        out[k] = [[placed[r] for r in p] for p in parts]
    return out


def _left_of(d: np.ndarray) -> np.ndarray:
    """A small part of the grid's step to the left of directions."""
    return np.stack([-d[:, 1], d[:, 0]], 1) * (2.0**-6 / np.hypot(d[:, 0], d[:, 1]))[:, None]


def _walked(start: np.ndarray, end: np.ndarray, of: np.ndarray) -> Rings:
    """Rings of directed edges of sets, in ascending order, with the inside on the left; at a corner of several rings the walk turns as far left as it can, so rings don't cross. A ring is cut where it comes back to a corner; corners on a straight line go."""
    n = len(start)
    every = np.concatenate([start, end])
    corner, at = _distinct(np.concatenate([of, of]), every[:, 0], every[:, 1])
    a, b = at[:n].tolist(), at[n:].tolist()
    leaving: list[list[int]] = [[] for _ in corner]
    for e, v in enumerate(a):
        leaving[v].append(e)
    angle = np.arctan2(*(end - start).T[::-1]).tolist()
    used, out, owners = [False] * n, [], []
    sets = of.tolist()
    for first in range(n):
        if used[first]:
            continue
        e, ring = first, []
        while not used[e]:
            used[e] = True
            ring.append(a[e])
            ways = leaving[b[e]]
            if len(ways) > 1:
                ways = [k for k in ways if not used[k] or k == first]
            if not ways:
                break
            if len(ways) > 1:
                back = angle[e] + np.pi
                e = min(ways, key=lambda k: (back - angle[k]) % (2 * np.pi) or 2 * np.pi)  # noqa: B023
            else:
                e = ways[0]
            if e == first:
                break
        stack: list[int] = []
        place: dict[int, int] = {}
        for v in [*ring, ring[0]]:
            if v in place:
                loop = stack[place[v] :]
                out.append(loop)
                owners.append(sets[first])
                for k in loop[1:]:
                    del place[k]
                del stack[place[v] + 1 :]
            else:
                place[v] = len(stack)
                stack.append(v)
    rings = Rings(every[corner[[v for r in out for v in r]]].reshape(-1, 2) if out else np.zeros((0, 2)), np.array([len(r) for r in out], np.int64), np.array(owners, np.int64))
    while True:
        into, on = rings.xy - rings.xy[rings.prv], rings.xy[rings.nxt] - rings.xy
        flat = (into[:, 0] * on[:, 1] == into[:, 1] * on[:, 0]) & ((into * on).sum(1) > 0) & (rings.sizes >= 3)[rings.of]
        if not flat.any():
            return rings.only(rings.sizes >= 3)
        rings = rings.kept(~flat)


def repaired_many(polygons: list[Polygon]) -> list[list[Polygon]]:
    """Of each polygon the parts, largest first, of what is inside the shell, by parity, and in no hole. Holes are so clipped to the shell, and merged where they overlap."""
    rings = Rings.of_polygons(polygons)
    _, layer = spread(np.array([len(p) for p in polygons], np.int64))
    return assembled_many(rings, layer, len(polygons), lambda i: i[:, 0] & ~i[:, 1:].any(1))


def repaired(polygon: Polygon) -> list[Polygon]:
    return repaired_many([polygon])[0]


def united_many(rings: Rings, layer: np.ndarray, n: int) -> list[list[Polygon]]:
    """Of each of n sets (rings.polygon) of polygons (layer), each taken by parity of its rings, the union as polygons that share no more than corners."""
    return assembled_many(rings, layer, n, lambda i: i.any(1))


def united(polygons: list[Polygon]) -> list[Polygon]:
    layer = np.repeat(np.arange(len(polygons)), [len(p) for p in polygons])
    return united_many(Rings.of_polygons([[r for p in polygons for r in p]]), layer, 1)[0]
