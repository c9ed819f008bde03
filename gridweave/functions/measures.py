"""Column expressions for pixel measures and for rings (arrays of x, y structs).

All of them are Catalyst expressions: they stay inside whole-stage code generation or higher-order
functions, and no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to denominators, as published ratios do.
EPS = 1e-9


def at_least(byte: Column, threshold: float) -> Column:
    """byte / 255 >= threshold, as a comparison of whole numbers."""
    least = next((b for b in range(256) if b / 255 >= threshold), 256)
    return byte >= F.lit(least)


def foreground(label: Column) -> Column:
    return label > 127


def seed(interior: Column, boundary: Column, t_interior: float = 0.5, t_boundary: float = 0.4) -> Column:
    """Confident inside and not on a wall: interior >= max(t, 0.6) and boundary < t_boundary."""
    return at_least(interior, max(t_interior, 0.6)) & ~at_least(boundary, t_boundary)


def confusion(predicted: Column, truth: Column) -> list[Column]:
    """tp, fp, fn, tn as mergeable counts."""
    cases = (("tp", predicted & truth), ("fp", predicted & ~truth), ("fn", ~predicted & truth), ("tn", ~predicted & ~truth))
    return [F.count_if(c).alias(name) for name, c in cases]


def ratios(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall, f1 and iou from counts."""
    eps = F.lit(EPS)
    tp, fp, fn = (c.cast("double") for c in (tp, fp, fn))
    precision, recall = tp / (tp + fp + eps), tp / (tp + fn + eps)
    return {"precision": precision, "recall": recall, "f1": F.lit(2.0) * precision * recall / (precision + recall + eps), "iou": tp / (tp + fp + fn + eps)}


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def to_byte(p: Column) -> Column:
    """A probability as the byte that is stored: half to even."""
    return F.bround(p * 255).cast("int")


def tversky_index(tp: Column, fp: Column, fn: Column, alpha: float, beta: float) -> Column:
    return (tp + 1) / (tp + F.lit(alpha) * fp + F.lit(beta) * fn + 1)


def focal(index: Column, gamma: float) -> Column:
    return F.pow(F.greatest(F.lit(1.0) - index, F.lit(1e-7)), F.lit(1.0 / gamma))


# Rings are open: the first point isn't repeated at the end.


def ring_of(values: Column) -> Column:
    """A ring from numbers x0, y0, x1, y1, ..."""
    pairs = F.sequence(F.lit(0), (F.size(values) / 2).cast("int") - 1)
    return F.transform(pairs, lambda i: F.struct(F.get(values, 2 * i).cast("double").alias("x"), F.get(values, 2 * i + 1).cast("double").alias("y")))


def opened(ring: Column) -> Column:
    """Without a closing point within 1e-8 of the first."""
    a, z = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    closes = (F.size(ring) > 1) & (F.abs(a["x"] - z["x"]) <= 1e-8 + 1e-5 * F.abs(z["x"])) & (F.abs(a["y"] - z["y"]) <= 1e-8 + 1e-5 * F.abs(z["y"]))
    return F.when(closes, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def edges(ring: Column) -> Column:
    """ax, ay, bx, by of each edge, the closing one last."""
    n = F.size(ring)

    def edge(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        return F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))

    return F.transform(ring, edge)


def _total(items: Column, one) -> Column:
    return F.aggregate(F.transform(items, one), F.lit(0.0), lambda a, b: a + b)


def ring_area(ring: Column) -> Column:
    return F.abs(_total(edges(ring), lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2


def ring_length(ring: Column) -> Column:
    return _total(edges(ring), lambda e: F.sqrt((e["bx"] - e["ax"]) * (e["bx"] - e["ax"]) + (e["by"] - e["ay"]) * (e["by"] - e["ay"])))


def polygon_area(rings: Column) -> Column:
    """Of the first ring less all others."""
    return _total(rings, ring_area) * -1 + 2 * ring_area(F.get(rings, F.lit(0)))


def polygon_length(rings: Column) -> Column:
    """Of all rings, holes too."""
    return _total(rings, ring_length)


def dominant_angle(ring: Column) -> Column:
    """Length-weighted circular mean of edge directions modulo a right angle, in [0, pi / 2)."""
    long = F.filter(edges(ring), lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]) > 1e-9)
    part = lambda f: _total(long, lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]) * f(4 * F.atan2(e["by"] - e["ay"], e["bx"] - e["ax"])))
    x, y = part(F.cos), part(F.sin)
    flat = (F.size(ring) < 3) | ((F.abs(x) < 1e-12) & (F.abs(y) < 1e-12))
    return F.when(flat, F.lit(0.0)).otherwise(F.pmod(F.atan2(y, x) / 4, F.lit(3.141592653589793 / 2)))


def corner_angles(ring: Column) -> Column:
    """Unsigned angle at every vertex in degrees, without those next to an edge of no length."""
    n = F.size(ring)

    def corner(p: Column, i: Column) -> Column:
        a, b = F.get(ring, (i + n - 1) % n), F.get(ring, (i + 1) % n)
        ax, ay, bx, by = a["x"] - p["x"], a["y"] - p["y"], b["x"] - p["x"], b["y"] - p["y"]
        la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
        real = (la > 1e-9) & (lb > 1e-9)
        cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ax * bx + ay * by, la * lb)))
        return F.when(real, F.degrees(F.acos(cos)))

    return F.when(n < 3, F.array().cast("array<double>")).otherwise(F.filter(F.transform(ring, corner), lambda d: d.isNotNull()))


def orthogonality(ring: Column, tolerance: float = 10.0) -> Column:
    """Share of corners within tolerance of 90 or 180 degrees; 0 without corners."""
    angles = corner_angles(ring)
    good = F.filter(angles, lambda d: (F.abs(d - 90) <= tolerance) | (F.abs(d - 180) <= tolerance))
    return F.coalesce(F.try_divide(F.size(good).cast("double"), F.size(angles).cast("double")), F.lit(0.0))


def rotated(ring: Column, theta: Column, ox: Column, oy: Column) -> Column:
    def turn(p: Column) -> Column:
        x, y = p["x"] - ox, p["y"] - oy
        return F.struct((F.cos(theta) * x - F.sin(theta) * y + ox).alias("x"), (F.sin(theta) * x + F.cos(theta) * y + oy).alias("y"))

    return F.transform(ring, turn)


def segment_distance(x: Column, y: Column, e: Column) -> Column:
    """From a point to the segment ax, ay, bx, by."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    along = F.coalesce(F.try_divide((x - e["ax"]) * dx + (y - e["ay"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    px, py = x - e["ax"] - t * dx, y - e["ay"] - t * dy
    return F.sqrt(px * px + py * py)


def displacement(a: Column, b: Column) -> Column:
    """Mean of both directed mean distances from one ring's vertices to the other's boundary; null if a ring is empty."""

    def one(u: Column, v: Column) -> Column:
        nearest = lambda p, es: F.array_min(F.transform(es, lambda e: segment_distance(p["x"], p["y"], e)))
        bound = F.transform(F.array(edges(v)), lambda es: F.try_divide(_total(u, lambda p: nearest(p, es)), F.size(u).cast("double")))  # edges are made once for all vertices
        return F.get(bound, F.lit(0))

    return F.when((F.size(a) > 0) & (F.size(b) > 0), (one(a, b) + one(b, a)) / 2)


def to_map(transform: Column, col: Column, row: Column) -> Column:
    """Pixel to map coordinates by the affine a..f."""
    return F.struct((transform["a"] * col + transform["b"] * row + transform["c"]).alias("x"), (transform["d"] * col + transform["e"] * row + transform["f"]).alias("y"))


def to_pixel(transform: Column, x: Column, y: Column) -> Column:
    """Map to pixel coordinates, the inverse of to_map."""
    a, b, c, d, e, f = (transform[k] for k in "abcdef")
    det = a * e - b * d
    return F.struct(((e * (x - c) - b * (y - f)) / det).alias("col"), ((a * (y - f) - d * (x - c)) / det).alias("row"))
