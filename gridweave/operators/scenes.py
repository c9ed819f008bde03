"""Instances and outlines of scenes of any size, square by square.

A scene is a lattice of squares. Each square numbers its own parts; where two squares touch, parts
are linked, and a part's id in the scene is the least of its numbers. Only strips along the edges of
squares and tables of numbers cross the network for that. A part of the mask that holds one seed
is that seed's without a look at its cells; the cells of a part that several seeds share are brought
together and flooded, a part a task. Outlines are walked inside squares; open walks are put together by
where they go on. So a task holds a square, a part that seeds share, or a polygon, never a scene.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators.graphs import least_ids, ordered_cycles
from gridweave.operators.kernels import labels
from gridweave.operators.tiles import assembled, dealt, with_halo
from gridweave.sources.blocks import SIZE
from gridweave.sources.tables import discarded, materialised

STRIP = "struct<kind:string,line:int,at:int,role:int,planes:array<binary>>"
SQUARE = f"scene string, row0 int, col0 int, h int, w int, counts array<int>, strips array<{STRIP}>"
#: A piece of a raster of labels: codes (packed, h x w) count from 1 into values; 0 is no label.
PIECE = "scene string, row0 int, col0 int, h int, w int, codes binary, values array<long>"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all tasks by keys: packed planes are few bytes but much work, so they aren't coalesced by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def packed(plane: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(plane).tobytes(), 1)


def unpacked(data: bytes, h: int, w: int, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind).reshape(h, w)


def _strips(top: int, left: int, size: int, planes: list[np.ndarray], eight: bool) -> list[tuple]:
    """The edge cells of a square for each neighbour: kind, line and at name the border; role 0 is the upper or left side. Corners count only for eight."""
    planes = [np.pad(p, [(0, size - p.shape[0]), (0, size - p.shape[1])]) if p.shape != (size, size) else p for p in planes]
    whole, last = slice(None), slice(-1, None)
    places = [("row", top, left, 1, (slice(1), whole)), ("row", top + size, left, 0, (last, whole)), ("col", left, top, 1, (whole, slice(1))), ("col", left + size, top, 0, (whole, last))]
    if eight:
        places += [("fall", top, left, 1, (slice(1), slice(1))), ("fall", top + size, left + size, 0, (last, last)), ("rise", top, left + size, 1, (slice(1), last)), ("rise", top + size, left, 0, (last, slice(1)))]
    return [(kind, line, at, role, [p[where].astype("<i4").tobytes() for p in planes]) for kind, line, at, role, where in places if any(p[where].any() for p in planes)]


def number(local: Column, size: int) -> Column:
    """The id in the scene of a local number of the square at row0, col0."""
    return F.shiftleft(F.floor(F.col("row0") / size).cast("long"), 47) + F.shiftleft(F.floor(F.col("col0") / size).cast("long"), 31) + local.cast("long")


def links(squares: DataFrame, size: int, eight: bool) -> DataFrame:
    """plane, scene, a, b: the numbers of each numbered plane that touch across the edges of squares."""
    one = squares.select("scene", "row0", "col0", F.explode("strips").alias("s")).select("scene", "s.*", number(F.lit(0), size).alias("base"))
    a, b = (one.filter(F.col("role") == k).select("scene", "kind", "line", "at", F.col("base").alias(f"base{k}"), F.col("planes").alias(f"planes{k}")) for k in (0, 1))

    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out: list[list] = [[], [], [], []]
            for row in rows:
                for plane, (x, y) in enumerate(zip(row["planes0"], row["planes1"], strict=True)):
                    x, y = np.frombuffer(x, "<i4").astype(np.int64), np.frombuffer(y, "<i4").astype(np.int64)
                    shifts = (-1, 0, 1) if eight and len(x) > 1 else (0,)
                    pairs = np.concatenate([np.stack([x[max(0, -k) : len(x) - max(0, k)], y[max(0, k) : len(y) - max(0, -k)]], 1) for k in shifts])
                    pairs = np.unique(pairs[(pairs > 0).all(1)], axis=0)
                    for lot, values in zip(out, ([row["scene"]] * len(pairs), [plane] * len(pairs), pairs[:, 0] + row["base0"], pairs[:, 1] + row["base1"]), strict=True):
                        lot.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(lot, kind) for lot, kind in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["scene", "plane", "a", "b"])

    return materialised(a.join(b, ["scene", "kind", "line", "at"]).select("scene", "base0", "planes0", "base1", "planes1").mapInArrow(touch, "scene string, plane int, a long, b long"))


def rooted(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """rows with the number in column replaced by its id in the scene, given roots (scene, id, least)."""
    to = roots.select("scene", F.col("id").alias(column), F.col("least").alias("_least"))
    return rows.join(to, ["scene", column], "left").withColumn(column, F.coalesce("_least", column)).drop("_least")


def numbered_squares(blocks: DataFrame, planes: Callable[[dict], list[np.ndarray]], names: list[str], reach: int, label: Callable[..., tuple[list[np.ndarray], dict]], extra: str, eight: bool, size: int) -> DataFrame:
    """SQUARE and extra of every square that holds anything: label turns its window's planes into numbered planes, and other columns."""

    def one(parts: pd.DataFrame) -> pd.DataFrame:
        top, left = int(parts["top"].iloc[0]) + reach, int(parts["left"].iloc[0]) + reach
        tall, wide = int((parts["row0"] + parts["h"]).max()) - top, int((parts["col0"] + parts["w"]).max()) - left
        rim = (slice(min(tall, size) + 2 * reach), slice(min(wide, size) + 2 * reach))  # a square at the end of a scene is cut where its blocks end
        found, more = label(*(assembled(parts, n)[rim] for n in names))
        if min(found[0].shape) < 1 or not any(p.any() for p in found):
            return pd.DataFrame(columns=columns)
        counts = [int(p.max()) for p in found]
        return pd.DataFrame([(parts["scene"].iloc[0], top, left, *found[0].shape, counts, _strips(top, left, size, found, eight), *more.values())], columns=columns)

    columns = ["scene", "row0", "col0", "h", "w", "counts", "strips", *(c.split()[0] for c in extra.split(", "))]
    pieces = dealt(blocks, with_halo(size, reach), planes, names)
    return materialised(spread(pieces, "scene", "top", "left").groupBy("scene", "top", "left").applyInPandas(one, f"{SQUARE}, {extra}"))


def component_pieces(blocks: DataFrame, band: str = "v", least: int = 128, eight: bool = True, size: int = SIZE) -> DataFrame:
    """PIECE rows of the components of the cells whose byte in band is at least least."""
    cells = lambda row: [np.frombuffer(row[band], np.uint8).reshape(row["h"], row["w"])]

    def label(window: np.ndarray) -> tuple[list[np.ndarray], dict]:
        found = labels.components(window >= least, eight)
        return [found], {"plane": packed(found)}

    squares = numbered_squares(blocks, cells, ["v"], 0, label, "plane binary", eight, size)
    between = links(squares, size, eight)
    roots = least_ids(between.select("scene", "a", "b"))
    own = squares.select("scene", "row0", "col0", F.posexplode(F.sequence(F.lit(1), F.col("counts")[0])).alias("i", "local")).withColumn("id", number(F.col("local"), size))
    values = rooted(own, roots, "id").groupBy("scene", "row0", "col0").agg(F.transform(F.array_sort(F.collect_list(F.struct("local", "id"))), lambda x: x["id"]).alias("values"))
    out = squares.join(values, ["scene", "row0", "col0"])
    out = materialised(out.select("scene", "row0", "col0", "h", "w", F.col("plane").alias("codes"), "values"))
    for used in (squares, between, roots):
        discarded(used)
    return out


def instance_pieces(blocks: DataFrame, t_interior: float = 0.5, t_boundary: float = 0.4, seed_least: int = 16, size: int = SIZE) -> DataFrame:
    """PIECE rows of the instances of blocks with bytes interior and boundary: what labels.instances() finds in a whole scene."""
    shares = np.arange(256) / 255
    inside, core, calm = shares >= t_interior, shares >= max(t_interior, 0.6), shares < t_boundary

    def planes(row: dict) -> list[np.ndarray]:
        found = [np.frombuffer(row[b], np.uint8).reshape(row["h"], row["w"]) for b in ("interior", "boundary")]
        return [*found, np.ones_like(found[0])]

    def label(interior: np.ndarray, boundary: np.ndarray, there: np.ndarray) -> tuple[list[np.ndarray], dict]:
        middle = (slice(1, -1),) * 2
        there = there > 0
        seeds = labels.components(labels.eroded(core[interior] & calm[boundary] & there, [(0, 0), *labels.EIGHT])[middle])
        parts = labels.components((inside[interior] & there)[middle])
        both = np.unique(parts[seeds > 0].astype(np.int64) << 32 | seeds[seeds > 0])
        held = [(int(x >> 32), int(x & 0xFFFFFFFF)) for x in both]
        return [parts, seeds], {"parts": packed(parts), "seeds": packed(seeds), "surface": packed(boundary[middle]), "sizes": np.bincount(seeds.ravel())[1:].tolist(), "held": held}

    extra = "parts binary, seeds binary, surface binary, sizes array<long>, held array<struct<part:int,seed:int>>"
    squares = numbered_squares(blocks, planes, ["interior", "boundary", "there"], 1, label, extra, False, size)
    place = ["scene", "row0", "col0"]
    between = links(squares, size, False)
    of_parts, of_seeds = (least_ids(between.filter(F.col("plane") == k).select("scene", "a", "b")) for k in (0, 1))
    # seeds that are large enough, over all their squares
    seeds = squares.select(*place, F.posexplode("sizes").alias("i", "n")).select(*place, (F.col("i") + 1).alias("seed_no"), number(F.col("i") + 1, size).alias("seed"), "n")
    seeds = rooted(seeds, of_seeds, "seed")
    kept = seeds.groupBy("scene", "seed").agg(F.sum("n").alias("n")).filter(F.col("n") >= seed_least).select("scene", "seed")
    # the seeds of each part: one decides it, several share it
    held = squares.select(*place, F.explode("held").alias("h")).select(*place, F.col("h.part").alias("part_no"), number(F.col("h.part"), size).alias("part"), number(F.col("h.seed"), size).alias("seed"))
    held = rooted(rooted(held, of_parts, "part"), of_seeds, "seed").join(kept, ["scene", "seed"])
    decided = held.groupBy("scene", "part").agg(F.min("seed").alias("low"), F.max("seed").alias("high")).select("scene", "part", F.when(F.col("low") == F.col("high"), F.col("low")).alias("label"))
    numbers = squares.select(*place, F.explode(F.when(F.col("counts")[0] > 0, F.sequence(F.lit(1), F.col("counts")[0]))).alias("part_no")).withColumn("part", number(F.col("part_no"), size))
    numbers = rooted(numbers, of_parts, "part").join(decided, ["scene", "part"])
    of_square = numbers.groupBy(*place).agg(F.collect_list(F.struct("part_no", "part", "label")).alias("known"))
    own_seeds = seeds.join(kept, ["scene", "seed"]).groupBy(*place).agg(F.collect_list(F.struct("seed_no", "seed")).alias("own"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, w = row["h"], row["w"]
                parts = unpacked(row["parts"], h, w)
                codes, values, out = np.zeros(int(parts.max()) + 1, np.int32), [], []
                shared = {}
                for k in row["known"]:
                    if k["label"] is None:
                        shared[k["part_no"]] = k["part"]
                    else:
                        values.append(k["label"])
                        codes[k["part_no"]] = len(values)
                where = (row["scene"], row["row0"], row["col0"])
                if values:
                    out.append((*where, h, w, packed(codes[parts]), values, None, None))
                if shared:
                    seeds, surface = unpacked(row["seeds"], h, w), unpacked(row["surface"], h, w, "u1")
                    roots = np.zeros(int(seeds.max()) + 1, np.int32)
                    names = [s["seed"] for s in row["own"] or []]
                    roots[[s["seed_no"] for s in row["own"] or []]] = np.arange(1, len(names) + 1)
                    for no, top, bottom, left, right in labels.boxes(np.where(np.isin(parts, list(shared)), parts, 0)):
                        crop = (slice(top, bottom), slice(left, right))
                        mask = parts[crop] == no
                        cells = np.where(mask, roots[seeds[crop]] + 1, 0)  # 1: no seed
                        out.append((row["scene"], row["row0"] + top, row["col0"] + left, bottom - top, right - left, packed(cells.astype("<i4")), names, shared[no], packed(surface[crop])))
                if out:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=schema.names), schema, preserve_index=False)

    schema = pa.schema([("scene", pa.string()), *((n, pa.int32()) for n in ("row0", "col0", "h", "w")), ("codes", pa.binary()), ("values", pa.list_(pa.int64())), ("part", pa.int64()), ("surface", pa.binary())])
    known = squares.select(*place, "h", "w", "parts", "seeds", "surface").join(of_square, place).join(own_seeds, place, "left")
    cut = materialised(spread(known, *place).mapInArrow(split, f"{PIECE}, part long, surface binary"))
    flooded = spread(cut.filter("part is not null"), "scene", "part").groupBy("scene", "part").applyInPandas(_flood, PIECE)
    out = materialised(cut.filter("part is null").drop("part", "surface").unionByName(flooded))
    for used in (squares, between, of_parts, of_seeds, cut):
        discarded(used)
    return out


def _flood(rows: pd.DataFrame) -> pd.DataFrame:
    """One part's cells, as pieces with the seeds in them, flooded; pieces with the labels."""
    top, left = int(rows["row0"].min()), int(rows["col0"].min())
    shape = int((rows["row0"] + rows["h"]).max()) - top, int((rows["col0"] + rows["w"]).max()) - left
    mask, seeds, surface = np.zeros(shape, bool), np.zeros(shape, np.int32), np.zeros(shape, np.uint8)
    names = np.unique(np.concatenate([np.asarray(v, np.int64) for v in rows["values"]]))
    for r in rows.itertuples(index=False):
        at = (slice(r.row0 - top, r.row0 - top + r.h), slice(r.col0 - left, r.col0 - left + r.w))
        cells = unpacked(r.codes, r.h, r.w)
        own = np.concatenate([[0, 0], np.searchsorted(names, np.asarray(r.values, np.int64)) + 1])
        mask[at] |= cells > 0
        seeds[at] = np.where(cells > 1, own[cells], seeds[at])
        surface[at] = np.where(cells > 0, unpacked(r.surface, r.h, r.w, "u1"), surface[at])
    found = labels.flooded(surface, seeds, mask)
    out = []
    for r in rows.itertuples(index=False):
        codes = np.where(unpacked(r.codes, r.h, r.w) > 0, found[r.row0 - top : r.row0 - top + r.h, r.col0 - left : r.col0 - left + r.w], 0)
        used, codes = np.unique(codes, return_inverse=True)
        if used[0]:
            used, codes = np.concatenate([[0], used]), codes + 1
        out.append((r.scene, r.row0, r.col0, r.h, r.w, packed(codes.reshape(r.h, r.w).astype("<i4")), names[used[1:] - 1].tolist()))
    return pd.DataFrame(out, columns=["scene", "row0", "col0", "h", "w", "codes", "values"])


def outlines(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """scene, label, rings (arrays of struct xs, ys in pixel corners) of PIECE rows that don't overlap and whose labels are 8-connected."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                codes, r0, c0 = unpacked(row["codes"], row["h"], row["w"]), row["row0"], row["col0"]
                for i in range((r0 - 1) // size, (r0 + row["h"]) // size + 1):
                    for j in range((c0 - 1) // size, (c0 + row["w"]) // size + 1):
                        top, left = max(i * size - 1, r0), max(j * size - 1, c0)
                        bottom, right = min((i + 1) * size + 1, r0 + row["h"]), min((j + 1) * size + 1, c0 + row["w"])
                        part = codes[top - r0 : bottom - r0, left - c0 : right - c0]
                        if min(part.shape) > 0 and part.any():
                            used = np.flatnonzero(np.bincount(part.ravel()))
                            short = np.zeros(used[-1] + 1, "<i4")
                            short[used] = np.arange(len(used))
                            values = [0 if k == 0 else row["values"][k - 1] for k in used.tolist()]
                            out.append((row["scene"], i, j, top, left, bottom - top, right - left, packed(short[part]), values))
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=schema.names), schema, preserve_index=False)

    none = pd.DataFrame(columns=["scene", "label", "id", "next", "xs", "ys"])

    def walk(parts: pd.DataFrame) -> pd.DataFrame:
        i, j = int(parts["i"].iloc[0]), int(parts["j"].iloc[0])
        row0, col0, h, w = (parts[c].to_numpy() for c in ("row0", "col0", "h", "w"))
        if not ((row0 < (i + 1) * size) & (row0 + h > i * size) & (col0 < (j + 1) * size) & (col0 + w > j * size)).any():
            return none  # all rim, as at the ends of scenes
        plane = np.zeros((size + 2, size + 2), np.int64)
        for r in parts.itertuples(index=False):
            at = (slice(r.row0 - i * size + 1, r.row0 - i * size + 1 + r.h), slice(r.col0 - j * size + 1, r.col0 - j * size + 1 + r.w))
            found = np.asarray(r.values, np.int64)[unpacked(r.codes, r.h, r.w)]
            plane[at] = np.where(found, found, plane[at])
        # no walk leaves the box of the square's own labels but into its rim
        rows, cols = (np.flatnonzero(plane[1:-1, 1:-1].any(axis)) for axis in (1, 0))
        if not len(rows):
            return none
        walks = labels.arcs(plane[rows[0] : rows[-1] + 3, cols[0] : cols[-1] + 3], i * size + int(rows[0]), j * size + int(cols[0]))
        return pd.DataFrame([(parts["scene"].iloc[0], *x[:2], x[2], x[3].astype(np.int32), x[4].astype(np.int32)) for x in walks], columns=["scene", "label", "id", "next", "xs", "ys"]).astype({"next": "Int64"})

    schema = pa.schema([("scene", pa.string()), *((n, pa.int32()) for n in ("i", "j", "row0", "col0", "h", "w")), ("codes", pa.binary()), ("values", pa.list_(pa.int64()))])
    parts = pieces.mapInArrow(deal, "scene string, i int, j int, row0 int, col0 int, h int, w int, codes binary, values array<long>")
    walks = materialised(spread(parts, "scene", "i", "j").groupBy("scene", "i", "j").applyInPandas(walk, "scene string, label long, id long, next long, xs array<int>, ys array<int>"))
    closed = walks.filter("next is null").select("scene", "label", "xs", "ys")
    open_ = walks.filter("next is not null")
    if not open_.isEmpty():
        order = ordered_cycles(open_.select("scene", "id", "next"))
        # along a cycle: the least id, then the others by how far ahead it is
        one = F.struct((F.col("off") != 0).alias("rest"), (-F.col("off")).alias("place"), "xs", "ys")
        joined = open_.join(order, ["scene", "id"]).groupBy("scene", "label", "cycle").agg(F.array_sort(F.collect_list(one)).alias("walk"))
        along = lambda c: F.flatten(F.transform("walk", lambda x: x[c])).alias(c)
        closed = closed.unionByName(joined.select("scene", "label", along("xs"), along("ys")))
    return closed.groupBy("scene", "label").agg(F.collect_list(F.struct("xs", "ys")).alias("rings"))
