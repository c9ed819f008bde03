"""GeoTIFF files as block tables: a data source that reads only the strips or tiles that its window meets."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gridweave.sources.blocks import KEY, SIZE
from gridweave.sources.tables import store_of

# Numbers of tags and the byte widths of their types, as the format defines them.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, PIXEL_SCALE, TIE_POINT = 284, 317, 322, 323, 324, 325, 33550, 33922
TYPES = {1: "B", 3: "H", 4: "I", 12: "d", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


def directory(read: Callable[[int, int], bytes]) -> dict[int, tuple]:
    """Values of the first directory, of the types in TYPES, of a classic file or one with 64-bit offsets; read(at, n) gives n bytes."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    # fixed values: widths of counts, entries and offsets in both forms
    many, entry, place = ("H", 12, "I") if magic == 42 else ("Q", 20, "Q")
    (at,) = struct.unpack_from(order + place, head, 4 if magic == 42 else 8)
    (n,) = struct.unpack(order + many, read(at, struct.calcsize(many)))
    data = read(at + struct.calcsize(many), entry * n)
    out = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HH" + place, data, entry * i)
        if kind in TYPES:
            form = f"{order}{count}{TYPES[kind]}"
            size, inline = struct.calcsize(form), entry * i + 4 + struct.calcsize(order + place)
            if size > struct.calcsize(place):
                out[tag] = struct.unpack(form, read(struct.unpack_from(order + place, data, inline)[0], size))
            else:
                out[tag] = struct.unpack_from(form, data, inline)
    return out


def tags(data: bytes) -> dict[int, tuple]:
    return directory(lambda at, n: data[at : at + n])


class Raster:
    """Windows of an 8-bit file in strips or tiles: only the pieces that a window meets are read and decoded."""

    def __init__(self, read: Callable[[int, int], bytes], kept: int = 64):
        self.read = read
        t = directory(read)
        (self.w,), (self.h,) = t[WIDTH], t[HEIGHT]
        self.bands = t.get(SAMPLES, (1,))[0]
        if set(t.get(BITS, (1,))) != {8}:
            raise ValueError("only samples of 8 bits are supported")
        self.tiled = TILE_OFFSETS in t
        self.wide, self.tall = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if self.tiled else (self.w, min(self.h, t.get(ROWS_PER_STRIP, (self.h,))[0]))
        self.apart = t.get(PLANAR, (1,))[0] == 2
        self.offsets, self.sizes = (t[TILE_OFFSETS], t[TILE_SIZES]) if self.tiled else (t[STRIP_OFFSETS], t[STRIP_SIZES])
        self.compression, self.predictor = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0]
        self.affine = None
        if PIXEL_SCALE in t and TIE_POINT in t:
            sx, sy = t[PIXEL_SCALE][:2]
            col, row, _, x, y = t[TIE_POINT][:5]
            self.affine = (sx, 0.0, x - col * sx, 0.0, -sy, y + row * sy)
        self.piece = lru_cache(kept)(self._piece)  # a piece that several windows meet is decoded once

    def _piece(self, i: int, lines: int, depth: int) -> np.ndarray:
        part = np.frombuffer(unpacked(self.read(self.offsets[i], self.sizes[i]), self.compression), np.uint8)[: lines * self.wide * depth].reshape(lines, self.wide, depth)
        return np.cumsum(part, 1, dtype=np.uint8) if self.predictor == 2 else part

    def window(self, row: int, col: int, h: int, w: int) -> np.ndarray:
        """h x w x bands bytes of a window inside the raster."""
        out = np.zeros((h, w, self.bands), np.uint8)
        across, down = -(-self.w // self.wide), -(-self.h // self.tall)
        depth = 1 if self.apart else self.bands
        for band in range(self.bands if self.apart else 1):
            for i in range(row // self.tall, min(down, -(-(row + h) // self.tall))):
                for j in range(col // self.wide, min(across, -(-(col + w) // self.wide))):
                    top, left = i * self.tall, j * self.wide
                    part = self.piece(band * across * down + i * across + j, self.tall if self.tiled else min(self.tall, self.h - top), depth)
                    r0, c0, r1, c1 = max(row, top), max(col, left), min(row + h, top + len(part)), min(col + w, left + self.wide)
                    out[r0 - row : r1 - row, c0 - col : c1 - col, band : band + depth] = part[r0 - top : r1 - top, c0 - left : c1 - left]
        return out


def unpacked(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == LZW:
        return _lzw(data)
    raise ValueError(f"compression {compression} isn't supported")


def _lzw(data: bytes) -> bytes:
    clear, stop = 256, 257
    known: list[bytes] = []
    out, held, bits, width, last = [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == stop:
            break
        if code == clear:
            known, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        word = known[code] if code < len(known) else last + last[:1]
        out.append(word)
        if last:
            known.append(last + word[:1])
        last = word
        width = min(12, max(9, (len(known) + 1).bit_length()))
    return b"".join(out)


def image(data: bytes) -> tuple[np.ndarray, tuple[float, ...] | None]:
    """height x width x bands bytes and the affine a..f (None without georeference) of a whole file."""
    raster = Raster(lambda at, n: data[at : at + n])
    return raster.window(0, 0, raster.h, raster.w), raster.affine


def encoded(planes: np.ndarray, affine: tuple[float, ...] | None = None, tall: int = 256) -> bytes:
    """A file of h x w x bands bytes: strips, deflate, differences along rows; affine without rotation."""
    h, w, n = planes.shape
    moved = planes.copy()
    moved[:, 1:] -= planes[:, :-1]
    strips = [zlib.compress(moved[r : r + tall].tobytes()) for r in range(0, h, tall)]
    sizes = [len(s) for s in strips]
    offsets = [8 + sum(sizes[:i]) for i in range(len(strips))]
    entries = [(WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (8,) * n), (COMPRESSION, 3, (DEFLATE,)), (262, 3, (1,)), (STRIP_OFFSETS, 4, offsets), (SAMPLES, 3, (n,)), (ROWS_PER_STRIP, 4, (tall,)), (STRIP_SIZES, 4, sizes), (PLANAR, 3, (1,)), (PREDICTOR, 3, (2,))]
    if affine:
        a, _, c, _, e, f = affine
        entries += [(PIXEL_SCALE, 12, (a, -e, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, c, f, 0.0))]
    body = b"".join(strips)
    body += b"\0" * (len(body) % 2)
    at = 8 + len(body)
    extra, after = b"", at + 2 + 12 * len(entries) + 4
    directory = struct.pack("<H", len(entries))
    for tag, kind, values in entries:
        packed = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        if len(packed) > 4:
            value, extra = struct.pack("<I", after + len(extra)), extra + packed
        else:
            value = packed.ljust(4, b"\0")
        directory += struct.pack("<HHI", tag, kind, len(values)) + value
    return b"II" + struct.pack("<HI", 42, at) + body + directory + b"\0" * 4 + extra


#: Bytes of blocks that a partition of the source decodes; files below this size are a partition each, unopened on the driver.
SPLIT = 64 << 20


class Blocks(InputPartition):
    """Blocks of one file: block rows from first to stop, or all where it is unknown."""

    def __init__(self, path: str, scene: str, first: int = 0, stop: int | None = None):
        self.path, self.scene, self.first, self.stop = path, scene, first, stop


class RasterReader(DataSourceReader):
    """Reads blocks of the files in a folder. The options scene and window (row, col, h, w) decide which files, block rows and pieces are read at all.

    They are options rather than pushed filters because one source keeps what one query pushed for the next one.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", ".tif")
        self.names, self.size = [b.strip() for b in options["bands"].split(",")], int(options.get("size", SIZE))
        self.scene = options.get("scene")
        row, col, h, w = map(int, options["window"].split(",")) if "window" in options else (0, 0, 1 << 62, 1 << 62)
        self.rows, self.cols = ((max(0, at) // self.size * self.size, at + length) for at, length in ((row, h), (col, w)))  # from, below

    def _files(self) -> Iterator[tuple[str, str, int]]:
        store, folder = store_of(self.path)
        for f in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
            scene = f.base_name.removesuffix(self.suffix)
            if f.type == fs.FileType.File and f.base_name.endswith(self.suffix) and self.scene in (None, scene):
                yield f.path, scene, f.size

    def partitions(self) -> list[Blocks]:
        out = []
        for path, scene, size in self._files():
            if size <= SPLIT:
                out.append(Blocks(path, scene))
                continue
            with _opened(self.path, path) as raster:
                first, stop = self.rows[0] // self.size, -(-min(self.rows[1], raster.h) // self.size)
                step = max(1, SPLIT // (self.size * raster.w * raster.bands))
                out += [Blocks(path, scene, at, min(at + step, stop)) for at in range(first, stop, step)]
        return out

    def read(self, partition: Blocks | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no file
            return
        schema = pa.schema([("scene", pa.string()), *((n, pa.int32()) for n in ("row0", "col0", "h", "w")), *((b, pa.binary()) for b in self.names), ("affine", pa.list_(pa.float64()))])
        with _opened(self.path, partition.path) as raster:
            if raster.bands < len(self.names):
                raise ValueError(f"{partition.scene} has {raster.bands} bands, {len(self.names)} were asked for")
            stop = -(-raster.h // self.size) if partition.stop is None else partition.stop
            for r in range(partition.first * self.size, min(stop * self.size, raster.h), self.size):
                if not self.rows[0] <= r < self.rows[1]:
                    continue
                rows = []
                for c in range(0, raster.w, self.size):
                    if self.cols[0] <= c < self.cols[1]:
                        h, w = min(self.size, raster.h - r), min(self.size, raster.w - c)
                        part = raster.window(r, c, h, w)
                        rows.append((partition.scene, r, c, h, w, *(part[..., k].tobytes() for k in range(len(self.names))), raster.affine))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@contextmanager
def _opened(folder: str, path: str) -> Iterator[Raster]:
    with store_of(folder)[0].open_input_file(path) as file:
        yield Raster(lambda at, n: file.read_at(n, at))


class RasterSource(DataSource):
    """format("geotiff"): option path (a folder), bands (names, comma-separated), suffix, size, scene and window."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return ", ".join([KEY, *(f"{b.strip()} binary" for b in self.options["bands"].split(",")), "affine array<double>"])

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(self.options)


def read_geotiff(spark: SparkSession, folder: str, bands: tuple[str, ...], suffix: str = ".tif", size: int = SIZE, scene: str | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Blocks (KEY, bands, affine) of all files of a folder with the suffix, or of one scene's; the scene is the rest of the name.

    Large files are split by rows of blocks, classic ones and those above 4 GB alike. With window (row, col, h, w) only blocks that meet it
    are made, and no other strip or tile is read. Bands beyond those named are left out.
    """
    spark.dataSource.register(RasterSource)
    options = {"bands": ",".join(bands), "suffix": suffix, "size": str(size)} | ({"scene": scene} if scene is not None else {}) | ({"window": ",".join(map(str, window))} if window else {})
    return spark.read.format("geotiff").options(**options).load(folder)
