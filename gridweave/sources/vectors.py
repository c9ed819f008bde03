"""Polygon layers: Parquet with WKB, and GeoPackage files through SQLite."""

from __future__ import annotations

import shutil
import sqlite3
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from gridweave.sources.tables import store_of

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LAYER = T.StructType(
    [T.StructField("scene", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("variant", T.StringType()), T.StructField("rings", T.ArrayType(T.ArrayType(POINT)))]
    + [T.StructField("area_m2", T.DoubleType()), T.StructField("perimeter_m", T.DoubleType()), T.StructField("n_vertices", T.IntegerType()), T.StructField("raw_vertices", T.IntegerType()), T.StructField("orthogonality", T.DoubleType())]
)


def to_wkb(rings: list) -> bytes:
    """Little-endian WKB of a polygon; rings are closed on the way."""
    out = [struct.pack("<BII", 1, 3, len(rings))]
    for ring in rings:
        points = np.array([[p["x"], p["y"]] if not isinstance(p, (tuple, list, np.ndarray)) else p for p in ring], "<f8")
        points = np.concatenate([points, points[:1]])
        out += [struct.pack("<I", len(points)), points.tobytes()]
    return b"".join(out)


def wkb_of(rings: pa.ListArray) -> list[bytes | None]:
    """to_wkb() of a column of rings, from its flat arrays."""
    inner = rings.flatten()
    points = inner.flatten()
    xy = np.stack([points.field("x").to_numpy(zero_copy_only=False), points.field("y").to_numpy(zero_copy_only=False)], 1).astype("<f8")
    of_ring = np.concatenate([[0], np.cumsum(np.diff(inner.offsets.to_numpy()))]) if len(inner) else np.zeros(1, np.int64)
    out: list[bytes | None] = []
    at = 0
    for n in pc.list_value_length(rings).to_pylist():
        if n is None:
            out.append(None)
            continue
        parts = [struct.pack("<BII", 1, 3, n)]
        for k in range(at, at + n):
            ring = xy[of_ring[k] : of_ring[k + 1]]
            parts += [struct.pack("<I", len(ring) + 1 if len(ring) else 0), ring.tobytes(), ring[:1].tobytes()]
        out.append(b"".join(parts))
        at += n
    return out


def from_wkb(data: bytes) -> list[np.ndarray]:
    order = "<" if data[0] == 1 else ">"
    kind, n = struct.unpack_from(order + "II", data, 1)
    if kind != 3:
        raise ValueError(f"not a polygon: {kind}")
    rings, at = [], 9
    for _ in range(n):
        (m,) = struct.unpack_from(order + "I", data, at)
        rings.append(np.frombuffer(data, order + "f8", 2 * m, at + 4).reshape(m, 2)[:-1].astype(float))
        at += 4 + 16 * m
    return rings


def is_polygon(geometry: Column) -> Column:
    """Whether WKB, in either byte order, is there and a polygon."""
    kind = F.hex(F.substring(geometry, 1, 5))
    return F.coalesce(kind.isin("0103000000", "0000000003"), F.lit(False))


def write_layer(layer: DataFrame, path: str) -> None:
    """Parquet by scene, with the geometry as WKB next to the rings; null rings have none."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wkb_of(batch["rings"]), pa.binary())], [*names, "geometry"])

    names = layer.columns
    layer.mapInArrow(add, T.StructType([*layer.schema.fields, T.StructField("geometry", T.BinaryType())])).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene").parquet(path)


ATTRIBUTES = ("area_m2 REAL", "perimeter_m REAL", "n_vertices INTEGER", "raw_vertices INTEGER", "orthogonality REAL", "scene TEXT")


def write_geopackage(rows: Iterable[dict], path: str | Path, srid: int, layer: str = "buildings") -> None:
    """One layer in a GeoPackage file: the format's own tables, and geometries as WKB with its header. Rows are written as they come."""
    path = Path(path)
    path.unlink(missing_ok=True)
    db = sqlite3.connect(path)
    with db:
        db.execute("PRAGMA application_id = 1196444487")  # fixed value: "GPKG"
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT CURRENT_TIMESTAMP, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL)")
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srid}", srid, srid))
        db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom POLYGON, {", ".join(ATTRIBUTES)})')
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, srid))
        names = [a.split()[0] for a in ATTRIBUTES]
        low, high = np.full(2, np.inf), np.full(2, -np.inf)
        for r in rows:
            points = np.concatenate([np.array([[p["x"], p["y"]] if not isinstance(p, (tuple, list, np.ndarray)) else p for p in x], float) for x in r["rings"]])
            low, high = np.minimum(low, points.min(0)), np.maximum(high, points.max(0))
            blob = b"GP" + struct.pack("<BBi", 0, 1, srid) + to_wkb(r["rings"])
            db.execute(f'INSERT INTO "{layer}" (geom, {", ".join(names)}) VALUES ({", ".join("?" * (len(names) + 1))})', (blob, *(r.get(n) for n in names)))
        box = (*low, *high) if np.isfinite(low).all() else (0, 0, 0, 0)
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (layer, layer, *map(float, box), srid))
    db.close()


def read_geopackage(path: str | Path, layer: str = "buildings") -> list[dict] | None:
    """Rows of a layer with rings, or None if the file or layer is missing or broken."""
    if not Path(path).is_file():
        return None
    db = sqlite3.connect(path)
    try:
        found = db.execute(f'SELECT * FROM "{layer}" ORDER BY fid')
        names = [d[0] for d in found.description]
        out = []
        for values in found:
            row = dict(zip(names, values, strict=True))
            blob = row.pop("geom")
            sizes = (0, 32, 48, 48, 64)  # fixed values: bytes of the header's envelope by its kind
            row["rings"] = from_wkb(blob[8 + sizes[blob[3] >> 1 & 7] :])
            out.append(row)
        return out
    except sqlite3.DatabaseError:
        return None
    finally:
        db.close()


class Package(InputPartition):
    def __init__(self, path: str, scene: str):
        self.path, self.scene = path, scene


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task has left under a folder of its own."""

    folder: str
    names: list[str]


class PackageReader(DataSourceReader):
    """One partition a file; a file or layer that is missing or broken gives no rows."""

    def __init__(self, options: dict[str, str]):
        self.path, self.layer = options["path"], options.get("layer", "buildings")

    def partitions(self) -> list[Package]:
        store, folder = store_of(self.path)
        files = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [Package(f.path, f.base_name.removesuffix(".gpkg")) for f in sorted(files, key=lambda f: f.path) if f.base_name.endswith(".gpkg")]

    def read(self, partition: Package | None) -> Iterator[tuple]:
        if partition is None:  # there is no file
            return
        store, _ = store_of(self.path)
        with tempfile.NamedTemporaryFile(suffix=".gpkg") as own:  # SQLite needs a file of this machine
            with store.open_input_stream(partition.path) as source:
                shutil.copyfileobj(source, own)
            own.flush()
            for k, row in enumerate(read_geopackage(own.name, self.layer) or []):
                rings = [[(float(x), float(y)) for x, y in r] for r in row["rings"]]
                yield (row["scene"] or partition.scene, k, None, rings, *(row[c] for c in LAYER.fieldNames()[4:]))


class PackageWriter(DataSourceWriter):
    """A file a scene, written by the task that has its rows, which must follow each other; files appear when all tasks are done."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.srid, self.layer = options["path"], int(options["srid"]), options.get("layer", "buildings")
        self.job = f"_staged-{uuid.uuid4().hex}"
        self.names = schema.fieldNames()

    def write(self, rows: Iterator[Row]) -> Staged:
        store, folder = store_of(self.path)
        task, names = f"{folder}/{self.job}/{uuid.uuid4().hex}", []
        for scene, own in groupby((dict(zip(self.names, r, strict=True)) for r in rows), key=lambda r: r["scene"]):
            with tempfile.TemporaryDirectory() as here:
                write_geopackage((r for r in own if r["rings"]), f"{here}/one.gpkg", self.srid, self.layer)
                store.create_dir(task)
                with open(f"{here}/one.gpkg", "rb") as source, store.open_output_stream(f"{task}/{scene}.gpkg") as out:
                    shutil.copyfileobj(source, out)
            names.append(f"{scene}.gpkg")
        return Staged(task, names)

    def commit(self, messages: list[Staged | None]) -> None:
        store, folder = store_of(self.path)
        for m in messages:
            for name in m.names if m else []:
                store.move(f"{m.folder}/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        store, folder = store_of(self.path)
        if store.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.job}")


class PackageSource(DataSource):
    """format("geopackage"): option path (a folder of files named by scene), layer, and srid for writing."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> T.StructType:
        return LAYER

    def reader(self, schema: T.StructType) -> PackageReader:
        return PackageReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> PackageWriter:
        return PackageWriter(self.options, schema)


def write_packages(layer: DataFrame, folder: str, srid: int, name: str = "buildings") -> None:
    """A GeoPackage file a scene in a folder, each written where its scene's rows are; scenes that are written again replace their files. A scene's rows are one task's, streamed."""
    layer.sparkSession.dataSource.register(PackageSource)
    rows = layer.select(*LAYER.fieldNames()).repartition("scene").sortWithinPartitions("scene", "seq")
    rows.write.format("geopackage").mode("append").options(srid=str(srid), layer=name).save(folder)


def read_packages(spark: SparkSession, folder: str, name: str = "buildings") -> DataFrame:
    """LAYER of all GeoPackage files of a folder, a task a file."""
    spark.dataSource.register(PackageSource)
    return spark.read.format("geopackage").option("layer", name).load(folder)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Scenes (ord, scene, city, image_path, gt_path); ord counts rows from 0 by file name, then in file order.

    A manifest lists scenes, so numbering it in one task is bounded by their number.
    """
    fields = ["scene", "city", "image_path", "gt_path"]
    rows = spark.read.schema(", ".join(f"{f} string" for f in fields)).option("header", True).csv(path)
    place = rows.select(*fields, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    return place.select((F.row_number().over(Window.orderBy("file", "block", "nth")) - 1).alias("ord"), *fields)


def there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A CSV result with a header, or None where there is none; nulls are empty."""
    return spark.read.schema(schema).option("header", True).csv(path) if there(spark, path) else None


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file; nulls are empty."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
