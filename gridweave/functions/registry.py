"""SQL names for the engine's functions: register(spark) makes them known to spark.sql."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from gridweave.operators.kernels import polygons
from gridweave.sources.vectors import from_wkb, to_wkb

RINGS = "array<array<struct<x:double,y:double>>>"


def _rings(value) -> list[np.ndarray] | None:
    return None if value is None else [np.array([[p["x"], p["y"]] for p in ring], float).reshape(-1, 2) for ring in value]


def _structs(rings: list[np.ndarray] | None):
    return None if rings is None else [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]


def register(spark: SparkSession) -> None:
    """gw_area, gw_length, gw_iou, gw_intersection, gw_displacement, gw_orthogonality, gw_simplify, gw_regularize,
    gw_to_wkb, gw_from_wkb over rings, and the table functions gw_window_starts and gw_block_cells. Null gives null."""

    def scalar(name: str, kind: str, f) -> None:
        one = lambda *values: None if any(v is None for v in values) else f(*values)

        if f.__code__.co_argcount == 1:

            @pandas_udf(kind)
            def call(a: pd.Series) -> pd.Series:
                return pd.Series([one(x) for x in a], dtype=object)

        else:

            @pandas_udf(kind)
            def call(a: pd.Series, b: pd.Series) -> pd.Series:
                return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

        spark.udf.register(name, call)

    scalar("gw_area", "double", lambda a: polygons.area(_rings(a)))
    scalar("gw_length", "double", lambda a: polygons.length(_rings(a)))
    scalar("gw_iou", "double", lambda a, b: polygons.iou([_rings(a)], [_rings(b)]))
    scalar("gw_intersection", "double", lambda a, b: polygons.overlay([_rings(a)], [_rings(b)])[2])
    scalar("gw_displacement", "double", lambda a, b: polygons.displacement(_rings(a)[0], _rings(b)[0]))
    scalar("gw_orthogonality", "double", lambda a: polygons.orthogonality(_rings(a)[0]))
    scalar("gw_simplify", RINGS, lambda a, tolerance: _structs(polygons.simplified(_rings(a), float(tolerance))))
    scalar("gw_regularize", RINGS, lambda a: _structs(polygons.regularised(_rings(a))))
    scalar("gw_to_wkb", "binary", lambda a: to_wkb(_rings(a)))
    scalar("gw_from_wkb", RINGS, lambda a: _structs(from_wkb(bytes(a))))

    @udtf(returnType="start: int")
    class WindowStarts:
        def eval(self, total: int, tile: int, stride: int) -> Iterator[tuple[int]]:
            from gridweave.operators.scoring import starts

            for s in starts(total, tile, stride):
                yield (s,)

    @udtf(returnType="row: int, col: int, value: int")
    class BlockCells:
        def eval(self, row0: int, col0: int, w: int, band: bytes) -> Iterator[tuple[int, int, int]]:
            for i, v in enumerate(bytes(band)):
                yield row0 + i // w, col0 + i % w, v

    spark.udtf.register("gw_window_starts", WindowStarts)
    spark.udtf.register("gw_block_cells", BlockCells)
