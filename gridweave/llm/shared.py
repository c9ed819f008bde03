"""Pieces the training-data operators share: materialised tables, and vectorised text hashing.

Text is handled as one UTF-8 byte buffer for a whole Arrow batch, so that a kernel runs once
for thousands of documents instead of once for each.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space (Java, RE2 and Python agree on it).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a kernel takes at a time; longer documents are taken whole.
SLICE_BYTES = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set, one of this machine, but never on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridweave-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Spark then removes the shuffle files of a query when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def written(df: DataFrame, partitions: int | None = None, most_rows: int | None = None) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, so lost executors lose nothing.

    Parquet is written by row groups and read by batches of thousands of rows; most_rows, of a file, bounds both where rows are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridweave-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        out = (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd")
        (out.option("maxRecordsPerFile", most_rows) if most_rows else out).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridweave_path = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_gridweave_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes all tables that written() made inside it at its end, but those that its value was called with."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    before = _made.set(made)
    try:
        yield lambda df: (kept.append(df), df)[1]
    finally:
        _made.reset(before)
        dropped(*[df for df in made if not any(df is k for k in kept)])


def word_count(text) -> F.Column:
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, and where each value starts (one more than values); null is empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        offset_type = np.int64
    elif pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        offset_type = np.int32
    else:
        raise TypeError(f"not text: {texts.type}")
    if texts.null_count:
        texts = texts.fill_null("" if "string" in str(texts.type) else b"")
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, offset_type)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]] if len(starts) else data[:0], starts - (starts[0] if len(starts) else 0)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about that many bytes; a longer text is a range of its own."""
    _, starts = buffer_of(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
        yield at, min(to, len(texts))
        at = min(to, len(texts))


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's multiplier and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        out = []
        for base in (_MULT, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = tuple(out)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes; span_hash() takes the hash of any span from them."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MULT
    return h ^ (h >> np.uint64(32))


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans start..stop (positions in the buffer), equal for equal bytes."""
    _, down = powers(len(sums))
    return mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * _MIX)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of each word of the buffer, and the index of its document."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    bounds = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(data))]
    cut = bounds[inside[bounds] & inside[bounds + 1]]  # a word can't reach into the next document
    begins[cut] = True
    ends[cut] = True
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    return first, last, np.searchsorted(starts, first, "right") - 1


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by key; a table has about that many bytes, or one group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += batch.nbytes
        if size < least:
            continue
        rows = pa.Table.from_batches(held)
        keys = rows[key].to_numpy(zero_copy_only=False)
        cut = int(np.argmin(keys != keys[-1])) if keys[0] != keys[-1] else 0  # where the last group begins
        if cut:
            yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
        else:
            held = rows.to_batches()
        size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)
