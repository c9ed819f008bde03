"""Quartile bucket digests of documents.

Six byte triplets of every window of five bytes are counted in 128 hashed buckets. The digest holds
a checksum, the length on a log scale, two ratios of the counts' quartiles, and for each bucket
which quartile its count lies in. Two digests differ by a bounded score, of which the likeness is
the complement. Edits move few buckets over a quartile, so near texts have near digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.shared import buffer_of, slices, small_batches, table

BUCKETS, WINDOW = 128, 5
#: Weights of a triplet's bytes, and the triplets as (offset, offset, salt) besides the window's last byte.
_WEIGHTS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_TRIPLETS = ((1, 2, 2), (1, 3, 3), (2, 3, 5), (2, 4, 7), (1, 4, 11), (3, 4, 13))
#: Difference at which the likeness is 0; steps of a quartile, two quartiles and three count 1, 2 and 6.
WORST = 300
_STEPS = np.array([0, 1, 2, 6])


def digests(texts: pa.Array) -> np.ndarray:
    """A row of bytes for each text: checksum, length code, quartile ratios, quartiles of the buckets, four a byte. Null is empty."""
    rows = [_digests(*buffer_of(texts.slice(a, b - a))) for a, b in slices(texts)]
    return np.concatenate(rows) if rows else np.zeros((0, 3 + BUCKETS // 4), np.uint8)


def _digests(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n, sizes = len(starts) - 1, np.diff(starts)
    doc = np.repeat(np.arange(n), sizes)
    weighted = [data.astype(np.uint32) * np.uint32(w) for w in _WEIGHTS]
    counts = np.zeros(n * BUCKETS, np.int64)
    if len(data) >= WINDOW:
        last = np.arange(WINDOW - 1, len(data))
        inside = doc[last] == doc[last - WINDOW + 1]
        base = doc[last] * BUCKETS
        for a, b, salt in _TRIPLETS:
            h = weighted[0][WINDOW - 1 :] + weighted[1][WINDOW - 1 - a : len(data) - a] + weighted[2][WINDOW - 1 - b : len(data) - b] + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount((base + (h >> np.uint32(25)))[inside], minlength=n * BUCKETS)
    counts = counts.reshape(n, BUCKETS)
    ranked = np.sort(counts, 1)
    q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    code = ((counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])).reshape(n, BUCKETS // 4, 4)
    body = code[:, :, 0] | code[:, :, 1] << 2 | code[:, :, 2] << 4 | code[:, :, 3] << 6
    ratio = lambda q: (q * 15 // np.maximum(q3, 1)).astype(np.uint8)
    total = np.concatenate(([0], np.cumsum(data.astype(np.int64))))
    checksum = ((total[starts[1:]] - total[starts[:-1]]) * 0x9E37 >> 4 & 255).astype(np.uint8)
    length = np.minimum(255, np.round(np.log2(sizes + 1.0) * 8)).astype(np.uint8)
    return np.concatenate([checksum[:, None], length[:, None], (ratio(q1) << 4 | ratio(q2))[:, None], body], 1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, down to 0 for a difference of WORST or more."""
    apart = (a[:, 0] != b[:, 0]).astype(np.int64) + 2 * np.abs(a[:, 1].astype(np.int64) - b[:, 1])
    for shift in (0, 4):
        apart += 2 * np.abs((a[:, 2] >> shift & 15).astype(np.int64) - (b[:, 2] >> shift & 15))
    for shift in (0, 2, 4, 6):
        apart += _STEPS[np.abs((a[:, 3:] >> shift & 3).astype(np.int8) - (b[:, 3:] >> shift & 3).astype(np.int8))].sum(1)
    return 1 - np.minimum(apart, WORST) / WORST


def hexed(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def with_next(docs: DataFrame, apply, schema: str) -> DataFrame:
    """apply(doc_ids, texts, next_texts) -> columns, over docs by ascending doc_id; the last document's next is the first.

    Null ids come first, rows of one id are ordered by text. Documents are dealt into ranges of
    doc_id; each range also gets the first document of the range that follows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    splits = docs.filter("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    splits = sorted({int(x) for x in splits})
    bounds = F.array(*[F.lit(x).cast("long") for x in splits]) if splits else F.array().cast("array<bigint>")
    docs = docs.withColumn("part", F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))), F.lit(0)))
    docs = docs.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("part")))
    # at most one row for each range
    heads = {r["part"]: None if r["nulls"] else r["least"] for r in docs.groupBy("part").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()}
    used = sorted(heads)
    size = max(used, default=0) + 1
    least, before = [None] * size, [0] * size
    for i, part in enumerate(used):
        least[part], before[part] = heads[part], used[i - 1]
    at = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("part"))
    first = docs.filter(F.col("doc_id").eqNullSafe(at(least)))
    rows = docs.withColumn("after", F.lit(0)).unionByName(first.withColumn("part", at(before).cast("int")).withColumn("after", F.lit(1)))
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "after", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()
            if not rows:
                continue
            rows = rows[0]
            for a, b in slices(rows["text"].slice(0, len(rows) - 1)):
                real = np.flatnonzero(rows["after"].slice(a, b - a).to_numpy() == 0) + a
                if len(real):
                    yield apply(rows["doc_id"].take(pa.array(real)), rows["text"].take(pa.array(real)), rows["text"].take(pa.array(real + 1)))
            held = rows.slice(len(rows) - 1)

    return rows.mapInArrow(run, schema)


def op5_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents and of their texts edited with the next one's. Null text is empty; a single document follows itself; order and ties: see with_next(). Long texts are hashed whole, other columns ignored, an empty table gives an empty result."""
    def compare(ids: pa.Array, texts: pa.Array, following: pa.Array) -> pa.RecordBatch:
        texts, nexts = [t or "" for t in texts.to_pylist()], [t or "" for t in following.to_pylist()]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts, strict=True)]
        own, changed, after = (digests(pa.array(x, pa.large_string())) for x in (texts, edited, nexts))
        columns = [
            ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(hexed(own), pa.string()), pa.array(hexed(changed), pa.string()), pa.array(likeness(own, changed)), pa.array(likeness(own, after)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(table(spark, sf_dir, "documents"), compare, schema)
