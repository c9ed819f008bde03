"""Best-fit packing of token sequences by patterns.

The lengths' histogram, at most max_len numbers, is all that the planner sees. It enumerates
patterns of two and three lengths that fill a sequence, fits how often to repeat each by
non-negative least squares, rounds down, and packs what is left best fit, longest first, whole
groups of equal sequences at a time. The plan then says which sequence and offset the r-th piece
of each length gets, so the pieces themselves only need their rank within a length.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm.shared import small_batches, table, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Encoder:
    """Ids of a text as little-endian 32-bit bytes.

    ranks_path has the tokenizer's own vocabulary as merge ranks, which give the same ids faster;
    a text with a special token's string, and any text without ranks_path, goes to the tokenizer itself.
    """

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            # fixed value: the public byte-level pre-tokenizer pattern
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.ranks and "<|" not in text:
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, max_len: int = 1024, end_id: int = 2) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32.

    Null text is empty and gives the end id alone. Only a document of more than max_len ids is
    cut; its first piece takes the remainder, all others have max_len ids. Both paths are found on
    the executors, by default among the public tokenizers.
    """
    small_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = _Encoder(tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path if tokenizer_path else public_tokenizers.path("byte_bpe_50k.tiktoken"))
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encoder(text.as_py() or "") + end
                n = len(ids) // 4
                count = -(-n // max_len)
                at = 0
                for piece in range(count):
                    to = n - (count - 1 - piece) * max_len
                    rows.append((doc_id, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at = to
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def patterns(present: np.ndarray, max_len: int) -> np.ndarray:
    """Rows of three lengths, descending, 0 for none, that add up to max_len and all occur."""
    at = np.flatnonzero(present)
    at = at[at > 0]
    out = [np.array([[max_len, 0, 0]])] if present[max_len] else []
    for c in [0, *at]:
        b = at[(at >= max(c, 1)) & (2 * at <= max_len - c)]
        a = max_len - c - b
        keep = (a >= b) & (a < max_len) & present[np.minimum(a, max_len)]
        out.append(np.stack([a[keep], b[keep], np.full(keep.sum(), c)], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def fit(shapes: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts x with least |A x - counts|, A the lengths of each pattern: accelerated projected gradient.

    Rows are weighted by length, since a long piece that no pattern takes costs more than a short one.
    """
    n, width = len(counts), shapes.shape[1]
    flat, weight = shapes.ravel(), shapes.ravel() / (n - 1)
    counts = counts * np.arange(n) / (n - 1)

    def up(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, width) * weight, n)

    def down(r: np.ndarray) -> np.ndarray:
        return (r[flat] * weight).reshape(-1, width).sum(1)

    v = np.ones(len(shapes))
    for _ in range(20):
        v = down(up(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.02 * norm)
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * down(up(y) - counts))
        t, was = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (was - 1) / t * (new - x)
        x = new
    return x


def plan(counts: np.ndarray, max_len: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Sequences as (((length, how many), ...), repeats); uses up counts[length] exactly."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def take(shape: np.ndarray, most: int) -> None:
        parts = defaultdict(int)
        for length in shape:
            if length:
                parts[int(length)] += 1
        n = min([most, *(left[length] // m for length, m in parts.items())])
        if n > 0:
            for length, m in parts.items():
                left[length] -= n * m
            out.append((tuple(parts.items()), int(n)))

    shapes = patterns(left > 0, max_len)
    if len(shapes):
        x = fit(shapes, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1:
                break
            take(shapes[i], int(x[i]))
    free: list[list[tuple[tuple, int]]] = [[] for _ in range(max_len + 1)]  # groups of equal sequences by room left
    some = np.zeros(max_len + 1, bool)
    for length in range(max_len, 0, -1):
        c = int(left[length])
        while c:
            room = length + int(np.argmax(some[length:])) if some[length:].any() else 0
            if room:
                parts, n = free[room].pop()
                k = min(c, n)
                if n > k:
                    free[room].append((parts, n - k))
                some[room] = bool(free[room])
                q = min(room // length, -(-c // k)) if k == n else 1
                q = min(q, c // k)
                placed = (*parts, (length, q))
                free[room - q * length].append((placed, k))
                some[room - q * length] = True
                c -= k * q
            else:
                q = max_len // length
                for per, n in ((q, c // q), (c % q, 1)):
                    if per and n:
                        free[max_len - per * length].append((((length, per),), n))
                        some[max_len - per * length] = True
                c = 0
    return out + [group for groups in free for group in groups]


def _ranges(sequences: list, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys length << 40 | rank of the first slot, and for each: first rank, first sequence, slots a sequence, offset."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for parts, n in sequences:
        offset = 0
        for length, m in parts:
            rows.append((length << 40 | used[length], used[length], base, m, offset))
            used[length] += n * m
            offset += length * m
        base += n
    rows.sort()
    found = np.array(rows, np.int64).reshape(-1, 5)
    return found[:, 0].copy(), found[:, 1:].copy()


def pack(pieces: DataFrame, max_len: int = 1024) -> DataFrame:
    """pieces (PIECES) with sequence_id and offset; no sequence has more than max_len tokens or a gap.

    An empty table gives an empty result; repeated rows are pieces of their own. The plan has at
    most a row for each enumerated pattern and each length, whatever the number of pieces.
    """
    pieces = written(pieces)
    counts = np.zeros(max_len + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most max_len rows
        counts[length] = n
    keys, ranges = _ranges(plan(counts, max_len), max_len)
    buckets = max(1, math.isqrt(int(counts.sum())))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    totals = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("nth", F.row_number().over(inside) - 1).join(totals, ["length", "bucket"])
    rows = rows.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            first, base, each, offset = ranges[np.searchsorted(keys, length << 40 | rank, "right") - 1].T if len(batch) else np.zeros((4, 0), np.int64)
            at = rank - first
            each = np.maximum(each, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(base + at // each), pa.array(offset + at % each * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return rows.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces with their place in sequences. See token_pieces() and pack() for every edge case; long texts are encoded whole, null ids are documents like others, other columns are ignored."""
    return pack(token_pieces(table(spark, sf_dir, "documents")))
