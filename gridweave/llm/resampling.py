"""Importance resampling towards a target distribution, over hashed features.

A corpus becomes a sparse matrix of documents by buckets, kept as a table of CSR blocks: one row
of the table holds some documents' ids, their row pointers, and the buckets and counts of all of
them. Column sums over the blocks are the corpus' distribution; the log ratio of the target's to
the corpus' is each bucket's gain; the product of the matrix with the gains is each document's
weight. Documents are then drawn without replacement: a Gumbel variate, derived from the id, is
added to the weight, and the highest sums win.

Only a block and the gains, one number a bucket, are ever in a task. The draw finds its threshold
in a histogram of whole scores and numbers each score's documents by themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm.shared import buffer_of, dropped, lowered, slices, small_batches, table, written

BUCKETS, MOST_WORDS_OF_A_FEATURE = 10_000, 2
#: Words that a document needs to be drawn, the percentage drawn, and the seed of the draw.
LEAST_WORDS, PERCENT, SEED = 20, 25, "7"
#: Words longer than this take their checksum from zlib one by one, others all together.
LONG_WORD = 64
#: Blocks of a file: what a task holds of the matrix when it writes or reads it, however large its part of the input is.
FILE_BLOCKS = 32
BLOCK = "doc_ids array<long>, n_words array<long>, row_pointers array<int>, buckets array<int>, counts array<int>"


def _crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32 polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True  # digits, a-z, and all bytes of what is beyond ASCII


def crc_over(state: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 registers state after the spans of data that start at first, all spans in lockstep by byte."""
    order = np.argsort(-size, kind="stable")
    first, size, out = first[order], size[order], state[order]
    alive = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # spans longer than 0, 1, 2, ... bytes
    for i, n in enumerate(alive[:LONG_WORD]):
        out[:n] = _CRC[(out[:n] ^ data[first[:n] + i]) & 0xFF] ^ (out[:n] >> 8)
    for j in range(int(alive[LONG_WORD]) if len(alive) > LONG_WORD else 0):
        rest = data[first[j] + LONG_WORD : first[j] + size[j]].tobytes()
        out[j] = zlib.crc32(rest, int(out[j]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def features_of(texts: pa.Array, most: int = MOST_WORDS_OF_A_FEATURE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of every run of 1 to most words, the document each is of, and the number of words of each document.

    A-Z are lower-cased first. Words are runs of digits, a-z and characters beyond ASCII; the words
    of a run are joined by one space. Null is empty.
    """
    data, starts = buffer_of(texts)
    data = lowered(data)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    bounds = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(data))]
    cut = bounds[inside[bounds] & inside[bounds + 1]]  # a word can't reach into the next document
    begins[cut] = ends[cut] = True
    first, size = np.flatnonzero(begins), np.flatnonzero(ends)
    size = size - first
    doc = np.searchsorted(starts, first, "right") - 1
    state = crc_over(np.full(len(first), 0xFFFFFFFF, np.uint32), data, first, size)
    hashes, of = [state ^ np.uint32(0xFFFFFFFF)], [doc]
    for n in range(1, most):
        same = np.flatnonzero(doc[n:] == doc[:-n]) if len(doc) > n else np.zeros(0, np.int64)
        spaced = _CRC[(state[same] ^ 32) & 0xFF] ^ (state[same] >> 8)
        longer = crc_over(spaced, data, first[same + n], size[same + n])
        hashes.append(longer ^ np.uint32(0xFFFFFFFF))
        of.append(doc[same])
        state = np.zeros(len(first), np.uint32)
        state[same] = longer
    return np.concatenate(hashes), np.concatenate(of), np.bincount(doc, minlength=len(texts))


def csr_block(texts: pa.Array, buckets: int, most: int = MOST_WORDS_OF_A_FEATURE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row pointers, buckets and counts of the texts' matrix, and the words of each text."""
    hashes, of, words = features_of(texts, most)
    cells, counts = np.unique(of * np.int64(buckets) + hashes % np.uint32(buckets), return_counts=True)
    pointers = np.searchsorted(cells, np.arange(len(texts) + 1, dtype=np.int64) * buckets)
    return pointers, cells % buckets, counts, words


def csr_blocks(docs: DataFrame, buckets: int = BUCKETS, most: int = MOST_WORDS_OF_A_FEATURE) -> DataFrame:
    """The matrix of docs (doc_id, text) as a written table of CSR blocks: each row has some documents' ids, their words,
    row_pointers (one more than documents), and the buckets and counts of all of them.

    A block has about SLICE_BYTES of text; a longer document is a block of its own. A text without words is an empty
    row of the matrix. No documents: no blocks.
    """
    small_batches(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                pointers, which, counts, words = csr_block(batch["text"].slice(a, b - a), buckets, most)
                row = [batch["doc_id"].slice(a, b - a), *map(pa.array, (words, pointers.astype(np.int32), which.astype(np.int32), counts.astype(np.int32)))]
                columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in row]
                yield pa.RecordBatch.from_arrays(columns, ["doc_ids", "n_words", "row_pointers", "buckets", "counts"])

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, BLOCK), most_rows=FILE_BLOCKS)


def column_sums(blocks: DataFrame) -> DataFrame:
    """(bucket, n) of every bucket that occurs: each task adds up its blocks first, so a task sends at most one row a bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            which, counts = batch["buckets"].flatten().to_numpy(), batch["counts"].flatten().to_numpy()
            part = np.zeros(max(len(total), int(which.max(initial=-1)) + 1), np.int64)
            np.add.at(part, which, counts)
            part[: len(total)] += total
            total = part
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["bucket", "n"])

    return blocks.select("buckets", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln ratio) of the target's to the raw share of each bucket, one added to every count, from two tables of column_sums().

    It comes to the driver: one number a bucket, however large the corpus.
    """
    both = raw.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for row in both.collect():
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    all_s, all_t = int(s.sum()), int(t.sum())
    ratio = (t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def times(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the matrix' product with the gains, divided by the row's sum of counts, rounded down; 0 for an empty row."""
    shared = blocks.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words, pointers, which, counts = (batch[c].slice(i, 1).flatten().to_numpy() for c in ("n_words", "row_pointers", "buckets", "counts"))
                ends = lambda x: np.concatenate([np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)])[pointers]  # noqa: B023, E731
                features, sums = np.diff(ends(counts)), np.diff(ends(shared.value[which] * counts))
                yield pa.RecordBatch.from_arrays([batch["doc_ids"].slice(i, 1).flatten(), pa.array(words), pa.array(features), pa.array(sums // np.maximum(features, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(multiply, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: F.Column, seed: str = SEED) -> F.Column:
    """floor(-1000 ln(-ln u)) with u from the sha256 of seed:doc_id; a null id has an empty name."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def drawn(scored: DataFrame, able: F.Column, percent: int = PERCENT) -> DataFrame:
    """scored (doc_id, score, ...) with rank: 1, 2, 3, ... by score, ties by doc_id, null last, of floor(percent / 100) of the rows that are able; null for all others.

    A histogram of the whole scores tells which score is the last to be drawn and how many rows lie above each score.
    Rows of one score, a small part of all because of the variate in it, are numbered by themselves.
    """
    per = scored.filter(able).groupBy("score").agg(F.count("*").alias("here"))
    every = Window.orderBy(F.col("score").desc())  # as many rows as whole scores: bounded by the gains' range, not by the corpus
    per = per.withColumn("above", F.sum("here").over(every.rowsBetween(Window.unboundedPreceding, -1))).withColumn("all", F.sum("here").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    per = per.select("score", F.coalesce("above", F.lit(0)).alias("above"), F.floor(F.col("all") * percent / 100).alias("most")).filter("above < most")
    out = scored.withColumn("able", able).join(F.broadcast(per), "score", "left").withColumn("in", F.col("able") & F.col("most").isNotNull())
    rank = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "uid"))
    first = out.filter("in").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("most"), F.col("rank")))
    return first.unionByName(out.filter(~F.col("in")).withColumn("rank", F.lit(None).cast("long"))).drop("above", "most", "able", "in")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs (doc_id, text), drawn towards the texts of target (text).

    Null and empty texts have no features and weight 0, and like all with fewer than least_words words are never drawn.
    Repeated rows are rows of their own, with equal scores and following ranks; null ids share one variate and rank last
    among equal scores. Long texts are counted whole. An empty docs gives an empty result; an empty target gives gains
    against one count a bucket. Other columns are ignored.
    """
    raw = csr_blocks(docs, buckets)
    wanted = csr_blocks(target.select(F.lit(None).alias("doc_id"), "text"), buckets)
    weighed = times(raw, gains(column_sums(raw), column_sums(wanted), buckets))
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("uid", F.monotonically_increasing_id()))
    dropped(raw)
    dropped(wanted)
    return drawn(scored, F.col("n_words") >= least_words, percent).select("doc_id", "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weights towards the benchmark's texts and the ranks of the quarter drawn. See resample() for every edge case."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


#: The features' CRC-32 is taken byte by byte over the distinct features.
OP12_SQL = r"""
with polynomial as (
  select list_transform(range(256), lambda x: list_reduce([x::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc
), texts as (
  select row_number() over () as r, doc_id, text, 0 as kind from documents union all select row_number() over (), null, text, 1 from benchmark
), worded as (
  select r, doc_id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts
), features as (
  select r, kind, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as feature from worded
), per as (
  select r, kind, feature, count(*) as n from features group by all
), hexed as (
  select feature, hex(encode(feature)) as h from (select distinct feature from per)
), hashed as (
  select feature, xor(list_reduce([4294967295::bigint] || list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from hexed, polynomial
), counted as (
  select r, kind, bucket, sum(n)::bigint as n from per join hashed using (feature) group by all
), totals as (
  select bucket, sum(n) filter (kind = 0) as s, sum(n) filter (kind = 1) as t from counted group by bucket
), sums as (
  select coalesce(sum(s), 0)::double as ss, coalesce(sum(t), 0)::double as tt from totals
), gained as (
  select bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * (ss + 10000) / ((coalesce(s, 0)::double + 1) * (tt + 10000))))::bigint as gain from totals, sums
), weighed as (
  select r, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n)::double)::bigint as weight from counted join gained using (bucket) where kind = 0 group by r
), scored as (
  select w.r, w.doc_id, len(w.w) as words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('7:' || w.doc_id)[1:8])::bigint::double + 0.5) / 4294967296)))::bigint as score
  from worded w left join weighed using (r) where kind = 0
), ranked as (
  select r, row_number() over (order by score desc, doc_id) as nth from scored where words >= 20
)
select doc_id, n_features, weight, score, case when nth <= (select count(*) * 25 // 100 from ranked) then nth end::bigint as rank from scored left join ranked using (r)
"""
