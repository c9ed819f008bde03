"""Quality rules: a hashed n-gram log-likelihood ratio, and plain counts.

Runs of a few bytes of every text fall into a prime number of buckets. Two multinomials over the
buckets are counted, that of all documents and that of trusted ones, smoothed towards the former.
A document's score is the mean, over its n-grams, of the log ratio of the two. A document is kept if
its score reaches a threshold, the same for all: the one that nearly all of those trusted documents
reach that weren't counted.

The corpus is counted one row a bucket and task; gains and thresholds, one number a bucket and one in
all, are what tasks share. All trusted documents are counted or set the threshold; texts and trusted
ids meet by one exchange, hashed, not sorted, so texts aren't held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.shared import buffer_of, dropped, mixed, slices, small_batches, span_hash, prefix_sums, table, words_of, written

#: Bytes of an n-gram, and buckets: a prime, so that a bucket is the n-gram's value modulo it.
GRAM, BUCKETS = 5, 65_521
#: Gains and scores are whole numbers of this part of a nat.
UNIT = 1_000_000
#: Scores, in units, that the first of the two histograms which find the threshold takes together.
TOGETHER = 1000
#: One in so many trusted documents isn't counted but sets the threshold, which all but this share of them reach.
SET_ASIDE, LOST = 4, 0.01
#: Plain rules: a document fails with fewer words, or with more of them, in percent, in repeated windows of so many.
LEAST_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def grams(data: np.ndarray, starts: np.ndarray, gram: int = GRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every run of gram bytes of the buffer that lies in one document, and its document."""
    if len(data) < gram:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(data) - gram + 1
    value = np.zeros(n, np.int64)
    for i in range(gram):
        value = value << 8 | data[i : n + i]
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = doc[:n] == doc[gram - 1 :]
    return (value % buckets)[inside], doc[:n][inside]


def counted(docs: DataFrame, gram: int = GRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, trusted): n-grams of all docs (text, trusted boolean) and of the trusted ones; each task adds up its own first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch["trusted"].to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(batch["text"]):
                bucket, doc = grams(*buffer_of(batch["text"].slice(a, b - a)), gram, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                trusted += np.bincount(bucket[good[a:b][doc]], minlength=buckets)
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(raw[full]), pa.array(trusted[full])], ["bucket", "raw", "trusted"])

    small_batches(docs.sparkSession)
    parts = docs.select("text", "trusted").mapInArrow(add, "bucket int, raw long, trusted long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def gains(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(UNIT ln(p / q)) of each bucket, from counted(): q is the raw share with one added to each count, p the trusted share with buckets * q added.

    One number a bucket comes to the driver, however large the corpus.
    """
    raw, trusted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    got = counts.toArrow()
    raw[got["bucket"].to_numpy()], trusted[got["bucket"].to_numpy()] = got["raw"].to_numpy(), got["trusted"].to_numpy()
    all_raw, all_trusted = int(raw.sum()), int(trusted.sum())
    return np.floor(UNIT * np.log((trusted * (all_raw + buckets) / (raw + 1.0) + buckets) / (all_trusted + buckets))).astype(np.int64)


def measures(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document of a buffer."""
    n = len(starts) - 1
    first, last, doc = words_of(data, starts)
    sums = prefix_sums(data)
    upto = lambda flags: np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
    points, symbols = upto((data & 0xC0) != 0x80), upto(_SYMBOL[data])
    out = {"n_words": np.bincount(doc, minlength=n), "n_symbols": symbols[starts[1:]] - symbols[starts[:-1]]}
    chars = upto(points[last] - points[first])
    place = np.searchsorted(doc, np.arange(n + 1))
    out["word_chars"] = chars[place[1:]] - chars[place[:-1]]
    # lines: between line ends and document bounds
    cuts = np.unique(np.concatenate([starts, np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1]))
    a, b = cuts[:-1], cuts[1:]
    full = np.searchsorted(first, b) > np.searchsorted(first, a)  # with a word; a line end alone has none
    a, b = a[full], b[full]
    of = np.searchsorted(starts, a, "right") - 1
    out["n_dup_lines"] = np.bincount(of, minlength=n) - np.bincount(_distinct(of, span_hash(sums, a, b)), minlength=n)
    # windows of words: in which two or more of a document are equal
    hashes = span_hash(sums, first, last)
    ends = np.flatnonzero(doc[WINDOW - 1 :] == doc[: len(doc) - WINDOW + 1]) if len(doc) >= WINDOW else np.zeros(0, np.int64)
    window = np.zeros(len(ends), np.uint64)
    for i in range(WINDOW):
        window = mixed(window + hashes[ends + i])
    order = np.lexsort((window, doc[ends]))
    same = (window[order][1:] == window[order][:-1]) & (doc[ends][order][1:] == doc[ends][order][:-1])
    again = np.zeros(len(ends), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(doc) + 1, np.int64)
    np.add.at(covered, ends[again], 1)
    np.add.at(covered, ends[again] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(covered)[:-1] > 0], minlength=n)
    return out


def _distinct(of: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The documents of the distinct pairs (of, key)."""
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    head = np.ones(len(of), bool)
    head[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
    return of[head]


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored(docs: DataFrame, gain: np.ndarray, gram: int = GRAM) -> DataFrame:
    """doc_id, COLUMNS and score of docs (doc_id, text): the mean gain of the text's n-grams, rounded down; 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                data, starts = buffer_of(batch["text"].slice(a, b - a))
                bucket, doc = grams(data, starts, gram, len(shared.value))
                sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(shared.value[bucket])])
                place = np.searchsorted(doc, np.arange(b - a + 1))
                found = measures(data, starts) | {"score": (sums[place[1:]] - sums[place[:-1]]) // np.maximum(np.diff(place), 1)}
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), *(pa.array(found[c]) for c in (*COLUMNS, "score"))], ["doc_id", *COLUMNS, "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", score long")


def trusted_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """(id, aside) of the doc_ids that all their rows of labels (doc_id, quality, toxic) call good and not toxic; aside marks those that set the threshold.

    A caller that wants fewer names the most: if there are more, a part by hash of about so many.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit("trusted:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long")
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).filter("quality = 1 and coalesce(toxic, 0) = 0")
    good = good.select(F.col("doc_id").alias("id"), h.alias("h"))
    if most is not None and (n := good.count()) > most:
        good = good.filter(F.col("h") < (1 << 32) * most // n)
    return good.select("id", (F.col("h") % SET_ASIDE == 0).alias("aside"))


def _score_at(per: DataFrame, share: float) -> int | None:
    """The least score, of per (score, count), that all but that share of the counted reach; a histogram of TOGETHER scores a row tells where to look."""
    bin_ = F.floor(F.col("score") / TOGETHER)
    bins = per.groupBy(bin_.alias("bin")).agg(F.sum("count").alias("count")).orderBy("bin").toArrow()  # bounded by the gains' range, not by the corpus
    if not len(bins):
        return None
    n = np.cumsum(bins["count"].to_numpy())
    nth = int(n[-1] * share)
    at = int(np.searchsorted(n, nth, "right"))
    inside = per.filter(bin_ == int(bins["bin"][at].as_py())).orderBy("score").toArrow()  # TOGETHER rows at most
    before = int(n[at - 1]) if at else 0
    return int(inside["score"][int(np.searchsorted(before + np.cumsum(inside["count"].to_numpy()), nth, "right"))].as_py())


def judged(docs: DataFrame, labels: DataFrame, most: int | None = None, lost: float = LOST) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score, threshold of every row of docs (doc_id, text).

    kept is false if the plain rules fail, else whether score reaches threshold, which all but the share lost of the
    trusted documents set aside reach; without any, all with a score are kept. Null and empty texts have no words and
    fail; repeated rows are rows of their own with equal results; null ids are never trusted; long texts are taken
    whole; an empty table gives an empty result, empty labels keep whatever passes the plain rules. Other columns are ignored.
    """
    ids = written(trusted_ids(labels, most))
    # rows without an id, which match none, are dealt by their text
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("salt"))
    salted = ids.withColumn("zero", F.lit(0).cast("long"))
    marked = marked.join(salted.hint("shuffle_hash"), (F.col("doc_id") == F.col("id")) & (F.col("salt") == F.col("zero")), "left")
    gain = gains(counted(marked.select("text", F.coalesce(~F.col("aside"), F.lit(False)).alias("trusted"))))
    out = written(scored(docs, gain))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    aside = ids.filter("aside")
    per = written(out.filter(~failed).join(aside.hint("merge"), F.col("doc_id") == F.col("id")).groupBy("score").count())
    threshold = _score_at(per, lost)
    dropped(per)
    dropped(ids)
    reached = F.lit(True) if threshold is None else F.col("score") >= threshold
    return out.select("doc_id", *COLUMNS, "base_failed", (~F.col("base_failed") & reached).alias("kept"), "score", F.lit(threshold).cast("long").alias("threshold"))


def op11_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents, trusted ones by their labels. See judged() for every edge case."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with good as (
  select doc_id, ('0x' || md5('trusted:' || doc_id)[1:8])::bigint % 4 = 0 as aside
  from labels where doc_id is not null group by doc_id having min(quality) = 1 and coalesce(max(toxic), 0) = 0
), texts as (
  select row_number() over () as r, d.doc_id, coalesce(text, '') as text, coalesce(not aside, false) as trusted, coalesce(aside, false) as aside
  from documents d left join good using (doc_id)
), hexed as (
  select r, trusted, hex(encode(text)) as h from texts
), grams as (
  select r, trusted, unnest(list_transform(range(len(h) // 2 - 4), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 10])::bigint % 65521)) as bucket from hexed
), counted as (
  select r, trusted, bucket, count(*) as n from grams group by all
), totals as (
  select bucket, sum(n)::double as s, coalesce(sum(n) filter (trusted), 0)::double as t from counted group by bucket
), gained as (
  select bucket, floor(1000000 * ln((t * ((select sum(s) from totals) + 65521) / (s + 1) + 65521) / ((select sum(t) from totals) + 65521)))::bigint as gain from totals
), ratios as (
  select r, floor(sum(n * gain)::double / sum(n)::double)::bigint as score from counted join gained using (bucket) group by r
), worded as (
  select r, doc_id, aside, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from texts
), windows as (
  select r, unnest(list_transform(range(1, greatest(1, len(w) - 3)), lambda i: {'i': i, 'five': w[i : i + 4]}), recursive := true) from worded
), again as (
  select r, i from (select r, i, count(*) over (partition by r, five) as n from windows) where n > 1
), repeated as (
  select r, count(distinct i + j)::bigint as n from again, range(5) t(j) group by r
), measured as (
  select r, doc_id, aside, len(w) as n_words, len(list_aggregate(w, 'string_agg', '')) as word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, coalesce(score, 0) as score
  from worded left join repeated using (r) left join ratios using (r)
), failed as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from measured
), placed as (
  select score, row_number() over (order by score) - 1 as nth, count(*) over () as n from failed where aside and not base_failed
), limits as (
  select min(score) as threshold from placed where nth = floor(n * 0.01::double)
)
select doc_id, n_words::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (threshold is null or score >= threshold) as kept, score, threshold
from failed, limits
"""
