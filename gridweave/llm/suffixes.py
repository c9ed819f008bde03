"""Removal of long byte strings that occur twice, with run-length compressed Burrows-Wheeler indexes.

A string of LENGTH bytes (a window) is filed under its least-hashed gram of GRAM bytes, leftmost
first, so equal windows meet under one gram whatever stands around them. The windows of a text that
follow each other under one gram are a segment, and every window is in exactly one segment.

1. Grams that occur once are dropped: their windows can't repeat.
2. Equal segments are counted. Where a segment occurs twice, all its windows repeat.
3. What is left - segments of one occurrence under a gram with other segments - is cut into parts of
   WIDTH windows, filed under the core that all windows of a part have in common, and counted in the
   same way. That takes care of short common lines, whose grams are many but whose cores differ.
4. Of what is left then, the text is fetched and indexed, some hundred kilobytes at a time with all
   parts of their cores: the Burrows-Wheeler transform is cut into runs, and for both ends of each run the text position and
   its match with the neighbour in suffix order are sampled. From run end to run end the
   matching statistics of the text are streamed: a position's match is the last sample's less the
   distance to it. Windows whose match is LENGTH or more repeat.

Copies, however many, are therefore one segment with a count, and only grams, hashes and positions
are shuffled for text without near copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.llm.shared import buffer_of, dropped, prefix_sums, slices, small_batches, span_hash, table, whole_groups, written

LENGTH, GRAM = 200, 32
#: Windows of a part, at most a third of the length.
WIDTH = 43
#: Bytes of a text that are looked at at a time.
BLOCK = 1 << 22
_AT = np.uint64((1 << 24) - 1)
#: Names that no column of a caller has.
_UID, _MARKS = "gridweave uid", "gridweave marks"


def segments(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """doc, first window, number of windows, the gram's place after the first, gram hash and segment hash of all segments; positions in the buffer.

    The buffer is shorter than 2**24.
    """
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(sums, at, at + gram)
    least = (grams & ~_AT) | at.astype(np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: have - width], least[width - have :])
    doc = np.searchsorted(starts, np.arange(n), "right") - 1
    inside = np.arange(n) + length <= starts[doc + 1]
    windows = np.flatnonzero(inside)
    pick = (least[windows] & _AT).astype(np.int64)
    head = np.ones(len(windows), bool)
    head[1:] = (pick[1:] != pick[:-1]) | (windows[1:] != windows[:-1] + 1)
    heads = np.flatnonzero(head)
    first = windows[heads]
    count = np.diff(np.append(heads, len(windows)))
    return doc[first], first, count, pick[heads] - first, grams[pick[heads]], span_hash(sums, first, first + count - 1 + length)


def occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """uid, gram, seg, first, windows, at of all segments of docs (uid, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch["uid"].to_numpy()
            for lo, hi in slices(batch["text"]):
                data, starts = buffer_of(batch["text"].slice(lo, hi - lo))
                for begin in range(0, max(1, len(data) - length + 1), BLOCK):  # more than one block only for one long text
                    part = data[begin : begin + BLOCK + length - 1]
                    bounds = starts if len(data) < BLOCK + length else np.array([0, len(part)])
                    doc, first, count, place, g, seg = segments(part, bounds, length, gram)
                    first = first - bounds[doc] + begin
                    yield pa.RecordBatch.from_arrays([pa.array(uids[lo:hi][doc]), pa.array(g.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(first.astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(place.astype(np.int32))], ["uid", "gram", "seg", "first", "windows", "at"])
                    if len(data) < BLOCK + length:
                        break

    return docs.select("uid", "text").mapInArrow(cut, "uid long, gram long, seg long, first long, windows int, at int")


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of the strings that end at ends[i] (of the string of position i); ties by position. Prefix doubling."""
    n = len(data)
    at = np.arange(n)
    key = np.zeros(n, np.uint64)
    for j in range(7):
        there = at + j
        symbol = np.where(there < ends, data[np.minimum(there, n - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        key = (key << np.uint64(9)) | symbol
    order = np.argsort(key)
    ranked = key[order]
    head = np.ones(n, bool)
    head[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    deep, longest = 7, int((ends - at).max()) if n else 0
    while deep < longest:
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = np.flatnonzero(tied)  # only groups of equal prefixes are sorted again
        if not len(slots):
            break
        here = order[slots]
        there = here + deep
        after = np.where(there < ends[here], rank[np.minimum(there, n - 1)] + 1, 0)
        sub = np.argsort((rank[here] << 32) | after)
        here, pair = here[sub], ((rank[here] << 32) | after)[sub]
        order[slots] = here
        new = np.ones(len(slots), bool)
        new[1:] = pair[1:] != pair[:-1]
        head[slots] = new
        rank[here] = np.maximum.accumulate(np.where(new, slots, 0))
        deep *= 2
    return order[np.argsort((rank[order] << 32) | order)] if not head.all() else order


class RunIndex:
    """A run-length compressed Burrows-Wheeler transform of strings, with sampled run ends."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        n = len(data)
        self.n = n
        sizes = np.diff(bounds)
        ends = np.repeat(bounds[1:], sizes)
        opens = np.zeros(n, bool)
        opens[bounds[:-1][sizes > 0]] = True
        order = suffix_array(data, ends)
        bwt = np.where(opens[order], -1, data[order - 1].astype(np.int16))  # -1: a string begins, which is a run of its own
        cut = (bwt[1:] != bwt[:-1]) | (bwt[1:] < 0)
        self.runs = int(cut.sum()) + 1 if n else 0
        sums = prefix_sums(data)
        heads = np.flatnonzero(np.append(True, cut))
        tails = np.flatnonzero(np.append(cut, True))
        #: (positions, match with the neighbour in suffix order) at the first and the last row of each run
        self.samples = []
        for rows, step in ((heads, -1), (tails, 1)):
            here = order[rows]
            other = np.where((rows + step >= 0) & (rows + step < n), order[np.clip(rows + step, 0, max(n - 1, 0))], -1)
            self.samples.append((here, self._matches(sums, ends, here, other)))

    @staticmethod
    def _matches(sums: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        real = b >= 0
        b = np.where(real, b, a)
        high = np.minimum(ends[a] - a, ends[b] - b)
        high[~real] = 0
        low = np.zeros_like(high)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = span_hash(sums, a, a + mid) == span_hash(sums, b, b + mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def statistics(self) -> np.ndarray:
        """For each position the longest match with any other position, streamed from run end to run end."""
        out = np.zeros(self.n, np.int64)
        at = np.arange(self.n)
        for positions, match in self.samples:
            sampled = np.full(self.n, -1, np.int64)
            sampled[positions] = positions
            value = np.zeros(self.n, np.int64)
            value[positions] = match
            last = np.maximum.accumulate(sampled)  # each string's first position is sampled
            out = np.maximum(out, value[last] - (at - last))
        return out


def _indexed(length: int):
    """mapInArrow over (gram, uid, first, single, body) sorted by gram: repeated windows (uid, first, windows) of single segments."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "gram"):
            rows = rows.combine_chunks()
            data, bounds = buffer_of(rows["body"].chunk(0))
            match = RunIndex(data, bounds).statistics()
            single = rows["single"].to_numpy(zero_copy_only=False)
            hit = (match >= length) & np.repeat(single, np.diff(bounds))
            edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
            start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a segment's last windows reach no further than it, so no run of hits crosses into the next
            row = np.searchsorted(bounds, start, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(rows["uid"].to_numpy()[row]), pa.array(start - bounds[row] + rows["first"].to_numpy()[row]), pa.array((stop - start).astype(np.int32))], ["uid", "first", "windows"])

    return mark


def _parts(length: int, width: int):
    """mapInArrow over (uid, text, wanted): the parts (gram, seg, uid, first, windows, single) of each wanted segment, gram now for the core."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in slices(whole["text"]):
                batch = whole.slice(lo, hi - lo)
                data, starts = buffer_of(batch["text"])
                lists = batch["wanted"].flatten()
                row = np.repeat(np.arange(len(batch)), np.diff(batch["wanted"].offsets.to_numpy()))
                gram, first, windows, at = (lists.field(c).to_numpy() for c in ("gram", "first", "windows", "at"))
                single = lists.field("single").to_numpy(zero_copy_only=False)
                a = starts[row] + first
                p, b = a + at, a + windows - 1
                low = (p - b) // width
                n = (p - a) // width - low + 1
                of = np.repeat(np.arange(len(a)), n)
                block = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                core = p[of] - block * width  # the last window of the block begins here, and the first one reaches as far as this
                begin, end = np.maximum(a[of], core - width + 1), np.minimum(b[of], core)
                sums = prefix_sums(data)
                key = span_hash(sums, core, core - width + 1 + length) ^ (gram[of].view(np.uint64) + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                seg = span_hash(sums, begin, end + length) + (core - begin).astype(np.uint64)
                columns = [pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(batch["uid"].to_numpy()[row[of]]), pa.array(begin - starts[row[of]]), pa.array((end - begin + 1).astype(np.int32)), pa.array(single[of])]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "seg", "uid", "first", "windows", "single"])

    return cut


def _bodies(length: int):
    """mapInArrow over (uid, text, wanted): the bytes of each wanted segment."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = buffer_of(batch["text"])
            wanted = batch["wanted"]
            lists = wanted.flatten()
            row = np.repeat(np.arange(len(batch)), np.diff(wanted.offsets.to_numpy()))
            first, windows = lists.field("first").to_numpy(), lists.field("windows").to_numpy().astype(np.int64)
            a = starts[row] + first
            size = windows + length - 1
            stop = np.cumsum(size)
            at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(a - (stop - size), size)
            body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], stop)).astype(np.int32)), pa.py_buffer(data[at])])
            yield pa.RecordBatch.from_arrays([lists.field("gram"), pa.array(batch["uid"].to_numpy()[row]), lists.field("first"), lists.field("single"), body], ["gram", "uid", "first", "single", "body"])

    return fetch


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, into: str = "spans") -> DataFrame:
    """All columns of docs, and into (which replaces a column of that name): (start, stop) of the maximal byte runs that repeat, in order.

    A byte repeats if a string of length bytes that covers it also starts anywhere else in the
    UTF-8 bytes of any text, the same included; overlaps count, and no string crosses texts.
    Null texts are empty and have no spans, like texts shorter than length. Repeated rows are texts
    of their own, so they are covered whole. An empty table gives an empty result.
    """
    if length <= gram:
        raise ValueError("length must exceed gram")
    spark = docs.sparkSession
    small_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.drop(into).withColumn(_UID, F.xxhash64("doc_id", "text"))
    names = rows.columns[:-1]
    docs = rows.select("doc_id", "text", F.col(_UID).alias("uid"))
    every = occurrences(docs, length, gram)
    shared = written(every.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"))  # written: else the join can't split a hot gram
    # joins by sort and merge at every size: what is small here may not be at another scale, and hot keys are split
    found = written(every.join(shared.hint("merge"), "gram"))
    dropped(shared)
    kinds = found.groupBy("gram", "seg").agg(F.count("*").alias("n"), F.min(F.struct("uid", "first", "windows", "at")).alias("one"))
    kinds = written(kinds)
    # every table goes as soon as nothing reads it: texts are on disk twice at most, in an exchange and in a table
    whole = written(found.join(kinds.filter("n > 1").select("gram", "seg").hint("merge"), ["gram", "seg"]).select("uid", "first", "windows"))
    dropped(found)
    wanted = kinds.join(_open(kinds), "gram").select("one.uid", F.struct("gram", "one.first", "one.windows", "one.at", (F.col("n") == 1).alias("single")).alias("w"))
    texts = docs.select("uid", "text").join(wanted.groupBy("uid").agg(F.collect_list("w").alias("wanted")).hint("merge"), "uid")
    texts = written(texts)
    dropped(kinds)
    parts = written(texts.mapInArrow(_parts(length, min(WIDTH, length // 3)), "gram long, seg long, uid long, first long, windows int, single boolean"))
    kinds = written(parts.groupBy("gram", "seg").agg(F.count("*").alias("n"), F.max("single").alias("single"), F.min(F.struct("uid", "first", "windows")).alias("one")))
    again = written(parts.filter("single").join(kinds.filter("n > 1").select("gram", "seg").hint("merge"), ["gram", "seg"]).select("uid", "first", "windows"))
    dropped(parts)
    alone = (F.col("n") == 1) & F.col("single")
    left = kinds.join(_open(kinds.withColumn("n", F.when(alone, 1).otherwise(2))), "gram")
    left = left.select("one.uid", F.struct("gram", "one.first", "one.windows", alone.alias("single")).alias("w")).groupBy("uid").agg(F.collect_list("w").alias("wanted"))
    bodies = texts.select("uid", "text").join(left.hint("merge"), "uid").mapInArrow(_bodies(length), "gram long, uid long, first long, single boolean, body binary")
    indexed = bodies.repartition(partitions, "gram").sortWithinPartitions("gram").mapInArrow(_indexed(length), "uid long, first long, windows int")
    indexed = written(indexed)
    dropped(texts, kinds)
    marks = written(whole.unionByName(again).unionByName(indexed).groupBy("uid").agg(F.collect_set(F.struct("first", "windows")).alias("marks")))
    dropped(whole, again, indexed)
    joined = rows.join(marks.select(F.col("uid").alias(_UID), F.col("marks").alias(_MARKS)).hint("merge"), _UID, "left").select(*names, _MARKS)
    return joined.mapInArrow(_merged(length, names, into), T.StructType([*rows.schema.fields[:-1], T.StructField(into, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))]))


def _open(kinds: DataFrame) -> DataFrame:
    """Grams with several segments of which one occurs once."""
    return kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).filter("kinds > 1 and fewest = 1").select("gram")


def _merged(length: int, names: list[str], into: str):
    """mapInArrow: marks (first, windows) of each row to the byte spans they cover."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        for batch in batches:
            marks = batch[_MARKS].fill_null([]) if batch[_MARKS].null_count else batch[_MARKS]
            flat = marks.flatten()
            row = np.repeat(np.arange(len(batch)), np.diff(marks.offsets.to_numpy()))
            first = flat.field("first").to_numpy()
            stop = first + flat.field("windows").to_numpy() + length - 1
            order = np.lexsort((first, row))
            row, first, stop = row[order], first[order], stop[order]
            if len(row):
                wide = int(stop.max()) + 1
                reach = np.maximum.accumulate(stop + row * wide) - row * wide  # of this row: a later row's stops are larger
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (first[1:] > reach[:-1])
                heads = np.flatnonzero(new)
                last = np.append(heads[1:], len(row)) - 1
                row, first, stop = row[heads], first[heads], reach[last]
            offsets = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(first.astype(np.int64)), pa.array(stop.astype(np.int64))], fields=list(kind)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], spans], [*names, into])

    return merge


def kept_bytes(text: str | None, spans: list[dict]) -> bytes:
    """The bytes of a text without its spans."""
    body, at, out = (text or "").encode(), 0, []
    for span in spans:
        out.append(body[at : span["start"]])
        at = span["stop"]
    out.append(body[at:])
    return b"".join(out)


def op3_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of all documents without their repeated 200-byte strings. See repeated_spans() for every edge case; a null id is a document like others."""
    spanned = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch["text"], batch["spans"].to_pylist()
            sizes = np.diff(buffer_of(texts)[1])
            hashes = [hashlib.sha256(kept_bytes(t.as_py(), s)).hexdigest() for t, s in zip(texts, spans, strict=True)]
            removed = [sum(x["stop"] - x["start"] for x in s) for s in spans]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(hashes, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return spanned.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
