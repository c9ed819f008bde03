"""Hard negatives by distributed radix selection.

Each anchor ranks the other vectors by a whole-number score. Its positives are the best of its own
label; a positive then opens a window of scores below its own, from which the best of the other
labels are taken. Both are selections: the first k of a window in the order of score, then id.

A selection never sorts and never gathers candidates. Each round, every task counts how the scores
of its vectors fall into the digits of each open window, the counts are added up, and the window
shrinks to the one digit in which its kth score lies. When a window is down to one score that more
rows share than are wanted, the rounds go on over the digits of the ids. What then qualifies is
gathered, k rows a window.

Vectors stay where they are: a round scans them in blocks against one group of anchors, so what
is broadcast or comes to the driver, some numbers a window, is bounded by the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm.shared import dropped, small_batches, table, written

#: Bits of a digit: a window has at most 2 ** DIGIT counts a round and task.
DIGIT = 8
#: Anchors of a group, whose vectors and windows are broadcast together; vectors of a block.
GROUP, ROWS = 4096, 1024
#: Positives of an anchor, negatives of a positive, and the window's bounds in percent of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90


def quantised(vectors: DataFrame, label: Column, anchor: Column) -> DataFrame:
    """vec_id, label, is_anchor, v: what takes part, as a written table. Components become floor(256 x) of their double value.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), label.cast("int").alias("label"), anchor.alias("is_anchor"), "embedding")
    rows = rows.filter("vec_id is not null and label is not null and embedding is not null").filter(fine)
    return written(rows.select("vec_id", "label", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v")))


def matrix(v: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled up with zeros, since a missing component adds nothing to a score."""
    sizes = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(v), width))
    row = np.repeat(np.arange(len(v)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Windows:
    """Open selections of one group of anchors: the same label or others, and what is still undecided of each.

    low and high bound the scores; scores above top (top < high) are taken already, and of those in
    bottom..top the need first are wanted. Once bottom = top, ids in first..last are undecided, smaller
    ones are taken. A window is done when no more than need rows are undecided.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, need: int, same: bool, span: tuple[int, int]):
        self.ids, self.labels, self.vectors, self.same = ids, labels, vectors, same
        self.anchor, self.low, self.high = anchor, low.astype(np.int64), high.astype(np.int64)
        self.bottom, self.top = self.low.copy(), self.high.copy()
        self.need = np.full(len(anchor), need, np.int64)
        self.first, self.last = np.full(len(anchor), span[0], np.int64), np.full(len(anchor), span[1], np.int64)
        self.none = self.low > self.high
        self.done = self.none.copy()

    def shifts(self) -> np.ndarray:
        """How far a score's, or for windows of one score an id's, distance from the window's start is shifted to give a digit."""
        wide = np.where(self.bottom < self.top, self.top - self.bottom, self.last - self.first)
        return np.maximum(0, np.ceil(np.log2(wide.astype(np.float64) + 1)).astype(np.int64) - DIGIT + (wide >= 1 << 52))

    def pairs(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, row, score) of the rows in low..high of these windows, a block of rows at a time."""
        if not len(windows):
            return
        anchors, of = np.unique(self.anchor[windows], return_inverse=True)
        order = np.argsort(of, kind="stable")
        windows, of = windows[order], of[order]
        many = np.bincount(of, minlength=len(anchors))
        start = np.cumsum(many) - many
        least, most = np.minimum.reduceat(self.low[windows], start), np.maximum.reduceat(self.high[windows], start)
        # doubles add up whole numbers exactly as long as no sum can pass 2 ** 53
        exact = float(np.abs(self.vectors[anchors]).sum(1).max()) * float(np.abs(vectors).max(initial=0)) < 2.0**53
        theirs = self.vectors[anchors] if exact else self.vectors[anchors].astype(np.int64)
        for a in range(0, len(ids), ROWS):
            block = vectors[a : a + ROWS]
            scores = (block @ theirs.T if exact else block.astype(np.int64) @ theirs.T).astype(np.int64)
            alike = labels[a : a + ROWS, None] == self.labels[anchors][None, :]
            wanted = (alike & (ids[a : a + ROWS, None] != self.ids[anchors][None, :])) if self.same else ~alike
            row, col = np.nonzero(wanted & (scores >= least) & (scores <= most))
            score = scores[row, col]
            for k in range(int(many.max())):  # the kth window of each anchor
                has = np.flatnonzero(many[col] > k)
                w = windows[start[col[has]] + k]
                s = score[has]
                inside = (s >= self.low[w]) & (s <= self.high[w])
                yield w[inside], row[has][inside] + a, s[inside]

    def counts(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Iterator[np.ndarray]:
        """Window << DIGIT | digit of every undecided row of the open windows."""
        shift = self.shifts()
        for w, row, score in self.pairs(ids, labels, vectors, np.flatnonzero(~self.done)):
            by_id = self.bottom[w] == self.top[w]
            inside = (score >= self.bottom[w]) & (score <= self.top[w]) & (~by_id | ((ids[row] >= self.first[w]) & (ids[row] <= self.last[w])))
            w, row, score, by_id = w[inside], row[inside], score[inside], by_id[inside]
            yield (w << DIGIT) | (np.where(by_id, ids[row] - self.first[w], self.top[w] - score) >> shift[w])

    def narrow(self, window: np.ndarray, digit: np.ndarray, before: np.ndarray, here: np.ndarray) -> None:
        """Takes, of each open window, the digit in which its last wanted row lies: before rows come ahead of it, here are in it."""
        shift = self.shifts()
        open_ = ~self.done
        found = np.zeros(len(self.done), bool)
        found[window] = True
        self.done |= open_ & ~found  # fewer rows than wanted: all are taken
        w, step = window, np.int64(1) << shift[window]
        by_id = self.bottom[w] == self.top[w]
        i, s = w[by_id], w[~by_id]
        self.first[i] += digit[by_id] * step[by_id]
        self.last[i] = np.minimum(self.last[i], self.first[i] + step[by_id] - 1)
        self.top[s] -= digit[~by_id] * step[~by_id]
        self.bottom[s] = np.maximum(self.bottom[s], self.top[s] - step[~by_id] + 1)
        self.need[w] -= before
        single = (self.bottom[w] == self.top[w]) & (self.first[w] == self.last[w])
        self.done[w] = (here <= self.need[w]) | single

    def qualifying(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, row, score) of what the selections take; more only of rows with one id and score."""
        for w, row, score in self.pairs(ids, labels, vectors, np.flatnonzero(~self.none)):
            by_id = (self.bottom[w] == self.top[w]) & (score == self.top[w])
            taken = np.where(by_id, ids[row] <= self.last[w], score >= self.bottom[w])
            yield w[taken], row[taken], score[taken]


def selected(rows: DataFrame, width: int, windows: Windows, k: int) -> DataFrame:
    """(window, nth, vec_id, score): the first k rows of each window by score, then id, as a written table."""
    spark = rows.sparkSession
    rows = rows.select("vec_id", "label", "v")
    parts = lambda batch: (batch["vec_id"].to_numpy(), batch["label"].to_numpy(), matrix(batch["v"], width))
    while len(windows.done) and not windows.done.all():
        shared = spark.sparkContext.broadcast(windows)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                for codes in shared.value.counts(*parts(batch)):
                    held.append(np.unique(codes, return_counts=True))
                    size += len(held[-1][0])
                    if size > 1 << 20:
                        held = [_added(held)]
                        size = len(held[0][0])
            codes, n = _added(held)
            yield pa.RecordBatch.from_arrays([pa.array(codes >> DIGIT), pa.array((codes & (1 << DIGIT) - 1).astype(np.int32)), pa.array(n)], ["window", "digit", "n"])

        bins = rows.mapInArrow(count, "window long, digit int, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))
        need = spark.createDataFrame(pa.table({"window": np.flatnonzero(~windows.done), "need": windows.need[~windows.done]}))
        upto = F.sum("n").over(Window.partitionBy("window").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))  # at most 2 ** DIGIT rows
        kth = bins.withColumn("upto", upto).join(F.broadcast(need), "window").filter("upto >= need").groupBy("window").agg(F.min_by(F.struct("digit", (F.col("upto") - F.col("n")).alias("before"), F.col("n").alias("here")), "digit").alias("at"))
        found = kth.select("window", "at.*").toArrow()  # a row a window
        windows.narrow(*(found[c].to_numpy().astype(np.int64) for c in ("window", "digit", "before", "here")))
        shared.destroy()
    shared = spark.sparkContext.broadcast(windows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = parts(batch)
            for w, row, score in shared.value.qualifying(ids, labels, vectors):
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(ids[row]), pa.array(score)], ["window", "vec_id", "score"])

    nth = F.row_number().over(Window.partitionBy("window").orderBy(F.col("score").desc(), "vec_id"))
    out = rows.mapInArrow(gather, "window long, vec_id long, score long").withColumn("nth", nth).filter(F.col("nth") <= k)
    out = written(out.select("window", "nth", "vec_id", "score"))
    shared.destroy()
    return out


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, which = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    n = np.zeros(len(codes), np.int64)
    np.add.at(n, which, np.concatenate([n for _, n in held]))
    return codes, n


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from vectors (vec_id, label, embedding).

    The anchors are the rows for which anchor holds; label, if given, replaces the column. An anchor's positives are its
    first other rows of its label, a positive's negatives its first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score, both by score, then id; fewer, if there are
    fewer, and no row for a positive without negatives. A row isn't another one than the anchor if it has the anchor's
    id; apart from that, repeated rows are rows of their own, and a repeated anchor is one anchor for each different
    label and vector. See quantised() for nulls and what isn't finite; vectors of differing lengths are filled up with
    zeros. Scores must lie within 2 ** 62. An empty table, or no anchor, gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = quantised(vectors, F.col("label") if label is None else label, anchor)
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x))
    bounds = rows.agg(F.max(F.size("v")), F.min("vec_id"), F.max("vec_id"), F.max(size), F.max(F.array_max(F.transform("v", F.abs)))).first()
    anchors = written(rows.filter("is_anchor").select("vec_id", "label", "v").distinct().withColumn("uid", F.monotonically_increasing_id()))
    groups = max(1, -(-anchors.count() // GROUP))
    width, span = int(bounds[0] or 0), (int(bounds[1] or 0), int(bounds[2] or 0))
    most = min(int((bounds[3] or 0.0) * (bounds[4] or 0)), (1 << 62) - 1)  # no score is larger
    found = []
    for g in range(groups):  # each scans all vectors against about GROUP anchors
        part = anchors.filter(F.pmod(F.xxhash64("uid"), F.lit(groups)) == g)
        own = part.select("vec_id", "label", "v").toArrow().combine_chunks()
        if len(own):
            found.append(_group(rows, own, width, span, most, positives, negatives, low, high))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    dropped(anchors)
    return out


def _group(rows: DataFrame, own: pa.Table, width: int, span: tuple[int, int], most: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    ids, labels = own["vec_id"].to_numpy(), own["label"].to_numpy()
    v = own["v"].combine_chunks()
    vectors = matrix(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v, width)
    every = np.arange(len(ids))
    best = selected(rows, width, Windows(ids, labels, vectors, every, np.full(len(ids), -most), np.full(len(ids), most), positives, True, span), positives)
    mine = best.select(F.col("window").alias("anchor"), "vec_id", "score").orderBy("anchor", "nth").toArrow()  # a few rows an anchor of the group
    of, score = mine["anchor"].to_numpy(), mine["score"].to_numpy()
    # whole scores s with low * score <= 100 s <= high * score; the products can pass a long
    least, last = (np.array([at(x) for x in score.tolist()], np.int64) for at in (lambda x: -(-low * x // 100), lambda x: high * x // 100))
    windows = Windows(ids, labels, vectors, of, least, last, negatives, False, span)
    chosen = selected(rows, width, windows, negatives)
    heads = rows.sparkSession.createDataFrame(pa.table({"window": np.arange(len(of)), "anchor_id": ids[of], "positive_id": mine["vec_id"].to_numpy(), "positive_score": score}))
    out = chosen.join(F.broadcast(heads), "window")
    return out.select("anchor_id", "positive_id", F.col("nth").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_radix_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all of them, after every seventh label was changed. See hard_negatives() for every edge case."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP13_SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as alike, list_inner_product(a.v, r.v)::bigint as score
  from rows a join rows r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not alike and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""
