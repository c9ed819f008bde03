"""Jaccard metric-space join of word n-gram sets.

1. Level 0 splits the space into regions that no link crosses. A set's shingles are cut into groups by
   ranges of their hashes, as many groups as sets of that size get. Two sets of similarity t or more
   differ in at most (1 - t) / t |x| shingles, and a group that isn't in both has one of these, so of
   each set's groups, in one order of all groups, one of the first (1 - t) / t |x| + 1 is in both. Sets
   that share such a group are joined to one of them, and connected components of these stars are the
   regions: documents outside of them have no link at all, and no document is replicated. Any order
   is exact; this one puts large groups of rare shingles first, by counts in a sketch of fixed size.
   Unrelated sets share single shingles, the more the larger the corpus, but hardly whole groups.
2. Regions of more than region_most sets are divided in the same way by the exact counts inside them.
3. What is still larger is split around pivots: every set goes to the Voronoi cell of its nearest
   pivot, and also into the cells of other pivots q if d(x, q) <= d(x, nearest) + 2 r, the triangle
   inequality's window. Links to pivots are kept. Cells that are still too large are split again
   around pivots of their own; where cells stop shrinking, every pair of blocks of their parent is
   joined instead.
4. A cell is joined exactly: pivot after pivot, distances to earlier pivots rule out by the triangle
   inequality all that can't link, and what is known to be connected is not compared again.

Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm.components import components
from gridweave.llm.shared import buffer_of, dropped, lowered, mixed, prefix_sums, scratch, slices, small_batches, span_hash, table, whole_groups, words_of, written

#: Sets that one task joins without splitting their region around pivots.
REGION_MOST = 4000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GROUP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of each text, ascending, and where each text's begin (one more than texts).

    Fewer than n words are one shingle; null and wordless texts have none.
    """
    ranges = list(slices(texts))
    if len(ranges) > 1:  # bounded memory
        parts = [shingles(texts.slice(a, b - a), n) for a, b in ranges]
        sizes = np.concatenate([np.diff(bounds) for _, bounds in parts])
        return np.concatenate([h for h, _ in parts]), np.concatenate(([0], np.cumsum(sizes)))
    data, starts = buffer_of(texts)
    first, last, doc = words_of(data, starts)
    words = span_hash(prefix_sums(lowered(data)), first, last) if len(first) else np.zeros(0, np.uint64)
    count = np.bincount(doc, minlength=len(texts))
    length = np.minimum(count, n)
    begin = np.cumsum(count) - count
    whole = np.repeat(np.maximum(count - n + 1, np.minimum(count, 1)), count) > np.arange(len(words)) - np.repeat(begin, count)
    at = np.flatnonzero(whole)
    each = length[doc[at]]
    h = np.zeros(len(at), np.uint64)
    factor = _STEP
    with np.errstate(over="ignore"):
        for j in range(n):
            on = each > j
            h[on] += words[at[on] + j] * factor
            factor = factor * _STEP + np.uint64(2)
        h = mixed(h + each.astype(np.uint64))
    d = doc[at]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(texts) + 1))


def set_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mixed(h + _STEP), out=total[1:])
    return mixed(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


#: Counters of the sketch that orders shingles, as a power of two, and how many of these make a block.
SKETCH_BITS, BLOCK_BITS = 24, 20


def _counters(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def rarities(levels: np.ndarray) -> np.ndarray:
    """For each level how far it is below eight times the median count of levels.

    Nothing is dropped for being rare: a sketch tells what no other text has only while it is large for
    its corpus, so what is sent would grow faster than the input.
    """
    spread = sum(np.bincount(part, minlength=256) for part in levels.reshape(-1, 1 << BLOCK_BITS))
    median = int(np.searchsorted(np.cumsum(spread), len(levels) / 2))
    return np.clip(median + 24 - np.arange(256), 0, 255).astype(np.uint8)


#: Groups of the smallest sets, and the share of a set's groups, at most, that are in its prefix, if groups had one size.
LEAST_GROUPS, GROUPED = 16, 0.6


def _prefix(h: np.ndarray, bounds: np.ndarray, rare: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of which another set within the radius shares at least one, and the index of their sets; rare is the rarity of each shingle.

    A set has as many groups as its size, rounded up to a power of two, asks for; where a set that links
    with it may be larger by such a step, it has the larger one's groups as well. Sets with too few groups that aren't
    empty for one of them to be in both also give their rarest shingles, by which they find each other.
    """
    sizes = np.diff(bounds)
    step = np.frexp(sizes)[1]
    larger = np.frexp(100 * sizes // percent)[1]
    keys, owners, few = _grouped(h, bounds, rare, percent, step)
    again = np.flatnonzero(larger != step)
    more, of, few_more = _grouped(*_taken(h, bounds, rare, again), percent, larger[again])
    few = np.union1d(few, again[few_more])
    single, one = _rarest(*_taken(h, bounds, rare, few), percent)
    return np.concatenate([keys, more, single]), np.concatenate([owners, again[of], few[one]])


def _taken(h: np.ndarray, bounds: np.ndarray, rare: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h, bounds and rare of some rows only."""
    sizes = np.diff(bounds)[rows]
    stops = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    at = np.arange(stops[-1]) + np.repeat(bounds[rows] - stops[:-1], sizes)
    return h[at], stops, rare[at]


def _grouped(h: np.ndarray, bounds: np.ndarray, rare: np.ndarray, percent: int, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the first groups of each set, the index of their sets, and the sets that have too few groups."""
    sizes = np.diff(bounds)
    most = (100 - percent) * sizes // percent  # shingles that only one of two linked sets has; none: linked sets are equal
    n_groups = np.maximum(np.ceil(2.0**step * (100 - percent) / (GROUPED * percent)), LEAST_GROUPS).astype(np.uint64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    if not len(h):
        return np.zeros(0, np.uint64), of, of
    place = (h >> np.uint64(32)) * n_groups[of] >> np.uint64(32)
    new = np.ones(len(h), bool)
    new[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1])  # hashes ascend, so groups are runs
    at = np.flatnonzero(new)
    owner = of[at]
    value = np.add.reduceat(rare.astype(np.int64), at)
    with np.errstate(over="ignore"):
        key = mixed(np.add.reduceat(mixed(h + _GROUP), at) + n_groups[owner] * _GROUP)
    order = np.lexsort((key, -value, owner))
    count = np.bincount(owner, minlength=len(sizes))
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    keep = (within <= most[owner]) & (most[owner] > 0)
    return key[order][keep], owner[keep], np.flatnonzero((most > 0) & (count <= most))


def _rarest(h: np.ndarray, bounds: np.ndarray, rare: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of each set, of which linked sets share at least one, and the index of their sets."""
    sizes = np.diff(bounds)
    of = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((h, -rare.astype(np.int64), of))
    within = np.arange(len(h)) - np.repeat(bounds[:-1], sizes)
    keep = within <= np.repeat(sizes - (percent * sizes + 99) // 100, sizes)
    return h[order][keep], of[keep]


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, uid, n_shingles, set_id (equal for equal sets, null if empty); and, with a block, counts of the task's shingles for the sketch."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_ = np.zeros(1 << SKETCH_BITS, np.uint32), False
        names = ["doc_id", "uid", "n_shingles", "set_id", "block", "counts"]
        for batch in batches:
            for at, to in slices(batch["text"]):
                h, bounds = shingles(batch["text"].slice(at, to - at), n)
                np.add.at(sums, _counters(h), np.uint32(1))
                any_ = any_ or len(h) > 0
                counts = np.diff(bounds)
                none = pa.nulls(len(counts))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, to - at), batch["uid"].slice(at, to - at), pa.array(counts, pa.int64()), pa.array(set_ids(h, bounds), mask=counts == 0), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if any_:
            none = pa.nulls(1, pa.int64())
            for b, part in enumerate(sums.reshape(-1, 1 << BLOCK_BITS)):
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([b], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], names)

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, "text").alias("uid"), "text").mapInArrow(sets, "doc_id long, uid long, n_shingles long, set_id long, block int, counts binary")


def sketch_levels(sets: DataFrame) -> np.ndarray:
    """Eighths of the binary logarithm of the sketch's counts, from the blocks of shingle_sets()."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch["block"].to_pylist(), batch["counts"], strict=True):
                part = np.frombuffer(pa.decompress(counts.as_buffer(), 4 << BLOCK_BITS, "zstd"), np.uint32)
                sums[block] = sums[block] + part if block in sums else part.astype(np.int64)
        for block, total in sums.items():
            level = np.minimum(8 * np.log2(np.maximum(total, 1)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "levels"])

    blocks = 1 << (SKETCH_BITS - BLOCK_BITS)
    found = sets.filter("block is not null").select("block", "counts").repartition(blocks, "block").mapInArrow(add, "block int, levels binary")
    levels = np.zeros((blocks, 1 << BLOCK_BITS), np.uint8)
    for row in found.collect():  # 2**SKETCH_BITS bytes at most
        levels[row["block"]] = np.frombuffer(row["levels"], np.uint8)
    return levels.ravel()


#: Keys of prefixes that a task gathers before it combines them.
COMBINED = 1 << 20


def stars(docs: DataFrame, n: int, percent: int, levels) -> DataFrame:
    """Edges (a, b): sets that share a key of their prefixes are joined to one of them; levels is a broadcast.

    A task joins its own sets first and forwards one for each key, so a key that a third of
    all sets share is a few rows for each task. What is forwarded is sorted by key and joined as
    it streams by.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rarity = rarities(levels.value)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            key, one, ends = _first_of_groups(np.concatenate(keys), np.concatenate(ids))
            edges = np.unique(ends, axis=0) if len(ends) else ends
            columns = np.concatenate([key, edges[:, 0] ^ edges[:, 1]]), np.concatenate([one, edges[:, 0]]), np.concatenate([np.zeros(len(one), np.int64), edges[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], mask=np.arange(len(columns[2])) < len(one))], ["key", "a", "b"])

        for batch in batches:
            for at, to in slices(batch["text"]):
                h, bounds = shingles(batch["text"].slice(at, to - at), n)
                names = set_ids(h, bounds)
                k, of = _prefix(h, bounds, rarity[levels.value[_counters(h)]], percent)
                keys.append(k.view(np.int64))
                ids.append(names[of])
                held += len(k)
                if held >= COMBINED:
                    yield flush()
                    keys, ids, held = [], [], 0
        if held:
            yield flush()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "key", 1 << 20):
            rows = rows.combine_chunks()
            done = rows.filter(rows["b"].is_valid())
            open_ = rows.filter(rows["b"].is_null())
            _, _, ends = _first_of_groups(open_["key"].to_numpy(), open_["a"].to_numpy())
            ends = np.concatenate([ends, np.stack([done["a"].to_numpy(), done["b"].to_numpy()], 1)])
            if len(ends):
                ends = np.unique(ends, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    made = docs.select("text").mapInArrow(combine, "key long, a long, b long")
    return made.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(link, "a long, b long")


def _first_of_groups(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a value of each, and (value, that value) of the others."""
    order = np.argsort(key)
    key, value = key[order], value[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    one = value[new]
    pair = np.stack([value, one[np.cumsum(new) - 1]], 1) if len(value) else np.zeros((0, 2), np.int64)
    return key[new], one, pair[pair[:, 0] != pair[:, 1]]


class _Cell:
    """Sets of one region or cell, joined exactly."""

    def __init__(self, h: np.ndarray, bounds: np.ndarray, percent: int):
        self.ids = np.unique(h, return_inverse=True)[1]
        self.n_ids = int(self.ids.max()) + 1 if len(h) else 0
        self.bounds, self.sizes, self.percent = bounds, np.diff(bounds), percent
        self.root = np.arange(len(self.sizes))

    def common(self, p: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of p with others."""
        flag = np.zeros(self.n_ids, bool)
        flag[self.ids[self.bounds[p] : self.bounds[p + 1]]] = True
        sizes = self.sizes[others]
        stop = np.cumsum(sizes)
        at = np.arange(stop[-1]) + np.repeat(self.bounds[others] - (stop - sizes), sizes)
        hits = np.concatenate(([0], np.cumsum(flag[self.ids[at]])))
        return hits[stop] - hits[stop - sizes]

    def joined(self) -> np.ndarray:
        """root of each set: the same for all that links connect."""
        n = len(self.sizes)
        radius = 1 - self.percent / 100 + 1e-9
        far: list[np.ndarray] = []  # distances to the first pivots
        for p in range(n - 1):
            rest = np.arange(p + 1, n)
            near = (self.root[rest] != self.root[p]) & (100 * np.minimum(self.sizes[rest], self.sizes[p]) >= self.percent * np.maximum(self.sizes[rest], self.sizes[p]))
            for d in far:
                near &= np.abs(d[rest] - d[p]) <= radius
            table_it = len(far) < 8 and n > 16 and near.any()
            others = np.arange(n) if table_it else rest[near]
            if not len(others):
                continue
            both = self.common(p, others)
            union = self.sizes[others] + self.sizes[p] - both
            if table_it:
                far.append(1 - both / union)
            for q in others[(100 * both >= self.percent * union) & (self.root[others] != self.root[p])]:
                if self.root[q] != self.root[p]:
                    self.root[self.root == self.root[q]] = self.root[p]
            if (self.root == self.root[0]).all():
                break
        return self.root


def _own_sets(rows: pa.Table, n: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """rows and their shingles, without rows whose text isn't that of their set (other texts under one doc_id)."""
    rows = rows.combine_chunks()
    h, bounds = shingles(rows["text"].chunk(0), n)
    own = set_ids(h, bounds) == rows["set_id"].to_numpy()
    if not own.all():
        rows = rows.filter(pa.array(own)).combine_chunks()
        h, bounds = shingles(rows["text"].chunk(0) if rows["text"].num_chunks else pa.array([], pa.string()), n)
    return rows, h, bounds


def _cells(n: int, percent: int):
    """mapInArrow over (cell, set_id, text) sorted by cell: (a, b) with a the set, b one that stands for its component in the cell."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "cell"):
            rows, h, bounds = _own_sets(rows, n)
            cell, sets = (rows[c].to_numpy() for c in ("cell", "set_id"))
            if not len(sets):
                continue
            cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            out = np.empty_like(sets)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                root = _Cell(h[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], percent).joined()
                out[a:b] = sets[a:b][root]
            yield pa.RecordBatch.from_arrays([pa.array(sets), pa.array(out)], ["a", "b"])

    return join


def _pivoted(n: int, percent: int):
    """mapInArrow over (cell, parent, set_id, text, pivot) sorted by cell: links to pivots, and (parent, cell, set) of the Voronoi cells with their windows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "cell"):
            rows, h, bounds = _own_sets(rows, n)
            cell, parent, sets, pivot = (rows[c].to_numpy() for c in ("cell", "parent", "set_id", "pivot"))
            cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True]))) if len(cell) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here = _Cell(h[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], percent)
                pivots = np.flatnonzero(pivot[a:b])
                members = np.flatnonzero(~pivot[a:b])
                if not len(members):
                    continue
                both = np.stack([here.common(p, members) for p in pivots])
                union = here.sizes[members] + here.sizes[pivots][:, None] - both
                d = 1 - both / union
                links = np.argwhere(100 * both >= percent * union)
                homes = np.argwhere(d <= d.min(0) + 2 * (1 - percent / 100) + 1e-9)
                inner = mixed(sets[a:b][pivots].view(np.uint64) + mixed(parent[a:b][pivots].view(np.uint64))).view(np.int64)
                for kind, left, pairs in (("link", sets[a:b][pivots], links), ("cell", inner, homes)):
                    columns = [pa.array([kind] * len(pairs), pa.string()), pa.array(np.full(len(pairs), parent[a])), pa.array(left[pairs[:, 0]]), pa.array(sets[a:b][members[pairs[:, 1]]])]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "parent", "a", "b"])

    return split


def _sorted_cells(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartition(partitions, "cell").sortWithinPartitions("cell")


def near_components(docs: DataFrame, n: int = 5, percent: int = 80, region_most: int = REGION_MOST) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text), as a written table.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of n-word
    shingles (A-Z lower-cased; fewer words: one shingle of all). component_id is the least doc_id
    that links lead to, itself included (null ids count as none, so it is null only if all are). Null and wordless texts have no shingles and no links.
    Equal sets are one vertex, so repeated rows and copies never form pairs. An empty table gives an
    empty result; other columns are ignored. percent is 75 or more.
    """
    if percent < 75:
        raise ValueError("percent must be 75 or more")
    spark = docs.sparkSession
    small_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("uid", F.xxhash64("doc_id", "text"))
    made = written(shingle_sets(docs, n))
    levels = spark.sparkContext.broadcast(sketch_levels(made))
    sets = written(made.filter("block is null").select("doc_id", "uid", "n_shingles", "set_id"))
    dropped(made)
    held = sets.filter(F.col("set_id").isNotNull())
    roots = components(stars(docs, n, percent, levels))
    levels.unpersist()
    least = held.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("uid").alias("uid"))
    regions = written(roots.select(F.col("v").alias("set_id"), F.col("root").alias("cell")).join(least.select("set_id", "uid"), "set_id"))
    dropped(roots)
    texts = docs.select("uid", "text")
    large = regions.groupBy("cell").agg(F.count("*").alias("members")).filter(F.col("members") > region_most)
    large = written(large)
    few = written(_small_links(regions, large, texts, n, percent, partitions))
    linked, hot = few, few
    if not large.isEmpty():
        with scratch() as keep:
            hot = keep(components(_large_links(regions, large, texts, n, percent, region_most, partitions)))
        linked = few.unionByName(hot.select(F.col("v").alias("a"), F.col("root").alias("b")))
    dropped(regions, large)
    linked = linked.groupBy("a").agg(F.min("b").alias("b"))  # a row repeated whole gives its set twice
    heads = least.join(linked, least["set_id"] == linked["a"], "left").select(least["set_id"], F.coalesce("b", least["set_id"]).alias("head"), "doc_id")
    named = heads.groupBy("head").agg(F.min("doc_id").alias("component_id"))
    named = heads.join(named, "head").select(F.col("set_id"), "component_id")
    # joins by sort and merge at every size: what is small here may not be at another scale, and hot keys are split
    full = held.select("doc_id", "n_shingles", "set_id").join(named.hint("merge"), "set_id").select("doc_id", "n_shingles", "component_id")
    out = written(full.unionByName(sets.filter(F.col("set_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))
    dropped(sets, few, hot)
    return out


def _small_links(regions: DataFrame, large: DataFrame, texts: DataFrame, n: int, percent: int, partitions: int) -> DataFrame:
    small = texts.join(regions.join(large, "cell", "left_anti").hint("merge"), "uid").select("cell", "set_id", "text")
    return _sorted_cells(small, partitions).mapInArrow(_cells(n, percent), "a long, b long")


#: Pivots of one cell at most, and the shares of its size that its largest cell and all its cells may have to be split on.
PIVOTS, SHRINKS, SPREADS = 64, 0.75, 3


def _large_links(regions: DataFrame, large: DataFrame, texts: DataFrame, n: int, percent: int, region_most: int, partitions: int) -> DataFrame:
    """Links of the large regions: divided by exact counts, then cell after cell around pivots."""
    members = written(texts.join(regions.join(large, "cell").hint("merge"), "uid").select("cell", "set_id", "text").dropDuplicates(["set_id"]))
    texts = members.select("set_id", "text")
    cells = components(_counted_stars(members, n, percent)).select(F.col("v").alias("set_id"), F.col("root").alias("cell"))
    links = None
    while True:
        sizes = written(cells.groupBy("cell").agg(F.count("*").alias("members")))
        big = sizes.filter(F.col("members") > region_most)
        small = cells.join(sizes.filter(F.col("members") <= region_most).hint("merge"), "cell").select("cell", "set_id")
        found = _joined(small, texts, n, percent, partitions)
        links = found if links is None else links.unionByName(found)
        if big.isEmpty():
            return links
        split = written(_split(cells.join(big.hint("merge"), "cell"), texts, n, percent, region_most, partitions))
        links = links.unionByName(split.filter("kind = 'link'").select("a", "b"))
        inner = split.filter("kind = 'cell'").select("parent", F.col("a").alias("cell"), F.col("b").alias("set_id")).distinct()
        each = inner.groupBy("parent", "cell").agg(F.count("*").alias("n")).groupBy("parent").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
        stuck = each.join(big.withColumnRenamed("cell", "parent"), "parent").filter((F.col("most") > SHRINKS * F.col("members")) | (F.col("all") > SPREADS * F.col("members")))
        stuck = written(stuck.select(F.col("parent").alias("cell"), "members"))
        known = components(links)
        if not stuck.isEmpty():
            blocks = _open(_blocks(cells.join(stuck.hint("merge"), "cell"), region_most), known)
            links = links.unionByName(_joined(blocks, texts, n, percent, partitions))
        cells = written(_open(inner.join(stuck.select(F.col("cell").alias("parent")), "parent", "left_anti").select("cell", "set_id"), known))


def _joined(cells: DataFrame, texts: DataFrame, n: int, percent: int, partitions: int) -> DataFrame:
    """The exact stars inside each of cells (cell, set_id)."""
    rows = texts.join(cells.hint("merge"), "set_id").select("cell", "set_id", "text")
    return written(_sorted_cells(rows, partitions).mapInArrow(_cells(n, percent), "a long, b long"))


def _open(cells: DataFrame, known: DataFrame) -> DataFrame:
    """cells (cell, set_id) without those that known (v, root) connects already."""
    roots = cells.join(known.select(F.col("v").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    left = roots.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("cell")
    return cells.join(left.hint("merge"), "cell").select("cell", "set_id")


def _counted_stars(members: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b) as those of stars(), of sets in one cell, by the exact counts of the cell's shingles."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch["text"]):
                rows, h, bounds = _own_sets(pa.Table.from_batches([batch.slice(at, to - at)]), n)
                sizes = np.diff(bounds)
                cell, sets = (np.repeat(rows[c].to_numpy(), sizes) for c in ("cell", "set_id"))
                key = mixed(h + mixed(cell.view(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sets), pa.array(np.repeat(sizes, sizes))], ["key", "set_id", "size"])

    rows = members.mapInArrow(every, "key long, set_id long, size long").distinct()
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    place = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("n"), "key"))
    shared = rows.join(counts.hint("merge"), "key").withColumn("place", place)
    # all but the last ceil(t |x|) - 1 in the order; the last are the most frequent, which are the first here
    first = written(shared.filter(F.col("place") >= F.ceil(F.col("size") * percent / F.lit(100))).select("key", "set_id"))
    heads = first.groupBy("key").agg(F.min("set_id").alias("b"))
    return first.join(heads.hint("merge"), "key").select(F.col("set_id").alias("a"), "b")


def _split(cells: DataFrame, texts: DataFrame, n: int, percent: int, region_most: int, partitions: int) -> DataFrame:
    """What _pivoted() finds in cells (cell, set_id, members), around the sets of each cell that come first by a hash."""
    salts = F.ceil(F.col("members") / region_most).cast("int")
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("set_id", "cell"), "set_id"))
    wanted = F.greatest(F.lit(2), F.ceil(4 * F.col("members") / region_most))
    chosen = cells.withColumn("place", place).filter(F.col("place") <= PIVOTS).filter(F.col("place") <= wanted)
    spread = chosen.select("cell", "set_id", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("pivot"))
    dealt = cells.select("cell", "set_id", F.pmod(F.xxhash64("set_id", F.lit(1)), salts).cast("int").alias("salt"), F.lit(False).alias("pivot"))
    rows = texts.join(dealt.unionByName(spread).hint("merge"), "set_id")
    rows = rows.select(F.xxhash64("cell", "salt").alias("cell"), F.col("cell").alias("parent"), "set_id", "text", "pivot")
    return _sorted_cells(rows, partitions).mapInArrow(_pivoted(n, percent), "kind string, parent long, a long, b long")


def _blocks(cells: DataFrame, region_most: int) -> DataFrame:
    """(cell, set_id): every pair of blocks of about half of region_most sets of each of cells (cell, set_id, members)."""
    blocks = F.ceil(2 * F.col("members") / region_most).cast("int")
    own = cells.withColumn("own", F.pmod(F.xxhash64("set_id", F.lit(2)), blocks).cast("int"))
    pairs = own.select("cell", "set_id", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return pairs.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "set_id")


def op4_voronoi_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles at 90 percent. See near_components() for every edge case; long texts are taken whole."""
    return near_components(table(spark, sf_dir, "documents"), n=3, percent=90)
