"""The Jaccard join against all pairs, with and without pivots, and its edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridweave.llm import jaccard

SCHEMA = "doc_id long, text string, set_id string, cell int"


def brute(rows, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for (i, *_), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    return sorted((row[0], len(s), least[r]) for row, s, r in zip(rows, sets, root, strict=True))


def families(seed, groups, each, words, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, words))]
        for _ in range(rng.randint(1, each)):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "\n"]).join(text), "x", 1))
    rows += [(len(rows), "", "x", 1), (len(rows) + 1, None, "x", 1), (len(rows) + 2, " \t\n", "x", 1), (len(rows) + 3, "One", None, None), (len(rows) + 4, "one", None, None), (len(rows) + 5, "Ä one", "y", 2), (len(rows) + 6, "ä one", "y", 2)]
    return rows


@pytest.mark.parametrize(("seed", "n", "percent", "most"), [(1, 3, 90, 4000), (2, 5, 80, 4000), (3, 3, 90, 4), (4, 5, 80, 3), (5, 1, 75, 5)])
def test_against_all_pairs(spark, seed, n, percent, most):
    rows = families(seed, 25, 14, 90, 5)
    got = jaccard.near_components(spark.createDataFrame(rows, SCHEMA), n, percent, most).collect()
    assert sorted(map(tuple, got)) == brute(rows, n, percent)


def test_one_large_group(spark):
    rows = families(7, 1, 1, 200, 0)[:1]
    base = rows[0][1].split()
    rng = random.Random(0)
    for i in range(1, 120):
        text = list(base)
        for _ in range(rng.randint(0, max(1, len(base) // 12))):
            text[rng.randrange(len(text))] = f"new{rng.randrange(50)}"
        rows.append((i, " ".join(text), "x", 1))
    got = jaccard.near_components(spark.createDataFrame(rows, SCHEMA), 3, 80, 10).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 80)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.near_components(empty, 3, 90).collect() == []
    rows = [(5, "a b c d", "x", 1), (5, "a b c d", "x", 1), (5, "q r s t u", "x", 1), (2, "A b C d", "x", 1)]
    got = sorted(map(tuple, jaccard.near_components(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()))
    assert got == [(2, 2, 2), (5, 2, 2), (5, 2, 2), (5, 3, 5)]


def test_long_text_is_taken_whole():
    words = [f"w{i % 5000}x{i % 77}" for i in range(200_000)]
    h, bounds = jaccard.shingles(pa.array([" ".join(words), "a"]), 3)
    assert bounds[1] == len({tuple(words[i : i + 3]) for i in range(len(words) - 2)})
    assert (np.diff(h[: bounds[1]].astype(object)) > 0).all()


def chained(seed, n_sets, copies):
    """Texts of common lines and words of their own: no links but those of copies with one changed word."""
    rng = random.Random(seed)
    lines = [" ".join(f"l{i}x{j}" for j in range(12)) for i in range(6)]
    rows = []
    for i in range(n_sets):
        own = [f"own{i}y{j}" for j in range(rng.randint(20, 30))]
        words = " ".join(rng.sample(lines, 4)).split() + own
        for _ in range(1 + (i < copies)):
            rows.append((len(rows), " ".join(words), "x", 1))
            words[rng.randrange(len(words))] = f"new{len(rows)}"
    return rows


def test_large_cells_are_split_until_they_fit(spark, monkeypatch):
    rows = chained(3, 60, 12)
    largest = []
    frame = spark.createDataFrame(rows, SCHEMA)
    joined = jaccard._joined

    def watched(cells, *rest):
        largest.append(max([r["count"] for r in cells.groupBy("cell").count().collect()], default=0))
        return joined(cells, *rest)

    monkeypatch.setattr(jaccard, "_joined", watched)
    # all levels in one region, as if no shingle were rare: only the cells can bound a task
    everything = lambda docs, *_: jaccard.shingle_sets(docs, 2).filter("set_id is not null").crossJoin(jaccard.shingle_sets(docs, 2).agg(jaccard.F.min("set_id").alias("b"))).select(jaccard.F.col("set_id").alias("a"), "b")
    monkeypatch.setattr(jaccard, "stars", everything)
    monkeypatch.setattr(jaccard, "_counted_stars", lambda members, n, percent: everything(members.select(jaccard.F.lit(1).alias("doc_id"), "text")))
    got = jaccard.near_components(frame, 2, 80, 16).collect()
    assert sorted(map(tuple, got)) == brute(rows, 2, 80)
    assert largest and max(largest) <= 32


def test_common_lines_chain_no_region(spark):
    rows = chained(4, 60, 12)
    frame = spark.createDataFrame(rows, SCHEMA)
    levels = spark.sparkContext.broadcast(jaccard.sketch_levels(jaccard.shingle_sets(frame, 2)))
    found = jaccard.components(jaccard.stars(frame, 2, 80, levels)).groupBy("root").count().collect()
    assert max(r["count"] for r in found) <= 8
    members = jaccard.shingle_sets(frame, 2).filter("set_id is not null").select("doc_id", "set_id").join(frame.select("doc_id", "text"), "doc_id").select(jaccard.F.lit(7).cast("long").alias("cell"), "set_id", "text")
    found = jaccard.components(jaccard._counted_stars(members, 2, 80)).groupBy("root").count().collect()
    assert max(r["count"] for r in found) <= 8
    got = jaccard.near_components(frame, 2, 80, 4).collect()
    assert sorted(map(tuple, got)) == brute(rows, 2, 80)


def test_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*words[:k], f"x{k}", *words[k + 1 :]])
    rows = [(1, near(0)), (None, " ".join(words)), (2, near(59)), (2, near(59)), (None, "alone in the world"), (None, None)]
    got = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 96).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (0, 3, 0), (0, 59, 1), (1, 59, 1), (2, 59, 1), (2, 59, 1)]


def shared(seed, n_sets, lines):
    """Texts that share many single shingles and have few of their own, with a close copy of every fifth."""
    rng = random.Random(seed)
    pool = [" ".join(f"p{i}x{j}" for j in range(4)) for i in range(lines)]
    rows = []
    for i in range(n_sets):
        words = " ".join(rng.sample(pool, 30)).split()
        rows.append((len(rows), " ".join(words), "x", 1))
        if i % 5 == 0:
            rows.append((len(rows), " ".join([*words[:-1], f"new{i}"]), "x", 1))
    return rows


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (3, 80)])
def test_full_sketch_chains_no_region(spark, n, percent):
    rows = shared(9, 150, 1500)
    frame = spark.createDataFrame(rows, SCHEMA)
    full = spark.sparkContext.broadcast(np.full(1 << jaccard.SKETCH_BITS, 40, np.uint8))  # what a corpus far larger than the sketch leaves
    found = jaccard.components(jaccard.stars(frame, n, percent, full)).groupBy("root").count().collect()
    assert len(found) >= 30 and max(r["count"] for r in found) <= 8
    got = jaccard.near_components(frame, n, percent).collect()
    assert sorted(map(tuple, got)) == brute(rows, n, percent)


@pytest.mark.parametrize(("percent", "most"), [(75, 400), (80, 400), (90, 400), (97, 400), (90, 12)])
def test_prefixes_of_linked_sets_meet(percent, most):
    rng = np.random.default_rng(percent + most)
    for _ in range(300):
        size = int(rng.integers(1, most))
        a = rng.integers(0, 1 << 63, size, np.uint64)
        if most < 100:  # all in few ranges of hashes
            a >>= np.uint64(4)
        out = int(rng.integers(0, size * (100 - percent) // 100 + 1))
        extra = max(0, int((size - out) * 100 // percent) - size)
        b = np.concatenate([a[out:], rng.integers(0, 1 << 63, int(rng.integers(0, extra + 1)), np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common < percent * (len(a) + len(b) - common):
            continue
        if np.array_equal(a, b):
            continue
        h, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        rare = (h >> np.uint64(3)).astype(np.uint8) // np.uint8(2)
        keys, of = jaccard._prefix(h, bounds, rare, percent)
        assert len(np.intersect1d(keys[of == 0], keys[of == 1]))


def test_keys_do_not_depend_on_the_sketch():
    """A sparse sketch, as of a small corpus, must not let a task send less than a full one does: what is sent grows with the input."""
    texts = pa.array([row[1] for row in shared(11, 40, 400)])
    h, bounds = jaccard.shingles(texts, 5)
    found = []
    for level in (0, 40, 255):
        rarity = jaccard.rarities(np.full(1 << jaccard.SKETCH_BITS, level, np.uint8))
        found.append(len(jaccard._prefix(h, bounds, rarity[np.full(len(h), level)], 80)[0]))
    assert found[0] == found[1] == found[2] > 0
