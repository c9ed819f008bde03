"""Likelihood ratios, importance resampling and hard negatives: SQL on the given tables, brute force on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gridweave.llm import negatives, quality, resampling

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 7919}" for i in range(60_000))
TEXTS = [
    None, "", " \n\t", "one", "One two one two", "a" * 70 + " " + "b" * 64 + " " + "c" * 65 + " é" * 3, "line one\nline one\n\nline one \nother", "x\ny\nx\n" * 40,
    "the same five words here " * 6 + "and then some more that differ", "# * $ % & | < >", "naïve Ünïcode 日本語 mixed123 9a-b_c", "é b\x0bc\x85d", LONG,
]
DOCS = "doc_id long, text string, score string, id int, aside double, bucket string, v int"


def equal(want, got):
    columns = list(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(object) for x in (want, got))
    return a.where(a.notna(), None).equals(b.where(b.notna(), None))


@pytest.mark.parametrize(("query", "sql"), [(quality.op11_likelihood_ratio, quality.OP11_SQL), (resampling.op12_importance_resampling, resampling.OP12_SQL), (negatives.op13_radix_negatives, negatives.OP13_SQL)])
def test_queries_equal_sql(spark, query, sql):
    con = duckdb.connect()
    for name in ("documents", "labels", "benchmark", "embeddings"):
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    assert equal(con.sql(sql).df(), query(spark, DATA).toPandas())


def corpus(spark):
    rows = [(i, t, "clash", 1, 0.5, "clash", 2) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id but some words", None, None, None, None, None), (3, "one", None, None, None, None, None), (3, "one", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS), rows


def measured(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    five = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {i + j for i in range(len(words) - 4) if five[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_measures_and_ratio_by_brute_force(spark):
    docs, rows = corpus(spark)
    good = [(f"Good plain sentence number {i % 10} of the trusted kind, with words that differ {i * 7919 % 13}. Then {i % 7} more of them follow here.") for i in range(80)]
    bad = [" ".join(f"@@{(i * 31 + j) % 97}&&zz#{j}" for j in range(30)) for i in range(60)]
    extra = [(1000 + i, t) for i, t in enumerate(good)] + [(2000 + i, t) for i, t in enumerate(bad)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(1000 + i, 1, 0) for i in range(60)] + [(2000 + i, 0, 0) for i in range(9)] + [(1000, 1, 0), (2001, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels).collect()
    every = [(r[0], r[1]) for r in rows] + extra
    aside = {i: int(hashlib.md5(f"trusted:{i}".encode()).hexdigest()[:8], 16) % quality.SET_ASIDE == 0 for i in range(1000, 1060)}
    gram = lambda t: [int.from_bytes((t or "").encode()[i : i + 5], "big") % quality.BUCKETS for i in range(len((t or "").encode()) - 4)]
    raw, trusted = Counter(), Counter()
    for i, t in every:
        raw.update(gram(t))
        if i in aside and not aside[i]:
            trusted.update(gram(t))
    s, n, b = sum(raw.values()), sum(trusted.values()), quality.BUCKETS
    gain = {k: math.floor(1e6 * math.log((trusted[k] * (s + b) / (raw[k] + 1) + b) / (n + b))) for k in raw}
    want = []
    for i, t in every:
        m, g = measured(t), gram(t)
        want.append((i, m, m[0] < 10 or 100 * m[4] > 20 * m[0], sum(gain[x] for x in g) // max(1, len(g))))
    held = sorted(x[3] for x in want if aside.get(x[0]) and not x[2])
    threshold = held[int(len(held) * quality.LOST)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(i, m, f, not f and v >= threshold, v) for i, m, f, v in want], key=key) == sorted([(r["doc_id"], tuple(r[c] for c in quality.COLUMNS), r["base_failed"], r["kept"], r["score"]) for r in got], key=key)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert len(kept & set(range(1000, 1080))) >= 78
    assert not kept & set(range(2000, 2060))


def test_ratio_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs, _ = corpus(spark)
    assert all(r["kept"] != r["base_failed"] and r["threshold"] is None for r in quality.judged(docs, none).collect())
    assert quality.judged(spark.createDataFrame([], DOCS), none).collect() == []
    many = spark.createDataFrame([(i, 1, None) for i in range(4000)], "doc_id long, quality int, toxic int")
    assert 800 < quality.trusted_ids(many, 1000).count() < 1200


def features(text):
    w = FEATURE_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), Counter(zlib.crc32(x.encode()) % resampling.BUCKETS for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])


def test_blocks_are_the_matrix():
    pointers, which, counts, words = resampling.csr_block(pa.array(TEXTS), resampling.BUCKETS)
    for i, text in enumerate(TEXTS):
        n, want = features(text)
        cells = slice(pointers[i], pointers[i + 1])
        assert (int(words[i]), Counter(dict(zip(which[cells].tolist(), counts[cells].tolist(), strict=True)))) == (n, want)


def test_resampling_by_brute_force(spark):
    docs, rows = corpus(spark)
    rng = random.Random(5)
    extra = [(100 + i, " ".join(rng.choice(["alpha", "beta", "gamma", "Delta", "eps"]) for _ in range(rng.randrange(40)))) for i in range(200)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    target = ["alpha beta alpha", None, "Delta"]
    got = resampling.resample(docs.repartition(5), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), percent=40).collect()
    every = [(r[0], r[1]) for r in rows] + extra
    raw, wanted = Counter(), Counter()
    for _, t in every:
        raw.update(features(t)[1])
    for t in target:
        wanted.update(features(t)[1])
    s, n, b = sum(raw.values()), sum(wanted.values()), resampling.BUCKETS
    out = []
    for i, t in every:
        words, f = features(t)
        weight = sum(k * math.floor(1000 * math.log((wanted[x] + 1) * (s + b) / ((raw[x] + 1) * (n + b)))) for x, k in f.items()) // max(1, sum(f.values()))
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    able = able[: len(able) * 40 // 100]
    assert sorted(((r["rank"], r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got if r["rank"]), key=lambda x: x[0]) == [(k + 1, *x) for k, x in enumerate(able)]
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(((-1 if x[0] is None else x[0], *x[1:]) for x in out), key=key)


def test_resampling_ties_and_empty_tables(spark):
    same = " ".join(["word"] * 25)
    docs = spark.createDataFrame([(4, same), (4, same), (4, same), (None, same), (None, same), (9, "few words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    got = resampling.resample(docs, none, percent=100)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == [1, 2, 3, 4, 5]
    assert resampling.resample(none, docs).collect() == []


def brute(rows, anchor, label, k=5, most=10):
    fine = [(i, label(i, c), [math.floor(256 * x) for x in v]) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, c, v in {(i, c, tuple(v)) for i, c, v in fine if anchor(i)}:
        ranked = sorted((-dot(v, w), j, d) for j, d, w in fine)
        for p, j, _ in [x for x in ranked if x[2] == c and x[1] != i][:k]:
            found = [x for x in ranked if x[2] != c and -30 * p <= -100 * x[0] <= -90 * p][:most]
            out += [(i, j, n + 1, f[1], -p, -f[0]) for n, f in enumerate(found)]
    return sorted(out)


def test_negatives_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(3)), [float(np.float32(x)) for x in rng.normal(0, 0.3, 6)]) for i in range(300)]
    hot = rows[10][2]
    rows += [(1000 + i * 7919, 1, hot) for i in range(120)] + [(1000 + i * 7919, 2, [x * 0.75 for x in hot]) for i in range(120)]  # ties of scores and ids
    rows += [(20, 1, [0.5, 0.5]), (40, 0, []), (None, 1, hot), (41, None, hot), (42, 1, None), (43, 1, [1.0, None]), (44, 1, [float("nan")]), (45, 2, [float("inf")]), (rows[30][0], rows[30][1], rows[30][2]), (rows[5][0], 2, hot)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, label int, embedding array<double>, score string").repartition(5)
    want = brute(rows, lambda i: i % 10 == 0, lambda i, c: c)
    assert want
    got = lambda: sorted(map(tuple, negatives.hard_negatives(frame, frame["vec_id"] % 10 == 0).collect()))
    assert got() == want
    monkeypatch.setattr(negatives, "GROUP", 16)
    monkeypatch.setattr(negatives, "ROWS", 7)
    monkeypatch.setattr(negatives, "DIGIT", 2)
    assert got() == want


def test_negatives_of_large_scores_and_none(spark):
    rows = [(i, i % 2, [1e5 * (i + 1), 3e4]) for i in range(30)] + [(100, 0, [0.0, 0.0]), (200, 1, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, negatives.hard_negatives(frame, frame["vec_id"] % 10 == 0).collect())) == brute(rows, lambda i: i % 10 == 0, lambda i, c: c)
    assert negatives.hard_negatives(frame, frame["vec_id"] < 0).collect() == []
    assert negatives.hard_negatives(frame.limit(0), frame["vec_id"] % 10 == 0).collect() == []


def test_all_trusted_count(spark):
    """All trusted documents count, however many; rows without an id are dealt out and match none."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 50)) for _ in range(30)), "x") for i in range(300)]
    rows += [(None, rows[0][1], "x"), (None, None, "x"), (7, rows[8][1], "x")]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["score"])
    got = sorted(quality.judged(docs, labels).collect(), key=key)
    assert len(got) == len(rows) and got[0]["threshold"] is not None
    texts = docs.filter("doc_id is not null").repartition(3).unionByName(docs.filter("doc_id is null"))
    assert sorted(quality.judged(texts, labels).collect(), key=key) == got
    many = spark.range(70_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert quality.trusted_ids(many).count() == 70_000
    per = spark.createDataFrame([(s, 1 + abs(s) % 3) for s in range(-2500, 2500, 7)], "score long, count long")
    every = sorted(s for s in range(-2500, 2500, 7) for _ in range(1 + abs(s) % 3))
    for share in (0.0, 0.01, 0.37, 0.99):
        assert quality._score_at(per, share) == every[int(len(every) * share)]


def test_blocks_of_a_file_are_bounded(spark):
    """One task's large part of the input becomes many files, since a Parquet reader takes thousands of rows of a file at once."""
    docs = spark.range(400, numPartitions=1).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 60000) as text")
    blocks = resampling.csr_blocks(docs)
    files = [r["n"] for r in blocks.groupBy(resampling.F.input_file_name().alias("f")).agg(resampling.F.count("*").alias("n")).collect()]
    assert sum(files) > 2 * resampling.FILE_BLOCKS and max(files) <= resampling.FILE_BLOCKS
    assert blocks.select(resampling.F.sum(resampling.F.size("doc_ids"))).first()[0] == 400
