"""The run-length index and the removal of repeats against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from gridweave.llm import suffixes

SCHEMA = "doc_id long, text string, spans int"


def test_clashing_names(spark):
    rows = [(1, "x" * 90, 7, 8, 9), (None, "y" * 30, 7, 8, 9), (2, None, 7, 8, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, uid long, marks long, spans long")
    got = suffixes.repeated_spans(frame, 40, 8)
    assert got.columns == ["doc_id", "text", "uid", "marks", "spans"]
    assert sorted((r["doc_id"] or 0, r["uid"], r["marks"], len(r["spans"])) for r in got.collect()) == [(0, 7, 8, 0), (1, 7, 8, 1), (2, 7, 8, 0)]
    kept = suffixes.repeated_spans(frame, 40, 8, into="found")
    assert sorted(r["spans"] for r in kept.collect()) == [9, 9, 9]


def test_query_by_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = suffixes.op3_run_index(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == brute(rows, 200)


def brute(rows, length):
    seen = {}
    for _, text, *_ in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = [True] * length
        spans = [j for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1])]
        out.append((i, len(b), sum(gone), len(spans), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed, length):
    rng = random.Random(seed)
    letters = "abä c"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(rng.randint(length // 2, 3 * length)) for _ in range(6)]
    rows = []
    for _ in range(60):
        parts = [rng.choice([text(rng.randint(0, 2 * length)), rng.choice(passages)]) for _ in range(rng.randint(0, 5))]
        body = list("".join(parts))
        for _ in range(rng.randint(0, 2)):
            if body:
                body[rng.randrange(len(body))] = "x"
        rows.append((len(rows), "".join(body), 0))
    rows += [(len(rows) + i, t, 0) for i, t in enumerate([None, "", "a" * (length - 1), "a" * length, "b" * (2 * length), "ab" * length, rows[0][1], rows[1][1], rows[1][1]])]
    return rows


def digests(frame, length, gram):
    out = []
    for r in suffixes.repeated_spans(frame, length, gram).collect():
        b = (r["text"] or "").encode()
        spans = [s.asDict() for s in r["spans"]]
        out.append((r["doc_id"], len(b), sum(s["stop"] - s["start"] for s in spans), len(spans), hashlib.sha256(suffixes.kept_bytes(r["text"], spans)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "length", "gram"), [(1, 40, 8), (2, 20, 3), (3, 60, 32)])
def test_against_brute_force(spark, seed, length, gram):
    rows = corpus(seed, length)
    frame = spark.createDataFrame(rows, SCHEMA).drop("spans")
    assert digests(frame, length, gram) == brute(rows, length)


def test_blocks_of_a_long_text(spark, monkeypatch):
    rng = random.Random(5)
    part = "".join(rng.choice("abc") for _ in range(900))
    rows = [(1, part + "x" * 10 + part[:500] + "yz", 0), (2, part[200:700], 0), (1, "other text under one id", 0)]
    whole = digests(spark.createDataFrame(rows, SCHEMA).drop("spans"), 50, 8)
    assert whole == brute(rows, 50)
    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    assert len(suffixes.segments(data, np.array([0, len(data)]), 50, 8)[0]) > 10


def test_empty_table(spark):
    assert suffixes.repeated_spans(spark.createDataFrame([], SCHEMA).drop("spans")).collect() == []


def test_index_statistics():
    rng = random.Random(3)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(12)]
    strings += strings[:3]
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    index = suffixes.RunIndex(data, bounds)
    assert index.runs < len(data)
    suffix = [(s[i:], (k, i)) for k, s in enumerate(strings) for i in range(len(s))]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905, E731
    want = [max(common(a, b) for b, there in suffix if there != here) for a, here in suffix]
    assert index.statistics().tolist() == want
    order = suffixes.suffix_array(data, np.repeat(bounds[1:], np.diff(bounds)))
    assert [suffix[i][0] for i in order] == sorted(s for s, _ in suffix)
    assert pa.array([1]) is not None
