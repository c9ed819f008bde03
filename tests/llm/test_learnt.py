"""Language ID, digests, audio, the mixture and the pipeline: brute force, round trips, held-out accuracy, edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridweave.llm import digests, langid, media, mixture

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def longest_phrases(text, sample):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in sample:
            size += 1
        at += max(1, size - 1)
        n += 1
    return n


def test_phrases_equal_brute_force():
    rng = random.Random(1)
    samples = {lang: ["".join(rng.choice(letters) for _ in range(600))] for lang, letters in (("a", "abc "), ("b", "acd "))}
    model = langid.Automata(samples, 500)
    sample = {lang: model.encode(" ".join(s).lower())[:500].tobytes() for lang, s in samples.items()}
    text = model.encode("".join(rng.choice("abcd x") for _ in range(200)))
    got = model.phrases(text[:, None])[:, 0]
    assert got.tolist() == [longest_phrases(text.tobytes(), sample[lang]) for lang in model.langs]


def test_language_accuracy_and_edges(spark):
    got = langid.op8_cross_parsing(spark, DATA).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    rows = [(1, None, "en", None, None), (2, "", "en", None, None), (3, "12 + 3 😀", None, None, None), (4, "the and of " * 50, "en", None, None), (4, "der die das " * 50, "de", None, None), (None, "the of and", None, None, None), (6, "the of " * 60_000, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    out = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(frame, langid.learn(frame)).collect()]
    assert out == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "de"), (None, "en"), (6, "en")]
    assert {r["lang_pred"] for r in langid.predict(frame, langid.learn(frame.limit(0))).collect()} == {"und"}


def test_digests():
    texts = ["", "abc", "x" * 100, "the quick brown fox jumps over the lazy dog " * 30]
    rng = random.Random(0)
    other = "".join(rng.choice("qzxjkvw ") for _ in range(1300))
    edited = texts[3].replace("lazy", "busy", 3)
    rows = digests.digests(pa.array([*texts, edited, other, texts[3], None]))
    assert (rows[3] == rows[6]).all() and (rows[0] == rows[7]).all()
    like = digests.likeness(rows[[3, 3, 3]], rows[[6, 4, 5]])
    assert like[0] == 1 and like[0] > like[1] > like[2] >= 0
    # buckets by a plain loop
    data, mask = texts[3].encode(), 0xFFFFFFFF
    counts = Counter()
    for i in range(4, len(data)):
        for a, b, salt in digests._TRIPLETS:
            h = (data[i] * digests._WEIGHTS[0] + data[i - a] * digests._WEIGHTS[1] + data[i - b] * digests._WEIGHTS[2] + salt * 0x27D4EB2F) & mask
            h = (h ^ h >> 15) * 0x2C1B3C6D & mask
            counts[h >> 25] += 1
    ranked = sorted(counts[i] for i in range(128))
    q = [ranked[31], ranked[63], ranked[95]]
    want = [sum(counts[i] > x for x in q) for i in range(128)]
    assert [int(rows[3][3 + i // 4]) >> 2 * (i % 4) & 3 for i in range(128)] == want


def test_next_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = sorted(docs)
    got = {r["doc_id"]: r for r in digests.op5_quartile_digest(spark, DATA).collect()}
    for i, doc in enumerate(ids):
        text, after = docs[doc], docs[ids[(i + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[doc]["n_chars"] == len(text)
    keep = lambda ids, texts, nexts: pa.RecordBatch.from_arrays([ids, texts, nexts], ["doc_id", "text", "next"])
    for rows in ([], [(5, "only")], [(None, "n"), (3, "c"), (3, "b"), (1, None), (9, "z")]):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        want = [(d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order)]
        out = [tuple(r) for r in digests.with_next(frame, keep, "doc_id long, text string, next string").collect()]
        assert sorted(out, key=str) == sorted(want, key=str)


def test_audio(spark):
    x = np.sin(np.arange(8000) / 8000 * 2 * math.pi * 440).astype(np.float32)
    y = media.resampled(x)
    want = np.sin(np.arange(6400) / 6400 * 2 * math.pi * 440)
    lag = max(range(0, 24), key=lambda k: float(y[k + 100 : 3000 + k] @ want[100:3000]))
    assert np.abs(y[lag + 200 : lag + 2000] - want[200:2000]).max() < 0.25
    assert media.segmented(np.array([0, 3, 6, 3, 0, 3, 3, 0, 9, 0.0]), 0.5, 0.25).tolist() == [[1, 4], [8, 9]]
    for payload in (bytes(64), bytes(range(256)) * 3):
        assert media.read_back(media.stored(payload)) == (payload, media.RATE)
    rows = [(1, None), (2, ""), (3, "é" * 40), (4, "x" * 64), (5, "long " * 60_000), (5, "x" * 64)]
    got = media.audio_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r, (_, text) in zip(got, rows, strict=True):
        body = (text or "").encode()
        samples, _ = media.read_back(bytes(r["media"]))
        assert samples.startswith(body) and not samples[len(body) :].strip(b"\0") and len(samples) % 64 == 0 and len(samples) - len(body) <= 64
        assert len(r["tensor"]) == media.BINS * media.MELS
        assert all(0 <= s["start"] < s["stop"] <= len(samples) / media.RATE for s in r["spans"])
    assert got[3]["tensor"] == got[5]["tensor"]
    tensor = media.tensor_array(pa.array([r["tensor"] for r in got], pa.list_(pa.float32())))
    assert tensor.type.shape == [media.BINS, media.MELS]


def test_mixture_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None] for i, t in docs.items()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(t for i, ts in tokens.items() if i not in held for t in ts)
    n, v = sum(counts.values()), len(counts)
    for r in mixture.op1_context_mixing(spark, DATA).collect():
        ts = tokens[r["doc_id"]]
        assert r["held_out"] == (r["doc_id"] in held)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(counts[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts))
        assert r["score"] < 0


def small_model(texts):
    hashes = mixture.Stream(pa.array(texts)).hash
    keys, counts = np.unique(hashes[hashes != mixture._END_TOKEN], return_counts=True)
    keep = counts > 1
    letters = np.ones(mixture.STOP + 1, np.int64) + np.arange(mixture.STOP + 1) % 7
    words = mixture.Vocabulary(keys[keep], counts[keep], len(texts), int(counts[~keep].sum()), letters)
    pairs = np.random.default_rng(0).integers(0, 1 << 16, mixture.SLOTS).astype(np.uint16)
    return mixture.Model(words, pairs)


TEXTS = ["some words and some other words and more", "and some words, é rare 😀 thing", "", "more more more and some words and some other words and more"] * 2


def no_match(stream):
    return np.full(len(stream.ids), mixture._NONE), np.zeros(len(stream.ids), np.int64)


def test_mixture_codes_decode():
    """The bits of texts, read back through both trees, are the texts."""
    model = small_model(TEXTS)
    v = model.vocabulary
    for code in (v.words, v.letters):
        assert sum(2.0**-s for s in code.sizes.tolist()) == pytest.approx(1)
    stream = mixture.Stream(pa.array(TEXTS)).named(v)
    symbols = np.arange(len(stream.of))
    parts = [(at, bit) for _, _, at, _, _, bit in model.bits(stream, np.zeros(len(TEXTS), bool), no_match(stream), symbols)]
    at, bit = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(at, kind="stable")  # of one symbol, the word's bits and then the letters'
    text, bit = stream.of[at[order]], bit[order]
    trees = [{tuple(c.bits[a : a + n].tolist()): i for i, (a, n) in enumerate(zip(c.starts.tolist(), c.sizes.tolist()))} for c in (v.words, v.letters)]  # noqa: B905
    names = {int(h): w for t in TEXTS for w in t.split() for h in [mixture.Stream(pa.array([w])).hash[0]]}
    by_id = {int(i): names[int(k)] for k, i in zip(v.keys, v.ids, strict=True)}
    for d, t in enumerate(TEXTS):
        out, path, tree, letters = [], (), 0, []
        for b in bit[text == d].tolist():
            path += (b,)
            if path not in trees[tree]:
                continue
            found, path = trees[tree][path], ()
            if tree == 0:
                tree = int(found == v.escape)
                if found < v.escape:
                    out.append(by_id[found])
            elif found == mixture.STOP:
                out.append(bytes(letters).decode())
                letters, tree = [], 0
            else:
                letters.append(found)
        assert out == t.lower().split()
        assert not path


def test_mixture_steps(monkeypatch):
    """Scores don't depend on what else is in the batch, and even short texts move their weights."""
    model = small_model(TEXTS)
    one = lambda texts: model.scores(s := mixture.Stream(pa.array(texts)).named(model.vocabulary), np.zeros(len(texts), bool), no_match(s))
    texts = [TEXTS[0] * 3, *TEXTS[:4], "long words " * 500]
    together = one(texts)
    assert together == pytest.approx([one([t])[0] for t in texts], rel=1e-4)
    monkeypatch.setattr(mixture, "RATE", 0.0)
    assert abs(one(texts)[0] - together[0]) > 1e-3


def test_mixture_knows_copies(spark):
    """A text that occurs twice is expected by its copy; one that occurs once isn't known to itself."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(120))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    got = {r["doc_id"]: r for r in mixture.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") > 103).collect()}
    twice = [got[i]["bits_per_byte"] for i in (0, 1, 2, 3, 100, 101, 102, 103, 104)]
    once = [got[i]["bits_per_byte"] for i in (4, *range(5, 60))]
    assert max(twice) < min(once)
    assert got[0]["score"] == pytest.approx(got[100]["score"])


def test_mixture_beats_the_base(spark):
    got = mixture.op1_context_mixing(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_mixture_cuts_long_texts(spark, monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", text]), pa.array([1, 2])], ["text", "id"])
    whole = mixture.Stream(batch["text"])
    monkeypatch.setattr(mixture, "CUT", 500)
    monkeypatch.setattr(mixture, "_SLICE", 1000)
    parts = list(mixture._streams(iter([batch])))
    assert len(parts) > 10
    assert np.concatenate([s.hash for _, _, s in parts]).tolist() == whole.hash.tolist()


def test_mixture_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "The  the\nTHE", "a"), (3, "the the the", "a"), (4, "w" * 300_000, "a"), (None, "the", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(mixture.score_texts(frame, F.col("doc_id") == 99).collect(), key=lambda r: r["doc_id"] or 9)
    assert [r["n_tokens"] for r in got] == [1, 1, 4, 4, 2, 2]
    assert got[2]["score"] == got[3]["score"] and got[0]["score"] == got[1]["score"]
    assert mixture.score_texts(frame.limit(0), F.lit(False)).collect() == []
    assert [r["n_known"] for r in mixture.score_texts(frame.limit(2), F.lit(True)).collect()] == [0, 0]


def test_pipeline(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    base = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(12)]
    rows = [(i, f"{t} end{i}", "en", f"s{i % 2}", 1) for i, t in enumerate(base)]
    rows += [(20, base[0] + " end0 more", "en", "s0", 1), (21, base[1] + " end1", "en", "s1", 1), (22, "123 456", None, "s1", 1), (23, None, None, None, None)]
    rows += [(30, f"{base[2][:40]} own {passage} tail", None, "s0", 1), (31, f"{base[3][:40]} mine {passage} rest é", "en", "s0", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, "")
    assert {r[0] for r in rows} - {r["doc_id"] for r in kept.collect()} == {22, 23}
    single = stages["near_duplicates"](spark, kept, "")
    assert {r["doc_id"] for r in kept.collect()} - {r["doc_id"] for r in single.collect()} == {20, 21}
    cut = {r["doc_id"]: r for r in stages["repeated_passages"](spark, single, "").collect()}
    assert "shared5 " not in cut[30]["text"] and "own" in cut[30]["text"] and "tail" in cut[30]["text"] and cut[31]["text"].endswith("é")
    assert cut[5]["text"] == rows[5][1] and cut[30]["n_chars"] == len(cut[30]["text"])
    mixed = stages["source_mix"](spark, single, "")
    assert mixed.columns == docs.columns and 0 < mixed.count() < single.count()
    assert stages["packing"](spark, mixed, "").count() > 0


def test_pipeline_drops_copies_of_four_fifths(spark):
    base = [f"w{j}" for j in range(50)]
    changed = [*base[:20], "other", *base[21:]]  # 41 of 51 shingles
    rows = [(1, " ".join(base), "en", "s", 1), (2, " ".join(changed), "en", "s", 1), (3, " ".join(f"x{j}" for j in range(50)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_pipeline_leaves_no_texts(spark):
    from pathlib import Path

    words = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    rows = [(i, words(f"w{i}x", 80), "en", f"s{i % 2}", 1) for i in range(6)]
    rows += [rows[0], (None, rows[1][1], "en", "s0", 1), (7, None, None, "s1", 1), (7, None, None, "s1", 1), (8, words("w2x", 80) + " more", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    stages = dict(corpus_pipeline.STAGES)
    got = {}
    for name in ("near_duplicates", "repeated_passages", "source_mix"):
        before = set(folder.glob("gridweave-*"))
        out = stages[name](spark, docs, "")
        left = [spark.read.parquet(str(p)) for p in set(folder.glob("gridweave-*")) - before]
        assert len(left) <= 2 and not any({"text", "body"} & set(t.columns) for t in left)
        got[name] = sorted(((r["doc_id"], r["source"]) for r in out.collect()), key=str)
    assert got["near_duplicates"] == [(0, "s0"), (1, "s1"), (2, "s0"), (3, "s1"), (4, "s0"), (5, "s1"), (7, "s1"), (7, "s1")]
    assert (7, "s1") not in got["source_mix"] and 5 <= len(got["source_mix"]) < 9


def test_scripts_of_many_letters(spark):
    rng = np.random.default_rng(6)
    first, last = {"han": 0x4E00, "kana": 0x3041, "hangul": 0xAC00, "cyrillic": 0x430}, {"han": 0x9FA5, "kana": 0x3096, "hangul": 0xD7A3, "cyrillic": 0x44F}
    text = lambda lang: "".join(map(chr, rng.integers(first[lang], last[lang], 80)))
    docs = spark.createDataFrame([(i, text(lang), lang) for lang in first for i in range(20)], "doc_id int, text string, lang string")
    model = langid.learn(docs)
    assert model.width <= 3 + langid.MOST_LETTERS + langid.MOST_BLOCKS
    fresh = spark.createDataFrame([(i, text(lang), lang) for lang in first for i in range(10)], "doc_id int, text string, lang string")
    got = langid.predict(fresh, model).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_capitals_are_the_same_letters():
    model = langid.Automata({"x": ["Straße ÄÖ déjà"]})
    assert (model.encode("STRASSE äö DÉJÀ") == model.encode("strasse ÄÖ déjà")).all()


def test_audio_query_by_brute_force(spark):
    import hashlib
    import io
    import wave
    import zlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = media.op9_audio_features(spark, DATA).collect()
    kept = {r["doc_id"]: r for r in media.audio_columns(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    by_text = {}
    for r in got:
        body = (docs[r["doc_id"]] or "").encode()
        want = body.ljust(max(64, -(-len(body) // 64) * 64), bytes(1))
        stored = kept[r["doc_id"]]["media"]
        with wave.open(io.BytesIO(bytes(stored))) as sound:
            assert sound.getsampwidth() == 1 and sound.readframes(sound.getnframes()) == want
            seconds = sound.getnframes() / sound.getframerate()
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(body), len(want), zlib.crc32(want[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["media_sha256"] == hashlib.sha256(stored).hexdigest() and r["media_bytes"] == len(stored)
        tensor = np.array(kept[r["doc_id"]]["tensor"], np.float32).reshape(media.BINS, media.MELS)
        assert np.isfinite(tensor).all() and f"mel={','.join(f'{v:.3f}' for v in tensor.mean(0))};" in r["feature"]
        assert all(0 <= x["start"] < x["stop"] <= seconds for x in kept[r["doc_id"]]["spans"])
        by_text.setdefault(docs[r["doc_id"]] or "", set()).add(r["feature"])
    assert all(len(v) == 1 for v in by_text.values())


def test_automata_of_many_languages(monkeypatch):
    """Tables of 200 languages, and the same answers from wide offsets."""
    rng = np.random.default_rng(11)
    syllables = ["".join(rng.choice(list("bcdfghklmnprstvz"), 1)) + "".join(rng.choice(list("aeiou"), 1)) for _ in range(60)]
    samples, texts = {}, {}
    for k in range(200):
        own = rng.choice(syllables, 8)
        draw = lambda n: " ".join("".join(rng.choice(own, 3)) for _ in range(n))  # noqa: B023, E731
        samples[f"l{k:03}"], texts[f"l{k:03}"] = [draw(60)], draw(40)
    model = langid.Automata(samples, 400)
    got, _ = langid._judged(model, list(texts.values()))
    assert sum(a == b for a, b in zip(got, texts, strict=True)) >= 190
    assert model.table.dtype == np.int32
    wide = langid.Automata.__new__(langid.Automata)
    wide.__dict__.update(model.__dict__, table=model.table.astype(np.int64), kind=np.int64)
    assert langid._judged(wide, list(texts.values()))[0] == got


def test_mixture_fits_all_documents(spark, monkeypatch):
    """The start of weights and map comes from every training document, however many."""
    seen, fitted = [], mixture.fitted

    def watched(vocabulary, pairs, docs, *rest):
        seen.append(docs.count())
        return fitted(vocabulary, pairs, docs, *rest)

    monkeypatch.setattr(mixture, "fitted", watched)
    rows = spark.range(5000).selectExpr("id as doc_id", "concat('w', id % 7, ' v', id % 11) as text")
    got = mixture.score_texts(rows, F.col("doc_id") % 10 == 0).agg(F.count("*"), F.count("score")).first()
    assert seen == [4500] and tuple(got) == (5000, 5000)


def test_mixture_fits_from_counts(spark):
    """One pass counts every bit of every training document, and the weights are those that all bits one by one give."""
    model = small_model(TEXTS)
    model.pairs &= 0x0F0F  # counts below 16
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["some", "words", "and", "other", "more", "rare", f"x{rng.randrange(50)}"]) for _ in range(60)) for _ in range(40)]
    none = "array<struct<key:long,times:long,low:binary,high:binary>>"
    docs = spark.createDataFrame([(t, False) for t in texts], "text string, held_out boolean").selectExpr("*", f"cast(null as {none}) as matches").repartition(3)
    sent = [spark.sparkContext.broadcast(x) for x in (model.vocabulary, mixture.Pairs(model.pairs))]
    stream = mixture.Stream(pa.array(texts)).named(model.vocabulary)
    bits = list(model.bits(stream, np.ones(len(texts), bool), no_match(stream), np.arange(len(stream.of))))
    counted = {r["block"]: mixture._decoded(pa.scalar(r["counts"]), mixture.FIT_CELLS, np.int64).sum() for r in mixture.fit_counts(docs, *sent).collect()}
    gates = np.concatenate([first + gate.astype(int) for first, _, _, _, gate, _ in bits])
    assert counted == {int(g): int(n) for g, n in zip(*np.unique(gates, return_counts=True), strict=True)}
    x, bit = np.concatenate([b[3] for b in bits]).astype(float), np.concatenate([b[5] for b in bits])
    got, start = mixture.fitted(*sent, docs), model.weights[0].astype(float)
    for g in counted:
        xs, y, w = x[gates == g], bit[gates == g], start
        for _ in range(4):
            p = 1 / (1 + np.exp(-xs @ w))
            w = np.clip(w + np.clip(np.linalg.solve((xs.T * (p * (1 - p))) @ xs + 5 * np.eye(4), xs.T @ (y - p) - 5 * (w - start)), -1.5, 1.5), -8, 8)
        loss = [np.logaddexp(0, -(2 * y - 1.0) * (xs @ v)).mean() for v in (w, got.weights[g])]
        assert loss[1] == pytest.approx(loss[0], abs=0.01)


def test_mixture_codes_repeats_once():
    """What a symbol's bits depend on is coded once, however often it occurs; learnt texts, whose own occurrence is taken away, apart."""
    model = small_model(TEXTS)
    streams = [mixture.Stream(pa.array(TEXTS[:3] * n)).named(model.vocabulary) for n in (2, 40)]
    one, many = (model.coded(s, np.arange(len(s.bounds) - 1) % 6 < 3, no_match(s)) for s in streams)
    assert (len(one.words.bit), len(one.letters.bit)) == (len(many.words.bit), len(many.letters.bit))
    for n, s in zip((2, 40), streams, strict=True):
        kept = model.scores(s, np.arange(3 * n) % 6 < 3, no_match(s))
        assert kept == pytest.approx(np.tile(kept[:6], n // 2), rel=1e-4)
        assert kept[0] != kept[3]
