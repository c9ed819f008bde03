"""Mixing, chat formatting, packing and the link graph: exact cases, round trips, brute force, edge cases."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import chat, linkgraph, mixing, packing

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, size string"


def test_mix_targets_and_takes(spark):
    rows = [(i, " ".join(["w"] * (i % 13)), None, "a" if i % 3 == 0 else "b" if i % 7 else None, "clash") for i in range(400)]
    rows += [(400, None, None, "c", None), (401, "", None, "c", None), (7, "other row of an id", None, "b", None), (7, "other row of an id", None, "b", None)]
    frame = spark.createDataFrame(rows, DOCS)
    got = mixing.fair_mix(frame).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by.setdefault((r["source_size"], r["target"]), 0)
        by[r["source_size"], r["target"]] += r["taken"]
    total = sum(s for s, _ in by)
    assert sum(t for _, t in by) == pytest.approx(min(1.5 * total, 2 * total))
    for (size, target), taken in by.items():
        assert target <= 2 * size + 1e-9
        assert abs(taken - target) <= 13
    again = mixing.fair_mix(frame.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.fair_mix(spark.createDataFrame([], DOCS)).collect() == []


def test_mix_without_words(spark):
    got = mixing.fair_mix(spark.createDataFrame([(1, None, None, None, None), (2, " ", None, "x", None)], DOCS)).collect()
    assert [(r["size"], r["taken"]) for r in got] == [(0, 0), (0, 0)]


@pytest.mark.parametrize(("query", "sql"), [(mixing.op2_fair_mix, mixing.OP2_SQL), (chat.op6_typed_chat, chat.OP6_SQL)])
def test_queries_equal_sql(spark, query, sql):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    want = con.sql(sql).df()
    got = query(spark, DATA).toPandas()[list(want.columns)]
    order = list(want.columns)
    assert want.sort_values(order).reset_index(drop=True).equals(got.sort_values(order).reset_index(drop=True))


def test_chat_round_trip(spark):
    texts = ["plain", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\| \\ <| <", None, "", "<|image|>", "x" * 200_000, "a\nb", "é<|😀"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, 5) for i, t in enumerate(texts)] + [(2, None, None, "no turn", 5), (2, 0, "us\ner", "t", 5), (2, 0, "us\ner", "t", 5), (None, 0, "assistant", "no id", 5)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    chats = chat.format_chat(frame)
    got = {r["conv_id"]: r for r in chats.select("conv_id", "n_turns", "formatted", chat.parsed_turns(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("formatted"), F.col("loss_spans")).alias("learnt")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert got[1]["learnt"] == "".join(t or "" for t in texts[1::2])
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "no turn"), ("us\ner", "t"), ("us\ner", "t")]
    assert got[None]["learnt"] == "no id"
    assert chat.format_chat(frame.limit(0)).collect() == []


def test_chat_parts(spark):
    part = lambda kind, text=None, **k: {"type": kind, "text": text, "uri": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    rows = [(1, 0, "user", None, [part("text", "see <|image|> "), part("image", uri="a.png", width=57, height=28), part("audio", uri="b.wav", seconds=1.5), part("document", uri="c.pdf", pages=3), part("text", " end")]), (1, 1, "assistant", "yes", None)]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts array<{chat.PART}>")
    got = chat.format_chat(frame).collect()[0]
    assert got["formatted"] == "<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|document|> end<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert [tuple(a) for a in got["attachments"]] == [(1, "image", "a.png", 3), (1, "audio", "b.wav", 38), (1, "document", "c.pdf", 1536)]
    start, size = got["loss_spans"][0]
    assert got["formatted"][start : start + size] == "yes"


def test_chat_plan_is_native(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_chat(frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_packing(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = [None, "", "a", "hello <|endoftext|> there", "é 中文 😀 \u3000 \n\n  x", "word " * 5000, "it's a test's"] + [f"line {i} " * (i % 300) for i in range(120)]
    rows = [(i, t, "e", "s", "x") for i, t in enumerate(texts)] + [(3, texts[3], "e", "s", "x")]
    got = packing.pack(packing.token_pieces(spark.createDataFrame(rows, DOCS))).toPandas()
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in enumerate(texts)}
    for i, of in got.groupby("doc_id"):
        copies = 2 if i == 3 else 1
        assert of["length"].sum() == copies * len(ids[i])
        for r in of.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[i][r.start : r.start + r.length].tobytes())
            assert r.piece == 0 or r.length == 1024
        assert len(of) == copies * -(-len(ids[i]) // 1024)
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed["offset"] == placed.groupby("sequence_id")["length"].cumsum() - placed["length"]).all()
    assert placed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 1024) + 1
    assert packing.pack(packing.token_pieces(spark.createDataFrame([], DOCS))).collect() == []


def test_plan_uses_every_piece():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = np.bincount(rng.integers(1, 65, 500), minlength=65)
        used = Counter()
        for parts, n in packing.plan(counts, 64):
            assert sum(length * m for length, m in parts) <= 64
            for length, m in parts:
                used[length] += m * n
        assert [used[i] for i in range(65)] == counts.tolist()


RULES = [("com", "/", "allow"), ("bad.org", "/", "block"), ("x.bad.org", "/ok", "allow"), ("bad.org", "/", "allow"), ("net", "/es/", "block")]


def brute_graph(pages, rules, least=linkgraph.LEAST):
    """Verdicts by plain loops."""
    import re

    parsed = []
    for i, url, html in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        parsed.append((i, m[1].lower() if m else "", m[2] if m else "", html))
    out, share = [], {}
    for i, host, path, _ in parsed:
        fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else None
        out.append([i, host, path, best[2] if best else None, best[1] if best else None])
        s = share.setdefault(host, [0, 0, 0])
        s[0] += 1
        s[1] += best is not None and best[1] == "allow"
        s[2] += best is not None and best[1] == "block"
    edges = Counter((h, d.lower()) for _, h, _, html in parsed for d in re.findall(linkgraph.LINK, html or "") if h and d.lower() != h)
    kin = set()
    for h in {p[1] for p in parsed}:
        line = h.split(".")
        if len(line) <= linkgraph.MOST_LABELS and re.search("[^0-9.]", h):
            ups = [".".join(line[i:]) for i in range(len(line) - 1)]
            kin |= set(zip(ups, ups[1:], strict=False))
    for a, b in kin:
        if a and b:
            edges[a, b] += 1
            edges[b, a] += 1
    hosts = set(share) | {h for e in edges for h in e}
    own = {h: tuple(0.15 * x / share[h][0] for x in share[h][1:]) if h in share else (0, 0) for h in hosts}
    score = dict(own)
    outs, ins = Counter(), Counter()
    for (a, b), n in edges.items():
        outs[a] += n
        ins[b] += n
    for _ in range(60):
        new = {h: list(own[h]) for h in hosts}
        for (a, b), n in edges.items():
            new[b][0] += 0.85 * score[a][0] * n / outs[a]
            new[a][1] += 0.85 * score[b][1] * n / ins[b]
        score = new
    for r in out:
        trust, distrust = score[r[1]]
        r[4] = r[4] or ("block" if r[1] and distrust > trust and distrust >= least else "allow")
    return sorted(map(tuple, out), key=str)


def test_link_graph(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a><A HREF = //{h}>' for h in hosts)
    pages = [(1, "http://A.com/x", link("good.net")), (2, "http://bad.org/x?q#f", ""), (3, "https://shady.net/", link("bad.org", "bad.org")), (4, "http://good.net", link("a.com")), (5, "http://x.bad.org/ok/1", None), (6, None, link("bad.org")), (7, "no scheme", ""), (8, "u://lonely.io#x", link("lonely.io")), (9, "http://farm.net/1", link("shady.net", "bad.org", "good.net")), (10, "http://a.b.kin.net/es/1", ""), (11, "http://a.b.kin.net/1", None), (12, "http://c.kin.net", ""), (13, "http://10.0.0.1/", ""), (14, "http://" + "x." * 200 + "long.net/es/", ""), (15, "http://..odd..net/es/", ""), (9, "http://farm.net/1", link("shady.net"))]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = linkgraph.judged(frame, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    want = brute_graph(pages, RULES)
    assert sorted(map(tuple, got), key=str) == want
    assert {w[1]: w[4] for w in want}["shady.net"] == "block"
    assert ("a.b.kin.net", "block") in {(w[1], w[4]) for w in want if w[3] is None}
    assert linkgraph.judged(frame.limit(0), rules).collect() == []


def test_rules_query_by_brute_force(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    got = linkgraph.op7_link_graph(spark, DATA).collect()
    assert sorted(map(tuple, got), key=str) == brute_graph(rows, list(linkgraph.RULES))
