"""Language identification by cross-parsing entropy.

For every labelled language a suffix automaton of a bounded sample of its text is built. A text is
parsed greedily into the longest phrases that occur in the sample; the language that needs the
fewest phrases, normalised by the sample's size, wins.

Automata become dense tables in which a missing transition already leads to where the next phrase
starts, with a flag that counts it. Thousands of passages then walk all automata in lockstep, one
symbol a step, as array operations.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.llm.shared import small_batches, table

#: Letters that are looked at one by one, of all languages together; others are told apart by blocks of
#: code points, so scripts of many letters differ from each other too.
MOST_LETTERS, MOST_BLOCKS, BLOCK = 96, 128, 256
#: Symbols of a passage: a new phrase starts with each.
PASSAGE = 512
#: Bounds of the sample that a language is learnt from: documents, and symbols.
MOST_DOCS, MOST_SYMBOLS = 64, 24_000


@cache
def _letters() -> np.ndarray:
    """For every code point 2 if it is a letter, else 1."""
    return np.array([2 if chr(i).isalpha() else 1 for i in range(0x110000)], np.uint8)


class Automata:
    """Suffix automata of several languages over one alphabet, as one table."""

    def __init__(self, samples: dict[str, list[str]], most_symbols: int = MOST_SYMBOLS, most_letters: int = MOST_LETTERS):
        self.langs = sorted(samples)
        folded = {lang: " ".join(samples[lang]).lower()[: 2 * most_symbols] for lang in self.langs}
        # each language's letters by frequency; the alphabet takes the first of all languages, then the second, ...
        place: dict[str, int] = {}
        for text in folded.values():
            for i, (c, _) in enumerate(Counter(c for c in text if c.isalpha()).most_common()):
                place[c] = min(i, place.get(c, i))
        letters = sorted(sorted(place, key=lambda c: (place[c], c))[:most_letters])
        rest = Counter(ord(c) // BLOCK for c in place.keys() - set(letters))
        blocks = [b for b, _ in sorted(rest.items(), key=lambda x: (-x[1], x[0]))[:MOST_BLOCKS]]
        # 0: padding, 1: whatever is no letter, 2: other letters; then those of a block beyond the alphabet, then the alphabet
        self.width = 3 + len(blocks) + len(letters)
        self.symbols = _letters().copy()
        for i, block in enumerate(blocks):
            part = self.symbols[block * BLOCK : (block + 1) * BLOCK]
            part[part == 2] = 3 + i
        for i, c in enumerate(letters):
            for form in {c, *(f for f in (c.upper(), c.title()) if len(f) == 1 and f.lower()[:1] == c)}:
                self.symbols[ord(form)] = 3 + len(blocks) + i
        tables, self.roots, at = [], [], 0
        self.bits = []
        every = [self.encode(folded[lang])[:most_symbols] for lang in self.langs]
        # an automaton has at most two states a symbol; offsets are doubled in the table
        self.kind = np.int32 if sum(2 * len(s) + 2 for s in every) * self.width < 1 << 30 else np.int64
        for symbols in every:
            part = self._table(symbols.tolist(), at)
            tables.append(part)
            at += len(part)
            self.roots.append(at - self.width)
            self.bits.append(float(np.log2(max(2, len(symbols)))))
        self.table = np.concatenate(tables) if tables else np.zeros(0, self.kind)

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text; runs of what is no letter become one."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return squeezed(self.symbols[points])

    def _table(self, symbols: list[int], base: int) -> np.ndarray:
        go, link, length, last = [{}], [-1], [0], 0
        for c in symbols:
            new = len(go)
            go.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = new
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(go)
                    go.append(dict(go[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        # an entry: where the row of the next state starts, times 2, plus 1 if a phrase begins with this
        # symbol. The last row is where a text begins and where symbols that don't occur lead.
        starts = base + np.arange(len(go) + 1, dtype=np.int64) * self.width
        out = np.full((len(go) + 1, self.width), -1, np.int64)
        for i, edges in enumerate(go):
            for c, to in edges.items():
                out[i, c] = starts[to] * 2
        fresh = np.where(out[0] >= 0, out[0], starts[-1] * 2) + 1
        out = np.where(out >= 0, out, fresh)
        out[:, 0] = starts * 2
        return out.astype(self.kind).ravel()

    def phrases(self, passages: np.ndarray) -> np.ndarray:
        """passages: one per column; phrases of each, by language."""
        n = passages.shape[1]
        state = np.repeat(np.array(self.roots, self.kind) * 2, n).reshape(len(self.roots), n)
        count = np.zeros_like(state)
        for row in passages:
            state = self.table.take((state >> 1) + row)
            count += state & 1
        return count


def squeezed(symbols: np.ndarray) -> np.ndarray:
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 1) | (symbols[:-1] != 1)
    return symbols[keep]


def learn(docs: DataFrame, most_docs: int = MOST_DOCS, most_symbols: int = MOST_SYMBOLS) -> Automata:
    """Automata from docs (doc_id, text, lang): of every non-null lang the most_docs documents with
    text that come first by the md5 of their doc_id, at most most_symbols symbols together."""
    first = Window.partitionBy("lang").orderBy(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "text")
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "doc_id", F.substring("text", 1, 2 * most_symbols).alias("text"))
    ranked = usable.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= most_docs)
    samples: dict[str, list[str]] = {}
    for row in ranked.orderBy("lang", "nth").select("lang", "text").collect():
        texts = samples.setdefault(row["lang"], [])
        if sum(map(len, texts)) < 2 * most_symbols:
            texts.append(row["text"])
    return Automata(samples, most_symbols)


def predict(docs: DataFrame, automata: Automata, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, and lang_pred and score under the names in into, which replace columns of these names. A null text, one without a letter, or no learnt language gives und and 0.

    score is 1 less the ratio of the winner's normalised phrases to those of the second: 0 on a
    tie (the first language by name wins), 1 if only one language is known. Whole texts are
    parsed, in passages of PASSAGE symbols.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(automata)  # bounded: languages * MOST_SYMBOLS * 2 * width entries

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Automata = shared.value
        for batch in batches:
            preds, scores = [], []
            texts = batch["text"].to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < 1 << 20):
                    size += len(texts[to] or "")
                    to += 1
                p, s = _judged(model, [t or "" for t in texts[at:to]])
                preds += p
                scores += s
                at = to
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*names, *into])

    docs = docs.drop(*into)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())])
    return docs.mapInArrow(label, schema)


def _judged(model: Automata, texts: list[str]) -> tuple[list[str], list[float]]:
    if not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    symbols = model.symbols[points]
    doc = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 1) | (symbols[:-1] != 1) | (doc[1:] != doc[:-1])
    symbols, doc = symbols[keep], doc[keep]
    real = np.bincount(doc[symbols > 1], minlength=len(texts)) > 0
    sizes = np.bincount(doc, minlength=len(texts))
    counts = -(-sizes // PASSAGE)
    of = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passages = np.zeros((PASSAGE, len(of)), np.uint8)
    passages[within % PASSAGE, np.repeat(np.cumsum(counts) - counts, sizes) + within // PASSAGE] = symbols
    used = model.phrases(passages)
    total = np.stack([np.bincount(of, row, len(texts)) for row in used]) * np.array(model.bits)[:, None]
    best = total.argmin(0)
    order = np.sort(total, 0)
    score = 1 - order[0] / np.maximum(order[1], 1e-9) if len(order) > 1 else np.ones(len(texts))
    return [model.langs[b] if r else "und" for b, r in zip(best, real, strict=True)], np.where(real, np.clip(score, 0, 1), 0.0).tolist()


def op8_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages of all documents, learnt from those whose crc32(doc_id) mod 4 isn't 2. See predict() and learn() for every edge case; repeated rows get equal answers."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2)
    automata = learn(docs.filter(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), automata).drop("text")
