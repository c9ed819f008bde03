"""A corpus pipeline of the training-data operators, stage by stage.

Every stage takes all that its predecessor kept and, but for the last, returns the columns of
documents. run() writes each stage's result to the shared folder and reads it again, so an executor
that is lost costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm.jaccard import near_components
from gridweave.llm.langid import learn, predict
from gridweave.llm.mixing import fair_mix, row_name
from gridweave.llm.packing import pack, token_pieces
from gridweave.llm.shared import dropped, written
from gridweave.llm.suffixes import repeated_spans

#: Words and percent of the near-duplicate stage; the mix's share of all words, without repeats.
WORDS, PERCENT, SHARE = 5, 80, 0.9


#: Names of what stages add for their own use; no column of documents has them.
ROW, LANG, SCORE, SPANS, TAKES, NTH = (f"gridweave {name}" for name in ("row", "lang", "score", "spans", "takes", "nth"))


def first_of_each(rows: DataFrame, names: list[str], most: Column | int, every: Column) -> DataFrame:
    """The first rows, at most so many but where every holds, of those with one ROW, a hash: texts aren't written again only to number them.

    Rows with one hash differ in other columns at most, whose hash is their order.
    """
    rest = [n for n, kind in rows.select(*names).dtypes if n != "text" and "map<" not in kind]
    nth = F.row_number().over(Window.partitionBy(ROW).orderBy(F.xxhash64(*rest)))
    return rows.withColumn(NTH, nth).filter(every | (F.col(NTH) <= most)).select(*names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language (no text, or no letter); a missing lang becomes the predicted one.

    Equal texts get equal answers, ids don't matter, an empty table stays empty, long texts are parsed
    whole and other columns are kept, whatever their names.
    """
    named = predict(docs, learn(docs), (LANG, SCORE)).filter(F.col(LANG) != "und")
    return named.withColumn("lang", F.coalesce("lang", F.col(LANG))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the least doc_id, null last; of repeated rows one.

    Rows without words are in no group and stay. An empty table stays empty; other columns are kept.
    """
    rows = docs.withColumn(ROW, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    near = near_components(rows.select(F.col(ROW).alias("doc_id"), "text"), WORDS, PERCENT)
    found = near.groupBy(F.col("doc_id").alias(ROW)).agg(F.min("component_id").alias("component_id"), F.max("n_shingles").alias("size"))  # repeated rows have one hash
    groups = rows.groupBy(ROW).agg(F.min("doc_id").alias("doc_id")).join(found.hint("merge"), ROW).groupBy("component_id")
    first = groups.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(ROW).alias("row"))).alias("first"), F.max("size").alias("size"))
    first = written(first.select(F.col("first.row").alias(ROW), F.col("size").alias(TAKES)))
    dropped(near)
    return first_of_each(rows.join(first.hint("merge"), ROW), docs.columns, 1, F.col(TAKES) == 0)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every long byte string that repeats, by whole characters; a document that is nothing else goes.

    Null and short texts stay as they are, ids don't matter, repeated rows are cut whole and go, an
    empty table stays empty, other columns are kept. n_chars, if there is one, is counted anew.
    """

    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, spans in zip(batch["text"], batch[SPANS].to_pylist(), strict=True):
                text = text.as_py()
                if spans:
                    body, at, out = text.encode(), 0, []
                    for span in spans:
                        start, stop = span["start"], span["stop"]
                        while start < len(body) and body[start] & 0xC0 == 0x80:
                            start += 1
                        while stop < len(body) and body[stop] & 0xC0 == 0x80:
                            stop -= 1
                        out.append(body[at:start])
                        at = max(start, stop)
                    text = b"".join([*out, body[at:]]).decode()
                texts.append(text)
                keep.append(not spans or bool(text.strip()))
            columns = [pa.array(texts, pa.string()) if n == "text" else batch[n] for n in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    out = repeated_spans(docs, into=SPANS).mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what a mix of SHARE of all words by source takes, each row at most once.

    Null and repeated ids are rows like others, a null source is a source of its own, rows without
    words take no share and go, an empty table stays empty, other columns are kept.
    """
    mix = fair_mix(docs, share=SHARE, cap=1.0, key=F.monotonically_increasing_id()).filter("taken > 0")
    taken = mix.groupBy(F.col("name").alias(ROW)).agg(F.count("*").alias(TAKES))
    rows = docs.filter(F.col("text").isNotNull()).withColumn(ROW, row_name()).join(taken.hint("merge"), ROW)
    return first_of_each(rows, docs.columns, F.col(TAKES), F.lit(False))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset. Null texts are empty, repeated rows pieces of their own; see token_pieces() and pack()."""
    return pack(token_pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: SQL can't express the learnt stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
