"""The corpus pipeline: five stages over the documents, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, minhash_forest, rlbwt, sentencepiece_codec, toxicity
from tessera.llm.queries import TOKENIZER, table
from tessera.llm.shared import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document with this share or more of its words in benchmark windows is dropped whole; below it, the spans go.
LEAKED = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score below 0.5)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    weights = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, weights, COLUMNS).where("score < 0.5").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8), the one of smallest doc_id.

    Of different texts under one id only those go that are copies of a smaller id's; of rows
    with equal id and text one stays. Texts without words, and rows without an id, stay.
    """
    found = stash(minhash_forest.near_duplicates(docs), "near")
    hashed = docs.select(COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    left = hashed.join(found.where(~F.col("kept")).select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_anti")
    again = found.where("kept and doc_id is not null and n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    if again.isEmpty():
        return left.select(COLUMNS)
    again = stash(again, "again")
    once = left.join(again, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return left.join(again, ["doc_id", "text_hash"], "left_anti").unionByName(once).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that earlier documents have in strings of 100 bytes; characters cut in two go whole."""
    found = rlbwt.find_repeats(docs, columns=COLUMNS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [rlbwt.kept_bytes(t, s).decode("utf-8", "ignore") if s else t for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in COLUMNS], COLUMNS)

    return found.mapInArrow(cut, docs.select(COLUMNS).schema)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: hit spans are cut out, and a document that is mostly hit goes."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), columns=COLUMNS)
    return decontaminate.without_leaks(found, LEAKED, COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of what they decode to, and whether that is the text."""
    return sentencepiece_codec.summaries(docs, TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("minhash near-dedup", drop_near_copies), ("suffix-array dedup", cut_repeats), ("decontamination", drop_leaks), ("sentencepiece", tokenize)]

#: Scores of a fitted model can't be had from SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, "stage")
    return docs
