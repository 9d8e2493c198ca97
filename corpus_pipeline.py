"""A corpus pipeline of five stages over documents; each takes what its predecessor kept.

Toxic documents go; of each group of near copies the document with the smallest id stays; documents that hold a
benchmark item go; sources are mixed to their target weights, which repeats rows; and the rest becomes token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import decontaminate, mixture, ngram_join, toxicity, wavelet
from tallyframe.llm.common import cut, remove, shared_dir, without
from tallyframe.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that a factorization machine, fitted on the labelled ones among them, scores below 0.7."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of documents with n-gram Jaccard similarity 0.75 or more."""
    groups = ngram_join.jaccard_components(docs)
    return without(docs, cut(groups.where("doc_id <> component_id").select("doc_id").distinct()))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that hold no benchmark item, whatever its slots' values."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs mixed to target weights: some are gone, some are repeated."""
    return mixture.mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's place, length and checksum of token ids in shard files."""
    return wavelet.tokens(docs, tokenizer_path())


#: Bytes that a task gathers of a stage's rows before it writes them: tasks hold whole texts, and Parquet's 128 MB would fill an executor's heap.
ROW_GROUP = 16 << 20

STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixture", mix_sources),
    ("wavelet_tokens", to_tokens),
]

#: SQL can express neither the learned scores nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what the next stage has read is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.option("parquet.block.size", ROW_GROUP).parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove(spark, before)
        before = f"{base}/{name}"
    return docs
