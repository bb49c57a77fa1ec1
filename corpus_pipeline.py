"""Corpus pipeline over ``documents``; each stage works on all that the stage before it kept.

Every row is judged by its own text, so rows with a null or repeated id go or stay one by one.
Toxic documents go, one document of each near-duplicate class stays, documents with benchmark passages
go, sources are mixed to their target weights (a document may come several times), and the mix is
written as token files that are read back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lurewatch.llm import decontaminate, minhash, mixing, token_files, toxicity
from lurewatch.llm.common import in_training, read, stored

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC; learned from the labels outside the held-out third."""
    index = toxicity.learn(docs.where(in_training()), read(spark, sf_dir, "labels").where(in_training()))
    return toxicity.below(docs, index, TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, words=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The columns travel under plain numbers, so none clashes with a column of the mix.
    names = [f"c{k}" for k in range(len(docs.columns))]
    of = dict(zip(docs.columns, names))
    mixed = mixing.mix(docs.toDF(*names), names, id_column=of["doc_id"], text=of["text"], source=of["source"])
    return mixing.copies(mixed, names).select(*names).toDF(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_output", token_output),
]
# Learned scores, a hashed mix and a tokenizer have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
