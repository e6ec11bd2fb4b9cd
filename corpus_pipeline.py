"""A pipeline over documents: each stage calls one operator and hands its rows to the next.

toxicity: documents that the model rejects go. near_duplicates: one document of each group of five-word
Jaccard links of 0.8 stays, that of the smallest id (one row of it, where the id repeats). decontamination: documents that hold a benchmark
passage go. pseudonyms: personal data in the text is replaced, n_chars follows. encoding: ids of each
text and the digests of ids and decoded bytes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontaminate, jaccard, pseudonyms, toxicity
from millrace.session import ship

KEY = b"millrace"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_toxic(docs, toxicity.fit_on(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pseudonyms.replace_in(docs, KEY, length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pseudonyms", replace_personal_data),
    ("encoding", encode),
]

#: The stages learn, search and hash; SQL can't state them. tests/llm holds each operator against brute force,
#: an exact round trip or held-out rows, and each stage against its operator and on odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
