"""A training-corpus pipeline: each stage works on what the one before it kept.

toxicity drops the documents predicted toxic; line dedup removes cross-site boilerplate lines and
drops documents of which nothing is left; near-dedup keeps the smallest doc_id of each group; the
secret scan replaces credentials; packing cuts what remains into sequences. Every stage but the last
returns the columns of documents, and each is written as Parquet and reread.

There is no SQL for the whole: the first stage's scores come from a trained network.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvane.llm import lines, packing, secrets, simhash, toxicity
from corvane.llm.common import shared_folder, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", drop_near_duplicates), ("secrets", redact_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between them the rows are written under the cluster's shared folder.

    Two places take turns: what a stage writes replaces what the one before its predecessor wrote.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        place = f"{folder}/{'even' if i % 2 == 0 else 'odd'}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(place)
        docs = spark.read.parquet(place)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
