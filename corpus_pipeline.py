"""A training-data pipeline over ``documents``: each stage works on all rows that its predecessor kept.

Quality rules and near-duplicate removal drop documents, line dedup shortens texts, mixing thins out domains that are over their
share and repeats documents of those that are under it, and the last stage encodes what is left. Stages are written as Parquet in the shared folder and read again.

Cases: as in the operators that the stages call; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaytrail.llm import divergence, lexicon, linededup, mixing, nearcopies
from assaytrail.llm.common import scratch, table
from assaytrail.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough words, little repetition and histograms like those of their language."""
    ship_package(spark)
    return divergence.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document holds."""
    ship_package(spark)
    return linededup.dedup_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return nearcopies.one_of_each(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix wants them, those of a domain under its share several times; the table does not grow."""
    ship_package(spark)
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"), grow=False)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left, decoded again as a check: doc_id, n_tokens, digests of ids and decoded text."""
    ship_package(spark)
    out = lexicon.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.array_join(F.col("_ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                      F.sha2("_decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", simhash_near_dedup),
          ("mixing to target weights", target_mix), ("BPE encoding and decoding", bpe_encode)]

#: SQL cannot express the trained classifiers and the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        folder = f"{scratch(spark, 'pipeline')}/{k}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
