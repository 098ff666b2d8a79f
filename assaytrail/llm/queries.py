"""The registered queries of this folder: each applies an operator to its whole table and derives the result's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaytrail.llm import (chatrepair, divergence, heapmeans, lexicon, linededup, mixing, personal, prefixtrie, repair,
                            sharding, simhash, spotsigs, toxicity)
from assaytrail.llm.common import table
from assaytrail.session import ship_package


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards."""
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    ship_package(spark)
    return divergence.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as compressed id files and read back."""
    ship_package(spark)
    folder = repair.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return repair.read_ids(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
                      (F.col("_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, rate and copies of every document, so that expected domain totals match the target weights."""
    ship_package(spark)
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    ship_package(spark)
    groups = simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and after dropping those that an earlier document holds, and a digest of what stays."""
    ship_package(spark)
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2("_kept", 256).alias("kept_sha256"))


def op8_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of all conversations with its repair and its part of the rendered text."""
    ship_package(spark)
    return chatrepair.repair_conversations(table(spark, sf_dir, "conversations"))


def op9_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text decoded from them, as digests."""
    ship_package(spark)
    out = lexicon.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.array_join(F.col("_ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                      F.sha2("_decoded", 256).alias("decoded_sha256"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and its likeness to that and to the next document."""
    rows = spotsigs.compare_neighbours(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
                       F.array_join("_own", " ").alias("fingerprint"), F.array_join("_of_edited", " ").alias("edited_fingerprint"),
                       spotsigs.likeness(F.col("_own"), F.col("_of_edited")).alias("near_edited"),
                       spotsigs.likeness(F.col("_own"), F.col("_of_next")).alias("near_next"))


def _base_count(kind: str) -> Column:
    return F.size(F.filter("_found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def op11_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans of every document, and all spans with those that the classifier adds."""
    ship_package(spark)
    found = personal.find_personal_data(table(spark, sf_dir, "documents"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("_found", lambda s: s["base"])
    return found.select("doc_id", *[_base_count(kind) for kind in personal.KINDS], F.sha2(named(base), 256).alias("base_sha256"),
                        named(F.col("_found")).alias("spans"))


def op12_heap_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every vector after ten rounds, with inertias and a digest of its centroid."""
    ship_package(spark)
    return heapmeans.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations with its members, children, leaves and saved code points."""
    ship_package(spark)
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_jump_sharding": op1_jump_sharding,
    "op2_divergence_rules": op2_divergence_rules,
    "op3_repair_ids": op3_repair_ids,
    "op4_subword_toxicity": op4_subword_toxicity,
    "op5_soft_mixing": op5_soft_mixing,
    "op6_covering_simhash": op6_covering_simhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_role_repair": op8_role_repair,
    "op9_transducer_bpe": op9_transducer_bpe,
    "op10_spotsigs": op10_spotsigs,
    "op11_weak_pii": op11_weak_pii,
    "op12_heap_kmeans": op12_heap_kmeans,
    "op13_prefix_trie": op13_prefix_trie,
}
