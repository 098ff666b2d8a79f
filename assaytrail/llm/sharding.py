"""Sharding by jump consistent hashing, as DataFrame expressions.

A row's shard depends on its ``doc_id`` and the number of shards alone, and needs no table of ring points. With one
more shard, a row either stays or moves into the new one; about one row in ``shards + 1`` moves.

The generator of the published function (Lamping and Veach 2014) is a 64-bit linear congruence. Its state is kept in
two halves of 32 bits, as products of 64 bits raise an error in ANSI mode.

Cases: a null ``doc_id`` counts as key 0; a null text counts as no bytes; repeated rows go to the same
shard and get slots of their own; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 8
#: Parts of a shard that are numbered on their own: what one task sorts is a part of ``rows / (shards * BLOCKS)`` rows.
BLOCKS = 2048

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757

_LOW, _HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
_16, _32 = 0xFFFF, 0xFFFFFFFF


def _low_product(half: Column, factor: int) -> Column:
    """half * factor modulo 2**32, for a half below 2**32; no step leaves 63 bits."""
    high = F.shiftleft((half * F.lit(factor >> 16)).bitwiseAND(F.lit(_16)), 16)
    return (high + half * F.lit(factor & _16)).bitwiseAND(F.lit(_32))


def _next_state(state: Column) -> Column:
    """state * MULTIPLIER + 1 modulo 2**64, of and to (high, low) halves."""
    high, low = state["high"], state["low"]
    p, q = low * F.lit(_LOW & _16), low * F.lit(_LOW >> 16)
    t = p + F.shiftleft(q.bitwiseAND(F.lit(_16)), 16) + F.lit(1)
    carry = F.shiftright(t, 32) + F.shiftright(q, 16)
    return F.struct((carry + _low_product(high, _LOW) + _low_product(low, _HIGH)).bitwiseAND(F.lit(_32)).alias("high"),
                    t.bitwiseAND(F.lit(_32)).alias("low"))


def halves(key: Column) -> Column:
    return F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_32)).alias("low"))


def jump_hash(key: Column, shards: int) -> Column:
    """The jump consistent hash of a 64-bit key: int from 0 to shards - 1.

    Each jump goes at least one bucket up, so ``shards`` steps always suffice; steps past the last jump keep the
    result. The quotients are floating-point numbers, as in the published function.
    """
    start = F.struct(halves(key).alias("state"), F.lit(-1).cast("long").alias("bucket"), F.lit(0).cast("long").alias("jump"))

    def step(now: Column, _: Column) -> Column:
        state = _next_state(now["state"])
        target = F.floor((now["jump"] + F.lit(1)).cast("double")
                         * (F.lit(float(1 << 31)) / (F.shiftright(state["high"], 1) + F.lit(1)).cast("double")))
        return F.when(now["jump"] < F.lit(shards), F.struct(state.alias("state"), now["jump"].alias("bucket"), target.alias("jump"))) \
                .otherwise(now)

    # coalesce: the result is never null, and a join on it needs no filter that computes it once more
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda now: now["bucket"].cast("int")), F.lit(0))


def shard_documents(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (from 0 without gaps in each shard), grown_shard (with one shard more).

    Slots come in two steps: rows are numbered inside blocks of a shard, by a second hash, and a table of block sizes
    (at most shards * blocks rows, so a broadcast of bounded size) says where each block begins. No task orders a
    whole shard. Only ids, sizes and checksums are shuffled, not texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))

    def placed(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("shard", jump_hash(F.col("_key"), shards))
                .withColumn("_block", F.pmod(_next_state(halves(F.col("_key")))["high"], F.lit(blocks)).cast("int")))

    rows = placed(docs.select("doc_id", "text").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("_tie"), key.alias("_key")))
    sizes = placed(docs.select(key.alias("_key"))).groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size", "_tie")
    return (rows.withColumn("_n", F.row_number().over(inside))
            .join(F.broadcast(starts), ["shard", "_block"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_n") - 1).alias("slot"),
                    jump_hash(F.col("_key"), shards + 1).alias("grown_shard")))
