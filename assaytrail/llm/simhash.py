"""SimHash near-duplicates by covering locality-sensitive hashing.

The fingerprint of a text: words (runs without x20, x09 to x0D) of the text with A-Z in lower case, shingles of
``shingle`` words joined by a space, XXH64 with seed 42 of each, and a bit is 1 if it is set in over half of the hashes.

Two fingerprints are linked if at most ``RADIUS`` bits differ. Every bit place gets a vector of RADIUS + 1 bits that is
not 0; each vector ``v`` other than 0 gives a mask of the places whose vector has an odd number of bits in common with
``v``. The vectors of two places span at most two of three dimensions, so for some ``v`` both places lie outside the mask:
every pair within the radius agrees under at least one of the seven masks. No link is missed (Pagh 2016).

Distinct fingerprints are grouped under each mask. Groups of up to ``PAIRS_UP_TO`` fingerprints are compared directly. For
larger ones (many near copies of one text) every fingerprint is written under itself and its 64 neighbours at one bit;
two fingerprints differ in at most two bits exactly if they share such an entry, and an entry holds at most 65, so this
grows in proportion to the group. Components come from the links; copies of a fingerprint are one node.

Cases: null, empty and blank texts have fingerprint 0 and are linked like any other; a text with fewer words than a
shingle is one shingle; repeated rows share a component; a null doc_id is never the smallest if there is another; an
empty table gives an empty result; other columns are ignored by :func:`near_groups` and passed on by :func:`one_per_group`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaytrail.llm.common import slices, spread_join, stored
from assaytrail.llm.components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
PAIRS_UP_TO = 16


# Fingerprints

def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat, offsets = lists.flatten(), offsets - offsets[0]
    lengths = pc.binary_length(flat).to_numpy().astype(np.int64)
    real = lengths > 0                                                       # outer white space leaves empty words
    if not real.all():
        flat, lengths, offsets = flat.filter(pa.array(real)), lengths[real], np.r_[0, np.cumsum(real)][offsets]
    out, counts = np.zeros(len(texts), np.uint64), np.diff(offsets)
    if not len(flat):
        return out
    joined = b" ".join(flat.cast(pa.binary()).to_pylist())
    begins = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    ends = begins + lengths
    each = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)      # shingles of each text
    starts = np.r_[0, np.cumsum(each)]
    first = np.repeat(offsets[:-1] - starts[:-1], each) + np.arange(starts[-1])
    last = first + np.repeat(np.minimum(counts, shingle) - 1, each)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[first].tolist(), ends[last].tolist())], "<u8")
    some = np.flatnonzero(each)
    set_bits = np.add.reduceat(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), starts[some], 0, np.int32)
    majority = 2 * set_bits > each[some, None]
    out[some] = np.packbits(majority, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _add_fingerprints(names: list[str], shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = fingerprints(batch.column("text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found)], [*names, "_print"])
    return run


def with_fingerprints(docs: DataFrame, names: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns ``names`` and _print, the fingerprint as a signed long."""
    fields = [docs.schema[c] for c in names] + [T.StructField("_print", T.LongType())]
    rows = docs.select(*dict.fromkeys([*names, "text"]))
    return rows.mapInArrow(_add_fingerprints(names, shingle), T.StructType(fields))


# Links

def covering_masks(bits: int = 64, radius: int = RADIUS) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks, as unsigned numbers.

    Where there are more masks than bits, the vectors are those with the first bit set (a Reed-Muller code), so that every mask has
    half of the bits or all; vectors in order would leave masks of one bit.
    """
    count = (1 << radius + 1) - 1
    vectors = [i % count + 1 if count <= bits else 1 << radius | i % (1 << radius) for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Links (a, b) between the distinct longs of column _print that connect all pairs within the radius."""
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks()])
    members = prints.select("_print", F.posexplode(masks).alias("_table", "_mask")) \
        .select("_print", "_table", F.col("_print").bitwiseAND(F.col("_mask")).alias("_key"))
    sizes = members.groupBy("_table", "_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    shared = stored(members.join(sizes, ["_table", "_key"]), "simhash-groups")
    # at most pairs_up_to fingerprints in each array
    small = (shared.filter(F.col("_n") <= pairs_up_to).groupBy("_table", "_key").agg(F.sort_array(F.collect_list("_print")).alias("p"))
             .select(F.explode(F.flatten(F.transform("p", lambda a, i: F.transform(
                 F.filter(F.slice("p", i + 2, F.size("p")), lambda b: F.bit_count(a.bitwiseXOR(b)) <= RADIUS),
                 lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("l")).select("l.a", "l.b"))
    near = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    entries = (shared.filter(F.col("_n") > pairs_up_to).select("_print").distinct()
               .select("_print", F.explode(near).alias("_flip")).select("_print", F.col("_print").bitwiseXOR(F.col("_flip")).alias("_entry")))
    # at most 65 fingerprints in each array: those that differ from the entry in one bit or none
    large = (entries.groupBy("_entry").agg(F.sort_array(F.collect_list("_print")).alias("p")).filter(F.size("p") > 1)
             .select(F.element_at("p", 1).alias("a"), F.explode(F.slice("p", 2, 65)).alias("b")))
    return small.union(large)


def group_of_print(prints: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """_print and _first (smallest ``_id`` reachable), a row for each distinct fingerprint of (_print, _id)."""
    nodes = stored(prints.groupBy("_print").agg(F.min("_id").alias("_lo")), "simhash-nodes")
    roots = stored(connected_components(links(nodes.select("_print"), pairs_up_to)).withColumnRenamed("node", "_print"), "simhash-roots")
    first = nodes.join(roots, "_print").groupBy("root").agg(F.min("_lo").alias("_least"))
    linked = roots.join(first, "root").select("_print", "_least")
    return nodes.join(linked, "_print", "left").select("_print", F.coalesce("_least", "_lo").alias("_first"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """doc_id, _print, component_id (smallest doc_id reachable over links)."""
    prints = stored(with_fingerprints(docs, ["doc_id"], shingle), "simhash")
    groups = group_of_print(prints.select("_print", F.col("doc_id").alias("_id")), pairs_up_to)
    return spread_join(prints, groups, "_print").select("doc_id", "_print", F.col("_first").alias("component_id"))


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """One row of each group: that with the smallest doc_id; of repeated rows one stays. Columns as in ``docs``."""
    rows = stored(with_fingerprints(docs, docs.columns, shingle).withColumn("_row", F.monotonically_increasing_id()), "simhash")
    # nulls sort first in a struct, so a flag keeps rows without doc_id behind the others
    ids = rows.select("_print", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), "_row").alias("_id"))
    keep = group_of_print(ids, pairs_up_to).select(F.col("_first._row").alias("_row")).distinct()
    return rows.join(keep, "_row", "left_semi").select(*docs.columns)
