"""A trie of conversation prefixes: one row for each distinct sequence of first turns, over a table of perfect hashes.

Conversations are first rebuilt (:func:`rebuild`): the first h turns of the conversation whose number ends the hundred below, then the
conversation's own turns after its first h, with h from 0 to 5 by a hash of its number. Nodes of the trie are the distinct
sequences of first turns (role, text); members of a node are the conversations that start with it.

1. A prefix is known by the exclusive or of hashes of its turns, each taken together with its place: 128 bits, and 64 more as a check.
   Texts are hashed where they are read and are never shuffled. Running digests of a conversation are taken in stretches of
   ``STRETCH`` turn numbers, then over one row a stretch, so a very long conversation is no single group.
2. Nodes are counted by one aggregation. It also picks an owner, the member with the most turns (then the smallest number): the nodes of
   one owner are one downward path. If the check differs inside a node, all is done again with other hashes.
3. Digests are dealt to shards. Each shard is a file: a minimal perfect hash whose slots hold the second half of the digest, against which
   each hit is verified, the smallest member, the owner and the depth. Nodes probe the file of their parent, so a node with
   very many children is no hot join key.
4. Nodes are dealt anew by owner and stretch of depth, so paths stay together. A task scatters the counts of its nodes into flat arrays,
   and adds them up through an array of parent slots, deepest first. Sums for parents in another part are added up by
   Spark to one row a parent and are taken in by that part in a next round. With members of most turns as owners a path down
   from the root changes its owner at most about sqrt(2 n) times for n nodes, in practice a few times; that is the number of rounds.

Digests of the members that end at a node are taken over runs of at most 4,096 conversation numbers that Spark sorts and joins to one string
each; a task then reads these in order as a stream.

Cases: a null role or text is empty; turns with a null number come first; equal turn numbers are ordered by hashes of
role and text; repeated rows are turns of their own; turns without a conversation number are left out; a conversation
without any turn left is a member of the root alone; an empty table gives an empty result; other columns are ignored, whatever their names.
Conversation numbers must be integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaytrail.llm.common import pack, read_shared, scratch, stored, unpack, write_shared
from assaytrail.llm.linededup import PerfectHash

#: First turns that can come from another conversation, and how many conversations share one.
MOST_HEAD, FAMILY = 5, 100
#: Turn numbers of a stretch; depths of a path that stay in one part.
STRETCH, BAND = 1024, 1 << 16
#: Nodes of a shard of the hash table and of a part of the trie, on average.
SHARD_NODES = 1 << 18
#: Conversation numbers joined to one string.
RUN_BITS = 12
_NO_PARENT = -1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# Rebuilt conversations

def _hashes(salt: int) -> list[Column]:
    """Three hashes of a turn's role and text; the third shares nothing with the others but its input."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return [F.xxhash64(F.lit(2 * salt), role, text).alias("_a"), F.xxhash64(F.lit(2 * salt + 1), role, text).alias("_b"),
            F.xxhash64(F.lit(salt), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("_c")]


def head_turns(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_HEAD + 1)).cast("int")


def _placed(name: str, depth: Column) -> Column:
    return F.xxhash64(depth.cast("int"), F.col(name))


def rebuild(turns: DataFrame, salt: int = 0) -> DataFrame:
    """The prefixes of every rebuilt conversation: conv_id, _len (its turns), _depth (0: the root), _p1 _p2 _p3 (digest), _q1 _q2
    (digest without the last turn) and _chars (code points of the last turn's text)."""
    place = [F.asc_nulls_first("_turn"), "_a", "_b", "_c"]
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), F.floor(F.col("turn") / STRETCH).cast("long").alias("_part"),
        *_hashes(salt), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("_chars"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*place)))

    # the first turns of each family's first conversation, and what every conversation takes of them
    first = ranked.filter((F.col("conv_id") % FAMILY == 0) & (F.col("_rank") <= MOST_HEAD))
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("_part"), "_rank")
    heads = (first.withColumn("_at", F.row_number().over(in_order)).filter(F.col("_at") <= MOST_HEAD)
             .groupBy(F.col("conv_id").alias("_family")).agg(F.sort_array(F.collect_list(F.struct("_at", "_a", "_b", "_c", "_chars"))).alias("_head")))
    parts = rows.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = (parts.groupBy("conv_id").agg(F.sum("_n").alias("_n")).withColumn("_family", family).join(heads, "_family", "left")
             .withColumn("_h", head_turns(F.col("conv_id")))
             .withColumn("_head", F.slice(F.coalesce("_head", F.array()), 1, F.col("_h")))
             .select("conv_id", "_h", "_head", F.size("_head").alias("_k"),
                     (F.size("_head") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))).cast("int").alias("_len")))
    placed_head = lambda name: F.transform("_head", lambda x: F.xxhash64(x["_at"], x[name]))
    convs = stored(convs.select("*", *[placed_head(c).alias(f"_x{k + 1}") for k, c in enumerate(("_a", "_b", "_c"))]), "trie-convs")
    folded = lambda name, upto: F.aggregate(F.slice(name, F.lit(1), upto), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))

    # root and taken turns
    depths = convs.withColumn("_depth", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    up = lambda name: F.when(F.col("_depth") > 0, folded(name, F.greatest(F.col("_depth") - 1, F.lit(0))))
    taken = depths.select("conv_id", "_len", "_depth", *[folded(f"_x{k}", F.col("_depth")).alias(f"_p{k}") for k in (1, 2, 3)],
                          up("_x1").alias("_q1"), up("_x2").alias("_q2"),
                          F.when(F.col("_depth") > 0, F.col("_head")[F.greatest(F.col("_depth") - 1, F.lit(0))]["_chars"]).otherwise(F.lit(0)).alias("_chars"))

    # own turns: numbered and digested inside their stretch, then over stretches
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("_part")).rowsBetween(Window.unboundedPreceding, -1)
    starts = (parts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("int")).join(convs, "conv_id")
              .select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_of"), "_start", "_h", "_k", "_len",
                      *[folded(f"_x{k}", F.col("_k")).alias(f"_base{k}") for k in (1, 2, 3)]))
    own = (ranked.join(starts, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_part").eqNullSafe(F.col("_of")))
           .withColumn("_depth", (F.col("_rank") + F.col("_start") - F.col("_h") + F.col("_k")).cast("int")).filter(F.col("_depth") > F.col("_k"))
           .select("conv_id", "_part", "_len", "_depth", "_chars", "_base1", "_base2", "_base3",
                   *[_placed(c, F.col("_depth")).alias(f"_x{k + 1}") for k, c in enumerate(("_a", "_b", "_c"))]))
    own = stored(own, "trie-turns")
    folds = own.groupBy("conv_id", "_part").agg(*[F.bit_xor(f"_x{k}").alias(f"_x{k}") for k in (1, 2, 3)])
    carried = folds.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_of"),
                           *[F.coalesce(F.bit_xor(f"_x{k}").over(before), F.lit(0)).alias(f"_carry{k}") for k in (1, 2, 3)])
    upto = Window.partitionBy("conv_id", "_part").orderBy("_depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = [F.bit_xor(f"_x{k}").over(upto).bitwiseXOR(F.col(f"_base{k}")).alias(f"_y{k}") for k in (1, 2, 3)]
    digested = (own.select("*", *p).join(carried, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_part").eqNullSafe(F.col("_of")))
                .select("conv_id", "_len", "_depth", *[F.col(f"_y{k}").bitwiseXOR(F.col(f"_carry{k}")).alias(f"_p{k}") for k in (1, 2, 3)],
                        "_x1", "_x2", "_chars"))
    digested = digested.select("conv_id", "_len", "_depth", "_p1", "_p2", "_p3", F.col("_p1").bitwiseXOR(F.col("_x1")).alias("_q1"),
                               F.col("_p2").bitwiseXOR(F.col("_x2")).alias("_q2"), "_chars")
    return taken.unionByName(digested)


# Nodes

def count_nodes(paths: DataFrame) -> DataFrame:
    """One row a node: digest, digest of the parent, members, owner, children; _clash where different prefixes share a digest."""
    same = F.struct("_depth", "_p3", "_q1", "_q2", "_chars")
    nodes = paths.groupBy("_p1", "_p2").agg(
        F.count(F.lit(1)).alias("_convs"), F.min("conv_id").alias("_conv"),
        F.min(F.struct((-F.col("_len")).alias("l"), F.col("conv_id").alias("c"))).alias("_o"), F.min(same).alias("_s"), F.max(same).alias("_t"))
    nodes = nodes.select("_p1", "_p2", "_convs", "_conv", F.col("_o.c").alias("_owner"), "_s._depth", "_s._q1", "_s._q2", "_s._chars",
                         (~F.col("_s").eqNullSafe(F.col("_t"))).alias("_clash"))
    children = nodes.filter("_depth > 0").groupBy(F.col("_q1").alias("_p1"), F.col("_q2").alias("_p2")).agg(F.count(F.lit(1)).alias("_children"))
    return nodes.join(children, ["_p1", "_p2"], "left").withColumn("_children", F.coalesce("_children", F.lit(0)))


def _part_of(owner: np.ndarray, depth: np.ndarray, parts: int) -> np.ndarray:
    """The part of the trie of a node: equal for an owner's nodes of one band of depths."""
    x = (owner.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((depth // BAND).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


def _write_shard(folder: str):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        p1, p2 = (group.column(c).to_numpy().view(np.uint64) for c in ("_p1", "_p2"))
        table = PerfectHash.build(p1, p2)
        order = np.argsort(table.places(p1, p2))
        write_shared(f"{folder}/{shard}", pack(
            sizes=table.sizes, words=table.words, ranks=table.ranks, prints=p2[order],
            **{c: group.column(f"_{c}").to_numpy()[order] for c in ("conv", "owner", "depth")}))
        return pa.table({"shard": [shard], "nodes": [len(order)]})
    return run


_OPEN: dict[str, dict[str, np.ndarray]] = {}


def _file(folder: str, name: int) -> dict[str, np.ndarray]:
    """The arrays of one file, mapped into memory where the folder is a local or mounted one."""
    for old in [k for k in _OPEN if not k.startswith(f"{folder}/")]:          # a worker may have served another trie before
        del _OPEN[old]
    uri = f"{folder}/{name}"
    if uri not in _OPEN:
        _OPEN[uri] = unpack(read_shared(uri))
    return _OPEN[uri]


def find(folder: str, shards: int, p1: np.ndarray, p2: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(number of each node: shard and slot, what its slot holds); a digest that is in no slot is an error."""
    shard = (p1.view(np.int64) % shards).astype(np.int64)
    ids, out = np.zeros(len(p1), np.int64), {c: np.zeros(len(p1), np.int64) for c in ("conv", "owner", "depth")}
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1)) if shards < len(p1) else None
    some = np.flatnonzero(np.diff(bounds)).tolist() if bounds is not None else np.unique(shard).tolist()
    for s in some:
        rows = order[bounds[s]:bounds[s + 1]] if bounds is not None else np.flatnonzero(shard == s)
        file = _file(folder, s)
        slot = PerfectHash(file["sizes"], file["words"], file["ranks"]).places(p1[rows], p2[rows])
        if (slot < 0).any() or (file["prints"][slot] != p2[rows]).any():
            raise ValueError("a prefix is not in the table of nodes")
        ids[rows] = (s << 32) + slot
        for c, values in out.items():
            values[rows] = file[c][slot]
    return ids, out


def _probe(folder: str, shards: int, parts: int):
    names = ["_p1", "_p2", "_convs", "_conv", "_depth", "_chars", "_children"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p1, p2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("_p1", "_p2"))
            depth, owner = batch.column("_depth").to_numpy().astype(np.int64), batch.column("_owner").to_numpy()
            root = depth == 0
            q1, q2 = (batch.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("_q1", "_q2"))
            ids, _ = find(folder, shards, p1, p2)
            parent, found = find(folder, shards, np.where(root, p1, q1), np.where(root, p2, q2))
            parent_conv = pa.array(found["conv"], mask=root)
            parent[root] = _NO_PARENT
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(ids), pa.array(parent), parent_conv, pa.array(_part_of(owner, depth, parts)),
                 pa.array(_part_of(found["owner"], found["depth"], parts), mask=root)],
                [*names, "_id", "_parent", "_parent_conv", "_part", "_parent_part"])
    return run


_PROBED = ("_p1 long, _p2 long, _convs long, _conv long, _depth int, _chars long, _children long, _id long, _parent long, "
           "_parent_conv long, _part long, _parent_part long")


# Sums over subtrees

def add_up(values: np.ndarray, parent: np.ndarray, level_ends: np.ndarray) -> None:
    """Adds the values of nodes, which are ordered by depth, to those of their parent slots, the deepest level first."""
    for k in range(len(level_ends) - 1, 0, -1):
        here = slice(level_ends[k - 1], level_ends[k])
        inside = parent[here] >= 0
        np.add.at(values, parent[here][inside], values[here][inside])


_SUMS = "_id long, _leaves long, _saved long, _to_part long, _to long"


def _sums(file: dict[str, np.ndarray], leaves: np.ndarray, saved: np.ndarray) -> pa.Table:
    values = np.stack([leaves, saved], 1)
    add_up(values, file["parent"], file["ends"])
    at = np.flatnonzero(values.any(1))
    away = file["to"][at] < 0
    return pa.table({"_id": file["ids"][at], "_leaves": values[at, 0], "_saved": values[at, 1],
                     "_to_part": pa.array(file["to_part"][at], mask=away), "_to": pa.array(file["to"][at], mask=away)})


def _first_sums(folder: str):
    """Arrays of one part, written for later rounds, and the sums inside of it."""
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        part = key[0].as_py()
        col = {c: group.column(c).fill_null(-1).to_numpy() for c in ("_id", "_parent", "_depth", "_part", "_parent_part", "_convs", "_chars", "_children")}
        order = np.lexsort((col["_id"], col["_depth"]))
        col = {c: v[order] for c, v in col.items()}
        by_id = np.argsort(col["_id"])
        place = by_id[np.minimum(np.searchsorted(col["_id"], col["_parent"], sorter=by_id), len(by_id) - 1)]
        here = col["_id"][place] == col["_parent"]
        file = {"ids": col["_id"], "parent": np.where(here, place, -1), "to": np.where(here, _NO_PARENT, col["_parent"]),
                "to_part": col["_parent_part"], "ends": np.r_[0, np.flatnonzero(np.diff(col["_depth"])) + 1, len(order)].astype(np.int64)}
        write_shared(f"{folder}/{part}", pack(**file))
        return _sums(file, (col["_children"] == 0).astype(np.int64), (col["_convs"] - 1) * col["_chars"])
    return run


def _more_sums(folder: str):
    """What sums from other parts add inside of one."""
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        file = _file(folder, key[0].as_py())
        by_id = np.argsort(file["ids"])
        slot = by_id[np.searchsorted(file["ids"], group.column("_to").to_numpy(), sorter=by_id)]
        leaves, saved = np.zeros(len(by_id), np.int64), np.zeros(len(by_id), np.int64)
        np.add.at(leaves, slot, group.column("_leaves").to_numpy())
        np.add.at(saved, slot, group.column("_saved").to_numpy())
        return _sums(file, leaves, saved)
    return run


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """_id, _leaves, _saved of every node, from rows of :func:`_probe`."""
    folder = scratch(nodes.sparkSession, "trie-parts")
    rounds = [stored(nodes.groupBy("_part").applyInArrow(_first_sums(folder), _SUMS), "trie-sums")]
    while True:
        sent = rounds[-1].filter("_to IS NOT NULL").groupBy("_to_part", "_to").agg(F.sum("_leaves").alias("_leaves"), F.sum("_saved").alias("_saved"))
        more = stored(sent.groupBy("_to_part").applyInArrow(_more_sums(folder), _SUMS), "trie-sums")
        if not more.take(1):
            break
        rounds.append(more)
    every = reduce(DataFrame.union, [r.select("_id", "_leaves", "_saved") for r in rounds])
    return every.groupBy("_id").agg(F.sum("_leaves").alias("_leaves"), F.sum("_saved").alias("_saved"))


# Members that end at a node

def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of rows with the same node; rows come sorted by node and run."""
    now, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([state.hexdigest()])], ["_p1", "_p2", "_ends"])

    for batch in batches:
        done = []
        for p1, p2, ids in zip(*(batch.column(c).to_pylist() for c in ("_p1", "_p2", "_ids"))):
            if now != (p1, p2):
                if now is not None:
                    done.append(row())
                now, state = (p1, p2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if now is not None:
        yield row()


def end_digests(paths: DataFrame) -> DataFrame:
    """_p1, _p2, _ends: the digest over the numbers of the conversations that end at a node."""
    runs = (paths.filter("_depth = _len").groupBy("_p1", "_p2", F.shiftright("conv_id", RUN_BITS).alias("_run"))
            .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("_ids")))
    return runs.repartition("_p1", "_p2").sortWithinPartitions("_p1", "_p2", "_run").mapInArrow(_stream_digests, "_p1 long, _p2 long, _ends string")


def prefix_trie(turns: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    spark = turns.sparkSession
    for salt in range(4):
        paths = stored(rebuild(turns, salt), "trie-paths")
        nodes = stored(count_nodes(paths), "trie-nodes")
        n, clashes = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_clash").cast("long")), F.lit(0))).first()
        if not clashes:
            break
    else:
        raise ValueError("different prefixes share a digest under each of four hashes")
    shards, folder = max(1, -(-n // shard_nodes)), scratch(spark, "trie-table")
    written = nodes.groupBy(F.pmod("_p1", F.lit(shards)).alias("_shard")).applyInArrow(_write_shard(folder), "shard long, nodes long")
    if (written.agg(F.sum("nodes")).first()[0] or 0) != n:
        raise ValueError("the table of nodes is not whole")
    probed = stored(nodes.mapInArrow(_probe(folder, shards, shards), _PROBED), "trie-linked")
    out = probed.join(subtree_sums(probed), "_id").join(end_digests(paths), ["_p1", "_p2"], "left")
    return out.select(F.col("_conv").alias("conv_id"), F.col("_depth").cast("long").alias("depth"), F.col("_parent_conv").alias("parent_conv_id"),
                      F.col("_convs").alias("n_convs"), F.col("_children").alias("n_children"), F.col("_leaves").alias("n_leaves"),
                      F.col("_saved").alias("saved_tokens"), F.coalesce("_ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))
