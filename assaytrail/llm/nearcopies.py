"""Near copies by SimHash, covering hashing and prefixes of shingles, with an exact check: the stage of the pipeline.

Two texts are near copies if the Jaccard coefficient of their five-word shingles is at least 0.8. One changed word changes five
shingles, so fingerprints of shingles are far apart even then; fingerprints of the distinct words are near. Candidates are pairs whose word
fingerprints (64 bits) differ in at most ``RADIUS`` bits; the 2 ** (RADIUS + 1) - 1 covering masks
find every such pair. A block that is appended, cut off or replaced changes many words at few shingles and is missed by these, so
pairs that share a shingle of their prefixes are candidates as well: with the shingles of each text in one order of all shingles (those in
few texts first), two texts at 0.8 share one of the first n - ceil(0.8 n) + 1, whatever was edited. The order decides how
many candidates there are, not whether one is missed. The exact coefficient then decides.

No step lists the pairs of a large group:

1. Equal texts (same words, A-Z in lower case) are one node. Nodes are grouped by fingerprint under each mask; inside a group,
   a spanning forest of the pairs within the radius is passed on (in groups of over ``FOREST_UP_TO``: a star, which only adds candidates).
   Prefix shingles are grouped too. Pairs of a group of up to ``PAIRS_UP_TO`` texts (at most half as many a text) stay if sizes and
   histograms of shingles allow 0.8; a larger group is sorted by size and neighbours within the ratio 0.8 are linked, which connects
   whatever the pairs would.
2. Components of these links are families. Shingles are compared inside of families only, in blocks of about ``BLOCK`` texts (by a hash): a task gets
   two blocks, counts common shingles by a matrix product and passes on the links that still connect two components.
3. Components of these links are the groups of near copies.

Cases: null, empty and blank texts are equal to each other; a text with fewer words than a shingle is one shingle; a null doc_id is
kept only if the group has no other; of repeated rows one stays; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaytrail.llm.common import slices, spread_join, stored
from assaytrail.llm.components import connected_components
from assaytrail.llm.simhash import covering_masks

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 6
FOREST_UP_TO = 512
BLOCK = 256
#: Counters of shingles for the order of prefixes.
COUNTERS = 1 << 22
#: Texts with a common prefix shingle up to which all their pairs are looked at; classes of a histogram of shingles.
PAIRS_UP_TO = 32
BARS = 256
#: Rows of a table of ids up to which it is broadcast (some 50 MB); beyond, Spark joins by shuffling.
SMALL_ROWS = 1 << 20
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 4096

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words of a slice of texts, A-Z in lower case, with a hash of each distinct word."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        at = lists.offsets.to_numpy().astype(np.int64)
        flat, at = lists.flatten(), at - at[0]
        real = pc.binary_length(flat).to_numpy() > 0
        if not real.all():
            flat, at = flat.filter(pa.array(real)), np.r_[0, np.cumsum(real)][at]
        coded = flat.dictionary_encode()
        digest = xxhash.xxh3_64_intdigest
        self.hashes = np.fromiter(map(digest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
        self.codes, self.offsets, self.counts = coded.indices.to_numpy(), at, np.diff(at)
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def nodes(self) -> np.ndarray:
        """A 64-bit hash of the word sequence of each text."""
        row = np.ascontiguousarray(self.hashes[self.codes])
        raw, at = memoryview(row).cast("B"), (self.offsets * 8).tolist()
        return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(at, at[1:])], np.uint64)

    def fingerprints(self) -> np.ndarray:
        """SimHash of the distinct words of each text."""
        size = len(self.hashes)
        pair = np.unique(self.text * np.int64(size) + self.codes)
        text, code = pair // max(size, 1), pair % max(size, 1)
        some = np.flatnonzero(self.counts)
        out = np.zeros(len(self.counts), np.uint64)
        if len(some):
            mixed = self.hashes * _MULTIPLIER
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MULTIPLIER
            bits = np.unpackbits((mixed ^ (mixed >> np.uint64(32))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.searchsorted(text, some)
            each = np.diff(np.r_[starts, len(text)])
            total = np.concatenate([np.add.reduceat(bits[code[a:b]], starts[i:j] - a, 0, np.int32) for i, j, a, b in _chunks(starts, len(text))])
            out[some] = np.packbits(2 * total > each[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
        return out

    def shingles(self) -> list[bytes]:
        """The sorted distinct 32-bit hashes of the shingles of each text, as bytes."""
        out = []
        row = self.hashes[self.codes]
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            n = max(b - a - SHINGLE + 1, 1 if b > a else 0)
            h = np.zeros(n, np.uint64)
            for k in range(min(SHINGLE, b - a)):
                h = (h ^ row[a + k:a + k + n]) * _MULTIPLIER
                h ^= h >> np.uint64(32)
            out.append(np.unique((h & np.uint64(0xFFFFFFFF)).astype(np.uint32)).tobytes())
        return out

    def ordered(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, key) of the distinct shingles of all texts, sorted: a key is the shingle's counter (16 bits), then its hash (48 bits)."""
        row = self.hashes[self.codes]
        h = np.zeros(max(0, len(row) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            h = (h ^ row[k:k + len(h)]) * _MULTIPLIER
            h ^= h >> np.uint64(32)
        inside = self.text[:len(h)] == self.text[SHINGLE - 1:]
        h, text = h[inside], self.text[:len(h)][inside]
        short = np.flatnonzero((self.counts > 0) & (self.counts < SHINGLE))   # one shingle each
        alone = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            more = self.counts[short] > k
            alone[more] = (alone[more] ^ row[self.offsets[short[more]] + k]) * _MULTIPLIER
            alone[more] ^= alone[more] >> np.uint64(32)
        h, text = np.r_[h, alone], np.r_[text, short]
        key = counts[(h >> np.uint64(16) & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(48) | h >> np.uint64(16)
        order = np.lexsort((key, text))
        key, text = key[order], text[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])][:len(key)]
        return text[new], key[new]


def _chunks(starts: np.ndarray, size: int, rows: int = 1 << 18) -> Iterator[tuple[int, int, int, int]]:
    """Runs of texts (i to j) with their pairs (a to b), about ``rows`` pairs each: bounds the table of bits."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + rows)))
        yield i, j, int(starts[i]), int(starts[j]) if j < len(starts) else size
        i = j


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = Words(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.nodes().view(np.int64)), pa.array(words.fingerprints().view(np.int64))],
                                         ["doc_id", "_node", "_print"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = Words(batch.column("text"))
        nodes, first = np.unique(words.nodes().view(np.int64), return_index=True)
        sets = words.shingles()
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([sets[i] for i in first.tolist()], pa.binary())], ["_node", "_set"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, none = np.zeros(COUNTERS, np.int64), np.zeros(COUNTERS, np.uint16)
    for batch in slices(batches):
        _, key = Words(batch.column("text")).ordered(none)
        total += np.bincount((key & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["_counter", "_n"])


def _prefixes(counts, similarity: float):
    """(_key, _size, _node) of the prefix of each text; ``counts``: broadcast counters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            nodes = words.nodes().view(np.int64)
            text, key = words.ordered(counts.value)
            size = np.bincount(text, minlength=len(nodes))
            most = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
            place = np.arange(len(text)) - (np.cumsum(size) - size)[text]
            once = np.zeros(len(nodes), bool)                                 # of equal texts of a slice, one
            once[np.unique(nodes, return_index=True)[1]] = True
            kept = (place < most[text]) & once[text]
            text = text[kept]
            yield pa.RecordBatch.from_arrays([pa.array(key[kept].view(np.int64)), pa.array(size[text].astype(np.int32)), pa.array(nodes[text])],
                                             ["_key", "_size", "_node"])
    return run


def _prefix_pairs(similarity: float):
    """Pairs (a, b, _sure) of rows in the order (_key, _size, _node) that have one key and sizes within the ratio: all pairs of a group
    of up to ``PAIRS_UP_TO``, neighbours of a larger one (_sure: not to be filtered)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        known_large = None                                                    # a key of which only the last row is held any more

        def pairs(key: np.ndarray, size: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][:len(key)]
            key, size, node = key[new], size[new], node[new]
            _, group, n = np.unique(key, return_inverse=True, return_counts=True)
            large, found = (n[group] > PAIRS_UP_TO) | (key == known_large if known_large is not None else False), []
            for step in range(1, min(PAIRS_UP_TO, len(key))):
                near = (key[step:] == key[:-step]) & (size[:-step] >= similarity * size[step:] - 1e-9) & ((step == 1) | ~large[step:])
                if step > 1 and not near.any() and not (key[step:] == key[:-step]).any():
                    break
                a, b = node[:-step][near], node[step:][near]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b), large[step:][near]], 1))
            rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(bool))], ["a", "b", "_sure"])

        for batch in batches:
            rows = [np.r_[h, batch.column(c).to_numpy()] for h, c in zip(held, ("_key", "_size", "_node"))]
            if not len(rows[0]) or len(rows[0]) < 1 << 16:                    # some more, as pairs are made distinct here
                held = rows
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))                  # the last group may go on
            if cut:
                yield pairs(*(x[:cut] for x in rows))
                held = [x[cut:] for x in rows]
            else:                                                             # one key alone: neighbours are linked, and the last row stays
                known_large = int(rows[0][0])
                yield pairs(*rows)
                held = [x[-1:] for x in rows]
        yield pairs(*held)
    return run


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_node, _size, _bars) of each text: how many of its shingles fall into each of ``BARS`` classes, up to 255."""
    none = np.zeros(COUNTERS, np.uint16)
    for batch in slices(batches):
        for first in range(0, batch.num_rows, 4096):
            words = Words(batch.column("text").slice(first, 4096))
            nodes, one = np.unique(words.nodes().view(np.int64), return_index=True)
            text, key = words.ordered(none)
            bars = np.bincount(text * BARS + (key % np.uint64(BARS)).astype(np.int64), minlength=len(words.counts) * BARS).reshape(-1, BARS)[one]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(bars.sum(1)), pa.array([x.tobytes() for x in np.minimum(bars, 255).astype(np.uint8)], pa.binary())],
                                             ["_node", "_size", "_bars"])


def _possible(similarity: float):
    """The pairs whose histograms allow the similarity: no more shingles are common than the sum of the smaller bars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BARS) for c in ("_x", "_y"))
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            both = batch.column("_n").to_numpy()
            kept = (most >= similarity * (both - most) - 1e-9) | ((x == 255) | (y == 255)).any(1)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(kept)) for c in ("a", "b")], ["a", "b"])
    return run


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a symmetric matrix."""
    out, left = [], np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            out += [(i, j) for j in new.tolist()]
            queue += new.tolist()
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """(consecutive rows with equal keys, of batches in that order; whether they go on a group that was cut). A group is cut into pieces of about
    ``most`` rows, if that is given."""
    held: list[pa.RecordBatch] = []
    cut, rows = False, 0

    def of(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(k)[row].as_py() for k in keys)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.r_[0, np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1, batch.num_rows].tolist()
        for a, b in zip(cuts, cuts[1:]):
            if a or last is None or last != of(batch, a):
                if held:
                    yield pa.Table.from_batches(held), cut
                held, cut, rows = [], False, 0
            held.append(batch.slice(a, b - a))
            rows += b - a
            if most is not None and rows >= most:
                yield pa.Table.from_batches(held), cut
                held, cut, rows = [], True, 0
        last = of(batch, batch.num_rows - 1)
    if held:
        yield pa.Table.from_batches(held), cut


def _family_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        star = 0
        for group, goes_on in _groups(batches, ["_key"], 1 << 16):
            x, node = group.column("_print").to_numpy(), group.column("_node").to_numpy()
            if goes_on:                                                       # the first node of a large group stands for it
                x, node = np.r_[x[:1], x], np.r_[star, node]
                pairs = [(0, j) for j in range(1, len(x))]
            elif len(x) == 2:
                pairs = [(0, 1)] if (int(x[0] ^ x[1]) & (1 << 64) - 1).bit_count() <= radius else []
            elif len(x) <= FOREST_UP_TO:
                u = x.view(np.uint64)
                pairs = _forest(np.bitwise_count(u[:, None] ^ u[None]) <= radius)
            else:
                pairs = [(0, j) for j in range(1, len(x))]
            star = node[0]
            a += [int(node[i]) for i, _ in pairs]
            b += [int(node[j]) for _, j in pairs]
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common members of each pair of sets, by products of incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[code] > 1                                                      # members of one set alone add nothing
    owner, code = owner[shared], code[shared]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    new = np.cumsum(np.r_[0, code[1:] != code[:-1]]) if len(code) else code
    for first in range(0, int(new[-1]) + 1 if len(new) else 0, COLUMNS):
        lo, hi = np.searchsorted(new, [first, first + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[lo:hi], new[lo:hi] - first] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _copy_links(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for group, _ in _groups(batches, ["_family", "_i", "_j"]):
            nodes, block = group.column("_node").to_numpy(), group.column("_block").to_numpy()
            i, j = group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
            sets = [np.frombuffer(s.as_buffer(), np.uint32) for s in group.column("_set")]
            if len(sets) < 2:
                continue
            both, size = common_shingles(sets), np.array([len(s) for s in sets])
            linked = both >= similarity * (size[:, None] + size[None] - both) - 1e-9
            if i != j:
                linked &= block[:, None] != block[None]
            pairs = _forest(linked)
            a += [int(nodes[p]) for p, _ in pairs]
            b += [int(nodes[q]) for _, q in pairs]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def small(frame: DataFrame) -> DataFrame:
    """``frame`` (stored) with a hint to broadcast it, if its rows are few enough."""
    return F.broadcast(frame) if frame.count() <= SMALL_ROWS else frame


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many of all texts have a shingle of each counter, up to 65,535. A task sums its texts up, so it passes on one row a counter at most."""
    n = F.least(F.sum("_n"), F.lit(65535)).cast("int")
    found = docs.select("text").mapInArrow(_counts, "_counter int, _n long").groupBy("_counter").agg(n.alias("_n")).filter("_n > 1").toArrow()
    out = np.zeros(COUNTERS, np.uint16)
    out[found.column("_counter").to_numpy()] = found.column("_n").to_numpy()
    return out


def prefix_links(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that connect all pairs of nodes at ``similarity``, and some others that share a shingle of their prefixes."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs))   # 8 MB
    rows = docs.select("text").mapInArrow(_prefixes(counts, similarity), "_key long, _size int, _node long")
    pairs = stored(rows.repartition("_key").sortWithinPartitions("_key", "_size", "_node")
                   .mapInArrow(_prefix_pairs(similarity), "a long, b long, _sure boolean").distinct(), "prefix-pairs")
    open_pairs = pairs.filter("not _sure").select("a", "b")
    nodes = stored(open_pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct(), "prefix-nodes")
    bars = stored(docs.select("text").mapInArrow(_histograms, "_node long, _size long, _bars binary").join(small(nodes), "_node")
                  .dropDuplicates(["_node"]), "prefix-bars")
    known = (open_pairs.join(bars.select(F.col("_node").alias("a"), F.col("_size").alias("_m"), F.col("_bars").alias("_x")), "a")
             .join(bars.select(F.col("_node").alias("b"), "_size", F.col("_bars").alias("_y")), "b")
             .select("a", "b", (F.col("_m") + F.col("_size")).alias("_n"), "_x", "_y"))
    return known.mapInArrow(_possible(similarity), "a long, b long").union(pairs.filter("_sure").select("a", "b"))


def families(nodes: DataFrame, radius: int = RADIUS, more: DataFrame | None = None) -> DataFrame:
    """(_node, _family) of the nodes (_node, _print) that may have near copies; ``more``: further links (a, b)."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in covering_masks(64, radius)])
    members = (nodes.select("_node", "_print", F.posexplode(masks).alias("_table", "_mask"))
               .select(F.hash("_table", F.col("_print").bitwiseAND(F.col("_mask"))).alias("_key"), "_print", "_node"))
    shared = (members.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_key"))).filter("_n > 1")
              .select("_key", "_print", "_node").sortWithinPartitions("_key", "_node"))
    links = shared.mapInArrow(_family_links(radius), "a long, b long")
    near = stored((links if more is None else links.union(more)).distinct(), "near-family-links")
    roots = connected_components(near).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return nodes.join(roots, "_node", "left").select("_node", F.coalesce("_root", "_node").alias("_family"))


def near_links(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes that connect all near copies."""
    found = stored(families(nodes, radius, prefix_links(docs, similarity)), "families")
    several = found.groupBy("_family").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    placed = spread_join(found, several.select("_family", F.ceil(F.col("_n") / block).cast("int").alias("_blocks")), "_family")
    placed = stored(placed.withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int")), "family-blocks")
    sets = docs.select("text").mapInArrow(_sets, "_node long, _set binary")
    with_sets = sets.join(small(placed), "_node").dropDuplicates(["_node"])
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1),
                        lambda x: F.struct(F.least(x, F.col("_block")).alias("i"), F.greatest(x, F.col("_block")).alias("j")))
    dealt = (with_sets.select("_family", "_node", "_block", "_set", F.explode(pairs).alias("_p"))
             .select("_family", F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"), "_block", "_node", "_set"))
    keys = ["_family", "_i", "_j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "_node").mapInArrow(_copy_links(similarity), "a long, b long")


def near_copy_groups(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """doc_id, _node (hash of the text's words) and _first (smallest doc_id of its group of near copies)."""
    rows = stored(docs.select("doc_id", "text").mapInArrow(_keys, T.StructType([
        docs.schema["doc_id"], T.StructField("_node", T.LongType()), T.StructField("_print", T.LongType())])), "near-keys")
    nodes = stored(rows.groupBy("_node").agg(F.min("_print").alias("_print"), F.min("doc_id").alias("_lo")), "near-nodes")
    links = stored(near_links(docs, nodes.select("_node", "_print"), similarity, radius, block), "near-links")
    roots = stored(connected_components(links).withColumnRenamed("node", "_node"), "near-roots")
    first = nodes.join(roots, "_node").groupBy("root").agg(F.min("_lo").alias("_least"))
    known = nodes.join(roots.join(first, "root").select("_node", "_least"), "_node", "left")
    return spread_join(rows.select("doc_id", "_node"), known.select("_node", F.coalesce("_least", "_lo").alias("_first")), "_node").select("doc_id", "_node", "_first")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group of near copies, that with the smallest doc_id.

    What is dropped is the smaller part, so its keys (doc_id, node) are listed and their rows left out. Where several rows have the
    key of a row that stays, all are taken out and one is put back.
    """
    groups = stored(near_copy_groups(docs, similarity, radius, block), "near-groups")
    keys = groups.groupBy("doc_id", "_node", "_first").agg(F.count(F.lit(1)).alias("_rows"))
    # of different texts with the doc_id that stays, one stays
    stays = keys.filter(F.col("doc_id").eqNullSafe(F.col("_first"))).groupBy("_first").agg(F.min(F.struct("_node", "_rows")).alias("_stay")) \
        .select(F.col("_first").alias("doc_id"), "_stay._node", F.col("_stay._rows").alias("_rows"))
    again = stored(stays.filter("_rows > 1").select(F.col("doc_id").alias("_d"), F.col("_node").alias("_m")), "near-again")
    alone = stays.filter("_rows = 1").select(F.col("doc_id").alias("_d"), F.col("_node").alias("_m"))
    same = lambda rows, other: rows["doc_id"].eqNullSafe(other["_d"]) & (rows["_node"] == other["_m"])
    out = stored(keys.join(alone, same(keys, alone), "left_anti").select(F.col("doc_id").alias("_d"), F.col("_node").alias("_m")), "near-out")

    def with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes = Words(batch.column("text")).nodes().view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes)], [*batch.schema.names, "_node"])

    rows = docs.mapInArrow(with_node, T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType())]))
    out = small(out)
    kept = rows.join(out, same(rows, out), "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    again = small(again)
    back = rows.join(again, same(rows, again), "left_semi")
    order = Window.partitionBy("_node", "doc_id").orderBy(F.xxhash64(*docs.columns))
    return kept.union(back.withColumn("_again", F.row_number().over(order)).filter("_again = 1").select(*docs.columns))
