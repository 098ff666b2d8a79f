"""Line dedup: a sharded minimal perfect hash over repeated line hashes, probed by documents without a join.

A line's key is the line without outer white space (x20, x09 to x0D), A-Z in lower case. Keys of at least
``MIN_CHARS`` code points that occur in two or more documents lose all their lines, except in the smallest doc_id that
holds them. Other lines stay, joined by a line feed.

1. Each task hashes its lines (128 bits) and sends one row per distinct hash and slice of text; Spark adds them up to the
   smallest and largest doc_id and a count. A hash with one document only cannot lose a line and is left out.
2. Hashes are dealt to shards. One task per shard builds a minimal perfect hash: levels of bit arrays in which a key
   keeps its place if no other key takes it, and ranks of the set bits. Next to it lie, in the order of the ranks, a
   64-bit fingerprint, the count and the smallest doc_id: about 21 bytes a key. Each shard is a file in the shared folder.
3. Tasks over the documents map these files into memory and probe them. Lines are never shuffled or joined, and no
   file passes through the driver.

Cases: a null or empty text is one empty line; a null doc_id counts as larger than any other; repeated rows of one
doc_id count as one document; an empty table gives an empty result; other columns pass through by name in
:func:`dedup_documents`. A key is taken for another only if 128 bits of their hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaytrail.llm.common import scratch, slices, stored

MIN_CHARS = 10
#: Keys of a shard: what one task builds and one file holds.
SHARD_KEYS = 1 << 18
#: Bits of a level for each key that is still without a place.
ROOM = 1.5
NO_ID = np.iinfo(np.int64).max

_SPACES = " \t\n\x0b\x0c\r"
_MAGIC = 0x4C4D5048


# Keys of lines

def line_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all lines, offsets by text)."""
    lists = pc.split_pattern(texts.fill_null(""), "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), offsets - offsets[0]


def line_hashes(lines: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the lines with a key of that length, their 128-bit hashes as two columns)."""
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=_SPACES))
    at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
    digest = xxhash.xxh3_128_digest
    found = b"".join(map(digest, keys.take(pa.array(at)).cast(pa.binary()).to_pylist()))
    return at, np.frombuffer(found, "<u8").reshape(-1, 2)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy()


def _hash_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines, offsets = line_lists(batch.column("text"))
            at, found = line_hashes(lines, min_chars)
            if not len(at):
                continue
            ids = np.repeat(_ids(batch.column("doc_id")), np.diff(offsets))[at]
            order = np.lexsort((ids, found[:, 1], found[:, 0]))
            h, ids = found[order], ids[order]
            new = np.r_[True, (h[1:] != h[:-1]).any(1)]
            first = np.flatnonzero(new)
            other = np.r_[True, new[1:] | (ids[1:] != ids[:-1])]
            last = np.r_[first[1:], len(h)] - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[first, 0].view(np.int64)), pa.array(h[first, 1].view(np.int64)), pa.array(ids[first]),
                 pa.array(ids[last]), pa.array(np.add.reduceat(other.astype(np.int64), first))],
                ["h1", "h2", "lo", "hi", "n"])
    return run


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, lo (smallest doc_id), n (documents, repeated rows may count again) of the keys in two or more documents."""
    rows = docs.select("doc_id", "text").mapInArrow(_hash_rows(min_chars), "h1 long, h2 long, lo long, hi long, n long")
    return (rows.groupBy("h1", "h2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
            .filter("lo < hi").drop("hi"))


# Minimal perfect hash

def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash for each level; the multipliers are odd numbers without pattern."""
    x = h1 ^ ((h2 + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Places 0 to n - 1 for n distinct keys of 128 bits; other keys get some place or -1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, room: float = ROOM) -> PerfectHash:
        sizes, arrays, level = [], [], 0
        while len(h1):
            size = -(-max(64, int(room * len(h1))) // 64) * 64
            at = (_mix(h1, h2, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            arrays.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = ~alone[at]
            h1, h2, level = h1[left], h2[left], level + 1
        words = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
        ranks = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)][:-1].astype(np.uint32)
        return cls(np.array(sizes, np.int64), words, ranks)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            bit = self.starts[level] + (_mix(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
            word, inside = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            here = (word >> inside) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << inside) - np.uint64(1)))
            out[left[here]] = self.ranks[bit[here] >> 6].astype(np.int64) + below[here]
            left = left[~here]
        return out


class LineShard:
    """A perfect hash with fingerprint, count and smallest doc_id of each key; one file."""

    def __init__(self, places: PerfectHash, prints: np.ndarray, lo: np.ndarray, n: np.ndarray):
        self.hash, self.prints, self.lo, self.n = places, prints, lo, n

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, lo: np.ndarray, n: np.ndarray) -> LineShard:
        places = PerfectHash.build(h1, h2)
        order = np.argsort(places.places(h1, h2))
        return cls(places, h2[order], lo[order], np.minimum(n[order], 0xFFFFFFFF).astype(np.uint32))

    def to_bytes(self) -> bytes:
        """Header of 64-bit numbers (magic, keys, levels, words), then the arrays, those of 8 bytes first."""
        head = np.array([_MAGIC, len(self.lo), len(self.hash.sizes), len(self.hash.words)], np.int64)
        return b"".join(a.tobytes() for a in (head, self.hash.sizes, self.hash.words, self.prints, self.lo, self.hash.ranks, self.n))

    @classmethod
    def from_buffer(cls, buffer) -> LineShard:
        magic, keys, levels, words = np.frombuffer(buffer, np.int64, 4).tolist()
        if magic != _MAGIC:
            raise ValueError("not a shard of line hashes")
        at, parts = 32, []
        for kind, count in ((np.int64, levels), (np.uint64, words), (np.uint64, keys), (np.int64, keys), (np.uint32, words), (np.uint32, keys)):
            parts.append(np.frombuffer(buffer, kind, count, at))
            at += parts[-1].nbytes
        sizes, bits, prints, lo, ranks, n = parts
        return cls(PerfectHash(sizes, bits, ranks), prints, lo, n)

    def smallest(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known?, smallest doc_id) of each hash."""
        if not len(self.lo):
            return np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        place = self.hash.places(h1, h2)
        known = place >= 0
        place[~known] = 0
        known &= self.prints[place] == h2
        return known, self.lo[place]


# Files of an index

def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _write_shard(folder: str):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        h1, h2, lo, n = (group.column(c).to_numpy() for c in ("h1", "h2", "lo", "n"))
        blob = LineShard.build(h1.view(np.uint64), h2.view(np.uint64), lo, n).to_bytes()
        fs, path = _place(folder)
        fs.create_dir(path, recursive=True)
        # A task that runs again writes the same keys; the name appears only when the file is whole.
        name, part = f"{path}/{shard:07d}", f"{path}/.{shard:07d}-{xxhash.xxh3_64_hexdigest(blob)}-{np.random.default_rng().integers(1 << 62)}"
        with fs.open_output_stream(part) as f:
            f.write(blob)
        fs.move(part, name)
        return pa.table({"shard": [shard], "keys": [len(lo)], "bytes": [len(blob)]})
    return run


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> tuple[str, int]:
    """Writes the shard files; returns (folder, number of shards)."""
    lines = stored(repeated_lines(docs, min_chars), "repeated-lines")
    shards = max(1, -(-lines.count() // shard_keys))
    folder = scratch(docs.sparkSession, "line-index")
    (lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard")
     .applyInArrow(_write_shard(folder), "shard long, keys long, bytes long").agg(F.sum("keys")).collect())
    return folder, shards


_OPEN: dict[tuple[str, int], LineShard | None] = {}


def _shard(folder: str, shard: int) -> LineShard | None:
    """A shard of the index, mapped into memory where the folder is a local or mounted one; None if it has no keys."""
    if (folder, shard) not in _OPEN:
        fs, path = _place(folder)
        name = f"{path}/{shard:07d}"
        if fs.get_file_info(name).type == pyarrow.fs.FileType.NotFound:
            _OPEN[folder, shard] = None
        else:
            with (pa.memory_map(name) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(name)) as f:
                _OPEN[folder, shard] = LineShard.from_buffer(f.read_buffer())
    return _OPEN[folder, shard]


def _drop_lines(folder: str, shards: int, min_chars: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for old in [k for k in _OPEN if k[0] != folder]:        # a worker may have served another index before
            del _OPEN[old]
        for batch in slices(batches):
            lines, offsets = line_lists(batch.column("text"))
            at, found = line_hashes(lines, min_chars)
            ids = np.repeat(_ids(batch.column("doc_id")), np.diff(offsets))[at]
            drop = np.zeros(len(lines), bool)
            shard = (found[:, 0].view(np.int64) % shards) if len(at) else np.zeros(0, np.int64)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                rows = order[bounds[s]:bounds[s + 1]]
                if index := _shard(folder, s):
                    known, lo = index.smallest(found[rows, 0], found[rows, 1])
                    drop[at[rows]] = known & (lo != ids[rows])
            texts = batch.column("text").fill_null("")
            ends = np.r_[0, np.cumsum(~drop)][offsets]
            if drop.any():
                kept = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lines.filter(pa.array(~drop)))
                texts = pc.binary_join(kept, "\n")
            columns = [batch.column(c) for c in names] + [texts, pa.array(np.diff(offsets)), pa.array(np.diff(offsets) - np.diff(ends))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_kept", "_n_lines", "_n_dropped"])
    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The columns of ``docs`` and _kept (text), _n_lines (before dropping), _n_dropped."""
    folder, shards = build_index(docs, min_chars, shard_keys)
    schema = T.StructType([*docs.schema.fields, T.StructField("_kept", T.StringType()), T.StructField("_n_lines", T.LongType()),
                           T.StructField("_n_dropped", T.LongType())])
    return docs.mapInArrow(_drop_lines(folder, shards, min_chars, docs.columns), schema)


def dedup_documents(docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with shortened texts; n_chars, where there is such a column, is counted anew for those."""
    out = dedup_lines(docs, min_chars, shard_keys)
    text = F.when(F.col("_n_dropped") > 0, F.col("_kept")).otherwise(F.col("text"))
    new = {"text": text} | ({"n_chars": F.when(F.col("_n_dropped") > 0, F.length("_kept").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
