"""Helpers shared by the operators of this folder: tables, scratch folders, Arrow and numpy views of texts."""

from __future__ import annotations

import ctypes
import gc
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaytrail.session import shared_folder

#: Bytes of text that a Python task turns over at once; one longer document is a slice of its own.
SLICE_BYTES = 4 << 20

#: The characters x20 and x09 to x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of the session (``spark.checkpoint.dir``)."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, whatever executor is lost."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread_join(rows: DataFrame, known: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """``rows`` joined with ``known`` (one row a key), where one key may hold a large part of the rows.

    Keys that hold more than one of ``most`` parts of all rows, so fewer than ``most``, are joined by broadcasting their rows of ``known``;
    all others by a shuffle."""
    counts = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_of_key")), "key-counts")
    total = counts.agg(F.sum("_of_key")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("_of_key") > total // most).select(key))
    few = rows.join(hot, key, "left_semi").join(F.broadcast(known.join(hot, key, "left_semi")), key)
    return few.unionByName(rows.join(hot, key, "left_anti").join(known, key))


@contextmanager
def without_collector() -> Iterator[None]:
    """No garbage collector inside: for loops that make many small objects and no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, nulls as empty texts; offsets start at 0."""
    column = column.fill_null("") if column.null_count else column
    size = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], size)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The string array over these bytes, without copying them."""
    if len(data) < 2**31:
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)),
                                           pa.py_buffer(np.ascontiguousarray(data)))
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)),
                                            pa.py_buffer(np.ascontiguousarray(data)))


def trim() -> None:
    """Give freed memory back to the system: a worker lives through many stages beside an executor with a fixed limit."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):                                   # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that none holds more than ``limit`` bytes of text, if it has more than one row."""
    for batch in batches:
        _, offsets = texts_of(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
        if batch.num_rows:
            del batch, offsets
            trim()


def gather(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``rows`` of a table of runs, one after the other, and their offsets."""
    lengths = offsets[rows + 1] - offsets[rows]
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    at = np.repeat(offsets[rows] - ends[:-1], lengths)
    at += np.arange(ends[-1])
    return data[at], ends


def runs(parts: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    """A table of runs from a list of arrays."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return (np.concatenate(parts).astype(dtype) if parts else np.zeros(0, dtype)), offsets


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts can be cut: at the first of some white space after something else, and at the start of each text.

    No cut is made after a space beyond ASCII, as rules about runs of white space look at it together with what follows.
    """
    space = IS_SPACE[data]
    start = np.zeros(len(data), bool)
    np.logical_and(space[1:], ~space[:-1], out=start[1:])
    at = np.flatnonzero(start)
    at = at[data[at - 1] >= 0x80]
    if len(at):
        a, b, c = data[at - 1], data[at - 2], data[at - 3]
        wide = (((b == 0xC2) & ((a == 0x85) | (a == 0xA0))) | ((c == 0xE2) & ((b == 0x80) | (b == 0x81)))
                | ((c == 0xE1) & (b == 0x9A)) | ((c == 0xE3) & (b == 0x80)))
        start[at[wide]] = False
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


def write_shared(uri: str, blob: bytes) -> None:
    """One file in the shared folder; it appears under its name when it is whole, so a task may run again."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(blob)
    fs.move(part, path)


def read_shared(uri: str) -> pa.Buffer | None:
    """The bytes of a file in the shared folder, mapped into memory where that is a local or mounted folder; None: no such file."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return None
    with (pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)) as f:
        return f.read_buffer()


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one file: a line of JSON with names, types and lengths, then the arrays, each at a multiple of 8 bytes."""
    head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode() + b"\n"
    parts = [head + b" " * (-len(head) % 8)]
    for a in arrays.values():
        parts.append(np.ascontiguousarray(a).tobytes())
        parts.append(b"\0" * (-a.nbytes % 8))
    return b"".join(parts)


def unpack(buffer) -> dict[str, np.ndarray]:
    """The arrays of :func:`pack`, without copying them."""
    view = memoryview(buffer)
    size = 1 << 12
    while b"\n" not in (head := bytes(view[:size])):
        size *= 2
    at = head.index(b"\n") + 1
    out, fields = {}, json.loads(head[:at])
    at += -at % 8
    for name, kind, count in fields:
        out[name] = np.frombuffer(view, kind, count, at)
        at += out[name].nbytes + -out[name].nbytes % 8
    return out
