"""Lloyd's clustering with heap-ordered bounds (after Hamerly and Drake 2015), exact in whole numbers.

Vectors of ``DIMENSIONS`` finite components become whole numbers, floor(``SCALE`` * x). The first centroids are the vectors whose ids have
the smallest hashes. Each round assigns every vector to its nearest centroid (ties: the smaller number) and moves each centroid that has
vectors to floor(sum / count); at the end all are assigned once more.

A vector keeps its centroid as long as its distance to it (u) is below that to any other (l). When centroids move, the gap l - u shrinks
by at most the own centroid's drift plus the largest drift of the others. So each cluster keeps a heap of gaps, to which the drift summed up
so far was added when they were pushed: all gaps of a cluster shrink alike, and a vector needs to be looked at only when its entry is no larger than
the cluster's drift by now. Those are popped, measured exactly against all centroids and pushed to the heap of their cluster.

Vectors lie in blocks of ``BLOCK_ROWS`` in files of the shared folder, which tasks map into memory. A task of a round takes a block and
its heaps as the round before wrote them, and gives back the name of its new file of heaps and what the vectors that changed their cluster
add to sums and counts. These are added up by Spark; the driver holds sums, centroids and drifts only. A task that runs again
writes a file of its own; only files named in the stored rows of a round are read.

Distances are compared as exact integers. Bounds are rounded away from the vector's side, so a gap that counts as open is open.

Cases: vectors with another number of components, a null, or one that is not finite are left out; components beyond ``MOST`` after scaling count as
that, so that squared distances fit 64 bits; repeated rows count each; a null id counts as an empty one in the hash; fewer vectors than centroids:
as many centroids as vectors; equal first centroids: the smaller number takes all; an empty table gives an empty result; other columns are
ignored, whatever their names. Inertias beyond 64 bits are given as the largest number. Ids must be integers.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaytrail.llm.common import pack, read_shared, scratch, stored, unpack, write_shared

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
SEED = "3"
#: Largest component after scaling.
MOST = 1 << 27
#: Vectors of a block: 8 MB with 64 components.
BLOCK_ROWS = 1 << 15
#: Tasks of a round at most; beyond that a task takes several blocks.
MOST_TASKS = 1 << 14
_SLACK = 1e-12
_ROWS = 4096


# Blocks

def scaled(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """_id and _v (whole numbers) of the vectors that are kept."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform("embedding", lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(
        F.greatest(F.lit(-1e12), F.least(F.lit(1e12), x.cast("double") * scale))))).cast("int"))
    kept = vectors.filter((F.size("embedding") == dimensions) & ~bad)
    return kept.select(F.col("vec_id").cast("long").alias("_id"), whole.alias("_v"))


def _write_blocks(folder: str, dimensions: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush():
            ids = pa.chunked_array([b.column("_id") for b in held]).combine_chunks()
            v = np.concatenate([b.column("_v").flatten().to_numpy() for b in held]).astype(np.int32)
            name = f"{folder}/{uuid.uuid4().hex}"
            write_shared(name, pack(ids=ids.fill_null(0).to_numpy(), null=ids.is_null().to_numpy(zero_copy_only=False), v=v))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64())], ["_block", "_n"])

        for batch in batches:
            first = 0
            while first < batch.num_rows:
                part = batch.slice(first, block_rows - rows)
                held.append(part)
                rows, first = rows + part.num_rows, first + part.num_rows
                if rows == block_rows:
                    yield flush()
                    held, rows = [], 0
        if rows:
            yield flush()
    return run


def _open(block: str, dimensions: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    file = unpack(read_shared(block))
    return file, file["v"].reshape(-1, dimensions)


# Rounds

def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids."""
    x = x.astype(np.int64)
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * largest * largest * x.shape[1] < 1 << 53:                          # all sums are exact as floating numbers
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (c * c).sum(1) - 2 * (a @ c.T)).astype(np.int64)
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * (x @ centroids.T)


class Heaps:
    """The heaps and assignments of a block."""

    def __init__(self, assigned: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.assigned, self.heaps = assigned, heaps

    @classmethod
    def new(cls, rows: int, clusters: int) -> Heaps:
        """Nothing is assigned; every vector is due."""
        first = [(-np.inf, i) for i in range(rows)]
        return cls(np.full(rows, -1, np.int32), [first, *([] for _ in range(clusters - 1))])

    @classmethod
    def read(cls, name: str) -> Heaps:
        file = unpack(read_shared(name))
        keys, rows, ends = file["keys"].tolist(), file["rows"].tolist(), file["ends"].tolist()
        return cls(file["assigned"].copy(), [list(zip(keys[a:b], rows[a:b])) for a, b in zip([0, *ends], ends)])

    def write(self, name: str) -> None:
        every = [e for heap in self.heaps for e in heap]
        write_shared(name, pack(keys=np.array([k for k, _ in every], np.float64), rows=np.array([r for _, r in every], np.int32),
                                ends=np.cumsum([len(h) for h in self.heaps]).astype(np.int64), assigned=self.assigned))

    def due(self, drifted: list[float]) -> np.ndarray:
        """Pops the vectors whose gap may be used up."""
        out = []
        for heap, limit in zip(self.heaps, drifted):
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def rescan(self, v: np.ndarray, centroids: np.ndarray, drifted: list[float]) -> tuple[np.ndarray, int]:
        """(changes of sums and counts by cluster, vectors measured): due vectors get their nearest centroid and a new gap."""
        change = np.zeros((len(centroids), v.shape[1] + 1), np.int64)
        due = self.due(drifted)
        for first in range(0, len(due), _ROWS):
            rows = due[first:first + _ROWS]
            x = v[rows]
            d = squared(x, centroids)
            near = d.argmin(1)
            u = np.sqrt(d[np.arange(len(rows)), near].astype(np.float64)) * (1 + _SLACK)
            d[np.arange(len(rows)), near] = np.iinfo(np.int64).max
            rest = np.sqrt(d.min(1).astype(np.float64)) * (1 - _SLACK) if len(centroids) > 1 else np.full(len(rows), np.inf)
            keys = (rest - u) + np.array(drifted)[near]
            for key, row, k in zip(keys.tolist(), rows.tolist(), near.tolist()):
                heapq.heappush(self.heaps[k], (key, row))
            old = self.assigned[rows]
            moved = np.flatnonzero(old != near)
            ones = np.concatenate([x[moved].astype(np.int64), np.ones((len(moved), 1), np.int64)], 1)
            np.add.at(change, near[moved], ones)
            known = old[moved] >= 0
            np.subtract.at(change, old[moved][known], ones[known])
            self.assigned[rows] = near
        return change, len(due)


def _round(folder: str, dimensions: int, centroids: list[list[int]], drifted: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centroids, np.int64)
        for batch in batches:
            for block, n, state in zip(*(batch.column(c).to_pylist() for c in ("_block", "_n", "_state"))):
                heaps = Heaps.read(state) if state else Heaps.new(n, len(at))
                change, measured = heaps.rescan(_open(block, dimensions)[1], at, drifted)
                name = state
                if measured:
                    name = f"{folder}/{uuid.uuid4().hex}"
                    heaps.write(name)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([n], pa.int64()), pa.array([name]), pa.array([change.reshape(-1)], pa.list_(pa.int64())),
                     pa.array([measured], pa.int64())], ["_block", "_n", "_state", "_change", "_measured"])
    return run


def _spread(rows: DataFrame, blocks: int) -> DataFrame:
    """About one block a task."""
    return rows.repartitionByRange(max(1, min(blocks, MOST_TASKS)), "_block")


def _moves(old: list[list[int]], new: list[list[int]]) -> list[float]:
    """How much the gaps of each cluster shrink at most."""
    drift = [sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5 * (1 + _SLACK) for x, y in zip(old, new)]
    return [(d + max([e for j, e in enumerate(drift) if j != k], default=0.0)) * (1 + _SLACK) for k, d in enumerate(drift)]


class Clustering:
    """Blocks with their last heaps, centroids, and how many vectors were measured in each round."""

    def __init__(self, rows: DataFrame, centroids: list[list[int]], measured: list[int], dimensions: int):
        self.rows, self.centroids, self.measured, self.dimensions = rows, centroids, measured, dimensions

    def assigned(self) -> DataFrame:
        """_id, _cluster, _distance (squared) of every vector."""
        centroids, dimensions = self.centroids, self.dimensions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = np.array(centroids, np.int64)
            for batch in batches:
                for block, state in zip(batch.column("_block").to_pylist(), batch.column("_state").to_pylist()):
                    (file, v), near = _open(block, dimensions), Heaps.read(state).assigned
                    for first in range(0, len(v), _ROWS):
                        part = slice(first, first + _ROWS)
                        away = v[part].astype(np.int64) - at[near[part]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(file["ids"][part], mask=file["null"][part]), pa.array(near[part]), pa.array((away * away).sum(1))],
                            ["_id", "_cluster", "_distance"])
        return self.rows.select("_block", "_state").mapInArrow(run, "_id long, _cluster int, _distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
            seed: str = SEED, block_rows: int = BLOCK_ROWS) -> Clustering | None:
    """Centroids after ``rounds`` rounds and the last assignment; None without vectors."""
    spark = vectors.sparkSession
    folder = scratch(spark, "heap-means")
    kept = scaled(vectors, dimensions, scale)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r._v) for r in kept.orderBy(hashed, "_id", "_v").select("_v").limit(clusters).collect()]
    if not centroids:
        return None
    rows = stored(kept.mapInArrow(_write_blocks(folder, dimensions, block_rows), "_block string, _n long"), "heap-blocks")
    rows, blocks = rows.withColumn("_state", F.lit(None).cast("string")), rows.count()
    drifted, measured, width = [0.0] * len(centroids), [], dimensions + 1
    sums = [[0] * width for _ in centroids]
    for k in range(rounds + 1):
        done = _spread(rows, blocks).mapInArrow(_round(folder, dimensions, centroids, drifted),
                                                "_block string, _n long, _state string, _change array<long>, _measured long")
        done = stored(done, "heap-round")
        for r in done.select(F.posexplode("_change").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x")).collect():
            sums[r.p // width][r.p % width] += r.x
        measured.append(done.agg(F.sum("_measured")).first()[0])
        rows = done.select("_block", "_n", "_state")
        if k == rounds:
            break
        moved = [[x // s[-1] for x in s[:-1]] if s[-1] else c for s, c in zip(sums, centroids)]
        if moved == centroids:                                                # no later round changes anything
            break
        drifted = [d + m for d, m in zip(drifted, _moves(centroids, moved))]
        centroids = moved
    return Clustering(_spread(rows, blocks), centroids, measured, dimensions)


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster_vectors(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and a digest of the final centroid of every vector that is kept."""
    found = cluster(vectors, **options)
    if found is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    rows = stored(found.assigned(), "heap-assigned")
    most = (1 << 63) - 1
    totals = {r._cluster: int(r.s) for r in rows.groupBy("_cluster").agg(F.sum(F.col("_distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    inertias = F.array(*[F.lit(min(totals.get(k, 0), most)).cast("long") for k in range(len(digests))])
    return rows.select(F.col("_id").alias("vec_id"), F.col("_cluster").alias("cluster"), F.col("_distance").alias("distance"),
                       inertias[F.col("_cluster")].alias("cluster_inertia"), F.lit(min(sum(totals.values()), most)).cast("long").alias("inertia"),
                       F.array(*map(F.lit, digests))[F.col("_cluster")].alias("centroid_sha256"))
