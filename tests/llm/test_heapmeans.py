"""Clustering with heap-ordered bounds against plain rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from assaytrail.llm import heapmeans, queries


def plain(vectors, clusters=8, rounds=10, dimensions=64, most=heapmeans.MOST):
    rows = [(i, [max(-most, min(most, math.floor(1024 * float(x)))) for x in v]) for i, v in vectors
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1])
    c = [v for _, v in sorted(rows, key=key)[:clusters]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(c)), key=lambda k: (distance(v, c[k]), k))
    for _ in range(rounds):
        groups = [[] for _ in c]
        for _, v in rows:
            groups[nearest(v)].append(v)
        c = [[sum(x) // len(g) for x in zip(*g)] if g else old for g, old in zip(groups, c)]
    out = [(i, k, distance(v, c[k])) for i, v in rows for k in [nearest(v)]]
    total = sum(d for _, _, d in out)
    most = (1 << 63) - 1
    return sorted([(i, k, d, min(most, sum(e for _, j, e in out if j == k)), min(most, total),
                    hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in out], key=str)


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, "x", 3) for i, v in vectors], f"vec_id long, embedding array<{kind}>, cluster string, _block int")


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block_rows", [heapmeans.BLOCK_ROWS, 17])
def test_clusters_equal_plain_rounds(spark, block_rows):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (5, 64))
    vectors = [(int(i), [float(np.float32(x)) for x in centers[i % 5] + rng.normal(0, 0.4, 64)]) for i in range(300)]
    vectors += [(i, vectors[7][1]) for i in range(1000, 1100)]                # a large group of copies
    found = heapmeans.cluster(frame(spark, vectors), block_rows=block_rows)
    assert got(heapmeans.cluster_vectors(frame(spark, vectors), block_rows=block_rows)) == plain(vectors)
    assert found.measured[0] == len(vectors) and sum(found.measured[1:]) < 0.6 * len(vectors) * max(1, len(found.measured) - 1)


def test_ties_and_odd_vectors(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.choice([0.0, 1.0]) for _ in range(64)]) for i in range(60)] + [(3, [0.5] * 64)] * 3 + [(None, [0.25] * 64)]
    vectors += [(90, None), (91, []), (92, [1.0] * 63), (93, [1.0] * 63 + [None]), (94, [float("nan")] * 64), (95, [float("inf")] + [0.0] * 63),
                (96, [1e30, -1e30] * 32), (97, [-0.0003] * 64)]
    assert got(heapmeans.cluster_vectors(frame(spark, vectors, "double"))) == plain(vectors)
    assert heapmeans.cluster_vectors(frame(spark, [])).count() == 0
    assert got(heapmeans.cluster_vectors(frame(spark, vectors[:3], "double"))) == plain(vectors[:3])
    same = [(i, [0.5] * 64) for i in range(20)]
    assert got(heapmeans.cluster_vectors(frame(spark, same))) == plain(same) and {r[1] for r in plain(same)} == {0}


def test_other_dimensions(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(80)]
    assert got(heapmeans.cluster_vectors(frame(spark, vectors, "double"), clusters=4, rounds=3, dimensions=3)) == plain(vectors, 4, 3, 3)


def test_heaps_survive_their_files(tmp_path):
    v = np.random.default_rng(1).integers(-50, 50, (40, 4)).astype(np.int32)
    heaps = heapmeans.Heaps.new(40, 3)
    heaps.rescan(v, v[:3].astype(np.int64), [0.0] * 3)
    heaps.write(f"file://{tmp_path}/h")
    again = heapmeans.Heaps.read(f"file://{tmp_path}/h")
    assert again.heaps == heaps.heaps and (again.assigned == heaps.assigned).all()
    assert sorted(r for h in again.heaps for _, r in h) == list(range(40))


def test_query_equals_plain_rounds(spark, sf):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(queries.QUERIES["op12_heap_kmeans"](spark, sf)) == plain(vectors)
