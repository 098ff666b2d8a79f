"""The trie of conversation prefixes against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from assaytrail.llm import prefixtrie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in convs.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, ms in members.items():
        ends = ",".join(map(str, sorted(c for c in ms if len(rebuilt[c]) == len(p))))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("shard_nodes", [prefixtrie.SHARD_NODES, 40])
def test_trie_equals_plain_version(spark, shard_nodes):
    rng = random.Random(2)
    rows = []
    for c in rng.sample(range(700), 260):
        for t in range(rng.choice([0, 1, 2, 3, 6, 9])):
            text = rng.choice(["a", "b", "é😀"]) if t < 3 or c % 7 == 0 else f"{c} {t}"
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice([text, text, text, None])))
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1080) for t in range(12)]            # one large group of equal ones
    rows += [(c, t, "user", f"grow {t}") for c in range(1100, 1140) for t in range(c - 1095)]      # each one turn longer than the one before
    rows += [(1201, t, "x", str(t)) for t in range(2500)]                                          # over several stretches
    rng.shuffle(rows)
    assert got(prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA), shard_nodes)) == plain_trie(rows)


def test_trie_edge_cases(spark):
    schema = SCHEMA + ", depth string, n_convs int, _extra long"
    rows = [(None, 0, "user", "no number"), (5, None, "user", None), (5, 1, None, "x"), (5, 1, None, "x"), (100, 0, "user", ""), (100, 0, "user", ""),
            (-3, 2, "user", "below"), (6, 0, "user", "y" * 300_000), (7, 3, None, None)]
    out = got(prefixtrie.prefix_trie(spark.createDataFrame([(*r, "d", 1, 2) for r in rows], schema)))
    assert out == plain_trie([r for r in rows if r[0] is None or r[0] >= 0] + [(-3, 2, "user", "below")])
    assert prefixtrie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    ties = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "a")]
    assert got(prefixtrie.prefix_trie(spark.createDataFrame(ties, SCHEMA))) == got(prefixtrie.prefix_trie(spark.createDataFrame(ties[::-1], SCHEMA)))


def test_clashing_digests_are_noticed(spark):
    paths = spark.createDataFrame([(1, 1, 1, 9, 9, 7, 0, 0, 3), (2, 1, 1, 9, 9, 8, 0, 0, 3), (3, 1, 1, 5, 5, 5, 0, 0, 3)],
                                  "conv_id long, _len int, _depth int, _p1 long, _p2 long, _p3 long, _q1 long, _q2 long, _chars long")
    assert {r._p1: r._clash for r in prefixtrie.count_nodes(paths).collect()} == {9: True, 5: False}


def test_levels_add_up():
    values = np.ones((6, 1), np.int64)
    prefixtrie.add_up(values, np.array([-1, 0, 0, 1, 1, 2]), np.array([0, 1, 3, 6]))
    assert values[:, 0].tolist() == [6, 3, 2, 1, 1, 1]


def test_trie_query_equals_plain_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op13_prefix_trie"](spark, sf)) == plain_trie(rows)
