"""Sharding, line dedup and quality rules against plain versions."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaytrail.llm import divergence, linededup, queries, sharding
from assaytrail.llm.sql import ORACLE_SQL
from compare import compare, connect


def jump(key, shards):
    """The published loop."""
    bucket, nxt = -1, 0
    while nxt < shards:
        bucket, key = nxt, (key * sharding.MULTIPLIER + 1) % 2**64
        nxt = int(float(bucket + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return bucket


def test_jump_hash_equals_the_published_loop(spark):
    rows = spark.range(-300, 300).select(F.xxhash64("id").alias("k")).select(
        "k", *[sharding.jump_hash(F.col("k"), n).alias(f"n{n}") for n in (1, 2, 8, 9, 100)]).collect()
    assert all(r[f"n{n}"] == jump(r.k % 2**64, n) for r in rows for n in (1, 2, 8, 9, 100))


def test_shards_are_gapless_and_grow_into_the_new_one(spark, odd, empty):
    rows = sharding.shard_documents(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), blocks=16).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == 5000
    assert max(map(len, slots.values())) < 1.2 * 5000 / 8
    out = sharding.shard_documents(odd).collect()
    assert len(out) == odd.count() and {r.size for r in out if r.doc_id == 3} == {1}
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    same, message = compare(spark, connect(sf), name, queries.QUERIES[name], ORACLE_SQL[name], sf)
    assert same, message


def plain_dedup(docs):
    key = lambda x: re.sub(r"^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$", "", x).translate({i: i + 32 for i in range(65, 91)})
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(2**63 if d is None else d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != d for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_keys", [1, 1 << 18])
def test_line_dedup_equals_plain_version(spark, odd, empty, sf, shard_keys):
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id > 20").select("doc_id", "text"))
    got = sorted(((r.doc_id, r._n_lines, r._n_dropped, r._kept) for r in linededup.dedup_lines(docs, shard_keys=shard_keys).collect()), key=repr)
    assert got == plain_dedup([tuple(r) for r in docs.collect()])
    assert linededup.dedup_lines(empty).count() == 0
    out = linededup.dedup_documents(odd)
    assert out.columns == odd.columns and out.filter("doc_id = 7").first().n_chars == 0 and out.filter("doc_id = 3").first().text is None


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 2**63, 20000, dtype=np.uint64) for _ in range(2))
    built = linededup.PerfectHash.build(h1, h2)
    assert sorted(built.places(h1, h2).tolist()) == list(range(20000))
    shard = linededup.LineShard.from_buffer(linededup.LineShard.build(h1, h2, np.arange(20000), np.ones(20000, np.int64)).to_bytes())
    known, lo = shard.smallest(h1, h2)
    assert known.all() and (lo == np.arange(20000)).all()
    assert not shard.smallest(h1 + np.uint64(1), h2 + np.uint64(3))[0].any()


def test_quality_counts_and_verdicts(spark, odd, empty):
    rows = {r.doc_id: r for r in divergence.judge(odd).collect()}
    words = re.findall(r"[^\x20\x09-\x0D]+", odd.filter("doc_id = 5").first().text)
    assert (rows[5].n_words, rows[5].word_chars) == (len(words), sum(map(len, words))) and rows[5].n_repeat_words == len(words) and rows[5].base_failed
    assert [rows[d].n_words for d in (2, 3, 4)] == [0, 0, 0] and not any(rows[d].kept for d in (2, 3, 4))
    assert divergence.judge(empty).count() == 0
    assert divergence.keep_documents(odd).columns == odd.columns
    texts = pa.array(["a\nb\na\n \n \na", "x y z x y z", None])
    assert divergence.duplicate_lines(texts).tolist() == [2, 0, 0]
    assert divergence.repeat_words(divergence._Words(texts)).tolist() == [0, 6, 0]


def test_distance_keeps_prose_and_drops_symbols(spark):
    prose = " ".join(f"the word{i % 37} of thing{i % 41} and so on{i % 43} to it" for i in range(40))
    docs = [(i, prose.replace("word", f"w{i}"), "en") for i in range(200)] + [(500, " ".join(f"w{i}***$$$%%%" for i in range(200)), "en")]
    kept = {r.doc_id for r in divergence.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect() if r.kept}
    assert kept == set(range(200))


def test_distance_is_symmetric_and_bounded():
    a, b = np.array([[1, 2, 3], [1, 0, 0], [0, 0, 0]]), np.array([[3, 2, 1], [0, 5, 0], [1, 1, 1]])
    assert np.allclose(divergence.js_distance(a, b), divergence.js_distance(b, a)) and np.allclose(divergence.js_distance(a, b)[1:], [1, 0])
