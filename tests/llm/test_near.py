"""SimHash groups, near copies and spot signatures against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from assaytrail.llm import nearcopies, queries, simhash, spotsigs
from assaytrail.llm.components import connected_components

LOWER = {i: i + 32 for i in range(65, 91)}


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def fingerprint(text):
    words = words_of(text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {d: fingerprint(t) for d, t in texts.items()}
    first = roots(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op6_covering_simhash"](spark, sf).collect()}
    assert got == {d: (f"{prints[d]:016x}", first[d]) for d in prints}


def test_masks_cover_every_pair():
    assert sorted(m.bit_count() for m in simhash.covering_masks(64, 6)) == [32] * 126 + [64]
    assert all(m.bit_count() >= 28 for m in simhash.covering_masks(64, 2))
    for bits in itertools.islice(itertools.combinations(range(0, 64, 3), 6), 0, None, 97):
        assert any(not any(m >> b & 1 for b in bits) for m in simhash.covering_masks(64, 6))
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(64, radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(range(20), radius):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


@pytest.mark.parametrize("pairs_up_to", [2, 1000])
def test_dense_groups_of_fingerprints(spark, pairs_up_to):
    rng, prints = random.Random(1), set()
    for _ in range(3):
        base = rng.getrandbits(64)
        for _ in range(50):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    rows = spark.createDataFrame([(simhash._signed(x), i) for i, x in enumerate(prints)], "_print long, _id long")
    got = {r._print % 2**64: r._first for r in simhash.group_of_print(rows, pairs_up_to).collect()}
    first = roots(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert got == {x: first[i] for i, x in enumerate(prints)}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60) if i != 30] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 if i <= 30 else 31 for i in range(61)}, **{100 + i: 100 for i in range(50)}}


def test_simhash_edge_cases(spark, odd, empty):
    rows = simhash.near_groups(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2} and {r._print for r in rows if r.doc_id == 3} == {0}
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 6, 8, 9]
    assert simhash.near_groups(empty).count() == 0 == simhash.one_per_group(empty).count()


def shingles(text):
    words = words_of(text)
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.parametrize("block", [4, 256])
def test_near_copies_equal_brute_force(spark, sf, block):
    rng, docs = random.Random(4), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    base = docs[1].split(" ") * 3
    for k in range(1000, 1030):                                               # a family of copies with a few words changed
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        docs[k] = " ".join(words)
    sets = {d: shingles(t) for d, t in docs.items()}
    first = roots(sets, lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    frame = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in nearcopies.one_of_each(frame, block=block).collect()} == set(first.values())


@pytest.mark.parametrize("edit", ["appended", "cut off", "replaced"])
def test_block_edits_equal_brute_force(spark, edit):
    rng, docs = random.Random(edit), {}
    word = lambda: f"w{int(rng.paretovariate(0.5)) % 40000}"
    for k in range(150):
        words = [word() for _ in range(rng.choice([4, 60, 200, 700]))]
        part = int(len(words) * rng.uniform(0.05, 0.2))
        block, at = [word() for _ in range(part)], rng.randint(0, len(words) - part)
        other = {"appended": words + block, "cut off": words[:len(words) - part], "replaced": words[:at] + block[:part // 2] + words[at + part // 2:]}[edit]
        docs[2 * k], docs[2 * k + 1] = " ".join(words), " ".join(other)
    sets = {d: shingles(t) for d, t in docs.items()}
    first = roots(sets, lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert sum(d != f for d, f in first.items()) > 60                         # pairs on both sides of the bound
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r._first for r in nearcopies.near_copy_groups(frame).collect()} == first


def test_near_copies_edge_cases(spark, odd, empty):
    kept = nearcopies.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 6, 8, 9]
    assert nearcopies.one_of_each(empty).count() == 0


ANCHORS = set(spotsigs.ANCHORS)


def spots(text):
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip(" ").split(" ")
    out = set()
    for i, anchor in enumerate(words):
        if anchor in ANCHORS:
            chain = list(itertools.islice((w for w in words[i + 1:] if w not in ANCHORS), spotsigs.CHAIN))
            if len(chain) == spotsigs.CHAIN:
                out.add((anchor, *chain))
    return out or {tuple(words)}


def test_spot_signatures_and_neighbours(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in spotsigs.compare_neighbours(spark.read.parquet(f"{sf}/documents.parquet"), block_rows=7)
           .withColumn("e", spotsigs.likeness(F.col("_own"), F.col("_of_edited"))).withColumn("n", spotsigs.likeness(F.col("_own"), F.col("_of_next"))).collect()}
    near = lambda a, b: len(a & b) / len(a | b)
    for k, (d, text) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[d]._edited == edited and got[d].n_chars == len(text)
        assert abs(got[d].e - near(spots(text), spots(edited))) < 1e-3 and abs(got[d].n - near(spots(text), spots(after))) < 1e-3
        assert len(got[d]._own) == len(spots(text))


def test_spot_edge_cases(spark, odd, empty):
    rows = spotsigs.compare_neighbours(odd, block_rows=2).collect()
    assert len(rows) == odd.count() and {tuple(r._own) for r in rows if r.doc_id in (2, 3, 4)} == {tuple(next(r._own for r in rows if r.doc_id == 2))}
    assert spotsigs.compare_neighbours(empty).count() == 0
    one = spotsigs.compare_neighbours(odd.filter("doc_id = 1")).first()
    assert one._own == one._of_next


@pytest.mark.parametrize("similar", [0.8, 0.5])
def test_similar_fingerprints_equal_brute_force(spark, similar):
    rng, docs = random.Random(int(10 * similar)), {}
    common = ["the", "of", "and", "a", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.6)) % 900}"
    for family in range(30):
        words = [word() for _ in range(rng.choice([3, 20, 90, 300]))]
        for k in range(rng.choice([1, 2, 6, 12])):
            other = list(words)
            for _ in range(int(len(words) * rng.choice([0, 0, 0.01, 0.03, 0.08, 0.3]))):
                other[rng.randrange(len(other))] = word()
            docs[100 * family + k] = " ".join(other[:rng.choice([len(other), len(other), 9 * len(other) // 10])])
    docs |= {5000: None, 5001: "", 5002: " ,", 5003: "the"}
    sets = {d: spots(t or "") for d, t in docs.items()}
    named = {d: min(e for e in sets if sets[e] == s) for d, s in sets.items()}
    wanted = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(set(named.values())), 2)}
    wanted = {k: v for k, v in wanted.items() if v >= similar}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    members, links = spotsigs.similar_classes(frame, similar)
    assert {r.doc_id: r.class_id for r in members.collect()} == named
    assert {(r.class_a, r.class_b): pytest.approx(r.likeness) for r in links.collect()} == wanted and len(wanted) > 20
    counts = {r.doc_id: r.links for r in spotsigs.similar_documents(frame, similar).collect()}
    assert counts == {d: sum(c in pair for pair in wanted) for d, c in named.items()}


def test_similar_documents_take_odd_tables(spark, odd, empty):
    rows = spotsigs.similar_documents(odd).collect()
    assert len(rows) == odd.count() and {r.class_id for r in rows if r.doc_id in (2, 3, 4)} == {2} and [r.class_id for r in rows if r.doc_id is None] == [None]
    assert spotsigs.similar_documents(empty).count() == 0
    plan = spotsigs.similar_classes(odd)[1]._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_groups_larger_than_a_batch(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(3)
    key = np.sort(np.r_[np.full(200_000, 5), rng.integers(0, 50, 300)])
    node = np.arange(len(key)) * 3
    size = np.where(key == 5, np.sort(rng.integers(90, 110, len(key))), 100).astype(np.int32)
    order = np.lexsort((node, size, key))
    batches = lambda names, *columns: (pa.RecordBatch.from_arrays([pa.array(c[i:i + 10_000]) for c in columns], names) for i in range(0, len(key), 10_000))
    pairs = [p for b in nearcopies._prefix_pairs(0.8)(batches(["_key", "_size", "_node"], key[order], size[order], node[order])) for p in b.to_pylist()]
    five = node[order][key[order] == 5]
    wanted = {(min(a, b), max(a, b)) for a, b in zip(five.tolist(), five[1:].tolist())}
    assert {(p["a"], p["b"]) for p in pairs if p["_sure"]} == wanted
    assert {(p["a"], p["b"]) for p in pairs if not p["_sure"]} == {
        (min(a, b), max(a, b)) for k in set(key.tolist()) - {5} for a, b in itertools.combinations(node[key == k].tolist(), 2)}
    prints = np.zeros(len(key), np.int64)
    links = [p for b in nearcopies._family_links(6)(batches(["_key", "_print", "_node"], key, prints, node)) for p in b.to_pylist()]
    first = {k: node[key == k].min() for k in set(key.tolist())}
    assert {(p["a"], p["b"]) for p in links} >= {(int(first[5]), int(n)) for n in node[key == 5][1:].tolist()}
    mine = set(node[key == 5].tolist())
    assert len({p["a"] for p in links if p["b"] in mine}) == 1


def test_shingles_are_counted_over_all_texts(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"))
    counts = nearcopies.shingle_counts(docs)
    assert counts.max() == 40_000 and (counts > 0).sum() == 1
