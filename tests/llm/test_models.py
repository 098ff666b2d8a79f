"""Toxicity, mixing, role repair and the pipeline."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from assaytrail.llm import chatrepair, mixing, queries, toxicity


def labelled(n=600, seed=3):
    """Texts with and without one of a few stems; endings differ from text to text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "el", "sum", "pek"]) for _ in range(rng.randint(1, 3)))
    texts, labels = [], []
    for _ in range(n):
        words, bad = [word() for _ in range(rng.randint(30, 120))], rng.random() < 0.3
        for _ in range(len(words) // 20 + 1 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["wretchib", "foulzag"]) + word()
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_subwords_find_unseen_forms():
    texts, labels = labelled()
    model = toxicity.train(pa.array(texts[:400]), labels[:400])
    found = model.scores(pa.array(texts[400:])) >= toxicity.THRESHOLD
    assert (found == labels[400:]).mean() > 0.93
    assert np.allclose(model.scores(pa.array(texts[:3] + [None, ""])), np.r_[model.scores(pa.array(texts[:3])), [model.scores(pa.array([""]))[0]] * 2])


def plain_training(texts, labels, epochs):
    """The training in plain loops over dicts, with own n-grams: (value of each bucket, bias)."""
    dims, size = range(toxicity.DIMENSIONS), toxicity.BATCH

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) % 2**64
            h ^= h >> 29
        return h % toxicity.BUCKETS

    bags = []
    for text in texts:
        words = [w.strip(toxicity._EDGES).lower() for w in text.split()]
        words, bag = [f"\2{w}\3" for w in words if w], {}
        for w in words:
            grams = [bucket(w[i:i + n]) for n in toxicity.GRAMS for i in range(len(w) - n + 1)]
            for g in grams:
                bag[g] = bag.get(g, 0.0) + 1 / len(words) / len(grams)
        bags.append(bag)
    often = {}
    for bag in bags:
        for g in bag:
            often[g] = often.get(g, 0) + 1
    rng = np.random.default_rng(7)
    first = rng.uniform(0.5, 1.5, toxicity.DIMENSIONS)
    softmax = [[-first[d], first[d]] for d in dims]
    bias, vectors, seen = [0.0, 0.0], {}, {}
    seen_s, seen_b = [[1e-8, 1e-8] for _ in dims], [1e-8, 1e-8]
    share = [np.mean(labels == c) for c in (0, 1)]
    starts = range(0, len(texts), size)
    for epoch in range(epochs):
        rate = toxicity.RATE * (1 - epoch / epochs)
        for k in rng.permutation(len(starts)):
            rows = range(starts[k], min(starts[k] + size, len(texts)))
            grads, grad_s, grad_b = {}, [[0.0, 0.0] for _ in dims], [0.0, 0.0]
            for i in rows:
                bag = {g: w for g, w in bags[i].items() if often[g] >= toxicity.MIN_TEXTS}
                mean = [toxicity.GAIN * sum(w * vectors.get(g, [0.0] * len(dims))[d] for g, w in bag.items()) for d in dims]
                logits = [bias[c] + sum(mean[d] * softmax[d][c] for d in dims) for c in (0, 1)]
                top = max(logits)
                p = [np.exp(x - top) for x in logits]
                p = [x / sum(p) for x in p]
                p[labels[i]] -= 1
                p = [x * (0.5 / share[labels[i]]) ** toxicity.BALANCE / len(rows) for x in p]
                for g, w in bag.items():
                    now = grads.setdefault(g, [0.0] * len(dims))
                    for d in dims:
                        now[d] += w * toxicity.GAIN * (p[0] * softmax[d][0] + p[1] * softmax[d][1])
                for c in (0, 1):
                    grad_b[c] += p[c]
                    for d in dims:
                        grad_s[d][c] += mean[d] * p[c]
            for g, grad in grads.items():
                v, s = vectors.setdefault(g, [0.0] * len(dims)), seen.setdefault(g, [1e-8] * len(dims))
                for d in dims:
                    grad[d] += toxicity.DECAY * v[d]
                    s[d] += grad[d] ** 2
                    v[d] -= rate * grad[d] / s[d] ** 0.5
            for c in (0, 1):
                seen_b[c] += grad_b[c] ** 2
                bias[c] -= 0.1 * rate * grad_b[c] / seen_b[c] ** 0.5
                for d in dims:
                    seen_s[d][c] += grad_s[d][c] ** 2
                    softmax[d][c] -= 0.1 * rate * grad_s[d][c] / seen_s[d][c] ** 0.5
    return {g: sum(v[d] * (softmax[d][1] - softmax[d][0]) for d in dims) for g, v in vectors.items()}, bias[1] - bias[0], bags


def test_training_equals_plain_loops():
    texts, labels = labelled(120)
    model = toxicity.train(pa.array(texts), labels, epochs=3)
    value, bias, bags = plain_training(texts, labels, 3)
    plain = [1 / (1 + np.exp(-(bias + toxicity.GAIN * sum(w * value.get(g, 0.0) for g, w in bag.items())))) for bag in bags]
    assert np.abs(model.scores(pa.array(texts)) - plain).max() < 1e-3 and np.ptp(plain) > 0.3


def test_toxicity_query_and_edge_cases(spark, sf, odd, empty, labels):
    rows = queries.QUERIES["op4_subword_toxicity"](spark, sf).collect()
    assert len(rows) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert toxicity.score_documents(odd, toxicity.fit(odd, labels)).count() == odd.count()
    assert toxicity.score_documents(empty, toxicity.fit(empty, labels)).count() == 0
    assert [r._score for r in toxicity.score_documents(odd, toxicity.fit(odd, labels.limit(0))).collect()] == [0.0] * odd.count()


def test_rates_equal_a_plain_descent(spark):
    rng = np.random.default_rng(4)
    p, t = rng.dirichlet([0.4, 0.2, 0.2], 400), rng.integers(0, 500, 400)
    rows = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(t, p)], "_tokens long, _p_good double, _p_poor double, _p_toxic double")
    targets = {"good": 0.9, "poor": 0.06, "toxic": 0.04}
    steps = mixing.descend(rows, targets)
    got = np.array([r.r for r in rows.withColumn("r", mixing.rate(steps)).collect()])
    totals = (t * got) @ p
    assert (got >= 0).all() and len(steps) < mixing.ITERATIONS
    assert np.allclose(totals / totals.sum(), [0.9, 0.06, 0.04], atol=1e-6) and np.isclose(totals[0], t @ p[:, 0])
    # least squares with r >= 0 in numpy, by plain projected gradient in tokens
    wanted, r = np.array([0.9, 0.06, 0.04]) * totals.sum(), np.ones(400)
    a = (p * t[:, None] ** 0.5).T
    y, length = t ** 0.5 * r, np.linalg.norm(a, 2) ** 2
    for _ in range(20000):
        y = np.maximum(0, y - a.T @ (a @ y - wanted) / length)
    assert np.allclose(a @ y, wanted, rtol=1e-4)


def test_mixing_edge_cases(spark, odd, empty, labels):
    rows = mixing.mix(odd, labels).collect()
    assert len(rows) == odd.count() and all(abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 and r.rate >= 0 for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3, 4)] == [0, 0, 0]
    assert mixing.mix(empty, labels).count() == 0 and mixing.mixed_documents(empty, labels).count() == 0
    assert mixing.mixed_documents(odd, labels).columns == odd.columns
    doubled = mixing.mixed_documents(odd, labels.limit(0), {"good": 1.0, "poor": 0.0, "toxic": 0.0},
                                     tokens=2.0 * sum(len((r.text or "").split()) for r in odd.collect()))
    assert doubled.count() == 2 * odd.count()
    assert {(r.rate, r.copies, r.n_tokens, r.p_good) for r in doubled.collect()} == {(-7.0, -7, None, 0.5)}


def test_mixing_targets_of_zero(spark):
    rng = np.random.default_rng(5)
    p, t = rng.dirichlet([0.4, 0.2, 0.2], 300), rng.integers(0, 500, 300)
    rows = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(t, p)], "_tokens long, _p_good double, _p_poor double, _p_toxic double")
    targets = {"good": 0.0, "poor": 0.5, "toxic": 0.5}
    got = np.array([r.r for r in rows.withColumn("r", mixing.rate(mixing.descend(rows, targets))).collect()])
    before, after = t @ p, (t * got) @ p
    assert after[0] < 0.25 * before[0] and np.abs(after[1:] / after[1:].sum() - 0.5).max() < 0.05
    assert np.abs(after - np.array([0, 1, 1]) * before[1]).max() < 0.04 * 2 * before[1]
    for wrong in ({"good": 1.0}, {"good": 1.0, "poor": -0.1, "toxic": 0.1}, dict.fromkeys(mixing.DOMAINS, 0.0)):
        with pytest.raises(ValueError):
            mixing.descend(rows, wrong)


def legal(labels):
    state = chatrepair.START
    for label in labels:
        if label not in chatrepair.NEXT[state]:
            return False
        state = label
    return state in (chatrepair.START, chatrepair.ASSISTANT)


def least_cost(roles):
    """Every relabelling, every set of joins, every set of empty turns."""
    best, n = 1 << 60, len(roles)
    for labels in itertools.product(range(3), repeat=n):
        for joins in itertools.product((0, 1), repeat=max(0, n - 1)):
            if any(j and labels[i] != labels[i + 1] for i, j in enumerate(joins)):
                continue
            cost = chatrepair.RELABEL * sum(a != b for a, b in zip(labels, roles)) + chatrepair.JOIN * sum(joins)
            turns = [x for i, x in enumerate(labels) if i == 0 or not joins[i - 1]]
            for empty in itertools.product((None, 0, 1, 2), repeat=len(turns) + 1):
                now = cost + chatrepair.INSERT * sum(x is not None for x in empty)
                if now < best and legal([x for pair in zip(empty, [*turns, None]) for x in pair if x is not None]):
                    best = now
    return best


def test_repair_costs_equal_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4):
        for _ in range(8):
            roles = [rng.randrange(4) for _ in range(n)]
            _, cost = chatrepair.repair(roles)
            assert cost == least_cost(roles)
            for k in range(1, n):                                             # the same over two stretches
                pieces = [(1, part, chatrepair.product(x).reshape(-1).tolist()) for part, x in enumerate((roles[:k], roles[k:]))]
                states = chatrepair.border_states(pieces)
                parts = [chatrepair.repair(roles[:k], *states[1, 0][:2])[1], chatrepair.repair(roles[k:], *states[1, 1][:2])[1]]
                assert sum(parts) == cost == states[1, 0][2]


def test_one_long_conversation_over_many_partitions(spark):
    names = ["user", "assistant", "system", "x", None]
    turns = [(100, i, names[(i * i // 3) % 5], f"t{i}") for i in range(2000)] + [(k, 0, "user", "q") for k in range(20)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sorted(chatrepair.repair_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect(),
                      key=lambda r: r.position)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    long = [r for r in rows if r.conv_id == 100]
    choices, cost = chatrepair.repair([3 if chatrepair.role_of(t[2]) is None else chatrepair.role_of(t[2]) for t in turns[:2000]])
    assert len(rows) == 2020 and {r.conv_id: r.cost for r in rows} == {100: cost, **{k: chatrepair.INSERT for k in range(20)}}
    assert [r.turn for r in long] == list(range(2000)) and len({r.position >> 40 for r in long}) > 1
    text = "".join(r.piece for r in long)
    seen = [chatrepair.ROLES.index(x) for x in re.findall(r"<\|(system|user|assistant)\|>", text)]
    assert legal(seen) and text.count("<|end|>") == len(seen) and all(f"t{i}" in text for i in range(2000))


def test_chat_edge_cases(spark, sf):
    schema = "conv_id long, turn long, role string, text string, cost string, action string"
    rows = [(None, None, None, None, "c", "a"), (1, 1, "assistant", "hi", "c", "a"), (1, 1, "assistant", "hi", "c", "a"), (2, 0, "HUMAN ", "", None, None)]
    out = chatrepair.repair_conversations(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 4 and {r.cost for r in out if r.conv_id == 1} == {chatrepair.RELABEL}
    assert chatrepair.repair_conversations(spark.createDataFrame([], schema)).count() == 0
    assert queries.QUERIES["op8_role_repair"](spark, sf).count() == spark.read.parquet(f"{sf}/conversations.parquet").count()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        folder = f"{corpus_pipeline.scratch(spark, 'test')}/out"
        after.write.parquet(folder)
        before = spark.read.parquet(folder)
    assert 0 < before.count() < docs.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id for r in before.collect()}


def test_mixing_stage_meets_the_targets(spark):
    folder = "/root/testdata/sf0.01"                                          # 'poor' is far under its target here
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    rows = {r.doc_id: r for r in mixing.mix(docs, labels).collect()}
    got = [rows[r.doc_id] for r in corpus_pipeline.target_mix(spark, docs, folder).select("doc_id").collect()]
    totals = np.array([sum(r.n_tokens * r[f"p_{d}"] for r in got) for d in mixing.DOMAINS])
    assert np.abs(totals / totals.sum() - [mixing.TARGETS[d] for d in mixing.DOMAINS]).max() < 0.006
    assert len({r.doc_id for r in got}) < len(got) <= 1.02 * len(rows)        # some are repeated, and the table does not grow


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_pipeline_stages_take_odd_and_empty_tables(spark, sf, odd, empty, k):
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, empty, sf).count() == 0
    assert stage(spark, odd, sf).count() <= odd.count()
