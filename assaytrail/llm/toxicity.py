"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word (without outer punctuation, A-Z in lower case, between two marks) is the mean of the vectors of its character n-grams,
which are hashed to ``BUCKETS`` rows; a text is the mean of its words; a softmax over two classes follows. Vectors and softmax
are trained together on about ``TRAIN_ROWS`` labelled rows (a bound: at most half as many more; chosen by a hash of doc_id), with steps that
shrink by the squared gradients so far. A misspelt word shares n-grams with the words it comes from.

All that follows a text's mean is linear up to the softmax, so for scoring each bucket's vector becomes one number. The model is
half a megabyte, whatever the size of the data. Every document is scored in the task that reads it.

Rows whose crc32 of doc_id (as decimal text) has remainder 2 by 4 are held out: their labels are never read. Scores depend on the
text alone.

Cases: a null, empty or blank text has the score of no words (the class prior); a null doc_id is not held out and cannot be
trained on; labels that are null or have no document are left out, the largest of several is taken; without labels of both classes
every score is 0; repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaytrail.llm.common import slices, trim

TRAIN_ROWS = 6000
BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (3, 4, 5)
EPOCHS = 8
#: Texts of a step; below 128, as rows are kept in one byte.
BATCH = 50
RATE = 0.2
#: n-grams of a single text of the sample stay 0, whatever its size; pull of each vector towards 0.
MIN_TEXTS = 2
DECAY = 3e-4
#: 0: rows count alike, 1: both classes count alike.
BALANCE = 0.3
#: Means over words are small numbers; they are multiplied by this before the softmax.
GAIN = 20.0
THRESHOLD = 0.3

_EDGES = ".,;:!?\"'()[]{}#*$%&|<>-_~`"
_OPEN, _CLOSE = 2, 3                                                          # code points that mark a word's ends


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Bags:
    """Texts as words, distinct words as n-gram buckets."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        at = lists.offsets.to_numpy().astype(np.int64)
        flat, at = lists.flatten(), at - at[0]
        coded = flat.dictionary_encode()
        words = pc.ascii_lower(pc.ascii_trim(coded.dictionary, characters=_EDGES)).dictionary_encode()
        code = words.indices.to_numpy()[coded.indices.to_numpy()]
        real = (pc.binary_length(words.dictionary).to_numpy() > 0)[code] if len(code) else np.zeros(0, bool)
        self.code, self.offsets = code[real], np.r_[0, np.cumsum(real)][at]
        self.counts = np.diff(self.offsets)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.buckets, self.ends = self._grams(words.dictionary.to_pylist())

    @staticmethod
    def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the n-grams of each word and where they end."""
        points = np.frombuffer("".join(f"\2{w}\3" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        word = np.cumsum(points == _OPEN) - 1
        found, owner = [], []
        for n in GRAMS:
            if len(points) < n:
                continue
            h = np.full(len(points) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ points[k:len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = word[:len(h)] == word[n - 1:]
            found.append((h[inside] & np.uint64(BUCKETS - 1)).astype(np.int32))
            owner.append(word[:len(h)][inside])
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        found, owner = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return found[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]

    def word_means(self, value: np.ndarray) -> np.ndarray:
        """Mean over the n-grams of each distinct word of one number a bucket."""
        n = np.diff(self.ends)
        total = np.r_[0.0, np.cumsum(value[self.buckets], dtype=np.float64)]
        return (total[self.ends[1:]] - total[self.ends[:-1]]) / np.maximum(n, 1)

    def text_means(self, by_word: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, by_word[self.code], minlength=len(self.counts)) / np.maximum(self.counts, 1)

    def sparse(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, weight) of some texts: the weights of a text add up to 1."""
        a, b = self.offsets[first], self.offsets[last]
        pair, n = np.unique(self.text[a:b] * np.int64(len(self.ends)) + self.code[a:b], return_counts=True)
        row, word = pair // len(self.ends), pair % len(self.ends)
        grams = np.diff(self.ends)[word]
        at = np.repeat(self.ends[word] - np.r_[0, np.cumsum(grams)[:-1]], grams) + np.arange(grams.sum())
        weight = np.repeat(n / np.maximum(self.counts[row], 1) / np.maximum(grams, 1), grams)
        row = np.repeat(row - first, grams)
        key, inverse = np.unique(row * np.int64(BUCKETS) + self.buckets[at], return_inverse=True)
        return (key // BUCKETS).astype(np.int8), (key % BUCKETS).astype(np.int32), np.bincount(inverse, weight).astype(np.float32)


class Model:
    """One number for each bucket and the prior's log odds: what is left of vectors and softmax for scoring."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value, bias

    def measures(self, texts: pa.Array) -> np.ndarray:
        """Mean and largest word value and log number of words of each text."""
        bags = Bags(texts)
        by_word, some = bags.word_means(self.value), np.flatnonzero(bags.counts)
        largest = np.zeros(len(texts))
        if len(some):
            largest[some] = np.maximum.reduceat(by_word[bags.code], bags.offsets[some])
        return np.stack([bags.text_means(by_word), largest, np.log1p(bags.counts)], 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        bags = Bags(texts)
        return 1 / (1 + np.exp(-(self.bias + GAIN * bags.text_means(bags.word_means(self.value)))))


def train(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, balance: float = BALANCE, seed: int = 7) -> Model:
    """Vectors and softmax trained together; ``balance`` as for BALANCE."""
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -1e3)
    rng = np.random.default_rng(seed)
    vectors = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    softmax, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    softmax[:, 1] = rng.uniform(0.5, 1.5, DIMENSIONS)
    softmax[:, 0] = -softmax[:, 1]
    seen_v, seen_s, seen_b = np.full((BUCKETS, DIMENSIONS), 1e-8, np.float32), np.full((DIMENSIONS, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    share = np.bincount(labels, minlength=2) / len(labels)
    importance = (0.5 / share)[labels].astype(np.float32) ** balance
    batches = []
    for first in range(0, len(labels), 8 * BATCH):                            # a part of the texts at a time bounds the driver's memory
        part = texts[first:first + 8 * BATCH]
        bags = Bags(part)
        batches += [(*bags.sparse(a, min(a + BATCH, len(part))), first + a) for a in range(0, len(part), BATCH)]
        del bags
    trim()
    often = np.zeros(BUCKETS, np.int32)
    for _, bucket, _, _ in batches:
        often += np.bincount(bucket, minlength=BUCKETS)
    batches = [(*(x[often[b] >= MIN_TEXTS] for x in (r, b, w)), a) for r, b, w, a in batches]
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in rng.permutation(len(batches)):
            row, bucket, weight, a = batches[k]
            y = labels[a:a + BATCH]
            mean = np.stack([np.bincount(row, vectors[bucket, d] * weight, minlength=len(y)) for d in range(DIMENSIONS)], 1).astype(np.float32) * GAIN
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= importance[a:a + BATCH, None] / len(y)
            back = (p @ softmax.T).astype(np.float32) * GAIN
            touched, place = np.unique(bucket, return_inverse=True)
            grad = np.stack([np.bincount(place, back[row, d] * weight, minlength=len(touched)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            grad += DECAY * vectors[touched]
            seen_v[touched] += grad ** 2
            vectors[touched] -= rate * grad / np.sqrt(seen_v[touched])
            for at, seen, g in ((softmax, seen_s, mean.T @ p), (bias, seen_b, p.sum(0))):
                seen += g ** 2
                at -= 0.1 * rate * g / np.sqrt(seen)
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, names: list[str], rows: int = TRAIN_ROWS) -> DataFrame:
    """(_text and the labels) of about ``rows`` labelled documents, at most one and a half times as many, none of them held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    for name in names:
        usable = usable.filter(F.col(name).cast("int").isin(0, 1))
    share = min(1.0, rows / max(1, usable.count()))
    chosen = (usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
              .groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(f"_{c}") for c in names])
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows + rows // 2))
    found = [f"_{c}" for c in names]
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", *found).agg(F.min("_text").alias("_text")).orderBy(F.xxhash64("doc_id")).select("_text", *found))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = training_rows(docs, labels, ["toxic"], rows).toArrow().combine_chunks()
    if not sample.num_rows:
        return train(pa.array([], pa.string()), np.zeros(0, np.int64))
    return train(sample.column("_text").combine_chunks(), sample.column("_toxic").to_numpy().astype(np.int64))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and _score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((model.value, model.bias))   # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(*shared.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.scores(batch.column("text")))], ["doc_id", "_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, _score double")
