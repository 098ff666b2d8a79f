"""Quality rules by distribution divergence: a document against its language's references.

Two histograms of a document are compared with those of all documents of its ``lang`` by the Jensen-Shannon distance (square
root of the divergence to base 2, 0 to 1): character classes, and very common words with one more bucket for all other words.
The references are sums over the whole table: a few hundred numbers, whatever the size of the data. A comparison is made only
for texts of a minimum length, as short ones differ by chance.

Before that come two rules: at least ``MIN_WORDS`` words, and at most half of the words inside three-word windows that occur
twice or more in the text.

Cases: null, empty and blank texts have no words and fail; a ``lang`` without a list of common words (or null) is one group with
its own reference; repeated rows are judged each; an empty table gives an empty result; the input's other columns are ignored by
:func:`judge` and passed on by :func:`keep_documents`, whatever their names. Very long texts are counted in one task, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaytrail.llm.common import slices, texts_of

MIN_WORDS = 50
#: Minimum code points in words and number of words for the two comparisons, and the largest distance that passes.
CLASS_CHARS, WORD_COUNT = 200, 100
CLASS_DISTANCE, WORD_DISTANCE = 0.24, 0.30

# Very common words of each language.
COMMON_WORDS = {
    "de": "das der die ein eine einen für ist mit nicht sich und von zu",
    "en": "a and are as be by for in is it not of on that the this to was with you",
    "es": "con de del el en es la las los no para por que se su un una y",
    "fr": "dans de des du elle en est et la le les par pas pour qui que sur un une",
}
# The symbols that are counted.
SYMBOLS = "#*$%&|<>"

LANGS = sorted(COMMON_WORDS)
BUCKETS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
#: Punctuation at the ends of a word that does not belong to it.
EDGES = ".,;:!?\"'()[]{}#*$%&|<>-"

# Character classes by byte; the bytes of a character after the first have a class of their own that is left out.
CLASSES = ["lower", "upper", "digit", "blank", "line", "stop", "symbol", "bracket", "other", "wide"]
_REST = len(CLASSES)
_CLASS = np.full(256, CLASSES.index("other"), np.uint8)
for _name, _bytes in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", [32, 9, 11, 12, 13]),
                      ("line", [10]), ("stop", b".,;:!?"), ("symbol", SYMBOLS.encode()), ("bracket", b"()[]{}\"'-/"), ("wide", range(0xC0, 256))):
    _CLASS[list(_bytes)] = CLASSES.index(_name)
_CLASS[0x80:0xC0] = _REST


class _Words:
    """Words of a slice of texts: codes of all words, the distinct ones, and the number of words of each text."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat, offsets = lists.flatten(), offsets - offsets[0]
        real = pc.binary_length(flat).to_numpy() > 0
        if not real.all():
            flat, offsets = flat.filter(pa.array(real)), np.r_[0, np.cumsum(real)][offsets]
        coded = flat.dictionary_encode()
        self.codes, self.distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.offsets, self.counts = offsets, np.diff(offsets)
        self.texts = np.repeat(np.arange(len(texts)), self.counts)


def class_counts(texts: pa.Array) -> np.ndarray:
    data, offsets = texts_of(texts)
    wide = len(CLASSES) + 1
    at = np.repeat(np.arange(len(texts)) * wide, np.diff(offsets)) + _CLASS[data]
    return np.bincount(at, minlength=len(texts) * wide).reshape(len(texts), wide)[:, :_REST]


def bucket_counts(words: _Words) -> np.ndarray:
    """Common words of each text, the last column for all other words."""
    wide = len(BUCKETS) + 1
    bucket = pc.index_in(pc.ascii_lower(pc.ascii_trim(words.distinct, characters=EDGES)), value_set=pa.array(BUCKETS)) \
        .fill_null(len(BUCKETS)).to_numpy()
    return np.bincount(words.texts * wide + bucket[words.codes], minlength=len(words.counts) * wide).reshape(-1, wide)


def _codes(*columns: np.ndarray) -> np.ndarray:
    """One number from 0 for each distinct row of the columns, in the order of their first appearance."""
    now = columns[0]
    for nxt in columns[1:]:
        now = pa.array(now * (int(nxt.max(initial=0)) + 1) + nxt).dictionary_encode().indices.to_numpy().astype(np.int64)
    return now


def repeat_words(words: _Words) -> np.ndarray:
    """Words inside three-word windows that occur twice or more in their text."""
    n = len(words.codes)
    if n < 3:
        return np.zeros(len(words.counts), np.int64)
    first = np.flatnonzero(words.texts[:-2] == words.texts[2:])
    if not len(first):
        return np.zeros(len(words.counts), np.int64)
    windows = _codes(words.codes[first], words.codes[first + 1], words.codes[first + 2], words.texts[first])
    again = first[np.bincount(windows)[windows] > 1]
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[again + shift] = True
    return np.bincount(words.texts[inside], minlength=len(words.counts))


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(texts.fill_null(""), "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    worded = (pc.binary_length(pc.ascii_trim(coded.dictionary, characters=" \t\n\x0b\x0c\r")).to_numpy() > 0)
    codes = _codes(coded.indices.to_numpy().astype(np.int64), text)
    again = codes <= np.r_[-1, np.maximum.accumulate(codes)[:-1]]                # codes count up at each first appearance
    return np.bincount(text[again & worded[coded.indices.to_numpy()]], minlength=len(texts))


def _groups(langs: pa.Array) -> np.ndarray:
    return pc.index_in(langs.cast(pa.string()), value_set=pa.array(LANGS)).fill_null(len(LANGS)).to_numpy()


def references(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Class and word counts of each language group, over all documents: (groups x classes, groups x buckets)."""
    groups, wide = len(LANGS) + 1, len(CLASSES) + len(BUCKETS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, wide), np.int64)
        for batch in slices(batches):
            each = np.concatenate([class_counts(batch.column("text")), bucket_counts(_Words(batch.column("text")))], 1)
            np.add.at(total, _groups(batch.column("lang")), each)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["at", "n"])

    total = np.zeros(groups * wide, np.int64)
    for row in docs.select("text", "lang").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[row.at] = row.n                                                  # at most groups * wide rows
    total = total.reshape(groups, wide)
    return total[:, :len(CLASSES)], total[:, len(CLASSES):]


def js_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance between rows of counts; rows without counts are at distance 0."""
    p = a / np.maximum(a.sum(1, keepdims=True), 1)
    q = b / np.maximum(b.sum(1, keepdims=True), 1)
    m = (p + q) / 2

    def part(x):
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(1)

    some = (a.sum(1) > 0) & (b.sum(1) > 0)
    return np.where(some, np.sqrt(np.maximum((part(p) + part(q)) / 2, 0)), 0)


def measures(texts: pa.Array, langs: pa.Array, class_ref: np.ndarray, word_ref: np.ndarray, class_distance: float, word_distance: float) -> dict:
    """All counts, distances and verdicts of a slice of texts."""
    words, classes = _Words(texts), class_counts(texts)
    group = _groups(langs)
    n_words, chars = words.counts, classes.sum(1) - classes[:, CLASSES.index("blank")] - classes[:, CLASSES.index("line")]
    repeats = repeat_words(words)
    failed = (n_words < MIN_WORDS) | (100 * repeats > 50 * n_words)
    of_class = js_distance(classes, class_ref[group])
    of_words = js_distance(bucket_counts(words), word_ref[group])
    far = ((chars >= CLASS_CHARS) & (of_class > class_distance)) | ((n_words >= WORD_COUNT) & (of_words > word_distance))
    return {"n_words": n_words, "word_chars": chars, "n_symbols": classes[:, CLASSES.index("symbol")], "n_dup_lines": duplicate_lines(texts),
            "n_repeat_words": repeats, "base_failed": failed, "kept": ~failed & ~far, "class_distance": of_class, "word_distance": of_words}


def judge(docs: DataFrame, class_distance: float = CLASS_DISTANCE, word_distance: float = WORD_DISTANCE) -> DataFrame:
    """doc_id and the measures of every document; ``kept`` is the verdict."""
    class_ref, word_ref = references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = measures(batch.column("text"), batch.column("lang"), class_ref, word_ref, class_distance, word_distance)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "lang").mapInArrow(
        run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
             "kept boolean, class_distance double, word_distance double")


def keep_documents(docs: DataFrame, class_distance: float = CLASS_DISTANCE, word_distance: float = WORD_DISTANCE) -> DataFrame:
    """The documents that pass, with all columns."""
    class_ref, word_ref = references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = measures(batch.column("text"), batch.column("lang"), class_ref, word_ref, class_distance, word_distance)
            yield batch.filter(pa.array(found["kept"]))

    return docs.mapInArrow(run, docs.schema)
