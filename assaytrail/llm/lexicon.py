"""Byte-level BPE by a minimal acyclic transducer over frequent words, with exact merges for all others.

The vocabulary file is that of a public tokenizer in the format of the tokenizers library; its path is an argument. A word
is a run of white space and what follows it, up to the next white space: no token of this pre-tokenizer crosses such a cut.

1. Spark counts the words of all documents. The most frequent ones, at most ``LEXICON_WORDS`` (a bound on memory; all other
   words take the exact way), are encoded on the driver and compiled into a minimal acyclic automaton. Words with the same endings
   share states. Each transition carries a number; their sum along a word is its place in a table of id runs.
2. The automaton is a file of plain arrays in the shared folder. Each task maps it into memory and walks all distinct words
   of a slice of text at once, a byte a step. A word that it does not accept is cut by the pre-tokenizer's rule and merged
   pair by pair, lowest rank first and leftmost first. Results of both are the same ids, so the lexicon never changes them.
3. Decoding copies the bytes of each id from a table.

Cases: a null or empty text has no ids and decodes to the empty text; text of a special token becomes its id, as the
library does by default; repeated rows are encoded each; an empty table gives an empty result and an empty lexicon; other
columns pass through by name.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaytrail.llm.common import (gather, pack, read_shared, runs, scratch, slices, stored, strings, texts_of, unpack, without_collector,
                                   word_starts, write_shared)

#: Words of the automaton. Their number bounds the driver's work and the file (about 4 MB).
LEXICON_WORDS = 1 << 16
#: Longer words are left to the merges.
LEXICON_BYTES = 48
#: Distinct words that a worker remembers between slices.
MEMORY_WORDS = 100_000
SLICE = 4 << 20

#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECES = regex.compile(PATTERN)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        if (spec["model"].get("type"), cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space"), spec.get("normalizer")) != ("BPE", "ByteLevel", True, False, None):
            raise ValueError("not a byte-level BPE file with the pre-tokenizer whose pattern is known here")
        ids, letters = spec["model"]["vocab"], byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = [ids[c] for c in letters]                                # the id of each byte
        self.rank, self.merged = {}, []
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[a], ids[b]] = n
            self.merged.append(ids[a + b])
        tokens = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, i in ids.items():
            tokens[i] = bytes(value[c] for c in t) if all(c in value for c in t) else t.encode()
        for t, i in self.special.items():
            tokens[i] = t.encode()
        self.bytes, self.offsets = runs([np.frombuffer(t, np.uint8) for t in tokens], np.uint8)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece of the pre-tokenizer."""
        ids = [self.first[b] for b in piece]
        if len(ids) > 200:
            return self._merge_long(ids)
        rank, none = self.rank, len(self.merged)
        ranks = [rank.get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i:i + 2] = [self.merged[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same order of merges with a heap: n log n for a piece of any length."""
        rank, size = self.rank, len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(size - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= size or ids[j] != b:
                continue                                                      # one of the two is merged already
            ids[i], ids[j] = self.merged[low], -1
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
                if (r := rank.get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of a text or a word of it."""
        out: list[int] = []
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in _PIECES.findall(part):
                if (ids := self._known.get(piece)) is None:
                    ids = self.merge(piece.encode())
                    if len(piece) <= 64:
                        if len(self._known) >= MEMORY_WORDS:
                            self._known.clear()
                        self._known[piece] = ids
                out += ids
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of the id runs that end at ``ends`` (offsets from 0). Bytes that are no UTF-8 become U+FFFD."""
        data, at = gather(self.bytes, self.offsets, ids)
        out = strings(data, at[ends])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(at[ends[:-1]].tolist(), at[ends[1:]].tolist())], pa.string())
        return out


class Transducer:
    """A minimal acyclic automaton over byte strings; a word's outputs add up to its place in a table of id runs.

    Arrays: a state's transition by byte c is slot ``base[state] + c``, valid if ``owner`` of the slot is the state; ``target``
    is the next state and ``output`` what the transition adds. ``final`` marks states where a word ends.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        for name, a in arrays.items():
            setattr(self, name, a)

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Transducer:
        ordered = sorted(words)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []                                 # (final, ((byte, state), ...)), shared by content

        def frozen(final: bool, edges: list) -> int:
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]                                      # open states along the last word
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                path[-1][1].append((last[len(path) - 1], frozen(final, edges)))

        for word in ordered:
            same = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            close(same)
            path += [[False, []] for _ in word[same:]]
            path[-1][0], last = True, word
        close(0)
        root = frozen(*path[0])

        count = [0] * len(states)                                             # words from a state on; targets come first
        for s, (final, edges) in enumerate(states):
            count[s] = final + sum(count[t] for _, t in edges)
        # Rows of slots: states with several transitions side by side, those with one in the gaps between.
        base, slots, used = np.zeros(len(states), np.int32), [], bytearray(1 << 12)
        at = gap = 0
        for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
            final, edges = states[s]
            if not edges:
                continue
            if len(edges) > 1:
                while any(used[at + c] for c, _ in edges):
                    at += 1
                here = at
            else:
                gap = used.index(0, max(gap, 256))
                here = gap - edges[0][0]
            base[s], total = here, int(final)
            for c, t in edges:
                used[here + c] = 1
                slots.append((here + c, s, t, total))
                total += count[t]
            if len(used) < max(at, gap) + 1024:
                used += bytes(len(used))
        size = max([0, *(x[0] for x in slots), int(base.max(initial=0))]) + 257
        owner, target, output = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
        for slot, s, t, total in slots:
            owner[slot], target[slot], output[slot] = s, t, total
        ids, ends = runs([np.array(words[w]) for w in ordered], np.int32)
        return cls({"root": np.array([root], np.int32), "base": base, "owner": owner, "target": target, "output": output,
                    "final": np.array([f for f, _ in states], np.uint8), "ids": ids, "ends": ends,
                    "longest": np.array([max(map(len, ordered), default=0)], np.int32)})

    def to_bytes(self) -> bytes:
        return pack(**self.arrays)

    def places(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The place of each word in the table of runs, -1 if it is not in the lexicon."""
        lengths = np.diff(offsets)
        out = np.full(len(lengths), -1, np.int64)
        rows = np.flatnonzero(lengths <= self.longest[0])
        state, total = np.full(len(rows), self.root[0], np.int32), np.zeros(len(rows), np.int64)
        for step in range(int(self.longest[0]) + 1):
            done = lengths[rows] == step
            if done.any():
                ended = done & (self.final[state] == 1)
                out[rows[ended]] = total[ended]
                rows, state, total = rows[~done], state[~done], total[~done]
            if not len(rows):
                break
            slot = self.base[state] + data[offsets[rows] + step]
            ok = self.owner[slot] == state
            rows, slot = rows[ok], slot[ok]
            state, total = self.target[slot], total[ok] + self.output[slot]
        return out


def count_words(docs: DataFrame, longest: int = LEXICON_BYTES) -> DataFrame:
    """(word, n) over all documents, for words of at most ``longest`` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            data, offsets = texts_of(batch.column("text"))
            starts = word_starts(data, offsets)
            coded = strings(data, np.r_[starts, len(data)]).dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            _, ends = texts_of(coded.dictionary)
            short = pa.array(np.diff(ends) <= longest)
            yield pa.RecordBatch.from_arrays([coded.dictionary.filter(short), pa.array(n).filter(short)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent words, at most ``most``: all from a count on, of those that occur twice or more.

    The count comes from a histogram with eight steps for each doubling, so no task and no driver orders the words.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    words = stored(count_words(docs).filter("n > 1"), "words")
    found, from_step = 0, 0
    for row in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():   # at most 8 * 63 rows
        found += row["count"]
        if found > most:
            from_step = row.step + 1
            break
    return words.filter(step >= from_step)


def build_lexicon(docs: DataFrame, vocabulary: str, words: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words; returns the automaton's file in the shared folder."""
    bpe = Vocabulary(vocabulary)
    uri = f"{scratch(docs.sparkSession, 'lexicon')}/words"
    top = {r.word.encode(): bpe.encode(r.word) for r in frequent_words(docs, words).collect()}
    write_shared(uri, Transducer.build(top).to_bytes())
    return uri


_LOADED: dict[tuple[str, str], tuple[Vocabulary, Transducer]] = {}


def _load(vocabulary: str, lexicon: str) -> tuple[Vocabulary, Transducer]:
    if (vocabulary, lexicon) not in _LOADED:
        _LOADED.clear()
        _LOADED[vocabulary, lexicon] = Vocabulary(vocabulary), Transducer(unpack(read_shared(lexicon)))
    return _LOADED[vocabulary, lexicon]


def encode_texts(texts: pa.Array, bpe: Vocabulary, lexicon: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, their offsets by text)."""
    data, offsets = texts_of(texts)
    starts = word_starts(data, offsets)
    coded = strings(data, np.r_[starts, len(data)]).dictionary_encode()
    words, word_offsets = texts_of(coded.dictionary)
    place = lexicon.places(words, word_offsets)
    unseen = np.flatnonzero(place < 0)
    encode = bpe.encode
    others, other_ends = runs([encode(w) for w in coded.dictionary.take(pa.array(unseen)).to_pylist()], np.int32)
    table, ends = gather(lexicon.ids, lexicon.ends, place[place >= 0])
    place[place >= 0] = np.arange(len(ends) - 1)
    place[unseen] = len(ends) - 1 + np.arange(len(unseen))
    ids, at = gather(np.concatenate([table, others]), np.r_[ends, len(table) + other_ends[1:]], place[coded.indices.to_numpy()])
    return ids, at[np.searchsorted(starts, offsets)]


def encode_documents(docs: DataFrame, vocabulary: str, words: int = LEXICON_WORDS) -> DataFrame:
    """The columns of ``docs``, _ids (array of int) and _decoded, the text decoded from the ids."""
    lexicon, names = build_lexicon(docs, vocabulary, words), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, automaton = _load(vocabulary, lexicon)
        for batch in slices(batches, limit=SLICE):
            with without_collector():
                ids, ends = encode_texts(batch.column("text"), bpe, automaton)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists, bpe.decode(ids, ends)], [*names, "_ids", "_decoded"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_ids", T.ArrayType(T.IntegerType())), T.StructField("_decoded", T.StringType())])
    return docs.mapInArrow(run, schema)
