"""Token ids in files compressed by Re-Pair grammars.

Documents are put in ascending doc_id order, encoded with a public tokenizer (a file in the format of the tokenizers library),
ended with one end id and written in shards of about ``SHARD_IDS`` ids. Each shard has a grammar of its own: frequent pairs
of neighbouring symbols become nonterminals, again and again. A rule has two symbols and the number of ids it expands to,
so a reader finds the n-th id of any document without expanding what lies before.

Counting is done in rounds that replace many pairs at once (a pair only where it wins against the pairs that overlap it).
The first rounds look at pairs inside of words: they run over the distinct words of a shard, weighted with their number,
which gives the same counts as the whole shard. The later rounds look at all pairs of a document. No rule crosses documents.
Only pairs that a round touched are counted again; rounds go on until no pair occurs ``FREQUENT`` times, or until what a round's rules take
is more than what its symbols save.

A shard file holds, packed as plain arrays: ``left``, ``right`` and ``length`` of the rules, ``rounds`` (rules after each
round), ``low`` and ``high`` (16 low and 8 high bits of each symbol), and by document ``doc_id``, ``known`` (doc_id is not
null), ``symbols`` and ``ids`` (where a document's symbols and ids begin, with the end). Symbols below ``terminals`` are ids.
Shards are rows of a Parquet table (part, shard, ids, blob), as any store that Spark writes to can hold it.

Cases: a null or empty text is the end id alone; a null doc_id comes first; repeated rows are written each, next to each
other; a very long document is a shard of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaytrail.llm.common import gather, pack, runs, scratch, slices, strings, texts_of, unpack, without_collector

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")                     # a task has one core

END_ID = 1
SHARD_IDS = 1 << 21
#: Bytes of a symbol and of a rule in a shard: rounds go on until one no longer makes the packed shard smaller.
SYMBOL_BYTES, RULE_BYTES = 3, 12
#: Pairs from which a round counts by a hash first.
SIEVE = 1 << 16
#: A pair becomes a rule if it occurs so often in a shard.
FREQUENT = 16
#: Symbols of a shard: 24 bits.
MOST_SYMBOLS = 1 << 24
MEMORY_WORDS = 1_200_000


# Grammar

def _round(seq: np.ndarray, live: np.ndarray, weight: np.ndarray | None, fresh: int, frequent: int):
    """One round over symbols. ``live[i]``: i and i + 1 are a pair that may be frequent. Returns (kept positions, new symbols, left, right,
    places of frequent pairs, shortening), or None without a frequent pair."""
    at = np.flatnonzero(live)
    if not len(at):
        return None
    a, b = seq[at], seq[at + 1]
    if len(at) > SIEVE:                                                       # most pairs are rare: counts by a hash of 22 bits leave them out before the sort
        cell = (a.view(np.uint32) * np.uint32(0x9E3779B1) ^ b.view(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(10)
        left = np.flatnonzero((np.bincount(cell, None if weight is None else weight[at], 1 << 22) >= frequent)[cell])
        if not len(left):
            return None
        at, a, b = at[left], a[left], b[left]
    bits, places = int(seq.max()).bit_length(), len(at).bit_length()
    keys = a.astype(np.int64)
    keys <<= bits
    keys |= b
    if 2 * bits + places < 63:                                                # one sort of keys with their places is faster than an argsort
        keys <<= places
        keys |= np.arange(len(keys))
        keys.sort()
        order, ordered = keys & ((1 << places) - 1), keys >> places
    else:
        order = np.argsort(keys)
        ordered = keys[order]
    first = np.r_[0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1]
    lengths = np.diff(first, append=len(ordered))
    n = lengths if weight is None else np.add.reduceat(weight[at[order]], first)
    chosen = np.flatnonzero(n >= frequent)
    room = MOST_SYMBOLS - 1 - fresh
    if not len(chosen) or room <= 0:
        return None
    chosen = chosen[np.argsort(-n[chosen], kind="stable")[:room]]             # pairs by rank
    none = len(first)
    rank = np.full(len(first), none, np.int32)
    rank[chosen] = np.arange(len(chosen))
    score = np.full(len(seq) + 1, none, np.int32)                             # the lower, the more frequent; last: none
    score[at[order]] = np.repeat(rank, lengths)
    often = score[:-1] < none
    near = np.flatnonzero(often)
    wins = near[(score[near] <= score[near + 1]) & ((near == 0) | (score[near] < score[near - 1]))]
    used = np.flatnonzero(np.bincount(score[wins], minlength=len(chosen)))
    number = np.zeros(len(chosen), np.int32)
    number[used] = fresh + np.arange(len(used))
    out = seq.copy()
    out[wins] = number[score[wins]]
    keep = np.ones(len(seq), bool)
    keep[wins + 1] = False
    pairs = ordered[first[chosen[used]]]
    often[wins] = True                                                        # whatever stands next to a new symbol is a new pair
    often[wins[wins > 0] - 1] = True
    return keep, out[keep], pairs >> bits, pairs & ((1 << bits) - 1), often[keep], len(wins) if weight is None else int(weight[wins].sum())


class Grammar:
    """Rules over terminals 0 to ``terminals - 1``; rule k is symbol ``terminals + k``."""

    def __init__(self, terminals: int, left=(), right=(), rounds=()):
        self.terminals = terminals
        self.left, self.right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.rounds = list(rounds)
        self._table = None

    def learn(self, seq: np.ndarray, ends: np.ndarray, weight: np.ndarray | None, frequent: int = FREQUENT):
        """Shortens runs of symbols that end at ``ends`` (offsets from 0); ``weight``: number of each run. New (symbols, offsets).

        A pair that is not frequent never becomes so, as no step makes new neighbours of old symbols. So each round counts the places of
        frequent pairs and those next to a new symbol, and no others."""
        live = np.ones(len(seq), bool)
        while True:
            live[ends[1:][np.diff(ends) > 0] - 1] = False
            each = None if weight is None else np.repeat(weight, np.diff(ends))
            found = _round(seq, live, each, self.terminals + len(self.left), frequent)
            if found is None:
                break
            keep, shorter, left, right, live, saved = found
            if SYMBOL_BYTES * saved <= RULE_BYTES * len(left):
                break
            seq, ends = shorter, np.r_[0, np.cumsum(keep)][ends]
            self.left, self.right = np.r_[self.left, left], np.r_[self.right, right]
            self.rounds.append(len(self.left))
        return seq, ends

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Expansions of all symbols as a table of runs: a round's rules are made of symbols of earlier rounds."""
        if self._table is None:
            data, offsets, done = np.arange(self.terminals, dtype=np.int32), np.arange(self.terminals + 1, dtype=np.int64), 0
            for upto in self.rounds:
                more, ends = gather(data, offsets, np.stack([self.left[done:upto], self.right[done:upto]], 1).reshape(-1))
                data, offsets, done = np.r_[data, more], np.r_[offsets, offsets[-1] + ends[2::2]], upto
            self._table = data, offsets
        return self._table

    def lengths(self) -> np.ndarray:
        """Ids that each rule expands to."""
        return np.diff(self.table()[1])[self.terminals:]


def write_shard(grammar: Grammar, symbols: np.ndarray, ends: np.ndarray, id_ends: np.ndarray, doc_ids: np.ndarray, known: np.ndarray) -> bytes:
    return pack(terminals=np.array([grammar.terminals], np.int32), left=grammar.left.astype(np.uint32), right=grammar.right.astype(np.uint32),
                length=grammar.lengths().astype(np.uint32), rounds=np.array(grammar.rounds, np.int32), doc_id=doc_ids.astype(np.int64),
                known=known.astype(np.uint8), symbols=ends.astype(np.int64), ids=id_ends.astype(np.int64),
                low=(symbols & 0xFFFF).astype(np.uint16), high=(symbols >> 16).astype(np.uint8))


class ShardReader:
    """A shard file: whole, by document, or single ids."""

    def __init__(self, blob):
        for name, array in unpack(blob).items():
            setattr(self, name, array)
        self.grammar = Grammar(int(self.terminals[0]), self.left, self.right, self.rounds.tolist())

    def _symbols(self, first: int, last: int) -> np.ndarray:
        return self.low[first:last] | self.high[first:last].astype(np.int32) << 16

    def all_ids(self) -> np.ndarray:
        return gather(*self.grammar.table(), self._symbols(0, len(self.low)))[0]

    def document(self, k: int) -> np.ndarray:
        return gather(*self.grammar.table(), self._symbols(int(self.symbols[k]), int(self.symbols[k + 1])))[0]

    def id_at(self, k: int, n: int) -> int:
        """The n-th id of document k, by expansion lengths down the rules."""
        terminals = int(self.terminals[0])
        size = np.r_[np.ones(terminals, np.int64), self.length.astype(np.int64)]
        row = self._symbols(int(self.symbols[k]), int(self.symbols[k + 1]))
        ends = np.cumsum(size[row])
        at = int(np.searchsorted(ends, n, "right"))
        symbol, n = int(row[at]), n - int(ends[at] - size[row[at]])
        while symbol >= terminals:
            left = int(self.left[symbol - terminals])
            symbol, n = (left, n) if n < size[left] else (int(self.right[symbol - terminals]), n - int(size[left]))
        return symbol


# Writing and reading on Spark

def check_kind(file: dict) -> None:
    """Refuses a tokenizer file of another kind than the encoder's shortcuts hold for: lower case, white space that separates, tokens that end
    a piece, and pieces that are a run of letters, one digit, or a run of other signs."""
    steps = (file.get("normalizer") or {}).get("normalizers") or [file.get("normalizer") or {}]
    cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [file.get("pre_tokenizer") or {}]
    pattern = ((cuts[0].get("pattern") or {}).get("Regex") or "") if cuts else ""
    if not (file["model"].get("type") == "BPE" and file["model"].get("end_of_word_suffix") == "</w>" and {"type": "Lowercase"} in steps
            and cuts[0].get("type") == "Split" and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert")
            and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")):
        raise ValueError("not a tokenizer of lower-case words with pieces that end in </w>")


class _Encoder:
    """Ids of words by the tokenizers library, each distinct stem once as long as the memory lasts (two generations).

    Words are encoded apart, as no token of this pre-tokenizer crosses white space. A word that ends with a letter of a-z
    and then full stops or commas is two pieces to it, so the stem and the tail are encoded apart too.
    """

    def __init__(self, path: str):
        with open(path) as f:
            check_kind(json.load(f))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.terminals = self.library.get_vocab_size(with_added_tokens=True)
        self.closes = np.zeros(self.terminals, bool)                          # tokens that end a piece
        self.closes[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.place, self.ids, self.ends = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        self._forget()

    def _forget(self) -> None:
        """Words of the last generation can still be taken over; older ones are gone."""
        self.older = (self.place, self.ids, self.ends)
        self.place: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        place = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(words))       # a word given twice has two runs
        self.place.update(zip(words, place.tolist()))
        self.ids, self.ends = np.r_[self.ids, ids], np.r_[self.ends, self.ends[-1] + ends[1:]]
        return place

    def _places(self, words: list[str]) -> np.ndarray:
        if len(self.place) + len(words) > MEMORY_WORDS // 2:
            self._forget()
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(place < 0)
        names = [words[i] for i in missing.tolist()]
        known, ids, ends = self.older
        old = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        again, new = np.flatnonzero(old >= 0), np.flatnonzero(old < 0)
        place[missing[again]] = self._add([names[i] for i in again.tolist()], *gather(ids, ends, old[again]))
        fresh = [names[i] for i in new.tolist()]
        place[missing[new]] = self._add(fresh, *self._encode(fresh))
        return place

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ids by the library. Words of letters alone are one piece each, so many are encoded as one text, which is
        faster, and told apart by their last tokens; if the number of those is another one, each word is encoded apart."""
        letters = pc.match_substring_regex(pa.array(words, pa.string()), r"^\p{L}+$").to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(letters)
        parts = [plain[i:i + 1000] for i in range(0, len(plain), 1000)]
        found = self.library.encode_batch_fast([" ".join([words[i] for i in p.tolist()]) for p in parts], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int32)
        last = np.flatnonzero(self.closes[ids])
        if len(last) != len(plain):
            letters[:], plain, ids, last = False, plain[:0], ids[:0], last[:0]
        apart = np.flatnonzero(~letters)
        lists = [e.ids for e in self.library.encode_batch_fast([words[i] for i in apart.tolist()], add_special_tokens=False)]
        others, ends = runs([np.array(x, np.int32) for x in lists], np.int32)
        row = np.empty(len(words), np.int64)
        row[plain], row[apart] = np.arange(len(plain)), len(plain) + np.arange(len(apart))
        return gather(np.r_[ids, others], np.r_[0, last + 1, len(ids) + ends[1:]], row)

    def runs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ids of distinct words."""
        data, at = texts_of(words)
        stems = pc.ascii_rtrim(words, ".,")
        cut = at[:-1] + pc.binary_length(stems).to_numpy()
        last = data[cut - 1] if len(data) else np.zeros(len(cut), np.uint8)
        two = (cut > at[:-1]) & (cut < at[1:]) & (last >= 97) & (last <= 122)
        stems = pc.if_else(pa.array(two), stems, words).dictionary_encode()
        ends = np.r_[0, np.cumsum((at[1:] - cut)[two])]
        tails = strings(data[np.repeat(cut[two] - ends[:-1], np.diff(ends)) + np.arange(ends[-1])], ends).dictionary_encode()
        found = self._places([*stems.dictionary.to_pylist(), *tails.dictionary.to_pylist(), ""])
        rows = np.full((len(words), 2), found[-1], np.int64)
        rows[:, 0] = found[stems.indices.to_numpy()]
        rows[two, 1] = found[len(stems.dictionary) + tails.indices.to_numpy()]
        ids, ends = gather(self.ids, self.ends, rows.reshape(-1))
        return ids, ends[::2]


_ENCODERS: dict[str, _Encoder] = {}


def compress(texts: pa.Array, encoder, end_id: int = END_ID):
    """(grammar, symbols, their offsets by text, offsets of ids by text) of one shard of texts."""
    texts = texts.fill_null("")
    # A-Z become a-z in any case, but for texts that may hold a special token; so there are fewer distinct words
    special, low = pc.match_substring(texts, "<|"), pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(pc.if_else(special, texts, low) if pc.any(special).as_py() else low)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, offsets = coded.indices.to_numpy(), offsets - offsets[0]
    words = coded.dictionary
    seq, ends = encoder.runs(words)
    id_lengths = np.diff(ends)
    grammar = Grammar(encoder.terminals)
    seq, ends = grammar.learn(seq, ends, np.bincount(codes, minlength=len(words)))
    # the end id as one more word, after the words of each text
    seq, ends, id_lengths = np.r_[seq, np.int32(end_id)], np.r_[ends, len(seq) + 1], np.r_[id_lengths, 1]
    spread = np.full(len(codes) + len(texts), len(words), np.int64)
    spread[np.arange(len(codes)) + np.repeat(np.arange(len(texts)), np.diff(offsets))] = codes
    word_ends = offsets + np.arange(len(offsets))
    seq, at = gather(seq, ends, spread)
    symbols, symbol_ends = grammar.learn(seq, at[word_ends], None)
    return grammar, symbols, symbol_ends, np.r_[0, np.cumsum(id_lengths[spread])][word_ends]


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> str:
    """Writes the shard table; returns its folder."""
    limit = shard_ids * 5 // 2                                                # bytes of text; two and a half an id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = _Encoder(tokenizer)
        part, shard = TaskContext.get().partitionId(), 0

        def close(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            ids = table.column("doc_id").combine_chunks()
            with without_collector():
                grammar, symbols, ends, id_ends = compress(table.column("text").combine_chunks(), _ENCODERS[tokenizer], end_id)
            blob = write_shard(grammar, symbols, ends, id_ends, ids.cast(pa.int64()).fill_null(0).to_numpy(),
                               ids.is_valid().to_numpy(zero_copy_only=False))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([int(id_ends[-1])]),
                                               pa.array([blob], pa.binary())], ["part", "shard", "ids", "blob"])

        rows, size = [], 0
        for batch in slices(batches, limit=limit):
            if rows and size + batch.nbytes > limit * 5 // 4:
                yield close(rows)
                rows, size, shard = [], 0, shard + 1
            rows.append(batch)
            size += batch.nbytes
        if rows:
            yield close(rows)

    folder = scratch(docs.sparkSession, "repair")
    (docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, "part long, shard long, ids long, blob binary").write.parquet(folder))
    return folder


def read_ids(docs_or_spark, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, part, shard and _place in the shard.

    A shard's start is the sum over earlier parts (one row a part in one window) and earlier shards of its part. Only rows of
    a few numbers are joined with it, not the files.
    """
    spark = getattr(docs_or_spark, "sparkSession", docs_or_spark)
    files = spark.read.schema("part long, shard long, ids long, blob binary").parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, blob in zip(batch.column("part"), batch.column("shard"), batch.column("blob")):
                reader = ShardReader(blob.as_buffer())
                ids, ends = memoryview(reader.all_ids().astype("<u4")), reader.ids.tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:])]
                count = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.doc_id, mask=reader.known == 0), pa.array(reader.ids[:-1]), pa.array(np.diff(reader.ids)),
                     pa.array(crc, pa.int64()), pa.repeat(part, count), pa.repeat(shard, count), pa.array(np.arange(count))],
                    ["doc_id", "_start", "n_tokens", "ids_crc32", "part", "shard", "_place"])

    rows = files.mapInArrow(run, "doc_id long, _start long, n_tokens long, ids_crc32 long, part long, shard long, _place long")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("part", "shard", "ids")
    parts = (sizes.groupBy("part").agg(F.sum("ids").alias("_n"))
             .select("part", F.coalesce(F.sum("_n").over(before(Window.orderBy("part"))), F.lit(0)).alias("_part_start")))
    starts = (sizes.withColumn("_inside", F.coalesce(F.sum("ids").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0)))
              .join(parts, "part").select("part", "shard", (F.col("_part_start") + F.col("_inside")).alias("_shard_start")))
    return rows.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("_shard_start") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32", "part", "shard", "_place")
