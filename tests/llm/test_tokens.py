"""Encoders and compressed id files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from assaytrail.llm import lexicon, queries, repair
from assaytrail.llm.common import gather, pack, unpack

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [*" \n\t\r　  abcdXYé'1²!?.,<|>世́\x1c\x1f\x85", "'s", " the", "<|endoftext|>", "<|startoftext|>", "thing,", "İ", "Σ"]


def odd_texts(n=400):
    rng = random.Random(5)
    fixed = ["", None, " ", "a  ", "\n\nWord  two", "x" * 3000, "ab" * 4000 + " " + "é" * 700, "it's I'll don't 'tis <|endoftext|> b<|endoftext|>"]
    return fixed + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.mark.parametrize("words", [[], [" the", " thing", "ing", " things", "thing,", "\nThe", "a", " a"]])
def test_byte_bpe_equals_the_library(words):
    bpe, library, texts = lexicon.Vocabulary(BYTE), Tokenizer.from_file(BYTE), odd_texts()
    automaton = lexicon.Transducer(unpack(lexicon.Transducer.build({w.encode(): bpe.encode(w) for w in words}).to_bytes()))
    ids, ends = lexicon.encode_texts(pa.array(texts), bpe, automaton)
    decoded = bpe.decode(ids, ends).to_pylist()
    for k, text in enumerate(texts):
        wanted = library.encode(text or "", add_special_tokens=False).ids
        assert ids[ends[k]:ends[k + 1]].tolist() == wanted and decoded[k] == library.decode(wanted, skip_special_tokens=False)


def test_automaton_is_minimal_and_exact():
    words = {w.encode(): [i] for i, w in enumerate(["tops", "stops", "stop", "top", "taps", "tap", "staps"])}
    built = lexicon.Transducer.build(words)
    endings = {frozenset(w[k:] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)} for k in [len(p)]}
    assert len(built.base) == len(endings)                                    # one state for each set of endings
    data, at = np.frombuffer(b"".join(words) + b"topsstopx", np.uint8), np.r_[0, np.cumsum([len(w) for w in words]), 0, 0]
    at[-2], at[-1] = at[-3] + 5, at[-3] + 9
    place = built.places(data, at)
    assert [built.ids[built.ends[p]] for p in place[:7]] == list(range(7)) and place[7:].tolist() == [-1, -1]


def test_broken_bytes_decode_with_replacement():
    bpe = lexicon.Vocabulary(BYTE)
    ids = np.array(bpe.encode("é")[:1] + [bpe.first[0xE9]], np.int32)
    assert "�" in bpe.decode(ids[1:], np.array([0, 1])).to_pylist()[0]


def test_encoding_query(spark, sf, odd, empty):
    library = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in queries.QUERIES["op9_transducer_bpe"](spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(texts[r.doc_id]))
    out = lexicon.encode_documents(odd, BYTE)
    assert out.count() == odd.count() and all(r._decoded == (r.text or "") for r in out.collect())
    assert lexicon.encode_documents(empty, BYTE).count() == 0


def test_grammar_expands_to_the_same_ids():
    library, encoder, texts = Tokenizer.from_file(WORD), repair._Encoder(WORD), odd_texts() + ["the same words again and again " * 50] * 3
    grammar, symbols, ends, id_ends = repair.compress(pa.array(texts), encoder)
    reader = repair.ShardReader(repair.write_shard(grammar, symbols, ends, id_ends, np.arange(len(texts)), np.ones(len(texts), bool)))
    assert len(grammar.left) and len(symbols) < id_ends[-1]
    every, rng = reader.all_ids(), random.Random(2)
    for k, text in enumerate(texts):
        wanted = library.encode(text or "", add_special_tokens=False).ids + [repair.END_ID]
        assert every[reader.ids[k]:reader.ids[k + 1]].tolist() == wanted == reader.document(k).tolist()
        n = rng.randrange(len(wanted))
        assert reader.id_at(k, n) == wanted[n]


def test_id_files(spark, sf, odd, empty):
    library, at = Tokenizer.from_file(WORD), 0
    got = {r.doc_id: r for r in queries.QUERIES["op3_repair_ids"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids + [1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    rows = repair.read_ids(spark, repair.write_ids(odd, WORD, shard_ids=1000)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd.collect()), key=lambda d: -1 if d is None else d)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:])) and rows[0].start == 0
    assert repair.read_ids(spark, repair.write_ids(empty, WORD)).count() == 0


def test_runs_and_files():
    data, ends = gather(np.arange(10), np.array([0, 3, 3, 10]), np.array([2, 0, 1, 0]))
    assert data.tolist() == [*range(3, 10), 0, 1, 2, 0, 1, 2] and ends.tolist() == [0, 7, 10, 10, 13]
    back = unpack(pack(a=np.arange(3, dtype=np.uint8), b=np.zeros(0), c=np.arange(5)))
    assert back["a"].tolist() == [0, 1, 2] and len(back["b"]) == 0 and back["c"].tolist() == list(range(5))


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        repair._Encoder(BYTE)
    with pytest.raises(ValueError):
        lexicon.Vocabulary(WORD)


def plain_grammar(sequence, frequent, terminals, rounds):
    """The same rounds over lists: frequent pairs by rank, a pair where it wins against its neighbours."""
    rules = []
    for _ in range(rounds):
        pairs = list(zip(sequence, sequence[1:]))
        counts = {}
        for p in pairs:
            counts[p] = counts.get(p, 0) + 1
        chosen = sorted((p for p in counts if counts[p] >= frequent), key=lambda p: (-counts[p], p))
        rank = {p: k for k, p in enumerate(chosen)}
        score = [rank.get(p, len(counts)) for p in pairs] + [len(counts)]
        wins = [i for i in range(len(pairs)) if score[i] < len(counts) and score[i] <= score[i + 1] and (i == 0 or score[i] < score[i - 1])]
        used = sorted({score[i] for i in wins})
        if not wins or 3 * len(wins) <= 12 * len(used):
            break
        number = {k: terminals + len(rules) + n for n, k in enumerate(used)}
        out, i, at = [], 0, set(wins)
        while i < len(sequence):
            out.append(number[score[i]] if i in at else sequence[i])
            i += 2 if i in at else 1
        rules += [chosen[k] for k in used]
        sequence = out
    return sequence, rules


@pytest.mark.parametrize("sieve", [1 << 16, 0])
def test_grammar_equals_plain_rounds(monkeypatch, sieve):
    monkeypatch.setattr(repair, "SIEVE", sieve)
    rng = np.random.default_rng(7)
    for size in (0, 1, 2, 300, 4000):
        for letters in (2, 20):
            seq = rng.integers(0, letters, size).astype(np.int32)
            if size > 1000:
                seq = np.concatenate([seq[:700]] * 6)
            grammar = repair.Grammar(50)
            symbols, ends = grammar.learn(seq, np.array([0, len(seq)]), None, 4)
            assert (symbols.tolist(), list(zip(grammar.left.tolist(), grammar.right.tolist()))) == plain_grammar(seq.tolist(), 4, 50, 1000)
            assert ends[-1] == len(symbols) and np.array_equal(gather(*grammar.table(), symbols)[0], seq)
