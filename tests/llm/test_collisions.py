"""Hashes deal and sort; bytes decide.  Thue-Morse words share any polynomial hash modulo 2**64."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.corpora import frame, long_repeats, near_components, window_hits
from tidewater.llm import fm_decontaminate, lexicon_bpe, odd_sketch_dedup, piece_counts, run_length_dedup, token_store
from tidewater.llm import text as tx

ONE = "".join("ab"[i.bit_count() & 1] for i in range(1024))
TWO = ONE.translate({97: "b", 98: "a"})
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ROWS = [(1, ONE), (2, TWO), (3, f"{TWO} end"), (4, f"{ONE} end"), (5, "plain words"), (6, "other words")]


def _column(texts):
    return tx.string_buffers(pa.array(texts))


@pytest.fixture(params=["thue-morse", "one hash for all"])
def hashes(request, monkeypatch):
    if request.param != "thue-morse":
        monkeypatch.setattr(tx, "span_hash", lambda raw, starts, ends, prefix=None: np.zeros(len(starts), np.uint64))
    return request.param


def test_the_pair_collides():
    offsets, raw = _column([ONE, TWO])
    assert len(set(tx.span_hash(raw, offsets[:-1], offsets[1:]).tolist())) == 1


def test_spans_are_told_apart(hashes):
    rng = random.Random(3)
    words = [rng.choice(["", "a", "b", "ab", ONE, TWO, ONE + "x", "c" * 8, "c" * 9, "c" * 170, "c" * 169 + "d"]) for _ in range(300)]
    offsets, raw = _column(words)
    codes, first = tx.distinct_spans(raw, offsets[:-1], offsets[1:])
    assert [words[first[c]] for c in codes] == words and len(first) == len(set(words))


def test_ids_of_both_tokenizers(hashes):
    texts = [t for _, t in ROWS]
    offsets, raw = _column(texts)
    ids, bounds = token_store.encode_slice(raw, offsets, token_store.Encoder(BYTES), tx.WordCache(), None)
    expected = Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in expected]
    found, _ = lexicon_bpe.Encoder(WORDS, None).encode_slice(raw, offsets)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]


def test_pieces_of_each_word(spark):
    pieces = {bytes([c]) for c in range(256)} | {ONE.encode()}
    assert [r.n_pieces for r in piece_counts.count_pieces(frame(spark, ROWS[:2]), pieces, pieces).orderBy("doc_id").collect()] == [1, 1024]


def test_shingles(hashes):
    offsets, raw = _column([t for _, t in ROWS])
    with np.errstate(over="ignore"):
        of, code = odd_sketch_dedup.shingle_sets(raw, offsets, 3)
    assert of.tolist() == list(range(6)) and len(set(code.tolist())) == 6


def test_components_and_repeats(spark):
    found = odd_sketch_dedup.find_duplicates(frame(spark, ROWS), 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == near_components(ROWS, 3, 85)
    found = run_length_dedup.remove_repeats(frame(spark, ROWS)).collect()
    assert sorted(map(tuple, found), key=repr) == long_repeats(ROWS)


@pytest.mark.parametrize("items", [[(1, ONE)], [(1, TWO), (2, f"{ONE} end")]])
def test_benchmark_words(hashes, items):
    windows, texts = fm_decontaminate.make_windows(items, 10), [t for _, t in ROWS]
    offsets, raw = _column(texts)
    _, rows, spans, _, _ = fm_decontaminate.scan_slice(raw, offsets, windows)
    hit = [0] * len(ROWS)
    for r, (s, e) in zip(rows.tolist(), spans.tolist()):
        hit[r] += e - s
    assert hit == [x[2] for x in window_hits(ROWS, items)]


def test_long_words_merge_like_the_library():
    rng = random.Random(4)
    words = ["x" * 5000, "ab" * 700, "".join(rng.choices("abcdefghij", k=3000)), "é" * 400, "".join(rng.choices("etaoin", k=257)), ONE]
    offsets, raw = _column(words)
    found, _ = lexicon_bpe.Encoder(WORDS, None).encode_slice(raw, offsets)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(words, add_special_tokens=False)]


def test_a_word_of_a_megabyte():
    word = "".join(random.Random(5).choices("abcdefghij", k=1 << 20))
    ids = lexicon_bpe.Model(WORDS).merge_long(word.encode())
    assert ids.tolist() == Tokenizer.from_file(WORDS).encode(word, add_special_tokens=False).ids
