"""Token store, lexicon BPE and piece counts against the tokenizers library."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer, models

from tests.llm.corpora import AWKWARD, families, frame
from tidewater.llm import lexicon_bpe, piece_counts, token_store
from tidewater.llm import text as tx

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "A", "É", "'s", "'", "é", "1", "½", "<|endoftext|>", "<|startoftext|>", ".", "l,", "\r\n", "\x1c", "\x85", "　", "日本", "İ", "Σ", "ΑΣ", "é", "!?", "'ll", "\x00", "ﬁ"]


def strange(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n)]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_segments_encode_as_in_context():
    whole, texts = Tokenizer.from_file(BYTES), strange(6000)
    encoder, cache = token_store.Encoder(BYTES), tx.WordCache(500)
    for lo, hi, offsets, raw in tx.slices(pa.array(texts), 4000):
        ids, bounds = token_store.encode_slice(raw, offsets, encoder, cache, 0)
        expected = whole.encode_batch(texts[lo:hi], add_special_tokens=False)
        for k in range(hi - lo):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == expected[k].ids + [0]


def test_store_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "PART_DOCS", 20)
    monkeypatch.setattr(token_store, "FAN", 3)
    rows = AWKWARD + families(3)
    whole = Tokenizer.from_file(BYTES)
    path = str(tmp_path / "store")
    token_store.write_store(frame(spark, rows), path, BYTES, mask_bits=4, least=4, most=64)
    ids = {t: whole.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows}
    found = token_store.read_digest(spark, path).orderBy("start").collect()
    assert all(r.verified for r in found)
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted((repr(i), len(ids[t]), zlib.crc32(packed(ids[t]))) for i, t in rows)
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert [r.start for r in found] == np.concatenate([[0], np.cumsum([r.n_tokens for r in found])])[:-1].tolist()
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() < sum(r.n_chunks for r in found)
    unique = {i: t for i, t in rows if i is not None}
    some = spark.createDataFrame([(8,), (10,)], "doc_id long")
    assert {r.doc_id: r.ids for r in token_store.read_ids(spark, path, some).collect()} == {i: ids[unique[i]] for i in (8, 10)}
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    for level in {m.level for m in manifest}:
        assert sum(m.n_docs for m in manifest if m.level == level) == len(rows) and sum(m.n_tokens for m in manifest if m.level == level) == sum(r.n_tokens for r in found)
    assert max(m.level for m in manifest) >= 2 and sum(m.level == max(m.level for m in manifest) for m in manifest) == 1
    recipes = spark.read.parquet(f"{path}/recipes")
    assert [r.start for r in recipes.orderBy("part", "start").collect()] == [r.start for r in found]


def test_damage_is_seen(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "PART_DOCS", 5)
    path = str(tmp_path / "store")
    token_store.write_store(frame(spark, AWKWARD), path, BYTES)
    chunks, recipes, manifest = (spark.read.parquet(f"{path}/{name}") for name in ("chunks", "recipes", "manifest"))

    def verified(name, chunks, recipes):
        for part, rows in (("chunks", chunks), ("recipes", recipes), ("manifest", manifest)):
            rows.write.parquet(f"{tmp_path}/{name}/{part}")
        return {r.doc_id: r.verified for r in token_store.read_digest(spark, f"{tmp_path}/{name}").collect()}

    lost = verified("lost", chunks.where("n < 100"), recipes)  # the long chunks are lost
    assert not lost[10] and lost[5]
    part = recipes.where("doc_id = 12").first()["part"]
    beside = {r.doc_id for r in recipes.where(f"part = {part}").collect()} - {12}
    cut = verified("cut", chunks, recipes.where("NOT doc_id <=> 12"))  # a recipe is lost: its part does not hold
    assert beside and not any(cut[i] for i in beside) and cut[1] and 12 not in cut


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(frame(spark, AWKWARD).where("false"), path, BYTES)
    assert token_store.read_digest(spark, path).count() == 0


def test_crc_shift():
    rng = random.Random(2)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 99)), rng.randbytes(rng.randint(0, 5000))
        moved = token_store.crc_shift(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_lexicon_and_merges_match_the_library():
    whole, texts = Tokenizer.from_file(WORDS), strange(6000, 2) + [t or "" for _, t in AWKWARD]
    lexicon = lexicon_bpe.build_lexicon([b"the", b"The", b"quick", b"dog.", b"a1b", b"lazy", b"ending", b"sending"], WORDS)
    encoder = lexicon_bpe.Encoder(WORDS, lexicon)
    for lo, hi, offsets, raw in tx.slices(pa.array(texts), 9000):
        ids, decoded = encoder.encode_slice(raw, offsets)
        for k, e in enumerate(whole.encode_batch(texts[lo:hi], add_special_tokens=False)):
            assert ids[k] == packed(e.ids)
            assert decoded[k].decode() == whole.decode(e.ids, skip_special_tokens=False)


def test_automaton_numbers_words():
    words = sorted({w.encode() for w in "a ab abc bc c cab dab dabc tab tabs stab stabs".split()})
    auto = lexicon_bpe.compile_words(words)
    probe = [*words, b"", b"x", b"sta", b"tabss", b"abcd"]
    ends = np.cumsum([len(w) for w in probe])
    numbers = lexicon_bpe.word_numbers(auto, np.frombuffer(b"".join(probe), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    assert numbers.tolist() == [*range(len(words)), -1, -1, -1, -1, -1]
    assert len(auto["keys"]) < sum(map(len, words))  # suffixes are shared


def test_encode_decode_query(spark):
    rows, whole = AWKWARD + families(4, 2, 10), Tokenizer.from_file(WORDS)
    found = lexicon_bpe.encode_decode(frame(spark, rows), WORDS, 50, with_ids=True, with_text=True).collect()
    expected = []
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        text = whole.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert lexicon_bpe.encode_decode(frame(spark, rows).where("false"), WORDS).count() == 0


def test_piece_counts_match_word_piece(spark):
    pieces = piece_counts.pieces_of(WORDS)
    letters, rng = lexicon_bpe.byte_alphabet(), random.Random(5)
    show = lambda b: "".join(letters[c] for c in b)
    for first, more in ((pieces, pieces), (set(rng.sample(sorted(pieces), 4000)), set(rng.sample(sorted(pieces), 9000)))):
        vocabulary = {"[UNK]": 0}
        for p in sorted(first):
            vocabulary.setdefault(show(p), len(vocabulary))
        for p in sorted(more):
            vocabulary.setdefault("##" + show(p), len(vocabulary))
        model = models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**6)
        rows = AWKWARD + [(i, t) for i, t in enumerate(strange(50, 6), 100)]
        found = piece_counts.count_pieces(frame(spark, rows), first, more).collect()
        expected = []
        for i, t in rows:
            raw = tx.LOWER[np.frombuffer((t or "").encode(), np.uint8)].tobytes()
            words = [w for w in raw.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
            cut = [[x.value for x in model.tokenize(show(w))] for w in words]
            expected.append((i, len(words), sum(map(len, cut)), sum("[UNK]" in c for c in cut)))
        assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
