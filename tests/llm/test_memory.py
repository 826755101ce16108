"""What a worker holds beside its text."""

import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import public_tokenizers

from tidewater.llm import fm_decontaminate, lexicon_bpe, rule_cascade, workspace
from tidewater.llm import text as tx


def _words(n):
    raw = np.frombuffer(b"".join(b"%dth " % (i % 5000) for i in range(n)), np.uint8)
    return (raw, *tx.spans(raw, np.array([0, len(raw)]), tx.SPACE)[:2])


def test_distinct_spans_hold_little_beside_the_text():
    raw = np.frombuffer(b"x" * 2_000_000 + b" a b a", np.uint8)
    starts, ends, _ = tx.spans(raw, np.array([0, len(raw)]), tx.SPACE)
    tracemalloc.start()
    codes, _ = tx.distinct_spans(raw, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert codes.tolist() == [0, 1, 2, 1]
    assert peak < 8 * len(raw)


def test_words_of_one_digest_stay_apart(monkeypatch):
    raw, starts, ends = _words(300)
    monkeypatch.setattr(tx, "span_digest", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    codes, first = tx.distinct_spans(raw, starts, ends)
    words = tx.take_spans(raw, starts, ends)
    assert [words[first[c]] for c in codes] == words and len(first) == len(set(words))


def test_a_full_cache_of_the_encoder_stays_small():
    encoder = lexicon_bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"), None)
    encode = lambda words: [(b"1234" * 3, w) for w in words]
    tracemalloc.start()
    for lo in range(0, 600_000, 20_000):
        encoder.cache.lookup([b"word-%d" % i for i in range(lo, lo + 20_000)], encode)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 50 << 20


class _Shared:
    value = fm_decontaminate.make_windows([(1, "one two three four five six seven eight nine ten"), (2, "5th 6th")], 10)


def test_a_benchmark_scan_holds_little_beside_the_text():
    body = "".join(f"{i % 5000}th " for i in range(800_000))
    lines = [body[lo : lo + 2000] for lo in range(0, 4_000_000, 2000)]
    n = len(lines)
    batch = pa.RecordBatch.from_arrays([pa.array(lines), pa.array([0] * n, pa.int64()), pa.array([[]] * n, pa.list_(pa.list_(pa.int32()))), pa.array([[]] * n, pa.list_(pa.int64()))], names=["text", "n", "spans", "items"])
    power = len(tx._powers[0])
    tracemalloc.start()
    hits = sum(len(x) for out in fm_decontaminate._scanner(_Shared, 0, False)([batch]) for x in out.column(3).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hits and len(tx._powers[0]) == power  # no table for each byte stays with the worker
    assert peak < 30 << 20


def test_benchmark_words_of_one_digest_stay_apart(monkeypatch):
    monkeypatch.setattr(tx, "span_digest", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    windows = fm_decontaminate.make_windows([(1, "alpha beta gamma")], 2)
    raw = np.frombuffer(b"gamma other alpha beta", np.uint8)
    starts, ends, _ = tx.spans(raw, np.array([0, len(raw)]), tx.NON_WORD)
    words = windows["words"]
    assert fm_decontaminate.word_symbols(raw, starts, ends, windows).tolist() == [words[b"gamma"], 0, words[b"alpha"], words[b"beta"]]


def test_a_worker_frees_what_its_task_made_before_it_waits(spark, monkeypatch):
    alive, at_release = [], []

    class Loop:
        def __init__(self):
            self.me = self

    def run(batches):
        loop = Loop()
        alive.append(weakref.ref(loop))
        yield from batches

    sent = []
    docs = type("Docs", (), {"sparkSession": spark, "mapInArrow": lambda self, f, schema: sent.append(f)})()
    workspace.map_arrow(docs, run, "x long")
    monkeypatch.setattr(workspace.ctypes, "CDLL", lambda name: at_release.append(alive[0]()) or type("C", (), {"malloc_trim": lambda self, n: 0})())
    assert list(sent[0]([1, 2])) == [1, 2] and at_release == [None]


def test_rules_evaluate_windows_and_characters_once(spark):
    from pyspark.sql import functions as F

    held = rule_cascade.rules(F.col("text"), F.col("words"), F.col("lines"))
    assert str(held["few_repeats"]).count("sequence(") == 1
    assert str(held["word_length"]).count("array_join(") == 1
