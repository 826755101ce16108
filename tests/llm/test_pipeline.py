"""The whole pipeline against a brute-force version of each stage."""

import hashlib
import math
import random
import struct
from collections import Counter

import public_tokenizers
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.corpora import AWKWARD, families, lower, near_components, plain_words, repeat_words, space_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
ITEMS = [(1, " ".join(f"leak{i}" for i in range(14))), (2, "lazy fox"), (3, None)]


def good(text):
    words, lines = space_words(text), [x for x in (text or "").split("\n") if space_words(x)]
    n, chars = len(words), sum(map(len, words))
    letters, long = sum(bool(regex.search(r"\p{L}", w)) for w in words), sum(len(w) > 40 for w in words)
    return (
        n >= 10 and 100 * repeat_words(text) <= 20 * n and 2 * n <= chars <= 20 * n and 100 * sum(text.count(c) for c in "#*$%&|<>") <= 20 * chars
        and 100 * (len(lines) - len(set(lines))) <= 50 * len(lines) and 100 * letters >= 50 * n and 100 * long <= 10 * n and not regex.search(r"[Ll]orem[\x20\x09-\x0D]+[Ii]psum", text)
    )


def without_boilerplate(rows):
    z, trim = corpus_pipeline.SOURCE_Z, lambda x: x.strip(" \t\n\x0b\x0c\r")
    pages = {s: {t for _, t, s in rows if s == s0} for s0 in {s for *_, s in rows} for s in [s0]}
    drop = {}
    for source, texts in pages.items():
        n = Counter(x for t in texts for x in {trim(line) for line in t.split("\n")} if x)
        m = len(texts)
        share = {x: (k + z * z / 2 - z * math.sqrt(k * (m - k) / m + z * z / 4)) / (m + z * z) for x, k in n.items()}
        drop[source] = {x for x, k in n.items() if k > 1 and share[x] > corpus_pipeline.SOURCE_RATIO}
    cleaned = [(i, "\n".join(x for x in t.split("\n") if trim(x) not in drop[s]), s) for i, t, s in rows]
    return [r for r in cleaned if space_words(r[1])]


def one_of_each(rows):
    component = {i: c for i, _, c in near_components([r[:2] for r in rows], 5, 80)}
    return [r for r in rows if r[0] is None or component[r[0]] == r[0]]


def decontaminated(rows, size=10):
    windows = set()
    for _, t in ITEMS:
        w = plain_words(t)
        take = min(size, len(w))
        windows |= {tuple(w[i : i + take]) for i in range(len(w) - take + 1 if take else 0)}
    out = []
    for i, t, s in rows:
        spans = [m.span() for m in regex.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))]
        words, hit = plain_words(t), set()
        for n in {len(w) for w in windows}:
            for p in range(len(words) - n + 1):
                if tuple(words[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
        gone = set()
        for k in hit:  # neighbouring hit words go with what stands between them
            gone |= set(range(spans[k][0], spans[k + 1][1] if k + 1 in hit else spans[k][1]))
        if not words or len(hit) < len(words):
            out.append((i, "".join(c for k, c in enumerate(t) if k not in gone), s))
    return out


def test_whole_pipeline(spark, tmp_path):
    rng = random.Random(9)
    body = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "word"]) + str(rng.randrange(4000)) for _ in range(n))
    rows = [(i, t, rng.choice("ab")) for i, t in AWKWARD + families(11, 4, 12)]
    rows += [(20_000 + i, body(40) + ("\nshared line of many pages" if i % 3 else "") + (f"\n{ITEMS[0][1]} end" if i % 7 == 0 else ""), rng.choice("ab")) for i in range(60)]
    rows += [(21_000, body(30) + " Lorem ipsum", "a"), (21_001, " ".join(f"{i}.5" for i in range(40)), "a"), (21_002, ITEMS[0][1], "b"), (21_003, body(30), None), (21_004, "the lazy fox " + body(30), None)]
    spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    expected = decontaminated(one_of_each(without_boilerplate([r for r in rows if good(r[1])])))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = []
    for i, t, _ in expected:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        encoded.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in found.collect()), key=repr) == sorted(encoded, key=repr)
    assert len(encoded) < len(rows) - 20


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
