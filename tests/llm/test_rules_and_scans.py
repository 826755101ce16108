"""Quality rules, decontamination, licenses, surrogates and the pipeline."""

import pytest

from tests.llm.corpora import AWKWARD, frame, plain_words, repeat_words, space_words, window_hits
from tidewater.llm import fm_decontaminate, license_vote, rule_cascade, surrogates


ALL_RULES = rule_cascade.BASE_RULES + rule_cascade.OWN_RULES


def test_measures(spark):
    rows = AWKWARD + [(20, "a b c d e " * 3 + "z y x w v u t s r q"), (21, "\n".join(["same line here"] * 4 + [f"line {i} is its own" for i in range(12)]))]
    found = {repr(tuple(r)) for r in rule_cascade.measure(frame(spark, rows), ALL_RULES).drop("kept").collect()}
    expected = set()
    for i, t in rows:
        words, lines = space_words(t), [x for x in (t or "").split("\n") if space_words(x)]
        again = repeat_words(t)
        expected.add(repr((i, len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), again, len(words) < 10 or 100 * again > 20 * len(words))))
    assert found == expected


def test_cascade_keeps_what_all_rules_pass(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good), (2, "short"), (3, "same five words again here " * 20), (4, " ".join(f"w{i}***" for i in range(50))), (5, "\n".join(["one line of it all"] * 9)), (6, None)]
    rows += [(7, " ".join(f"{i}.{i}" for i in range(40))), (8, good + " x" * 0 + "".join(f" {c * 50}" for c in "abcdefghijk")), (9, f"{good} Lorem ipsum dolor")]
    docs = frame(spark, rows)
    kept = rule_cascade.keep_good(docs, sample_bytes=400)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
    order = rule_cascade.cascade_order(docs)
    assert sorted(order) == sorted(ALL_RULES)
    verdicts = {r.doc_id: r.kept for r in rule_cascade.measure(docs, order).collect()}
    assert [i for i, k in verdicts.items() if k] == [1]
    assert rule_cascade.keep_good(docs.where("false")).count() == 0


ITEMS = [(1, "the quick brown fox jumps over the lazy dog the quick brown"), (2, "lazy dog"), (3, None), (4, ""), (None, "two words"), (5, "lazy dog"), (10, "Version 2.0. Released under the MIT license")]


@pytest.mark.parametrize(("size", "block"), [(10, 1 << 20), (3, 1 << 20), (10, 20)])
def test_window_hits(spark, size, block):
    docs = AWKWARD + [(30, "lazy"), (31, "the LAZY, dog... two-words")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = fm_decontaminate.report(frame(spark, docs), bench, size, block_bytes=block).collect()
    assert sorted(map(tuple, found), key=repr) == window_hits(docs, ITEMS, size)


def test_empty_benchmark_and_cutting(spark):
    docs = frame(spark, AWKWARD)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in fm_decontaminate.report(docs, none).collect())
    bench = spark.createDataFrame([(1, "quick brown fox"), (2, "one")], "item_id long, text string")
    cut = fm_decontaminate.clean(docs, bench, 3)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns
    assert texts[1] == "The  jumps over the lazy dog. The  jumps over the lazy dog." and 5 not in texts and texts[6] == "two words" and texts[3] is None
    assert fm_decontaminate.clean(docs.where("false"), bench).count() == 0


def test_license_phrases_and_passages(spark):
    rows = AWKWARD + [(40, "x y cc by-sa MIT license z Apache License"), (41, "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction")]
    found = {(r.doc_id, r.n_words): r for r in license_vote.scan(frame(spark, rows)).collect()}
    for i, t in rows:
        words, places, labels = plain_words(t), [], set()
        for phrase, label in license_vote.PHRASES:
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = found[i, len(words)]
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(","))| (set() if labels else {""}) and 0 <= r.score <= 1
    assert found[11, 13].labels == "apache,apache-2.0,mit" and found[11, 13].score == 1.0
    assert next(r for (i, _), r in found.items() if i == 41).labels == "mit"  # a word was added
    assert license_vote.scan(frame(spark, rows).where("false")).count() == 0


def test_surrogates_keep_type_format_and_identity(spark):
    text = "Write to jo.30@mail1.example.com, call +1 (788) 555-2942 or Mrs. Anna Schmidt; ip 217.75.41.129, card 4539 1488 0343 6467, token = \"b44e15e09fd311c3\"."
    rows = [*AWKWARD, (50, text), (51, "Again Jo.30@mail1.example.com and Mrs. Schmidt, +1 788 555 2942."), (52, "clean text 12 of 2024.")]
    found = {r.doc_id: r for r in surrogates.replace_entities(frame(spark, [r for r in rows if r[0] is not None]), b"k").collect()}
    out, again = found[50].text, found[51].text
    for secret in ("jo.30", "555-2942", "Anna", "Schmidt", "217.75.41.129", "4539 1488", "b44e15e0"):
        assert secret not in out
    assert found[50].n_entities == 6 and found[50].kinds == "card,email,ip,name,phone,secret"
    assert found[52].text == "clean text 12 of 2024." and found[3].text is None and found[2].text == ""
    import re

    mail, phone, card, name = re.search(r"\S+@mail1\.example\.com", out)[0], re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out)[0], re.search(r"card ([\d ]+)", out)[1], re.search(r"Mrs\. (\w+) (\w+)", out)
    assert mail.lower() in again.lower()
    assert re.sub(r"\D", "", phone) == re.sub(r"\D", "", re.search(r"\+[\d ]+", again)[0])
    digits = [int(c) for c in card.replace(" ", "")]
    assert surrogates._luhn(digits[:-1]) == digits[-1]  # validity stays
    assert name[1].endswith("ia") and name[2] in again


def test_surrogates_are_distinct():
    key = b"k"
    short = [f"{a}{b}.{c}@x.example.com" for a in "abc" for b in "xyz" for c in range(10)]
    assert len({surrogates.surrogate(key, "email", e) for e in short}) == len(short)
    numbers = [f"{n:013d}" for n in range(3000)]
    assert len({surrogates.surrogate(key, "card", n) for n in numbers}) == len(numbers)
    assert sorted(tuple(surrogates.permute(key, "t", [a, b], 6)) for a in range(6) for b in range(6)) == [(a, b) for a in range(6) for b in range(6)]


def test_collisions_are_drawn_again(spark):
    key = b"k"
    names = [("name", f"f:{chr(65 + a)}{chr(97 + b)}") for a in range(26) for b in range(26)]
    ips = [("ip", f"1.2.3.{i}") for i in range(4)]
    ips.append(("ip", surrogates.surrogate(key, "ip", "1.2.3.0")))  # the surrogate of one is another
    entities = names + ips
    later = {(r.kind, r.entity): r.attempt for r in surrogates.later_attempts(spark.createDataFrame(entities, "kind string, entity string"), key).collect()}
    final = [(k, surrogates.surrogate(key, k, e, later.get((k, e), 0))) for k, e in entities]
    assert later[("ip", "1.2.3.0")] >= 1 and len(set(final)) == len(final) and not set(final) & set(entities)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    body = lambda n: " ".join(f"{n}word{i}" for i in range(80))
    leak = " ".join(f"leak{i}" for i in range(12))
    rows = [(1, body("a")), (2, body("a")), (3, "too short"), (4, f"{body('b')} {leak} tail"), (5, None), *((10 + i, f"{body(f'c{i}')}\nboilerplate line") for i in range(8))]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen.columns == docs.columns
            texts = {r.doc_id: r.text for r in seen.collect()}
    assert sorted(texts) == [1, 4, *range(10, 18)]
    assert "leak" not in texts[4] and texts[4].endswith("tail") and "boilerplate" not in texts[10]
    assert sorted(r.doc_id for r in seen.collect()) == sorted(texts)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(texts)
