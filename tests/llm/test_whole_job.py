"""Places where an operator once did less than its whole job."""

import numpy as np
import pyarrow as pa

from tests.llm.corpora import frame, long_repeats
from tidewater.llm import run_length_dedup, surrogates
from tidewater.llm import text as tx


def test_pipeline_drops_a_line_on_a_tenth_of_a_source(spark):
    import corpus_pipeline

    own = lambda i: f"page {i} says what no other says"
    rows = [(i, own(i) + ("\nshared by a tenth" if i % 10 == 0 else "") + ("\nshared by two" if i < 2 else "")) for i in range(200)]
    found = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, frame(spark, rows), "").collect()}
    assert found == {i: own(i) + ("\nshared by two" if i < 2 else "") for i in range(200)}


def test_segments_around_one_anchor_are_spread():
    rng = np.random.default_rng(3)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    pool, n_deals, n_segment_deals, sent = letters(1 << 20), 1, 64, pa.schema([("g", pa.int32()), ("deal", pa.int32()), ("blob", pa.binary())])
    with np.errstate(over="ignore"):
        raw = np.frombuffer(pool.encode(), np.uint8)
        prefix, (_, inverse) = tx.prefix_hash(raw), tx._power_tables(len(raw))
        at = int(np.argmin(tx.mix((prefix[20:] - prefix[:-20]) * inverse[: len(raw) - 19])))
        passage = pool[at : at + 20]  # its hash is least in any string that holds it
        rows = [(i, f"{letters(30)}{passage}{letters(30)}") for i in range(12_000)] + [(20_000, "start "), (20_001, "end")]
        rows += [(30_000 + i, rows[7 * i][1]) for i in range(40)]
        groups = []
        for half in (rows[::2], rows[1::2]):
            table = pa.table({"g": pa.array([len(groups)] * len(half), pa.int32()), "id": pa.array([i for i, _ in half], pa.int64()), "text": [t for _, t in half], "tie": pa.array([0] * len(half), pa.int64())})
            groups.append(run_length_dedup.Group(run_length_dedup._pack(table).column(1)[0].as_py(), n_deals))
        anchors = [(g, d, b) for g, group in enumerate(groups) for d, b in group.anchor_deals()]
        verdicts = run_length_dedup._judge(pa.table([pa.array(c, f.type) for c, f in zip(zip(*anchors), sent)], schema=sent)).to_pylist()
        load, deals = np.zeros(n_segment_deals, int), {}
        for g, group in enumerate(groups):
            to, start, size, least, *_ = group.segments([(v["deal"], v["blob"]) for v in verdicts if v["g"] == g], n_segment_deals)
            load += np.bincount(to // run_length_dedup.PARTS, weights=size, minlength=n_segment_deals).astype(int)
            for d, blob in run_length_dedup.segment_blobs(group, [(v["deal"], v["blob"]) for v in verdicts if v["g"] == g], n_segment_deals):
                deals.setdefault(d, []).append((g, d, blob))
        assert load.max() < 2 * load.mean()
        answers = [a for d in deals.values() for a in run_length_dedup._index(pa.table([pa.array(c, f.type) for c, f in zip(zip(*d), sent)], schema=sent)).to_pylist()]
        found = []
        for g, group in enumerate(groups):
            cut = run_length_dedup.cut_group(group, [v for v in verdicts if v["g"] == g], [a for a in answers if a["g"] == g], n_segment_deals, False)
            found += [tuple(r.values())[:5] for r in cut.to_pylist()]
    assert sorted(found, key=repr) == long_repeats(rows)


def test_surrogates_of_more_shapes(spark):
    hidden = ["555-123-4567", "555.123.4567", "030 1234567", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "2001:db8::8a2e:370:7334", "fe80::1", "hunter2hunter2"]
    rows = [(i, f"see {x} there") for i, x in enumerate(hidden[:-1])] + [(8, "password: hunter2hunter2 set"), (9, "Mrs. Anna Schmidt came. Anna Schmidt left, Annabel stayed."), (10, "Prof. Dr. Karl Weber and Dr. Lena Vogel")]
    rows += [(11, "at 12:30:45 in std::vector password: required 3.14"), (12, "token=a1")]
    found = {r.doc_id: r for r in surrogates.replace_entities(frame(spark, rows), b"k").collect()}
    assert [x for x in [*hidden, "Anna Schmidt", "Karl", "Weber", "Lena", "Vogel"] if any(x in r.text for r in found.values())] == []
    for i in (3, 4):
        iban = found[i].text[4:-6].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and len(found[i].text) == len(rows[i][1])
    first, again = found[9].text.removeprefix("Mrs. ").split(" came. ")
    assert again == f"{first} left, Annabel stayed." and found[9].n_entities == 2
    assert found[11].text == rows[10][1] and found[12].text == "token=a1"


def test_licenses_belong_to_rows(spark):
    from tidewater.llm import license_vote

    mit = "Released under the MIT License"
    gpl = next(t for label, t in license_vote.TEMPLATES if label == "gpl-3.0" and len(t) > 100)
    lgpl = next(t for label, t in license_vote.TEMPLATES if label == "lgpl-2.1")
    rows = [(None, "nothing of the kind here"), (None, "Licensed under CC BY-NC 4.0"), (1, mit), (1, "other text"), (2, "worK under the Key"), (3, gpl), (4, f"{gpl} and then {lgpl}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = {(r.doc_id, r.n_words): r for r in license_vote.scan(docs).collect()}
    assert found[None, 5].labels == "" and found[None, 5].score == 0 and found[None, 7].labels == "cc-by,cc-by-nc-4.0"
    assert found[1, 5].labels == "mit" and found[1, 2].labels == ""
    assert [r.labels for (i, _), r in found.items() if i == 3] == ["gpl,gpl-3.0"]  # its relatives cover less of it
    assert [r.labels for (i, _), r in found.items() if i == 4] == ["gpl,gpl-3.0,lgpl-2.1"]
    own = spark.createDataFrame([("mine", "nothing of the kind here")], "label string, text string")
    assert {r.labels for r in license_vote.scan(docs.where("doc_id IS NULL"), own).collect()} == {"mine", "cc-by"}
    few = license_vote.FILTER_GRAMS, license_vote.BROADCAST_GRAMS
    license_vote.FILTER_GRAMS = license_vote.BROADCAST_GRAMS = -1
    try:
        again = {(r.doc_id, r.n_words): r for r in license_vote.scan(docs).collect()}
    finally:
        license_vote.FILTER_GRAMS, license_vote.BROADCAST_GRAMS = few
    assert again == found
    assert {r.labels for r in license_vote.scan(docs, []).collect()} == {"", "cc-by", "mit", "gpl"}


def test_lines_of_a_small_host(spark):
    from pyspark.sql import functions as F

    from tidewater.llm import site_lines

    rows = [(0, "h", "menu\none"), (1, "h", "menu\ntwo"), (2, "g", "alone"), (3, "k", "same\nwords"), (4, "k", "same\nwords")]
    docs = spark.createDataFrame(rows, "id long, host string, text string")
    drop = lambda **more: {r.id: r.text for r in site_lines.drop_boilerplate(docs, F.col("host"), **more).collect()}
    assert drop() == {0: "one", 1: "two", 2: "alone", 3: "", 4: ""}
    assert drop(distinct_pages=True) == {0: "one", 1: "two", 2: "alone", 3: "same\nwords", 4: "same\nwords"}
    assert drop(ratio=0.4, z=1.96) == {0: "menu\none", 1: "menu\ntwo", 2: "alone", 3: "same\nwords", 4: "same\nwords"}


def test_blocks_of_a_benchmark(spark):
    from tests.llm.corpora import window_hits
    from tidewater.llm import fm_decontaminate

    items = [(i, f"word{i} word{i + 1} word{i + 2}") for i in range(12)] + [(3, "word3 word4 word5")] * 5
    docs = [(1, "word3 word4 word5 x word9 word10 word11"), (2, None), (3, "x")]
    found = fm_decontaminate.report(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 10, block_bytes=40).collect()
    assert sorted(map(tuple, found), key=repr) == window_hits(docs, items)
    cut = fm_decontaminate.clean(spark.createDataFrame([(1, docs[0][1], 5)], "doc_id long, text string, n_words int"), spark.createDataFrame(items, "item_id long, text string"), 3, block_bytes=40)
    assert [tuple(r) for r in cut.collect()] == [(1, " x ", 5)] and cut.columns == ["doc_id", "text", "n_words"]


def test_hot_hubs_are_salted(spark, monkeypatch):
    from tests.llm.corpora import families, near_components
    from tidewater.llm import odd_sketch_dedup

    monkeypatch.setattr(odd_sketch_dedup, "SALT_FROM", 3)
    rows = families(5, 1, 30)
    found = odd_sketch_dedup.find_duplicates(frame(spark, rows), 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == near_components(rows, 3, 85)
