"""Near-duplicates, long repeats and boilerplate lines against brute force."""

import numpy as np
import pytest

from tests.llm.corpora import AWKWARD, families, frame, long_repeats, near_components
from tidewater.llm import odd_sketch_dedup, run_length_dedup, site_lines
from pyspark.sql import functions as F


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_components(spark, k, percent, seed):
    rows = families(seed) + AWKWARD
    found = odd_sketch_dedup.find_duplicates(frame(spark, rows), k, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == near_components(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in found)


def test_one_of_each_stays(spark):
    rows = [r for r in AWKWARD if r[0] is not None]
    kept = odd_sketch_dedup.keep_one_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted({r.doc_id for r in kept.collect()}) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13]


def test_no_documents(spark):
    none = frame(spark, AWKWARD).where("false")
    assert odd_sketch_dedup.find_duplicates(none).count() == 0
    assert run_length_dedup.remove_repeats(none).count() == 0


def test_odd_sketch_follows_similarity(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 9000, 500)]
    near, far = list(words), list(words)
    for i in rng.integers(0, 500, 12):
        near[i] = "x"
    for i in rng.integers(0, 500, 260):
        far[i] = f"y{i}"
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([" ".join(t) for t in (words, near, far)])], names=["doc_id", "text"])
    out = next(iter(odd_sketch_dedup._signatures(3)(iter([batch]))))
    sketch = np.array(out.column(5).to_pylist(), np.int64).view(np.uint64)
    frame_ = spark.createDataFrame([([int(x) for x in sketch[0].view(np.int64)], [int(x) for x in sketch[k].view(np.int64)]) for k in (0, 1, 2)], "a array<long>, b array<long>")
    same, near, far = (r[0] for r in frame_.select(odd_sketch_dedup.estimate("a", "b")).collect())
    assert same == 1 and 0.75 < near < 1 and far < odd_sketch_dedup.LEAST_ESTIMATE


@pytest.mark.parametrize("hot", [0, 1, 10**6])
def test_long_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(run_length_dedup, "GROUP_BYTES", 6_000)
    monkeypatch.setattr(run_length_dedup, "STEP", 700)
    monkeypatch.setattr(run_length_dedup, "HOT_GROUPS", hot)
    rows = families(7, 3, 8) + AWKWARD + [(i, "éa " * 40 + "the end") for i in (501, 502)]
    found = run_length_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted(map(tuple, found), key=repr) == long_repeats(rows)


def test_index_streams_and_samples():
    text = b"abracadabra" * 9
    starts, sizes = np.array([0, 3]), np.array([70, 80])
    raw = np.frombuffer(text, np.uint8)
    index = run_length_dedup.RunLengthIndex(raw, starts, sizes, np.array([7, 5]))
    docs, bounds = run_length_dedup.stream(index, sizes)
    expected = []
    for s, n, own in ((0, 70, 7), (3, 80, 5)):
        for p in range(n - 49):
            w = text[s + p : s + p + 50]
            expected.append(5 if w in text[3:83] else own)
    assert docs.tolist() == expected and bounds.tolist() == [0, 21, 52]
    assert len(index.run_start) < sizes.sum() / 3  # repetitive text has few runs


def _pages(spark):
    rows = [("h1", f"Home\nNews {i}\n  About us \n\nbody {i} text") for i in range(10)] + [("h2", "Home\nother"), ("h2", None), (None, "Home"), ("h1", "")]
    rows += [(None, "same\nline")] * 6
    return spark.createDataFrame([(i, h, t, 1, "x") for i, (h, t) in enumerate(rows)], "page_id int, h string, text string, pages int, line string")


def test_boilerplate_lines(spark):
    pages = _pages(spark)
    out = site_lines.drop_boilerplate(pages, F.col("h"), ratio=0.5)
    assert out.columns == pages.columns
    texts = {r.page_id: r.text for r in out.collect()}
    assert texts[0] == "News 0\n\nbody 0 text"
    assert texts[10] == "Home\nother" and texts[11] is None and texts[12] == "Home" and texts[13] == ""
    assert texts[14] == ""
    shuffled = site_lines.BROADCAST_LINES
    site_lines.BROADCAST_LINES = -1
    try:
        assert {r.page_id: r.text for r in site_lines.drop_boilerplate(pages, F.col("h"), ratio=0.5).collect()} == texts
    finally:
        site_lines.BROADCAST_LINES = shuffled
    assert site_lines.drop_boilerplate(pages.where("false"), F.col("h")).count() == 0


def test_visible_lines_and_hosts(spark):
    row = spark.createDataFrame([("HTTPS://u@Www.Example.com:80/a?b", "<html><script>x</script><p>One <b>two</b><br>three<!-- no --></p></html>")], "url string, html string")
    out = row.select(site_lines.host_of(F.col("url")).alias("h"), site_lines.visible_lines(F.col("html")).alias("t")).first()
    assert out.h == "www.example.com"
    assert [x for x in out.t.split("\n") if x.strip()] == ["One two", "three "]
