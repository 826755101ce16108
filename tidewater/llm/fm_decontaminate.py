"""Benchmark decontamination by an FM-index over each training shard.

Spark deals the documents out; each shard (a few MB of text) becomes one sequence of word
numbers, indexed as a Burrows-Wheeler transform with wavelet ranks and sampled positions.  All
benchmark windows are searched backward together, every occurrence is located by walking to a
sampled position, and covered words are merged into removal spans.

A word is a run of bytes outside ASCII but digits and small letters, after lowering A-Z.  A window
is ``size`` consecutive words of an item; an item of fewer words (but some) is one window.  Words
that no window holds cannot be covered, so a shard keeps only stretches of window words that are
long enough for the shortest window.

The benchmark side is sent to the workers in blocks of items of bounded bytes; each block is one
narrow pass over the documents, which carry their spans from one to the next.  A benchmark of
several blocks settles the documents after each, so that a worker holds one block and no more.

Edge cases: null texts have no words; an empty benchmark leaves every document clean; a null
item_id still marks words but is not listed; equal items are each listed; repeated rows and null
doc_ids stay rows of their own; a window never crosses documents; extra columns are ignored by
:func:`scan` and kept by :func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import text as tx
from tidewater.llm.workspace import fresh_names, map_arrow, materialize

WINDOW = 10
#: Text of benchmark items that one pass sends to the workers.
BLOCK_BYTES = 16 << 20
#: Text of one shard.
SHARD_BYTES = 1 << 20
#: Every so many-th position of a shard is kept with the index.
SAMPLE = 8


# --- the index -----------------------------------------------------------------------------


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane at a time, most significant first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for b in range(bits - 1, -1, -1):
            plane = (symbols >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(plane)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[plane == 0], symbols[plane == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before its position ``at``."""
        low = np.zeros(len(symbol), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            low_ones, at_ones = ones[low], ones[at]
            low = np.where(bit, zeros + low_ones, low - low_ones)
            at = np.where(bit, zeros + at_ones, at - at_ones)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            before = ones[at]
            bit = ones[at + 1] - before
            out = out << 1 | bit
            at = np.where(bit.astype(bool), zeros + before, at - before)
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the sequence ends in a unique least symbol."""
    _, rank = np.unique(symbols, return_inverse=True)
    rank, n, step = rank.astype(np.int64), len(symbols), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            return order


class FMIndex:
    """Backward search and location over a sequence of positive symbols."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        text = np.append(symbols, 0)
        order = suffix_order(text)
        bwt = text[order - 1]
        self.n, top = len(text), int(text.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.tree = WaveletMatrix(bwt, max(1, top.bit_length()))
        self.kept = order % sample == 0
        self.kept_rank = np.concatenate([[0], np.cumsum(self.kept)])
        self.positions = order[self.kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range [low, high) of each pattern; ``patterns`` has one row each, all of a length."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = self.before[c] + both[: len(live)], self.before[c] + both[len(live) :]
            empty = low[live] >= high[live]
            high[live[empty]] = low[live[empty]]
            live = live[~empty]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, walking back to a sampled one."""
        at, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            here = at[live]
            hit = self.kept[here]
            out[live[hit]] = self.positions[self.kept_rank[here[hit]]] + steps
            live, here = live[~hit], here[~hit]
            c = self.tree.access(here)
            at[live] = self.before[c] + self.tree.rank(c, here)
            steps += 1
        return out


# --- the benchmark -------------------------------------------------------------------------


def make_windows(items: list[tuple[int | None, str | None]], size: int) -> dict:
    """Distinct windows of a block of items as word numbers (from 1), by length, with their items."""
    if size < 1:
        raise ValueError("a window has at least one word")
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple, list[int]] = {}
    for at, (_, body) in enumerate(items):
        raw = tx.LOWER[np.frombuffer((body or "").encode("utf-8"), np.uint8)]
        starts, ends, _ = tx.spans(raw, np.array([0, len(raw)]), tx.NON_WORD)
        words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in tx.take_spans(raw, starts, ends)]
        take = min(size, len(words))
        for k in range(len(words) - take + 1 if take else 0):
            holders = found.setdefault(tuple(words[k : k + take]), [])
            if not holders or holders[-1] != at:
                holders.append(at)
    order = sorted(found, key=lambda w: (len(w), w))
    held = [found[w] for w in order]
    groups, base = [], 0
    for length in sorted({len(w) for w in order}):
        group = [w for w in order if len(w) == length]
        groups.append((length, base, np.array(group, np.int64)))
        base += len(group)
    words = sorted(vocabulary, key=vocabulary.get)
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    hashes = tx.span_digest(raw, np.concatenate([[0], ends[:-1]]) if words else ends, ends)
    sort = np.argsort(hashes)
    return {
        "hashes": hashes[sort], "numbers": (sort + 1).astype(np.int64), "groups": groups, "words": vocabulary,
        "raw": raw, "starts": (ends - np.array([len(w) for w in words], np.int64))[sort], "ends": ends[sort],
        "shortest": groups[0][0] if groups else 0,
        "item_flat": np.array([i for h in held for i in h], np.int64), "item_bounds": np.concatenate([[0], np.cumsum([len(h) for h in held], dtype=np.int64)]).astype(np.int64),
        "item_ids": [i for i, _ in items],
    }


def word_symbols(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, windows: dict) -> np.ndarray:
    """The number of each word in the benchmark's vocabulary, 0 for others.  A hash finds the entry
    and its bytes decide; words that only share a hash with it are looked up by their bytes."""
    hashes, numbers = windows["hashes"], windows["numbers"]
    own = tx.span_digest(raw, starts, ends)
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    hit = np.flatnonzero(hashes[at] == own)
    symbol = np.zeros(len(starts), np.int64)
    symbol[hit] = numbers[at[hit]]
    same = tx.same_bytes(raw, starts[hit], ends[hit], windows["raw"], windows["starts"][at[hit]], windows["ends"][at[hit]])
    for i in hit[~same].tolist():
        symbol[i] = windows["words"].get(raw[starts[i] : ends[i]].tobytes(), 0)
    return symbol


def scan_slice(raw: np.ndarray, offsets: np.ndarray, windows: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, rows and [start, end) of merged spans in words, rows and items hit)."""
    n = len(offsets) - 1
    raw = tx.LOWER[raw]
    starts, ends, rows = tx.spans(raw, offsets, tx.NON_WORD)
    n_words = np.bincount(rows, minlength=n).astype(np.int64)
    none = np.zeros(0, np.int64)
    if not windows["groups"] or not len(starts):
        return n_words, none, np.zeros((0, 2), np.int64), none, none
    numbers = windows["numbers"]
    symbol = word_symbols(raw, starts, ends, windows)

    # stretches of window words, cut at documents
    known = symbol > 0
    new_doc = np.concatenate([[True], rows[1:] != rows[:-1]])
    begin = np.flatnonzero(known & (new_doc | ~np.concatenate([[False], known[:-1]])))
    end = np.flatnonzero(known & np.concatenate([new_doc[1:] | ~known[1:], [True]])) + 1
    long = end - begin >= windows["shortest"]
    begin, size = begin[long], (end - begin)[long]
    if not len(begin):
        return n_words, none, np.zeros((0, 2), np.int64), none, none
    # one stretch after another, each closed by a symbol that no window holds
    gap = int(numbers.max()) + 1
    offset = np.concatenate([[0], np.cumsum(size + 1)])
    place = np.repeat(begin - offset[:-1], size + 1) + np.arange(offset[-1])
    closing = np.zeros(offset[-1], bool)
    closing[offset[1:] - 1] = True
    text = np.where(closing, gap, symbol[np.minimum(place, len(symbol) - 1)])

    index = FMIndex(text)
    covered = np.zeros(len(symbol) + 1, np.int64)
    hit_row, hit_window = [], []
    for length, base, patterns in windows["groups"]:
        low, high = index.search(patterns)
        times = high - low
        which = np.flatnonzero(times)
        if not len(which):
            continue
        upto = np.concatenate([[0], np.cumsum(times[which])])
        line = np.repeat(low[which] - upto[:-1], times[which]) + np.arange(upto[-1])
        word = place[index.locate(line)]
        np.add.at(covered, word, 1)
        np.add.at(covered, word + length, -1)
        hit_row.append(rows[word])
        hit_window.append(np.repeat(which + base, times[which]))
    if not hit_row:
        return n_words, none, np.zeros((0, 2), np.int64), none, none
    inside = np.cumsum(covered)[:-1] > 0
    s = np.flatnonzero(inside & (new_doc | ~np.concatenate([[False], inside[:-1]])))
    e = np.flatnonzero(inside & np.concatenate([new_doc[1:] | ~inside[1:], [True]])) + 1
    doc_first = tx.row_bounds(rows, n)[:-1]
    spans = np.stack([s, e], axis=1) - doc_first[rows[s]][:, None]

    total = len(windows["item_bounds"])
    pair = np.unique(np.concatenate(hit_row) * total + np.concatenate(hit_window))
    row, window = pair // total, pair % total
    lo, many = windows["item_bounds"][window], np.diff(windows["item_bounds"])[window]
    upto = np.concatenate([[0], np.cumsum(many)])
    item = windows["item_flat"][np.repeat(lo - upto[:-1], many) + np.arange(upto[-1])]
    pair = np.unique(np.repeat(row, many) * len(windows["item_ids"]) + item)
    return n_words, rows[s], spans, pair // len(windows["item_ids"]), pair % len(windows["item_ids"])


# --- Spark ---------------------------------------------------------------------------------

def _scanner(shared, text_at: int, cutting: bool):
    """A pass over one block: its spans and items join those that the rows carry already.  With
    ``cutting`` the texts then lose what the spans cover, and rows left without words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        ids = windows["item_ids"]
        for batch in batches:
            for lo, hi, offsets, raw in tx.slices(batch.column(text_at), SHARD_BYTES):
                n = hi - lo
                own = batch.slice(lo, n)
                n_words, span_row, spans, item_row, item = scan_slice(raw, offsets, windows)
                first, of = tx.row_bounds(span_row, n), tx.row_bounds(item_row, n)
                before, listed = own.column(own.num_columns - 2).to_pylist(), own.column(own.num_columns - 1).to_pylist()
                for d in np.flatnonzero(np.diff(first)).tolist():
                    before[d] = merged(before[d] + spans[first[d] : first[d + 1]].tolist())
                    listed[d] = sorted({*listed[d], *(ids[k] for k in item[of[d] : of[d + 1]].tolist())} - {None})
                columns = [*own.columns[:-3], pa.array(n_words), pa.array(before, pa.list_(pa.list_(pa.int32()))), pa.array(listed, pa.list_(pa.int64()))]
                if cutting:
                    columns[text_at] = _cut(columns[text_at], raw, offsets, before)
                out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
                if cutting:
                    out = out.filter(pa.array([not w or sum(e - s for s, e in held) < w for w, held in zip(n_words.tolist(), before)], pa.bool_()))
                yield out

    return run


def _cut(column: pa.Array, raw: np.ndarray, offsets: np.ndarray, before: list) -> pa.Array:
    """The texts of ``column`` without the words in their spans."""
    if not any(before):
        return column
    starts, ends, rows = tx.spans(tx.LOWER[raw], offsets, tx.NON_WORD)
    first, data, texts = tx.row_bounds(rows, len(before)), raw.tobytes(), column.to_pylist()
    for d, spans in enumerate(before):
        if spans:
            at, parts = int(offsets[d]), []
            for s, e in spans:
                parts.append(data[at : starts[first[d] + s]])
                at = int(ends[first[d] + e - 1])
            parts.append(data[at : int(offsets[d + 1])])
            texts[d] = b"".join(parts).decode("utf-8", "replace")
    return pa.array(texts, column.type)


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans joined where they overlap or touch, ascending."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def _marked(docs: DataFrame, benchmark: DataFrame, size: int, block_bytes: int, text_col: str, cutting: bool = False) -> tuple[DataFrame, list[str]]:
    """``docs`` with the number of words, merged spans (in words, end excluded) and items hit, and
    the names of these three columns.

    One pass over a block ends before the next begins, so the workers hold one block at a time.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = int(total // block_bytes) + 1
    names = fresh_names(docs, "n_words", "spans", "items")
    marked = docs.withColumns(dict(zip(names, (F.lit(0).cast("long"), F.array().cast("array<array<int>>"), F.array().cast("array<bigint>")))))
    for b in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        shared = spark.sparkContext.broadcast(make_windows([(r["item_id"], r["text"]) for r in block.collect()], size))
        marked = map_arrow(marked, _scanner(shared, docs.columns.index(text_col), cutting and b == n_blocks - 1), marked.schema)
        if n_blocks > 1:
            marked = materialize(marked, f"block-{b}")
            shared.unpersist()
    return marked, names


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, spans (merged, in words, end excluded), items (those with a
    window in the document, ascending)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _marked(own, benchmark, size, block_bytes, "text")[0].select("doc_id", "n_words", "spans", "items")


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, **options) -> DataFrame:
    """Counts and digests of :func:`scan` for each document."""
    found = scan(docs, benchmark, size, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """``docs`` with all their columns, the covered words cut out of each text; a document that
    had words and keeps none goes."""
    return _marked(docs, benchmark, size, block_bytes, text_col, cutting=True)[0].select(*docs.columns)


def op9_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 words of every benchmark item against the whole ``documents`` table."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))



def _oracle() -> str:
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    ahead = ", ".join(f"lead(w0, {k}) OVER (PARTITION BY r ORDER BY i) AS w{k}" for k in range(1, WINDOW))
    gram = lambda n: " || ' ' || ".join(f"w{k}" for k in range(n))
    hits = " UNION ALL ".join(f"SELECT dp.r, dp.i, {n} AS n, item_id FROM dp JOIN win ON win.n = {n} AND {gram(n)} = win.g" for n in range(1, WINDOW + 1))
    windows = " UNION ".join(f"SELECT item_id, {n} AS n, {gram(n)} AS g FROM bp WHERE least(size, {WINDOW}) = {n} AND {gram(n)} IS NOT NULL" for n in range(1, WINDOW + 1))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS r, {words} AS w FROM benchmark),
dp AS (SELECT *, {ahead} FROM (SELECT r, unnest(w) AS w0, generate_subscripts(w, 1) AS i FROM d)),
bp AS (SELECT *, {ahead} FROM (SELECT item_id, r, len(w) AS size, unnest(w) AS w0, generate_subscripts(w, 1) AS i FROM b)),
win AS ({windows}),
hit AS ({hits}),
covered AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, {WINDOW})) AS t(k) WHERE k < n GROUP BY r),
listed AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""


OP9_SQL = _oracle()
