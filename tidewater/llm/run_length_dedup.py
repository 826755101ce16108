"""Exact removal of long repeats by run-length compressed Burrows-Wheeler indexes.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document with a smaller
doc_id.  Strings are judged on the input and never cross documents.

Documents are dealt into groups of a few MB.  Every 50-byte string has an anchor, its k-gram of
least hash, which depends on the string alone: equal strings share their anchor, and consecutive
strings with one anchor form a segment.

1. Groups send the distinct hashes of their anchors, each with its number of distinct segments,
   dealt by hash; those in two documents or more are repeated (a state comes back for each).
2. Groups send the distinct segments around repeated anchors, dealt by anchor, each with its
   smallest doc_id.  Strings around a hot anchor (more than ``HOT_SEGMENTS`` segments sent by all
   groups, or more than ``HOT_GROUPS`` groups) are dealt by their own content, so that no anchor
   gathers in one task.
3. Each part of a deal of segments becomes an index: the Burrows-Wheeler transform of the segments, kept as
   runs, with the suffix sampled at run ends and the earliest document sampled at the head of each
   group of rows that agree in ``SPAN`` bytes.  All segments stream through it from their ends by
   run-length LF steps; wherever the match is ``SPAN`` long, its earliest document is read off.
4. Groups get those documents back for their segments, mark what an earlier one has, and cut.

Every deal is exact: hashes only route (40 bits and more, false hits cost work and not results),
and equal segments are told by their bytes.

Scale: a deal holds about as much text as a group, so the blobs between n groups and n deals have
1 / n of a group each; a group never sends more blobs than it has segments.

Edge cases: a null text counts as empty; texts under ``SPAN`` bytes lose nothing; equal texts
under one doc_id keep each other; a row with a null doc_id neither loses bytes nor makes others
lose any; repeated rows stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import text as tx
from tidewater.llm.workspace import bucketed, lasting, map_arrow, materialize, passing

SPAN = 50
#: Length of an anchor; a string has SPAN - ANCHOR + 1 places for one.
ANCHOR = 20
GROUP_BYTES = 8 << 20
#: Positions handled at once within a group.
STEP = 1 << 20
#: Indexes that a deal of segments is split into; each is built and left before the next.
PARTS = 32
HOT_GROUPS = 20_000
#: Segments around one anchor that may go to one index: about the text of an average one, in
#: segments of full length.
HOT_SEGMENTS = (2 * GROUP_BYTES // PARTS) // (2 * SPAN - ANCHOR)

_NO_DOC = np.int64(np.iinfo(np.int64).max)
U64 = np.uint64


def _zip(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _unzip(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data, "<u8", len(kinds) + 1)[1:].astype(int)
    at, out = 8 * (len(kinds) + 1), []
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges [start, start + size), one after another."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])


# --- groups --------------------------------------------------------------------------------


def anchored(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings with one anchor: (first start, number of strings, anchor hash)."""
    n, places = len(raw), SPAN - ANCHOR + 1
    firsts, counts, hashes = [], [], []
    for lo in range(0, n - SPAN + 1, STEP):
        part = raw[lo : lo + STEP + SPAN - 1]
        n_win, n_gram = len(part) - SPAN + 1, len(part) - ANCHOR + 1
        prefix = tx.prefix_hash(part)
        _, inverse = tx._power_tables(len(part))
        gram = tx.mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * inverse[:n_gram])
        low = (gram & U64(0xFFFFFFFF00000000)) | np.arange(n_gram, dtype=U64)
        width = 1
        while width * 2 <= places:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < places:
            low = np.minimum(low[: n_win], low[places - width : places - width + n_win])
        at = (low[:n_win] & U64(0xFFFFFFFF)).astype(np.int64)
        valid = np.ones(n_win, bool)
        d = np.searchsorted(offsets, lo, side="right")
        while d < len(offsets) and offsets[d] - SPAN + 1 < lo + n_win:
            valid[max(0, offsets[d] - SPAN + 1 - lo) : max(0, offsets[d] - lo)] = False
            d += 1
        new = valid.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        last = valid.copy()
        last[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
        s = np.flatnonzero(new)
        firsts.append(s + lo)
        counts.append(np.flatnonzero(last) - s + 1)
        hashes.append(gram[at[s]])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(hashes)


class Group:
    """A group's documents and the deals of its anchors and segments, the same in every pass."""

    def __init__(self, blob: bytes, n_deals: int):
        self.doc_ids, self.has_id, self.offsets, self.raw = _unzip(blob, "<i8", "u1", "<i8", "u1")
        self.first, self.count, self.hash = anchored(self.raw, self.offsets)
        doc = np.searchsorted(self.offsets, self.first, side="right") - 1
        known = self.has_id[doc] > 0
        self.first, self.count, self.hash, self.doc = self.first[known], self.count[known], self.hash[known], doc[known]
        self.n_deals = n_deals
        self.key = ((self.hash >> U64(40)) % U64(n_deals)) << U64(40) | (self.hash & U64((1 << 40) - 1))
        self.keys, self.code = np.unique(self.key, return_inverse=True)

    def anchor_deals(self) -> Iterator[tuple[int, bytes]]:
        """(deal, sorted 40-bit hashes, whether two documents here have each, distinct segments)."""
        n_docs = len(self.doc_ids)
        holders = np.unique(self.code * n_docs + self.doc) // n_docs
        several = np.bincount(holders, minlength=len(self.keys)) > 1
        again = np.flatnonzero(np.bincount(self.code, minlength=len(self.keys))[self.code] > 1)
        _, one = tx.distinct(tx.span_hash_along(self.raw, self.first[again], self.first[again] + self.count[again] + SPAN - 1, STEP))
        sent = np.maximum(np.bincount(self.code[again[one]], minlength=len(self.keys)), 1).astype("<u4")
        deal = (self.keys >> U64(40)).astype(np.int64)
        bounds = np.searchsorted(deal, np.arange(self.n_deals + 1))
        for d in np.flatnonzero(np.diff(bounds)).tolist():
            own = self.keys[bounds[d] : bounds[d + 1]] & U64((1 << 40) - 1)
            step = np.diff(own, prepend=U64(0)).view(np.uint8).reshape(-1, 8)[:, :5]
            yield d, _zip(step.T.copy(), np.packbits(several[bounds[d] : bounds[d + 1]]), sent[bounds[d] : bounds[d + 1]])

    def segments(self, verdicts: list[tuple[int, bytes]], n_deals: int) -> tuple[np.ndarray, ...]:
        """Distinct segments around repeated anchors, by deal and part: (deal * PARTS + part, start,
        size, min doc_id) and for every place its (segment, start, number of strings, document)."""
        state = np.zeros(len(self.keys), np.uint8)
        deal = (self.keys >> U64(40)).astype(np.int64)
        bounds = np.searchsorted(deal, np.arange(self.n_deals + 1))
        for d, blob in verdicts:
            state[bounds[d] : bounds[d + 1]] = _unzip(blob, "u1")[0]
        of = state[self.code]
        first, count, doc, anchor = self.first, self.count, self.doc, self.hash
        hot = of == 2
        if hot.any():  # hot anchors: every string for itself
            at = np.flatnonzero(hot)
            keep = np.flatnonzero(of == 1)
            alone = _ranges(first[at], count[at])
            doc = np.concatenate([doc[keep], np.repeat(doc[at], count[at])])
            anchor = np.concatenate([anchor[keep], np.zeros(len(alone), U64)])
            first, count = np.concatenate([first[keep], alone]), np.concatenate([count[keep], np.ones(len(alone), np.int64)])
            single = np.arange(len(first)) >= len(keep)
        else:
            keep = np.flatnonzero(of == 1)
            first, count, doc, anchor, single = first[keep], count[keep], doc[keep], anchor[keep], np.zeros(len(keep), bool)
        size = count + SPAN - 1
        alone = np.count_nonzero(single)  # both parts are in ascending order
        content = np.concatenate([tx.span_hash_along(self.raw, first[part], first[part] + size[part], STEP) for part in (slice(len(first) - alone), slice(len(first) - alone, len(first)))])
        code, one = tx.distinct_spans(self.raw, first, first + size, content)
        least = np.full(len(one), _NO_DOC)
        np.minimum.at(least, code, self.doc_ids[doc])
        route = np.where(single[one], content[one], tx.mix(anchor[one] ^ U64(0x5851F42D4C957F2D)))
        to = (route % U64(n_deals)).astype(np.int64) * PARTS + ((route >> U64(48)) % U64(PARTS)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        one = one[order]
        return to[order], first[one], size[one], least[order], place[code], first, count, doc


def _pack(table: pa.Table) -> pa.Table:
    order = np.lexsort((table.column(3).to_numpy(), table.column(1).fill_null(-1).to_numpy()))
    table = table.take(pa.array(order))
    ids = table.column(1).combine_chunks()
    offsets, raw = tx.string_buffers(table.column(2).combine_chunks())
    raw = raw[offsets[0] : offsets[-1]]
    blob = _zip(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), ids.is_valid().to_numpy(zero_copy_only=False).astype("u1"), (offsets - offsets[0]).astype("<i8"), raw)
    return pa.table({"g": table.column(0).slice(0, 1), "docs": pa.array([blob], pa.binary())})


def _send_anchors(n_deals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for g, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                    sent = list(Group(blob.as_buffer(), n_deals).anchor_deals())
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(sent), pa.int32()), pa.array([d for d, _ in sent], pa.int32()), pa.array([b for _, b in sent], pa.binary())], names=["g", "deal", "blob"])

    return run


def _judge(table: pa.Table) -> pa.Table:
    """For each group of a deal, per hash: 0 in one document, 1 in several, 2 with very many segments."""
    hashes, several, sent = [], [], []
    for blob in table.column(2).combine_chunks():
        step, bits, segments = _unzip(blob.as_buffer(), "u1", "u1", "<u4")
        n = len(step) // 5
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :5] = step.reshape(5, n).T
        hashes.append(np.cumsum(wide.view(U64).ravel(), dtype=U64))
        several.append(np.unpackbits(bits, count=n).astype(bool))
        sent.append(segments)
    sizes = [len(h) for h in hashes]
    code, first = tx.distinct(np.concatenate(hashes))
    groups = np.bincount(code, minlength=len(first))
    repeated = groups > 1
    repeated[code[np.concatenate(several)]] = True
    total = np.bincount(code, weights=np.concatenate(sent), minlength=len(first))
    hot = repeated & ((groups > HOT_GROUPS) | (total > HOT_SEGMENTS))
    state = (repeated.astype(np.uint8) + hot)[code]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return pa.table({"g": table.column(0), "deal": table.column(1), "blob": pa.array([_zip(state[a:b]) for a, b in zip(upto, upto[1:])], pa.binary())})


def segment_blobs(group: Group, verdicts: list[tuple[int, bytes]], n_deals: int) -> Iterator[tuple[int, bytes]]:
    """(deal, segments in each of its parts, their sizes, earliest documents and bytes)."""
    to, start, size, least, *_ = group.segments(verdicts, n_deals)
    bounds = np.searchsorted(to, np.arange(n_deals + 1) * PARTS)
    for d in np.flatnonzero(np.diff(bounds)).tolist():
        own = slice(bounds[d], bounds[d + 1])
        yield d, _zip(np.bincount(to[own] - d * PARTS, minlength=PARTS).astype("<u4"), size[own].astype("u1"), least[own].astype("<i8"), group.raw[_ranges(start[own], size[own])])


def _send_segments(n_deals: int, n_segment_deals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for g, docs, verdicts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    group = Group(docs.as_buffer(), n_deals)
                    sent = list(segment_blobs(group, [(v["deal"], v["blob"]) for v in verdicts or []], n_segment_deals))
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(sent), pa.int32()), pa.array([d for d, _ in sent], pa.int32()), pa.array([b for _, b in sent], pa.binary())], names=["g", "deal", "blob"])

    return run


# --- the index -----------------------------------------------------------------------------


class Marks:
    """A bit for each row, with ranks by popcount over words."""

    def __init__(self, n: int, at: np.ndarray):
        bits = np.zeros(n + 64 - n % 64, np.uint8)
        bits[at] = 1
        self.words = np.packbits(bits, bitorder="little").view(U64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def last(self, rows: np.ndarray) -> np.ndarray:
        """Number of the last mark at or before each row."""
        word = rows >> 6
        upto = np.bitwise_count(self.words[word] << (U64(63) - (rows & 63).astype(U64)))
        return self.before[word] + upto - 1


class RunLengthIndex:
    """Burrows-Wheeler transform of a collection of short strings, as runs.

    Row order: suffixes ascending, each string closed by an end of its own that sorts before all
    bytes (ends by string number).
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, doc: np.ndarray):
        m = len(sizes)
        wide = sizes + 1  # every string with its end
        begin = np.concatenate([[0], np.cumsum(wide)])[:-1]
        n = int(wide.sum())
        used = np.zeros(256, bool)
        body = raw[_ranges(starts, sizes)]
        used[body] = True
        letter = np.cumsum(used)  # 1 and up in byte order; 0 is the end
        width = max(1, int(letter[-1]).bit_length())
        text = np.zeros(n + 64, np.int64)
        text[_ranges(begin, sizes)] = letter[body]
        to_end = np.repeat(begin + wide, wide) - np.arange(n)  # symbols left, the end included

        # ranks of prefixes by doubling; what lies beyond an end counts as nothing
        depth, place = 42 // width, max(1, int(n).bit_length())
        key = np.zeros(n, np.int64)
        for j in range(depth):
            key = key << width | np.where(to_end > j, text[j : j + n], 0)
        bits, longest, agreed = 42, int(wide.max()), None
        while True:
            if bits + place <= 63:  # key and position share a word: one plain sort, ties by position
                packed = np.sort(key << place | np.arange(n))
                order, ordered = packed & (1 << place) - 1, packed >> place
            else:
                order = np.argsort(key, kind="stable")
                ordered = key[order]
            dense = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
            rank = np.empty(n, np.int64)
            rank[order] = dense
            if agreed is None and 2 * depth >= SPAN:
                agreed = (rank, min(depth, SPAN))
            if depth >= longest or dense[-1] == n:
                break
            ahead = np.zeros(n, np.int64)
            far = np.flatnonzero(to_end > depth)
            ahead[far] = rank[far + depth]
            key, bits = rank << place | ahead, 2 * place
            depth *= 2
        if agreed is None:
            agreed = (rank, min(depth, SPAN))

        # equal suffixes stand in text order, so ends are rows 0 .. m - 1 by string
        before = text[order - 1]
        whole = to_end[order] == wide[np.repeat(np.arange(m), wide)[order]]
        before[whole] = 0
        change = np.concatenate([[True], (before[1:] != before[:-1]) | whole[1:] | whole[:-1]])
        self.run_start = np.flatnonzero(change)
        self.runs = Marks(n, self.run_start)
        char, length = before[self.run_start], np.diff(np.append(self.run_start, n))
        # where a run's rows go: the block of its symbol, after earlier runs of the symbol
        block = np.concatenate([[0], np.cumsum(np.bincount(text[:n], minlength=258))])
        by_char = np.argsort(char, kind="stable")
        held = np.concatenate([[0], np.cumsum(length[by_char])])[:-1]
        head = np.concatenate([[0], np.cumsum(np.bincount(char, weights=length, minlength=258).astype(np.int64))])
        self.run_to = np.empty(len(length), np.int64)
        self.run_to[by_char] = held - head[char[by_char]] + block[char[by_char]]
        #: the suffix sampled at the last row of each run
        self.run_end_position = order[self.run_start + length - 1]

        # groups of rows that agree in SPAN symbols, and the earliest document of each
        ranks, seen = agreed
        rows = np.flatnonzero(to_end[order] > SPAN)
        there = order[rows]
        left, right = ranks[there], ranks[there + SPAN - seen]
        heads = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])) if len(rows) else rows
        self.groups = Marks(n, rows[heads])
        owner = np.repeat(doc, wide)[there]
        self.group_doc = np.minimum.reduceat(owner, heads) if len(heads) else owner

    def step_back(self, rows: np.ndarray) -> np.ndarray:
        """LF: the row of each suffix lengthened by the byte before it."""
        run = self.runs.last(rows)
        return self.run_to[run] + rows - self.run_start[run]

    def earliest(self, rows: np.ndarray) -> np.ndarray:
        """The earliest document of the group that a row with SPAN symbols lies in."""
        return self.group_doc[self.groups.last(rows)]


def stream(index: RunLengthIndex, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches of all strings at once, from their ends: wherever one reaches SPAN, its earliest
    document.  (documents of all strings' windows in order, bounds)"""
    bounds = np.concatenate([[0], np.cumsum(sizes - SPAN + 1)])
    out = np.empty(bounds[-1], np.int64)
    rows, live = np.arange(len(sizes)), np.arange(len(sizes))
    for matched in range(1, int(sizes.max(initial=0)) + 1):
        keep = sizes[live] >= matched
        live, rows = live[keep], index.step_back(rows[keep])
        if matched >= SPAN:
            out[bounds[live] + sizes[live] - matched] = index.earliest(rows)
    return out, bounds


def _index(table: pa.Table) -> pa.Table:
    """For each group of a deal, the earliest document of every string of its segments, as runs.
    One part of the deal after another is indexed and streamed."""
    sent = [_unzip(b.as_buffer(), "<u4", "u1", "<i8", "u1") for b in table.column(2).combine_chunks()]
    n = len(sent)
    upto = [np.concatenate([[0], np.cumsum(counts.astype(np.int64))]) for counts, *_ in sent]
    at = [np.concatenate([[0], np.cumsum(size.astype(np.int64))]) for _, size, _, _ in sent]
    runs: list[list[np.ndarray]] = [[] for _ in sent]
    docs: list[list[np.ndarray]] = [[] for _ in sent]
    with np.errstate(over="ignore"):
        for k in range(PARTS):
            own = [slice(u[k], u[k + 1]) for u in upto]
            size = np.concatenate([x[1][o] for x, o in zip(sent, own)]).astype(np.int64)
            if not len(size):
                continue
            least = np.concatenate([x[2][o] for x, o in zip(sent, own)])
            raw = np.concatenate([x[3][a[o.start] : a[o.stop]] for x, o, a in zip(sent, own, at)])
            start = np.concatenate([[0], np.cumsum(size)])[:-1]
            code, one = tx.distinct_spans(raw, start, start + size, tx.span_hash(raw, start, start + size))
            doc = np.full(len(one), _NO_DOC)
            np.minimum.at(doc, code, least)
            found, bounds = stream(RunLengthIndex(raw, start[one], size[one], doc), size[one])
            here = np.concatenate([[0], np.cumsum([o.stop - o.start for o in own])])
            for i in range(n):
                mine = code[here[i] : here[i + 1]]
                if not len(mine):
                    continue
                flat = found[_ranges(bounds[mine], bounds[mine + 1] - bounds[mine])]
                change = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
                runs[i].append(np.diff(np.append(change, len(flat))))
                docs[i].append(flat[change])
    blobs = [_zip(np.concatenate(r).astype("<u4"), np.concatenate(d).astype("<i8")) for r, d in zip(runs, docs)]
    return pa.table({"g": table.column(0), "deal": table.column(1), "blob": pa.array(blobs, pa.binary())})


# --- cutting -------------------------------------------------------------------------------

_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(n_deals: int, n_segment_deals: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for docs, verdicts, answers in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    yield cut_group(Group(docs.as_buffer(), n_deals), verdicts or [], answers or [], n_segment_deals, with_text)

    return run


def _at(sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The running sum before each offset."""
    return np.where(offsets > 0, sums[np.maximum(offsets, 1) - 1] if len(sums) else 0, 0).astype(np.int64)


def _stretches(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes, summed in ``upto``, come to about ``most`` each."""
    lo = 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def cut_group(group: Group, verdicts: list, answers: list, n_segment_deals: int, with_text: bool) -> pa.RecordBatch:
    n = len(group.raw)
    cover = np.zeros(n + 1, np.int32)
    if answers:
        _, _, size, _, place, first, count, doc = group.segments([(v["deal"], v["blob"]) for v in verdicts], n_segment_deals)
        parts = [np.repeat(docs, runs) for runs, docs in (_unzip(a["blob"], "<u4", "<i8") for a in sorted(answers, key=lambda a: a["deal"]))]
        earliest, upto = np.concatenate(parts), np.concatenate([[0], np.cumsum(size - SPAN + 1)])
        strings = np.cumsum(count)
        for lo, hi in _stretches(strings, STEP):  # neighbours in the text, a bounded number at once
            gone = earliest[_ranges(upto[place[lo:hi]], count[lo:hi])] < np.repeat(group.doc_ids[doc[lo:hi]], count[lo:hi])
            at = _ranges(first[lo:hi], count[lo:hi])[gone]
            if len(at):
                base, top = int(at.min()), int(at.max()) + SPAN + 1
                cover[base:top] += (np.bincount(at - base, minlength=top - base) - np.bincount(at + SPAN - base, minlength=top - base)).astype(np.int32)
    removed = np.cumsum(cover, out=cover)[:-1] > 0
    lo, hi = group.offsets[:-1], group.offsets[1:]
    removed_upto = _at(np.cumsum(removed, dtype=np.int32), group.offsets)
    new = removed.copy()
    new[1:] &= ~removed[:-1]
    full = group.offsets[:-1][np.diff(group.offsets) > 0]
    new[full] = removed[full]
    spans_upto = _at(np.cumsum(new, dtype=np.int32), group.offsets)
    kept_at = group.offsets - removed_upto
    kept = group.raw[~removed].tobytes()
    pieces = [kept[a:b] for a, b in zip(kept_at.tolist(), kept_at[1:].tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(group.doc_ids, pa.int64(), mask=group.has_id == 0), pa.array(hi - lo), pa.array(np.diff(removed_upto)), pa.array(np.diff(spans_upto)), pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string()), pa.array(pieces if with_text else [None] * len(pieces), pa.binary())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
    )


def _by_group(rows: DataFrame, name: str) -> DataFrame:
    """All of a group's answers in one row: what its own segments ask for, so bounded like a group."""
    return rows.groupBy("g").agg(F.collect_list(F.struct("deal", "blob")).alias(name)).hint("shuffle_hash")


def remove_repeats(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the
    bytes kept."""
    with passing(docs.sparkSession):  # the tables of the way there go with it
        out = _cut_repeats(docs, with_text, id_col, text_col)
        with lasting():
            return materialize(out, "cut-documents")


def _cut_repeats(docs: DataFrame, with_text: bool, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = int(total // GROUP_BYTES) + 1
    n_deals, n_segment_deals = n_groups // 2 + 1, n_groups
    tie = F.xxhash64("text")
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", tie), F.lit(n_groups)).cast("int").alias("g"), "doc_id", "text", tie.alias("tie"))
    # in buckets by group: answers come to the documents, which are not shuffled again
    groups = bucketed(dealt.groupBy("g").applyInArrow(_pack, "g int, docs binary"), "groups", n_groups, "g")

    sent = "g int, deal int, blob binary"
    anchors = map_arrow(groups, _send_anchors(n_deals), sent)
    verdicts = _by_group(materialize(anchors.groupBy("deal").applyInArrow(_judge, sent), "verdicts"), "verdicts")
    judged = groups.join(verdicts, "g", "left").select("g", "docs", "verdicts")
    segments = map_arrow(judged, _send_segments(n_deals, n_segment_deals), sent)
    answers = _by_group(materialize(segments.groupBy("deal").applyInArrow(_index, sent), "answers"), "answers")
    whole = judged.join(answers, "g", "left").select("g", "docs", "verdicts", "answers")
    out = map_arrow(whole, _cut(n_deals, n_segment_deals, with_text), _RESULT)
    return out if with_text else out.drop("kept")


def op5_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 50 bytes removed from the whole ``documents`` table."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
pos AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM d, unnest(range(0, length(h) // 2 - 49)) AS t(p) WHERE length(h) >= 100),
early AS (SELECT s, min(doc_id) AS m FROM pos GROUP BY s),
hit AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM pos JOIN early USING (s) WHERE m < doc_id),
run AS (SELECT r, p, sum(CASE WHEN p - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS k FROM hit),
span AS (SELECT r, min(p) AS lo, max(p) + 50 AS hi FROM run GROUP BY r, k),
cut AS (SELECT span.r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY span.r ORDER BY lo), 0) AS since FROM span),
kept AS (
  SELECT d.r, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS left_over
  FROM cut JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
