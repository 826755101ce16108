"""Vectorised views of Arrow string columns: word spans and word hashes over whole buffers.

Everything here works on one slice of a batch (a few MB of text) at a time, so that memory
follows the slice and not the partition.  A single text longer than a slice forms its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

SLICE_BYTES = 2 << 20

U64 = np.uint64
#: An odd multiplier, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def byte_class(*members: int | range) -> np.ndarray:
    """A boolean table over the 256 byte values."""
    table = np.zeros(256, dtype=bool)
    for m in members:
        table[list(m) if isinstance(m, range) else m] = True
    return table


#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACE = byte_class(0x20, range(0x09, 0x0E))
#: Separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: ASCII but digits and small letters.
NON_WORD = byte_class(range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64 of length n + 1, bytes uint8); a null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``most`` bytes: (first row, last row + 1, offsets from 0, bytes)."""
    if not len(column):
        return
    offsets, raw = string_buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]]
        lo = hi


def spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of other bytes within each text: (starts, ends, row of each)."""
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~separators[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets[:-1]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, side="right") - 1


_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]
_KEEP = (2 << 20) + 1


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n; only short tables are kept."""
    if n <= len(_powers[0]):
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (BASE, BASE_INVERSE):
        table = np.full(n, base, dtype=U64)
        table[0] = 1
        made.append(np.cumprod(table, dtype=U64))
    if n <= _KEEP:
        _powers[:] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = BASE**s * (polynomial hash of raw[s:e])."""
    power, _ = _power_tables(max(1, len(raw)))
    out = np.zeros(len(raw) + 1, dtype=U64)
    if len(raw):
        np.cumsum((raw.astype(U64) + U64(1)) * power[: len(raw)], out=out[1:])
    return out


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span's bytes.  It deals and sorts spans; it does not tell them apart:
    a polynomial modulo 2**64 has texts made to collide (Thue-Morse words), see ``distinct_spans``."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    prefix = prefix_hash(raw) if prefix is None else prefix
    _, inverse = _power_tables(len(raw) + 1)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def span_hash_along(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """``span_hash`` of short spans in ascending order, a stretch of ``raw`` at a time."""
    out, i = np.zeros(len(starts), dtype=U64), 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(starts, base + step))
        out[i:j] = span_hash(raw[base : int(ends[i:j].max())], starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each item, index of the first item of each code)."""
    codes, values = pd.factorize(hashes)
    first = np.empty(len(values), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


#: Spans up to this length are compared in steps of eight bytes, all at once.
_STEPPED = 160
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one little-endian word (zeros beyond the end)."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def same_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span of ``raw`` holds the same bytes as its partner in ``others``."""
    size = ends - starts
    same = size == other_ends - other_starts
    one = eights(raw)
    two = one if others is raw else eights(others)
    live = np.flatnonzero(same & (size > 0) & (size <= _STEPPED))
    at = 0
    while len(live):
        keep = _LOW_BYTES[np.minimum(size[live] - at, 8)]
        equal = (one[starts[live] + at] ^ two[other_starts[live] + at]) & keep == 0
        same[live[~equal]] = False
        at += 8
        live = live[equal & (size[live] > at)]
    for i in np.flatnonzero(same & (size > _STEPPED)).tolist():
        same[i] = np.array_equal(raw[starts[i] : ends[i]], others[other_starts[i] : other_ends[i]])
    return same


def distinct_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(code of each span, index of the first span of each code); one code means equal bytes.

    Hashes only sort the spans into classes: every member is compared with the first of its class,
    and those that differ get codes of their own by their bytes.  Digests need memory for the spans
    alone; callers with long spans bring ``span_hash``, which needs some for each byte of ``raw``.
    """
    codes, first = distinct(span_digest(raw, starts, ends) if hashes is None else hashes)
    again = np.flatnonzero(first[codes] != np.arange(len(codes)))
    one = first[codes[again]]
    other = again[~same_bytes(raw, starts[again], ends[again], raw, starts[one], ends[one])]
    if len(other):
        made: dict[bytes, int] = {}
        more = []
        for i in other.tolist():
            body = raw[starts[i] : ends[i]].tobytes()
            if body not in made:
                made[body] = len(first) + len(more)
                more.append(i)
            codes[i] = made[body]
        first = np.concatenate([first, np.array(more, np.int64)])
    return codes, first


def span_digest(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each span's bytes that follows no algebra: eight bytes at a time go
    through the finaliser, long spans through a cryptographic digest.  Spans that are compared
    across tasks, where their bytes are not at hand, go by it."""
    size = ends - starts
    out = size.astype(U64) * U64(0xA0761D6478BD642F)
    body, at = eights(raw), 0
    live = np.flatnonzero((size > 0) & (size <= _STEPPED))
    while len(live):
        left = size[live] - at
        out[live] = mix(mix(out[live] + U64(0x9E3779B97F4A7C15)) ^ (body[starts[live] + at] & _LOW_BYTES[np.minimum(left, 8)]))
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > _STEPPED).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def take_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data = raw.tobytes()
    return [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each row's items start among items ordered by row; length n + 1."""
    return np.searchsorted(rows, np.arange(n + 1))


class WordCache:
    """word -> value, in two generations: memory stays bounded, frequent words stay.

    ``limit`` bounds the bytes of a generation, reckoned as 300 a word and 4 for each of its bytes
    (keys, values and their Python objects); words over ``LONGEST`` bytes are never kept.
    """

    LONGEST = 512

    def __init__(self, limit: int = 24 << 20):
        self.limit, self.held, self.young, self.old = limit, 0, {}, {}

    def lookup(self, words: list[bytes], make) -> list:
        """Values of ``words``; ``make`` gets the list of those unknown and returns theirs."""
        young, old = self.young, self.old
        found = list(map(young.get, words))
        missing = [i for i, v in enumerate(found) if v is None]
        if old and missing:
            for i in missing:
                v = old.get(words[i])
                if v is not None:
                    found[i] = young[words[i]] = v
                    self.held += 300 + 4 * len(words[i])
            missing = [i for i in missing if found[i] is None]
        if missing:
            new = [words[i] for i in missing]
            made = make(new)
            for i, w, v in zip(missing, new, made, strict=True):
                found[i] = v
                if len(w) <= self.LONGEST:
                    young[w] = v
                    self.held += 300 + 4 * len(w)
        if self.held > self.limit:
            self.old, self.young, self.held = young, {}, 0
        return found
