"""Word-level BPE by a transducer lexicon, with exact merges for the rest.

Frequent words of the corpus are compiled into a minimal acyclic automaton (shared prefixes and
suffixes) whose accepting paths number the words; the number leads to the word's token ids.  The
automaton is a handful of flat arrays in one file of the shared folder, which Spark distributes to
its executors and their workers memory-map.  Words outside the lexicon are merged exactly: short
ones many at a time, long ones by a heap of pairs, so that no word costs more than n log n.

The tokenizer file must describe a BPE model with an end-of-word suffix, a white-space splitting
normaliser (NFC, white space, lower case) and a byte-level alphabet.  Which words are in the
lexicon decides speed only, never a result.

Edge cases: a null or empty text has no tokens and decodes to an empty text; repeated rows and
null doc_ids stay as they are; an empty table gives an empty result (and an empty lexicon); other
columns are ignored; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import text as tx
from tidewater.llm.workspace import map_arrow, materialize, share_file

#: Entries of the lexicon, and bytes of one at most: what bounds its size.
LEXICON_WORDS, ENTRY_BYTES = 65_536, 64
#: Words longer than this are merged one at a time, by a heap.
LONG_WORD = 256
#: Distinct segments that a task counts before it sends them on.
COUNTED = 200_000
#: What a worker's cache of segments holds in a generation, as ``WordCache`` reckons it; a worker keeps two.
CACHE_BYTES = 32 << 20
#: Text encoded at once: what the steps of a slice hold is many times its size.
SLICE_BYTES = 1 << 19


# --- the automaton -------------------------------------------------------------------------


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton over distinct sorted ``words``, numbered in that order.

    keys     sorted (state << 8 | byte), one for each edge
    target   the state that an edge leads to
    skip     words that end before this edge in the order of its state
    final    whether a word ends in a state
    """
    register: dict = {}
    nodes: list[list] = [[False, {}]]  # [final, {byte: node}]; node 0 is the root

    path, previous = [0], b""

    def settle(down_to: int) -> None:
        while len(path) - 1 > down_to:
            node, parent = path.pop(), path[-1]
            byte = previous[len(path) - 1]
            sign = (nodes[node][0], tuple(nodes[node][1].items()))
            same = register.setdefault(sign, node)
            nodes[parent][1][byte] = same
            if same != node:
                nodes[node] = None

    for w in words:
        common = 0
        for a, b in zip(w, previous):
            if a != b:
                break
            common += 1
        settle(common)
        previous = w
        for byte in w[common:]:
            nodes.append([False, {}])
            nodes[path[-1]][1][byte] = len(nodes) - 1
            path.append(len(nodes) - 1)
        nodes[path[-1]][0] = True
    settle(0)

    live = [i for i, n in enumerate(nodes) if n is not None]
    number = {node: i for i, node in enumerate(live)}
    below: dict[int, int] = {}
    for node in reversed(live):  # children are not always later, so count on demand
        stack = [node]
        while stack:
            top = stack[-1]
            todo = [c for c in nodes[top][1].values() if c not in below]
            if todo:
                stack.extend(todo)
                continue
            below[top] = nodes[top][0] + sum(below[c] for c in nodes[top][1].values())
            stack.pop()
    keys, target, skip = [], [], []
    for node in live:
        ahead = int(nodes[node][0])
        for byte, child in sorted(nodes[node][1].items()):
            keys.append(number[node] << 8 | byte)
            target.append(number[child])
            skip.append(ahead)
            ahead += below[child]
    return {"keys": np.array(keys, np.int64), "target": np.array(target, np.int32), "skip": np.array(skip, np.int32), "final": np.array([nodes[n][0] for n in live], bool), "longest": np.array([max(map(len, words), default=0)], np.int64)}


def word_numbers(auto: dict[str, np.ndarray], raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of each span's word in the automaton, or -1."""
    found = np.full(len(starts), -1, dtype=np.int64)
    keys = auto["keys"]
    if not len(keys) or not len(starts):
        return found
    live = np.flatnonzero((ends - starts <= auto["longest"][0]) & (ends > starts))
    state, count, at = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), starts[live]
    stop = ends[live]
    while len(live):
        key = state << 8 | raw[at]
        edge = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[edge] == key
        live, edge, at, stop, count = live[hit], edge[hit], at[hit] + 1, stop[hit], count[hit]
        state, count = auto["target"][edge].astype(np.int64), count + auto["skip"][edge]
        over = at == stop
        done = over & auto["final"][state]
        found[live[done]] = count[done]
        live, at, stop, state, count = live[~over], at[~over], stop[~over], state[~over], count[~over]
    return found


# --- the model -----------------------------------------------------------------------------


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


class Model:
    """Vocabulary and merges of a tokenizer file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, vocab = data["model"], data["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        self.suffix = suffix
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in data["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in data["added_tokens"]}
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.pairs: dict | None = None
        self.spaced = [b" " + self.tokens.get(i, "").encode("utf-8") for i in range(max(self.tokens) + 1)]

    def merge(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of every span: (ids of all, bounds of each).

        A round merges, in each word, every place of the word's best pair from the left.  A pair
        made by a merge ranks after it, so rounds of whole pairs equal one merge at a time.
        """
        n, size = len(starts), ends - starts
        bounds = np.concatenate([[0], np.cumsum(size)])
        word = np.repeat(np.arange(n), size)
        sym = self.inner[raw[np.repeat(starts - bounds[:-1], size) + np.arange(bounds[-1])]]
        full = size > 0
        sym[bounds[1:][full] - 1] = self.last[raw[ends[full] - 1]]
        never, n_pairs = np.int64(1 << 40), len(self.pair)
        done_word, done_sym = [], []
        while len(sym) > 1 and n_pairs:
            joined = word[1:] == word[:-1]
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.pair, key), n_pairs - 1)
            rank = np.where(joined & (self.pair[at] == key), self.rank[at], never)
            head = np.flatnonzero(np.concatenate([[True], ~joined]))
            best = np.minimum.reduceat(np.append(rank, never), head)
            of = np.cumsum(np.concatenate([[0], ~joined]))
            open_ = best < never
            if not open_.all():  # finished words leave
                out = ~open_[of]
                done_word.append(word[out])
                done_sym.append(sym[out])
                if not open_.any():
                    word, sym = word[:0], sym[:0]
                    break
            take = np.append((rank == best[of[:-1]]) & (rank < never), False)
            if len(sym) > 1 and (take[1:] & take[:-1]).any():  # a run of one symbol: every second place
                index = np.arange(len(take))
                start = np.maximum.accumulate(np.where(take & ~np.concatenate([[False], take[:-1]]), index, 0))
                take &= (index - start) % 2 == 0
            sym = sym.copy()
            where = np.flatnonzero(take)
            sym[where] = self.made[rank[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            keep &= open_[of]
            word, sym = word[keep], sym[keep]
        done_word.append(word)
        done_sym.append(sym)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order], tx.row_bounds(word[order], n)


    def merge_long(self, word: bytes) -> np.ndarray:
        """Exact BPE of one word in n log n: the best pair, leftmost first, from a heap."""
        if self.pairs is None:
            self.pairs = dict(zip(self.pair.tolist(), zip(self.rank.tolist(), self.made[self.rank].tolist())))
        pairs, sym = self.pairs, self.inner[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.last[word[-1]])
        n = len(sym)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*pairs[key], i) for i in range(n - 1) if (key := sym[i] << 32 | sym[i + 1]) in pairs]
        heapq.heapify(heap)
        while heap:
            _, made, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n or pairs.get(sym[i] << 32 | sym[j], (0, -1))[1] != made:
                continue  # one of the two has been merged since
            sym[i], sym[j], after[i] = made, -1, after[j]
            if after[i] < n:
                ahead[after[i]] = i
                if (found := pairs.get(made << 32 | sym[after[i]])) is not None:
                    heapq.heappush(heap, (*found, i))
            if (k := ahead[i]) >= 0 and (found := pairs.get(sym[k] << 32 | made)) is not None:
                heapq.heappush(heap, (*found, k))
        return np.array([s for s in sym if s >= 0], np.int64)


_PLAIN = regex.compile(r"[\x21-\x7E¡-įı-ɏ]+")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Encoder:
    """Token ids and decoded bytes of white-space separated segments, for one worker."""

    def __init__(self, tokenizer_path: str, lexicon: dict[str, np.ndarray] | None):
        from tokenizers import Tokenizer

        self.model, self.lexicon = Model(tokenizer_path), lexicon
        whole = Tokenizer.from_file(tokenizer_path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.model.special, key=len, reverse=True))) + ")") if self.model.special else None
        self.letters = {c: b for b, c in enumerate(byte_alphabet())}
        self.cache = tx.WordCache(CACHE_BYTES)

    def words(self, segment: str) -> list[bytes | int]:
        """The segment's words as bytes; special tokens as ids."""
        if self.marks and "<" in segment and self.marks.search(segment):
            out: list[bytes | int] = []
            for part in self.marks.split(segment):
                out += [self.model.special[part]] if part in self.model.special else self.words(part) if part else []
            return out
        if _PLAIN.fullmatch(segment):  # nothing here changes in NFC, and its small letters are settled
            return [w.encode() for w in _WORDS.findall(segment.lower())]
        split = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(segment))
        return [bytes(map(self.letters.__getitem__, w)) for w, _ in split]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word: from the lexicon where it holds the word, by merging elsewhere."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if words else ends
        number = word_numbers(self.lexicon, raw, starts, ends) if self.lexicon else np.full(len(words), -1)
        out: list = [None] * len(words)
        if self.lexicon:
            flat, bounds = self.lexicon["ids"], self.lexicon["bounds"]
            listed = np.flatnonzero(number >= 0)
            for i, a, b in zip(listed.tolist(), bounds[number[listed]].tolist(), bounds[number[listed] + 1].tolist()):
                out[i] = flat[a:b]
        long = (number < 0) & (ends - starts > LONG_WORD)
        for i in np.flatnonzero(long).tolist():
            out[i] = self.model.merge_long(words[i])
        rest = np.flatnonzero((number < 0) & ~long)
        ids, bounds = self.model.merge(raw, starts[rest], ends[rest])
        for k, i in enumerate(rest.tolist()):
            out[i] = ids[bounds[k] : bounds[k + 1]]
        return out

    def encode_segments(self, segments: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, tokens each after a space) of each segment."""
        split = [self.words(s.decode("utf-8", "replace")) for s in segments]
        unique = list({w: None for ws in split for w in ws if isinstance(w, bytes)})
        spaced, each = self.model.spaced, self.encode_words(unique)
        flat = np.concatenate(each).astype("<u4") if each else np.zeros(0, "<u4")
        data, tokens = flat.tobytes(), [spaced[i] for i in flat.tolist()]
        made: dict = {}
        at = 0
        for w, end in zip(unique, np.cumsum([len(ids) for ids in each]).tolist(), strict=True):
            made[w] = (data[4 * at : 4 * end], b"".join(tokens[at:end]))
            at = end
        for k in self.model.special.values():
            made[k] = (k.to_bytes(4, "little"), spaced[k])
        return [made[ws[0]] if len(ws) == 1 else (b"".join([made[w][0] for w in ws]), b"".join([made[w][1] for w in ws])) for ws in split]

    def encode_slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """(ids, decoded text) of every text of a slice, as bytes."""
        starts, ends, rows = tx.spans(raw, offsets, tx.SPACE)
        codes, first = tx.distinct_spans(raw, starts, ends)
        values = self.cache.lookup(tx.take_spans(raw, starts[first], ends[first]), self.encode_segments)
        bounds = tx.row_bounds(rows, len(offsets) - 1).tolist()
        out = []
        for k in (0, 1):
            table = np.empty(len(values), dtype=object)
            table[:] = [v[k] for v in values]
            each = table[codes].tolist()
            out.append([b"".join(each[a:b]) for a, b in zip(bounds, bounds[1:])])
        return out[0], [d[1:] for d in out[1]]


# --- Spark ---------------------------------------------------------------------------------


def _count_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All segments that may enter a lexicon, with their counts, summed over parts of a task."""
    held: Counter = Counter()

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["segment", "n"])
        held.clear()
        return out

    for batch in batches:
        for _, _, offsets, raw in tx.slices(batch.column(0), SLICE_BYTES):
            starts, ends, _ = tx.spans(raw, offsets, tx.SPACE)
            short = ends - starts <= ENTRY_BYTES
            starts, ends = starts[short], ends[short]
            codes, first = tx.distinct_spans(raw, starts, ends)
            counts = np.bincount(codes, minlength=len(first)).tolist()
            for word, n in zip(tx.take_spans(raw, starts[first], ends[first]), counts):
                held[word] += n
            if len(held) > COUNTED:
                yield sent()
    if held:
        yield sent()


def frequent_segments(docs: DataFrame, limit: int = LEXICON_WORDS, text_col: str = "text") -> list[bytes]:
    """The most frequent white-space separated segments of all texts, ``limit`` at most, each of
    ``ENTRY_BYTES`` at most (longer ones are merged where they stand)."""
    counted = map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), _count_segments, "segment binary, n long")
    totals = materialize(counted.groupBy("segment").agg(F.sum("n").alias("n")), "segment-counts")
    # the least count class (sixteenths of a power of two) from which all words still fit
    level = F.floor(F.log2("n") * 16)
    sizes = totals.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    room, least = limit, None
    for row in sorted(sizes, key=lambda r: -r["level"]):
        room -= row["n"]
        if room < 0:
            break
        least = row["level"]
    if least is None:
        return []
    return sorted(bytes(r["segment"]) for r in totals.where(level >= least).select("segment").collect())


def build_lexicon(segments: list[bytes], tokenizer_path: str) -> dict[str, np.ndarray]:
    """Automaton and outputs for the words of ``segments``."""
    encoder = Encoder(tokenizer_path, None)
    words = sorted({w for s in segments for w in encoder.words(s.decode("utf-8", "replace")) if isinstance(w, bytes) and w})
    ids = encoder.encode_words(words)
    lexicon = compile_words(words)
    lexicon["ids"] = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    lexicon["bounds"] = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
    return lexicon


def pack_lexicon(lexicon: dict[str, np.ndarray]) -> bytes:
    """The arrays in one file: a line of JSON (name, type, length, offset), then their bytes."""
    fields, at = [], 0
    for name, array in lexicon.items():
        fields.append((name, array.dtype.str, len(array), at))
        at += array.nbytes + -array.nbytes % 8
    head = json.dumps(fields).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in lexicon.values())


def map_lexicon(path: str) -> dict[str, np.ndarray]:
    """The arrays of a packed lexicon, memory-mapped."""
    with open(path, "rb") as f:
        head = f.readline()
    fields = json.loads(head)
    return {name: np.asarray(np.memmap(path, kind, "r", len(head) + at, (n,))) if n else np.zeros(0, kind) for name, kind, n, at in fields}


def encode_decode(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Per document: its id, n_tokens, ids_sha256, decoded_sha256; with ``with_ids`` also ``ids``,
    with ``with_text`` also ``decoded``."""
    lexicon = build_lexicon(frequent_segments(docs, lexicon_words, text_col), tokenizer_path)
    packed = pack_lexicon(lexicon)
    name = share_file(docs.sparkSession, f"lexicon-{hashlib.sha256(packed).hexdigest()[:16]}", packed)

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids + [("decoded", pa.string())] * with_text
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, map_lexicon(SparkFiles.get(name)))  # goes with the task
        for batch in batches:
            for lo, hi, offsets, raw in tx.slices(batch.column(1), SLICE_BYTES):
                ids, decoded = encoder.encode_slice(raw, offsets)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array([len(i) // 4 for i in ids], pa.int64())]
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x in col], pa.string()) for col in (ids, decoded)]
                if with_ids:
                    bounds = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                if with_text:
                    columns.append(pa.array([d.decode("utf-8") for d in decoded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, out)


def op8_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode the whole ``documents`` table."""
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
