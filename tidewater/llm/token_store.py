"""Token-ID output: a content-addressed store of token streams.

Every text is encoded by the tokenizers library and closed with an end id.  A rolling hash over
the last ids cuts each stream into chunks, so equal passages give equal chunks wherever they
stand.  A chunk is stored once, under the digest of its ids; a document is a recipe (the digests
in order) with the root of a Merkle tree over them.

Layout under ``path``::

    chunks/    digest BINARY(16), n INT, width INT, payload BINARY        each digest once
    recipes/   part=i/: doc_id, start, n_tokens, root, digests            ascending doc_id, part after part
    manifest/  level, node, n_docs, n_tokens, root                        Merkle tree over the parts

A part holds about ``PART_DOCS`` documents, however many there are.  Level 0 of the manifest has
the root over the documents of each part, a level above the roots of ``FAN`` nodes of the one below,
up to a single node.  Reading recomputes all of them.

Edge cases: a null text counts as empty; an empty text is one chunk with only the end id.
Repeated doc_ids stay separate rows (``start`` tells them apart), a null doc_id sorts first, an
empty table gives an empty store, and other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import text as tx
from tidewater.llm.lexicon_bpe import byte_alphabet
from tidewater.llm.workspace import delete_path, map_arrow, materialize, new_path

DIGEST = 16
#: Rows of the duplicates table up to which it is broadcast (12 bytes of key each).
BROADCAST_ROWS = 1_000_000
#: Documents of a part, and nodes below one of the manifest.
PART_DOCS, FAN = 65_536, 4_096
#: Text encoded at once: the more, the fewer distinct words are looked up again.
SLICE_BYTES = 4 << 20

_GRAPHIC = tx.byte_class(range(0x21, 0x7F))
_ALNUM = tx.byte_class(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B))
_STOP = tx.byte_class(*b",.;:!?")


def cut_points(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of segments that a byte-level BPE with the usual word pattern encodes alike alone
    and in context.

    The pattern starts a token wherever white space follows something else, and a lone space or
    newline never joins what stands before it.  So a cut is safe before a space or newline after
    an ASCII graphic character, before a space between any byte and a graphic one (a wide space
    before it stays with what precedes), and after a single newline between graphic characters.
    A word of letters or digits also ends before common punctuation.
    """
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    n = len(raw)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True
    graphic = _GRAPHIC[raw]
    before = np.zeros(n, dtype=bool)
    before[1:] = graphic[:-1]
    high_before = np.zeros(n, dtype=bool)
    high_before[1:] = raw[:-1] >= 0x80
    after = np.zeros(n, dtype=bool)
    after[:-1] = graphic[1:]
    after &= ~first[1:]
    newline = (raw == 0x0A) & before
    cut = ((raw == 0x20) & (before | (high_before & after))) | newline
    # a newline that begins its text has no neighbour before it: ``before`` looks across texts
    lone = newline & after & ~first[:-1]
    cut[1:] |= lone[:-1] | (_STOP[raw[1:]] & _ALNUM[raw[:-1]])
    cut |= first[:-1]
    return np.flatnonzero(cut)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over ``leaves`` in order; an odd node moves up unchanged."""
    level = leaves or [b""]
    while len(level) > 1:
        paired = [hashlib.blake2b(level[i] + level[i + 1], digest_size=DIGEST).digest() for i in range(0, len(level) - 1, 2)]
        level = paired + level[len(level) - 1 :] * (len(level) % 2)
    return level[0]


def chunk_bounds(ids: np.ndarray, doc_bounds: np.ndarray, mask_bits: int, least: int, most: int, window: int = 8) -> list[list[int]]:
    """Per document, the ends of its chunks (positions in ``ids``)."""
    g = tx.mix(ids.astype(np.uint64) + np.uint64(1))
    rolling = np.zeros(len(ids), dtype=np.uint64)
    for j in range(window):
        rolling[j:] += g[: len(ids) - j] * np.uint64(pow(tx.BASE, j, 1 << 64))
    marks = np.flatnonzero((tx.mix(rolling) >> np.uint64(64 - mask_bits)) == 0) + 1
    out = []
    lows = np.searchsorted(marks, doc_bounds[:-1] + window)
    highs = np.searchsorted(marks, doc_bounds[1:])
    for d in range(len(doc_bounds) - 1):
        at, end, ends = int(doc_bounds[d]), int(doc_bounds[d + 1]), []
        for m in marks[lows[d] : highs[d]].tolist():
            while m - at > most:
                at += most
                ends.append(at)
            if m - at >= least and m < end:
                ends.append(m)
                at = m
        while end - at > most:
            at += most
            ends.append(at)
        ends.append(end)
        out.append(ends)
    return out


_RECIPES = "doc_id long, start long, n_tokens long, root binary, digests binary, part int"
_MANIFEST = "level int, node int, n_docs long, n_tokens long, root binary"
_STAGED = "kind int, pack int, row int, digest binary, n int, width int, payload binary, doc_id long, n_tokens long, root binary, digests binary"
_STAGED_ARROW = pa.schema([("kind", pa.int32()), ("pack", pa.int32()), ("row", pa.int32()), ("digest", pa.binary()), ("n", pa.int32()), ("width", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("digests", pa.binary())])

class Encoder:
    """The library's tokenizer.  A segment that its pattern would take as one word goes straight
    to its model; any other goes through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = dict(enumerate(byte_alphabet()))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each segment as little-endian 32-bit integers."""
        out: list = [None] * len(words)
        rest, tokenize, space = [], self.model.tokenize, self.letters[0x20]
        for i, w in enumerate(words):
            body = w[1:] if w[:1] == b" " else w
            if body.isalpha():  # ASCII letters stand for themselves in the alphabet
                word = body.decode("ascii")
            elif _ONE_WORD.fullmatch(body.decode("utf-8", "replace")):
                word = body.decode("latin-1").translate(self.letters)
            else:
                rest.append(i)
                continue
            out[i] = array("I", [t.id for t in tokenize(word if body is w else space + word)]).tobytes()
        for i, e in zip(rest, self.whole.encode_batch_fast([words[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out


_ONE_WORD = regex.compile(r"\p{L}+")
_loaded: dict = {}


def _tokenizer(path: str) -> tuple[Encoder, tx.WordCache]:
    """The encoder and this worker's word cache, made once in a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = (Encoder(path), tx.WordCache(80 << 20))
    return _loaded[path]


def encode_slice(raw: np.ndarray, offsets: np.ndarray, tokenizer: Encoder, cache: tx.WordCache, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, bounds of each text's ids), the end id included."""
    n = len(offsets) - 1
    starts = cut_points(raw, offsets)
    ends = np.append(starts[1:], len(raw))
    codes, first = tx.distinct_spans(raw, starts, ends)

    values = cache.lookup(tx.take_spans(raw, starts[first], ends[first]), tokenizer.encode_words) if len(first) else []
    per_doc = np.searchsorted(starts, offsets[1:])
    if end_id is not None:
        codes = np.insert(codes, per_doc, len(values))
        per_doc = per_doc + np.arange(1, n + 1)
        values = [*values, end_id.to_bytes(4, "little")]
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
    flat = np.frombuffer(b"".join(values), "<u4")
    base = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(lengths) else lengths
    each = lengths[codes]
    upto = np.concatenate([[0], np.cumsum(each)])
    ids = flat[np.repeat(base[codes] - upto[:-1], each) + np.arange(upto[-1])]
    return ids, np.concatenate([[0], upto[per_doc]])


def _stage(tokenizer_path: str, end_id: int, mask_bits: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, cache = _tokenizer(tokenizer_path)
        pack, seen = TaskContext.get().partitionId(), set()
        for batch in batches:
            doc_ids = batch.column(0)
            for lo, hi, offsets, raw in tx.slices(batch.column(1), SLICE_BYTES):
                ids, bounds = encode_slice(raw, offsets, tokenizer, cache, end_id)
                cols: dict[str, list] = {f.name: [] for f in _STAGED_ARROW}

                def add(cols=cols, **row):
                    for k, v in cols.items():
                        v.append(row.get(k))

                for d, ends in enumerate(chunk_bounds(ids, bounds, mask_bits, least, most)):
                    at, digests = int(bounds[d]), []
                    for e in ends:
                        part = ids[at:e]
                        digest = hashlib.blake2b(part.tobytes(), digest_size=DIGEST).digest()
                        digests.append(digest)
                        if digest not in seen:
                            width = 2 if int(part.max()) < 1 << 16 else 4
                            add(kind=0, pack=pack, row=len(seen), digest=digest, n=e - at, width=width, payload=part.astype(f"<u{width}").tobytes())
                            seen.add(digest)
                        at = e
                    add(kind=1, doc_id=doc_ids[lo + d].as_py(), n_tokens=int(bounds[d + 1] - bounds[d]), root=merkle_root(digests), digests=b"".join(digests))
                yield pa.RecordBatch.from_pydict(cols, schema=_STAGED_ARROW)

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range of documents in order, with the range's number and the tokens before each."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        upto = np.concatenate([[0], np.cumsum(batch.column(1).to_numpy())])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), part, np.int32)), pa.array(upto[:-1] + total), *batch.columns[:4]], names=["part", "within", *batch.schema.names[:4]])
        total += int(upto[-1])


def _ordered(recipes: DataFrame) -> DataFrame:
    """``recipes(doc_id, n_tokens, root, digests, tie)`` with ``part``, ascending ranges of
    (doc_id, root, tie), and ``start``.  ``tie`` tells equal rows apart, so none is a range of its own."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("root").asc(), F.col("tie").asc()]
    ranged = recipes.repartitionByRange(recipes.count() // PART_DOCS + 1, *order).sortWithinPartitions(*order)
    numbered = materialize(map_arrow(ranged, _number, "part int, within long, doc_id long, n_tokens long, root binary, digests binary"), "numbered")
    ahead, total = [], 0
    for row in numbered.groupBy("part").agg(F.sum("n_tokens").alias("s")).orderBy("part").collect():  # a row for each part
        ahead.append((row["part"], total))
        total += row["s"]
    offsets = recipes.sparkSession.createDataFrame(ahead, "part int, ahead long")
    placed = numbered.join(F.broadcast(offsets), "part")
    return placed.select("part", "doc_id", (F.col("ahead") + F.col("within")).alias("start"), "n_tokens", "root", "digests")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [merkle_root([x["root"] for x in below]) for below in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(roots, pa.binary())], names=["node", "n_docs", "n_tokens", "root"])


def _level(rows: DataFrame) -> DataFrame:
    """(node, n_docs, n_tokens, root) over ``rows(node, at, docs, tokens, root)`` in the order of ``at``."""
    below = F.array_sort(F.collect_list(F.struct("at", "root")))
    gathered = rows.groupBy("node").agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"), below.alias("below"))
    return map_arrow(gathered, _roots, "node int, n_docs long, n_tokens long, root binary")


def manifest_of(recipes: DataFrame) -> DataFrame:
    """(level, node, n_docs, n_tokens, root): the Merkle tree over ``recipes(part, start, n_tokens, root)``."""
    level = materialize(_level(recipes.select(F.col("part").alias("node"), F.col("start").alias("at"), F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"), "root")), "manifest")
    out, number = level.select(F.lit(0).alias("level"), "*"), 0
    while level.count() > 1:
        number += 1
        above = level.select((F.col("node") / FAN).cast("int").alias("node"), F.col("node").cast("long").alias("at"), F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens"), "root")
        level = materialize(_level(above), "manifest")
        out = out.unionByName(level.select(F.lit(number).alias("level"), "*"))
    return out


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, mask_bits: int = 9, least: int = 64, most: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the store described above to ``path``."""
    spark = docs.sparkSession
    staging = new_path(spark, "packs")
    rows = map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), _stage(tokenizer_path, end_id, mask_bits, least, most), _STAGED)
    rows.write.option("compression", "zstd").parquet(staging)
    packs = spark.read.schema(rows.schema).parquet(staging)

    places = packs.where("kind = 0").select("digest", "pack", "row")
    owners = places.groupBy("digest").agg(F.min(F.struct("pack", "row")).alias("owner"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    losers = materialize(places.join(owners, "digest").where("struct(pack, row) > owner").select("pack", "row"), "duplicate-chunks")
    kept = packs.where("kind = 0").select("pack", "row", "digest", "n", "width", "payload")
    small = losers.count() <= BROADCAST_ROWS
    kept.join(F.broadcast(losers) if small else losers, ["pack", "row"], "left_anti").drop("pack", "row").write.option("compression", "zstd").parquet(f"{path}/chunks")

    recipes = materialize(packs.where("kind = 1").select("doc_id", "n_tokens", "root", "digests", F.monotonically_increasing_id().alias("tie")), "recipes")
    _ordered(recipes).sortWithinPartitions("part", "start").write.partitionBy("part").parquet(f"{path}/recipes")
    manifest_of(spark.read.schema(_RECIPES).parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    delete_path(spark, staging)


def _crc_operators(bits: int = 40) -> np.ndarray:
    """Row k: images of the 32 unit vectors under 'append 2**k zero bytes' to a CRC-32."""
    one_bit = np.array([0xEDB88320] + [1 << (b - 1) for b in range(1, 32)], dtype=np.uint32)

    def apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for b in range(32):
            out ^= np.where((v >> np.uint32(b)) & np.uint32(1), m[b], np.uint32(0)).astype(np.uint32)
        return out

    op = one_bit
    for _ in range(3):
        op = apply(op, op)
    table = [op]
    for _ in range(bits - 1):
        op = apply(op, op)
        table.append(op)
    return np.array(table)


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 parts moved ahead of ``n_bytes`` more bytes; XOR of moved parts is the whole's."""
    out = crc.astype(np.uint32).copy()
    for k, op in enumerate(_CRC):
        at = np.flatnonzero((n_bytes >> k) & 1)
        if not len(at):
            continue
        v, moved = out[at], np.zeros(len(at), dtype=np.uint32)
        for b in range(32):
            moved ^= ((v >> np.uint32(b)) & np.uint32(1)) * op[b]
        out[at] = moved
    return out


_CRC = _crc_operators()


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and CRC of each chunk as its bytes on disk say, beside the digest it is stored under."""
    for batch in batches:
        found, crcs, ok = [], [], []
        for digest, n, width, payload in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            ids = np.frombuffer(payload.as_buffer(), dtype=f"<u{width}").astype("<u4").tobytes()
            found.append(digest.as_py())
            crcs.append(zlib.crc32(ids))
            ok.append(hashlib.blake2b(ids, digest_size=DIGEST).digest() == found[-1] and len(ids) == 4 * n)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(crcs, pa.int64()), batch.column(1), pa.array(ok, pa.bool_())], names=["digest", "crc", "n", "ok"])


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = batch.column(4)
        if not len(parts):
            continue
        bounds = parts.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        flat = parts.flatten()
        seq, crc, n, ok = (flat.field(k) for k in range(4))
        seq = seq.to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(parts)), np.diff(bounds))
        order = np.lexsort((seq, doc))
        size = n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[order]
        good = ok.fill_null(False).to_numpy(zero_copy_only=False)[order]
        crc = crc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32)[order]
        upto = np.concatenate([[0], np.cumsum(size)])
        after = upto[bounds[1:]][doc] - upto[1:]
        moved = crc_shift(crc, 4 * after)
        digests = batch.column(3)
        out_crc, verified = [], []
        n_tokens, roots, sound = batch.column(2).to_numpy(), batch.column(5), batch.column(6).to_pylist()
        xors = np.bitwise_xor.reduceat(moved, bounds[:-1]) if len(moved) else moved
        for d in range(len(parts)):
            leaves = digests[d].as_py()
            tree = merkle_root([leaves[i : i + DIGEST] for i in range(0, len(leaves), DIGEST)])
            whole = bool(good[bounds[d] : bounds[d + 1]].all()) and int(upto[bounds[d + 1]] - upto[bounds[d]]) == int(n_tokens[d])
            verified.append(whole and sound[d] and tree == roots[d].as_py())
            out_crc.append(int(xors[d]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out_crc, pa.int64()), pa.array(np.diff(bounds), pa.int32()), pa.array(verified, pa.bool_())], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "verified"])


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document as read back from the files: doc_id, start, n_tokens, ids_crc32, n_chunks,
    verified (every chunk matches its digest, the lengths add up, the document's Merkle root agrees,
    and so do its part and the whole of the manifest).

    Each chunk is read and hashed once, where it lies; only its digest, CRC and length travel.
    The CRC of a document follows from those of its chunks, since CRC-32 is linear.
    """
    stored = spark.read.parquet(f"{path}/chunks").select("digest", "n", "width", "payload")
    checked = map_arrow(stored, _read_chunks, "digest binary, crc long, n int, ok boolean")
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    written, found = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest"), materialize(manifest_of(recipes), "manifest-read")
    odd = materialize(written.exceptAll(found).unionByName(found.exceptAll(written)), "manifest-odd")
    steps = recipes.select("start", F.posexplode(F.expr(f"transform(sequence(1, length(digests), {DIGEST}), i -> substring(digests, i, {DIGEST}))")).alias("seq", "digest"))
    parts = steps.join(checked, "digest", "left").groupBy("start").agg(F.collect_list(F.struct("seq", "crc", "n", "ok")).alias("parts"))
    bad_parts = odd.where("level = 0").select(F.col("node").alias("part"), F.lit(True).alias("odd")).distinct()
    whole = recipes.select("part", "doc_id", "start", "n_tokens", "digests", "root").join(parts, "start").join(F.broadcast(bad_parts), "part", "left")  # a row for each part at most
    whole = whole.select("doc_id", "start", "n_tokens", "digests", "parts", "root", F.col("odd").isNull().alias("sound"))
    return map_arrow(whole, _join_parts, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks int, verified boolean")


def _concatenate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for parts in batch.column(1).to_pylist():
            ids = [np.frombuffer(p["payload"], dtype=f"<u{p['width']}").astype(np.int64) for p in sorted(parts, key=lambda p: p["seq"])]
            out.append(np.concatenate(ids).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "ids"])


def read_ids(spark: SparkSession, path: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, ids) rebuilt from the store, of all documents or of those in ``doc_ids``."""
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    if doc_ids is not None:
        recipes = recipes.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    steps = recipes.select("doc_id", "start", F.posexplode(F.expr(f"transform(sequence(1, length(digests), {DIGEST}), i -> substring(digests, i, {DIGEST}))")).alias("seq", "digest"))
    stored = spark.read.parquet(f"{path}/chunks").select("digest", "width", "payload")
    parts = steps.join(stored, "digest").groupBy("start", "doc_id").agg(F.collect_list(F.struct("seq", "width", "payload")).alias("parts"))
    return map_arrow(parts.select("doc_id", "parts"), _concatenate, "doc_id long, ids array<long>")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store the whole ``documents`` table and report each document as read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "token-store")
    write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digest(spark, path)
