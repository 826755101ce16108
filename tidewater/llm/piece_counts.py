"""Token counts: greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a pair of tries (first pieces, continuing pieces).  Every node has a failure
link, the node reached once the longest pieces are taken off its string, and the count of those
pieces.  A word is then read once, byte by byte; pieces are counted and never built.

A word is a run of bytes outside white space, ASCII letters lowered.  A word that greedy matching
cannot finish counts as one unknown piece, as in the usual word-piece models.

Edge cases: a null or empty text has no words; a word of any length is read whole; repeated rows
and null doc_ids stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import text as tx
from tidewater.llm.lexicon_bpe import Model, byte_alphabet
from tidewater.llm.workspace import map_arrow

#: Words longer than this are read one at a time instead of in lock step.
LONG_WORD = 200


def build_automaton(first: set[bytes], continuing: set[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the automaton; node 0 is the root of first pieces, 1 that of continuing ones.

    keys, target   edges, sorted by node << 8 | byte
    fail           failure link, -1 where matching fails for good
    popped         pieces taken when the link is followed
    """
    children: list[dict[int, int]] = [{}, {}]
    ends = [False, False]
    for root, pieces in ((0, first), (1, continuing)):
        for piece in sorted(pieces):
            node = root
            for byte in piece:
                nxt = children[node].get(byte)
                if nxt is None:
                    children.append({})
                    ends.append(False)
                    nxt = children[node][byte] = len(children) - 1
                node = nxt
            ends[node] = bool(piece)
    fail, popped = [-1] * len(children), [0] * len(children)
    queue = [0, 1]
    for node in queue:
        for byte, child in children[node].items():
            queue.append(child)
            if ends[child]:
                fail[child], popped[child] = 1, 1
                continue
            z, count = fail[node], popped[node]
            while z != -1 and byte not in children[z]:
                count += popped[z]
                z = fail[z]
            if z != -1:
                fail[child], popped[child] = children[z][byte], count
    edges = sorted((node << 8 | byte, child) for node, kids in enumerate(children) for byte, child in kids.items())
    return {"keys": np.array([k for k, _ in edges], np.int64), "target": np.array([c for _, c in edges], np.int64), "fail": np.array(fail, np.int64), "popped": np.array(popped, np.int64)}


def piece_count(auto: dict[str, np.ndarray], raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Pieces of each span, or -1 where greedy matching fails."""
    keys, target, fail, popped = (auto[k] for k in ("keys", "target", "fail", "popped"))
    out = np.zeros(len(starts), np.int64)
    if not len(keys):
        return np.where(ends > starts, -1, 0)
    live = np.flatnonzero(ends > starts)
    for i in live[ends[live] - starts[live] > LONG_WORD].tolist():
        out[i] = _one(auto, raw[starts[i] : ends[i]].tobytes())
    live = live[ends[live] - starts[live] <= LONG_WORD]
    node, at, stop, count = np.zeros(len(live), np.int64), starts[live], ends[live], np.zeros(len(live), np.int64)
    while len(live):
        reading = at < stop
        key = np.where(reading, node << 8 | raw[np.minimum(at, len(raw) - 1)], -1)
        edge = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = reading & (keys[edge] == key)
        over = ~reading & (node == 1)
        link = fail[node]
        dead = ~hit & ~over & (link == -1)
        out[live[over]] = count[over]
        out[live[dead]] = -1
        count = np.where(hit, count, count + popped[node])
        node = np.where(hit, target[edge], link)
        at = at + hit
        keep = ~(over | dead)
        live, node, at, stop, count = live[keep], node[keep], at[keep], stop[keep], count[keep]
    return out


def _one(auto: dict[str, np.ndarray], word: bytes) -> int:
    edges = auto.setdefault("_edges", dict(zip(auto["keys"].tolist(), auto["target"].tolist())))
    fail, popped = auto.setdefault("_fail", auto["fail"].tolist()), auto.setdefault("_popped", auto["popped"].tolist())
    node = count = 0
    for byte in word:
        while (nxt := edges.get(node << 8 | byte)) is None:
            if fail[node] == -1:
                return -1
            count += popped[node]
            node = fail[node]
        node = nxt
    while node != 1:
        if fail[node] == -1:
            return -1
        count += popped[node]
        node = fail[node]
    return count


def pieces_of(tokenizer_path: str) -> set[bytes]:
    """Vocabulary strings of a byte-level BPE file as bytes, without end marks and specials."""
    model = Model(tokenizer_path)
    letters = {c: b for b, c in enumerate(byte_alphabet())}
    special = set(model.special.values())
    return {bytes(map(letters.__getitem__, t.removesuffix(model.suffix))) for i, t in model.tokens.items() if i not in special}


def count_pieces(docs: DataFrame, first: set[bytes], continuing: set[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_pieces, n_unknown (words that no pieces spell)."""
    auto = docs.sparkSession.sparkContext.broadcast(build_automaton(first, continuing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dict(auto.value)
        for batch in batches:
            for lo, hi, offsets, raw in tx.slices(batch.column(1)):
                raw = tx.LOWER[raw]
                starts, ends, rows = tx.spans(raw, offsets, tx.SPACE)
                codes, one = tx.distinct_spans(raw, starts, ends)
                each = piece_count(table, raw, starts[one], ends[one])
                n = hi - lo
                words = np.bincount(rows, minlength=n)
                unknown = np.bincount(rows, weights=(each < 0)[codes], minlength=n)
                pieces = np.bincount(rows, weights=np.maximum(each, 1)[codes] if len(codes) else None, minlength=n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), *(pa.array(x.astype(np.int64)) for x in (words, pieces, unknown))], names=["doc_id", "n_words", "n_pieces", "n_unknown"])

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    return map_arrow(docs.select(*columns), run, "doc_id long, n_words long, n_pieces long, n_unknown long")


def op3_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece lengths of the whole ``documents`` table, for the pieces of a public vocabulary
    used both at the start of a word and inside it."""
    import public_tokenizers

    pieces = pieces_of(public_tokenizers.path("word_bpe_49k.json"))
    return count_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), pieces, pieces)
