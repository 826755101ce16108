"""Near-duplicate components by banded MinHash, odd sketches and exact confirmation.

A document's set holds its distinct k-word shingles (its whole word sequence if it is shorter).
Documents with ``100 * |A & B| >= percent * |A | B|`` are linked; components of linked documents
share the smallest doc_id reachable.

1. Equal sets form a class, stood for by its smallest doc_id; all that follows works on classes.
2. Each class has MinHash samples.  Bands of ``ROWS`` samples put classes into buckets, and all
   samples folded into a parity bitmap give the odd sketch: the XOR of two sketches has few bits
   exactly if most samples agree, so its population count drops candidates far from the threshold.
3. A bucket of two is one candidate pair.  In a larger one every class is confirmed against the
   bucket's hub (the class that shares the most buckets), which is linear and joins most copies.
4. Where a hub's group still falls into several components, its leftover classes get a second hub
   of their own.  What then remains is searched exactly: with the shingles ordered 'outside the
   hub's set first, the rarest ahead', two sets at the threshold share an element among the first
   ``n - ceil(percent * n) + 1`` of both, and only sets that may have such a partner are compared.
5. Links are confirmed on full sets; components grow by alternating stars.

A pair at similarity 0.85 shares no band with probability (1 - 0.85**3)**20 < 1e-8; once it shares
one, nothing but confirmation on full sets decides.  No bucket is capped, and no group of copies
is expanded into pairs.

Edge cases: null and empty texts, and texts without words, have empty sets and stand alone; rows
with a null doc_id stand alone with a null component; repeated rows fall into one class; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm import text as tx
from tidewater.llm.workspace import lasting, map_arrow, materialize, passing

ROWS, BANDS = 3, 20
SKETCH_BITS = 256
#: Similarity estimated by the sketches below which a pair is dropped.  At 0.41 some 54 of the 256
#: bits differ, as from 27 differing samples of 60; at a true similarity of 0.8 the expected number
#: is 12 (27 or more with probability below 1e-5, and below 1e-8 at 0.85).
LEAST_ESTIMATE = 0.41
#: Pairs with one hub from which on they are dealt out, so many to a copy of the hub's set.
SALT_FROM = 1_000
#: Sets of one block, and elements multiplied at once, in the exact search.
BLOCK, STRIP = 512, 1024
#: Ids (8 bytes each) up to which a list is broadcast.
BROADCAST_IDS = 1_000_000
#: Text whose shingles a worker makes at once.
SLICE_BYTES = 1 << 20
MOST_ROUNDS = 60

_rng = np.random.default_rng(20_240_229)
_A = _rng.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
_K = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 3, 1 << 64) for i in range(64)], dtype=np.uint64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of each, hash of each) distinct shingle, ordered by text."""
    raw = tx.LOWER[raw]
    starts, ends, rows = tx.spans(raw, offsets, tx.SPACE)
    n_docs = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = tx.span_digest(raw, starts, ends)
    of, code = [], []
    if len(word) >= k:
        whole = np.flatnonzero(rows[k - 1 :] == rows[: len(rows) - k + 1])
        h = np.zeros(len(whole), np.uint64)
        for j in range(k):
            h += word[whole + j] * _K[j]
        of.append(rows[whole])
        code.append(tx.mix(h))
    bounds = tx.row_bounds(rows, n_docs)
    n_words = np.diff(bounds)
    for d in np.flatnonzero((n_words > 0) & (n_words < k)).tolist():
        h = np.uint64(n_words[d])
        for j, w in enumerate(word[bounds[d] : bounds[d + 1]]):
            h = np.bitwise_xor(h, np.multiply(w, _K[j + 32])) * np.uint64(0xA0761D6478BD642F)
        of.append(np.array([d]))
        code.append(tx.mix(np.array([h], np.uint64)))
    of, code = np.concatenate(of), np.concatenate(code)
    _, first = tx.distinct(tx.mix(code + of.astype(np.uint64) * _K[63]))
    of, code = of[first], code[first]
    order = np.argsort(of, kind="stable")
    return of[order], code[order]


_SIGNATURE = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>"


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, offsets, raw in tx.slices(batch.column(1), SLICE_BYTES):
                    n = hi - lo
                    of, code = shingle_sets(raw, offsets, k)
                    size = np.bincount(of, minlength=n)
                    full = np.flatnonzero(size)
                    head = np.searchsorted(of, full)
                    prints = np.zeros((2, n), np.uint64)
                    bands = np.zeros((len(full), BANDS), np.uint64)
                    words = np.zeros((n, SKETCH_BITS // 64), np.uint64)
                    if len(full):
                        for p in range(2):
                            prints[p, full] = np.add.reduceat(tx.mix(code * _K[50 + p]), head)
                        least = np.stack([np.minimum.reduceat(code * a + b, head) for a, b in zip(_A, _B)], axis=1)
                        sample = tx.mix(least + _K[np.arange(ROWS * BANDS) % 60] * np.arange(1, ROWS * BANDS + 1, dtype=np.uint64))
                        for r in range(ROWS):
                            bands = tx.mix(bands * _K[7] + sample[:, r::ROWS])
                        flips = np.zeros((len(full), SKETCH_BITS), np.int16)
                        np.add.at(flips, (np.repeat(np.arange(len(full)), ROWS * BANDS), (sample % np.uint64(SKETCH_BITS)).astype(np.int64).ravel()), 1)
                        words[full] = np.packbits((flips & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
                    held = np.zeros(n + 1, np.int32)
                    held[1:] = np.cumsum((size > 0) * BANDS)
                    wide = np.arange(0, n * words.shape[1] + 1, words.shape[1], dtype=np.int32)
                    columns = [batch.column(0).slice(lo, n), pa.array(size.astype(np.int64)), *(pa.array(p.view(np.int64)) for p in prints)]
                    columns += [pa.ListArray.from_arrays(pa.array(held), pa.array(bands.ravel().view(np.int64))), pa.ListArray.from_arrays(pa.array(wide), pa.array(words.ravel().view(np.int64)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, offsets, raw in tx.slices(batch.column(1), SLICE_BYTES):
                    of, code = shingle_sets(raw, offsets, k)
                    bounds = tx.row_bounds(of, hi - lo).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds), pa.array(code.view(np.int64)))], names=["cid", "members"])

    return run


def _xor_bits(a: str, b: str) -> Column:
    parts = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def estimate(a: str, b: str) -> Column:
    """The similarity that two odd sketches tell: of 2d elements in which the samples differ, an
    expected (1 - (1 - 2 / bits) ** 2d) / 2 of the bits are odd; solved for d / samples."""
    share = F.least(_xor_bits(a, b) * 2.0 / SKETCH_BITS, F.lit(1 - 1e-9))
    return 1 + F.log(1 - share) * (SKETCH_BITS / 2) / (2 * ROWS * BANDS)


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and odd sketches allow the similarity."""
    one = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    two = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    joined = pairs.join(one, "a").join(two, "b")
    sized = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    near = joined.where(sized & (estimate("ka", "kb") >= LEAST_ESTIMATE))
    return near.select("a", "b", F.lit(False).alias("star"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _confirm(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, star, linked) of distinct ``pairs(a, b, star)``, confirmed on full sets; for stars
    also what :func:`_rest` compares: ``n`` and ``take`` (the size of a's set and how many of its
    first elements count), ``outside`` and ``missing`` (what it has beyond b's set and lacks of it)
    and ``room`` (how many common elements ``take`` still reaches)."""
    involved = materialize(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), "involved")
    some = docs.join(_small(involved), docs["doc_id"] == involved["cid"], "left_semi").select("doc_id", "text")
    sets = materialize(map_arrow(some, _sets(k), "cid long, members array<long>"), "sets")
    one = sets.select(F.col("cid").alias("a"), F.col("members").alias("sa"))
    two = sets.select(F.col("cid").alias("b"), F.col("members").alias("sb"))
    # a hub of many pairs has copies of its set, each for a share of them
    heavy = _small(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SALT_FROM).cast("int").alias("salts")).where("salts > 1"))
    dealt = pairs.join(heavy, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = two.join(heavy, "b", "left").select("b", "sb", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    joined = dealt.join(one, "a").join(copies, ["b", "salt"]).drop("salt")
    joined = joined.withColumn("common", F.array_intersect("sa", "sb"))
    both, na, nb = F.size("common"), F.size("sa"), F.size("sb")
    linked = both * 100 >= (na + nb - both) * percent
    take = (na - F.ceil(na * percent / 100.0 - 1e-9) + 1).cast("int")
    room = F.greatest(take - (na - both), F.lit(0))
    own = lambda column: F.when(F.col("star"), column)
    return joined.select("a", "b", "star", linked.alias("linked"), own(na).alias("n"), own(take).alias("take"), own(F.array_except("sa", "sb")).alias("outside"), own(F.array_except("sb", "sa")).alias("missing"), own(room).alias("room"))


def _rest(held: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components ``ca`` within a hub's group.

    Elements are ordered: those outside the hub's set first, the rarest in the group ahead, then
    those inside.  Two linked sets share one of their first ``take`` elements.  If they share none
    outside the hub's set, the smaller one has at least 2 * percent / (100 + percent) of its
    elements inside (it is 'inner').  Sets that can have no partner by this leave.  The others are
    compared in blocks, by what they have beyond the hub's set and lack of it: a few elements each,
    whose products give all intersections of a block pair at once.  No pair but a link is made.
    """
    beyond = held.select("hub", "a", "ca", "take", F.explode("outside").alias("e"))
    counts = beyond.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("df"), F.min("ca").alias("lo"), F.max("ca").alias("hi"))
    rarest = Window.partitionBy("hub", "a").orderBy("df", "e")
    ranked = beyond.join(counts, ["hub", "e"]).withColumn("at", F.row_number().over(rarest))
    outer = ranked.where("at <= take AND lo <> hi").select("hub", "a")
    reaching = held.where("room > 0")
    inner = materialize(reaching.where((F.col("n") - F.size("outside")) * (100 + percent) >= 2 * percent * F.col("n")).select("hub").distinct(), "inner-hubs")
    open_ = outer.union(reaching.join(_small(inner), "hub").select("hub", "a")).distinct()
    members = materialize(held.join(open_, ["hub", "a"]).select("hub", "a", "ca", "n", F.size("outside").alias("x"), F.size("missing").alias("m"), F.concat("outside", "missing").alias("delta")), "open-members")
    groups = members.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("ca").alias("lo"), F.max("ca").alias("hi")).where("lo <> hi").select("hub", "blocks")
    groups = materialize(groups, "open-groups")
    dealt = members.join(_small(groups), "hub").withColumn("own", F.pmod(F.xxhash64("a"), "blocks").cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = spread.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "a", "ca", "n", "x", "m", "delta")
    return paired.groupBy("hub", "i", "j").applyInArrow(_block_links(percent), "a long, b long").distinct()


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        a, ca, n, x, m = (table.column(k).to_numpy() for k in range(3, 8))
        delta = table.column(8).combine_chunks()
        bounds = delta.offsets.to_numpy() - delta.offsets[0].as_py()
        code, _ = tx.distinct(delta.flatten().to_numpy())
        row = np.repeat(np.arange(len(a)), np.diff(bounds))
        often = np.bincount(code) > 1  # an element of one set adds nothing to an intersection
        column = np.cumsum(often) - 1
        keep = often[code]
        row, code = row[keep], column[code[keep]]
        shared = np.zeros((len(a), len(a)), np.float32)
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        for lo in range(0, int(often.sum()), STRIP):
            s, e = np.searchsorted(code, [lo, lo + STRIP])
            strip = np.zeros((len(a), STRIP), np.float32)
            strip[row[s:e], code[s:e] - lo] = 1
            shared += strip @ strip.T
        hub = int(n[0] - x[0] + m[0])
        both = hub - m[:, None] - m[None, :] + shared.astype(np.int64)
        linked = (both * 100 >= (n[:, None] + n[None, :] - both) * percent) & (ca[:, None] != ca[None, :])
        one, two = np.nonzero(np.triu(linked))
        first: dict = {}
        for p, q in zip(one.tolist(), two.tolist()):  # a link for each pair of components suffices
            first.setdefault((min(ca[p], ca[q]), max(ca[p], ca[q])), (a[p], a[q]))
        links = list(first.values())
        return pa.table({"a": pa.array([p for p, _ in links], pa.int64()), "b": pa.array([q for _, q in links], pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """(cid, component) for the ends of ``links(a, b)``, by alternating large and small stars."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        edges = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m").toDF("u", "v")).where("u <> v").distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("cid"), "component")
        before = state
    raise RuntimeError("components did not settle")


def _labelled(df: DataFrame, labels: DataFrame, col: str, out: str) -> DataFrame:
    own = labels.select(F.col("cid").alias(col), F.col("component").alias(out))
    return df.join(own, col, "left").withColumn(out, F.coalesce(out, col))


def find_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    with passing(docs.sparkSession):  # the tables of the way there go with it
        found = _find(docs, k, percent, id_col, text_col)
        with lasting():
            return materialize(found, "duplicates")


def _find(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(map_arrow(docs, _signatures(k), _SIGNATURE), "signatures")
    own = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    grouped = own.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("x"))
    classes = materialize(grouped.select(F.col("x.doc_id").alias("cid"), F.col("n_shingles").alias("n"), "f1", "f2", F.col("x.bands").alias("bands"), F.col("x.sketch").alias("sketch")), "classes")

    # buckets
    rows = classes.select("cid", F.explode("bands").alias("key"))
    sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("a"), F.max("cid").alias("b")).where("size > 1"), "buckets")
    twos = _near(sizes.where("size = 2").select("a", "b").distinct(), classes, percent).drop("star")
    members = materialize(rows.join(_small(sizes.where("size > 2").select("key", "size")), "key"), "members")
    weight = members.groupBy("cid").agg(F.sum("size").alias("weight"))
    weighed = members.join(weight, "cid")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("cid")).alias("c"))).alias("x")).select("key", (-F.col("x.c")).alias("b"))
    stars = materialize(members.join(hubs, "key").where("cid <> b").select(F.col("cid").alias("a"), "b").distinct(), "stars")

    # confirmation against hubs, and of lone pairs
    lone = twos.join(stars, ["a", "b"], "left_anti").withColumn("star", F.lit(False))
    pairs = materialize(stars.withColumn("star", F.lit(True)).unionByName(lone), "pairs")
    confirmed = materialize(_confirm(docs, pairs, k, percent), "confirmed")
    starred = confirmed.where("star")
    links = confirmed.where("linked").select("a", "b")
    labels = materialize(components(links), "components")

    # a second hub for what a hub's group has left
    held = materialize(_labelled(_labelled(starred.select("a", "b"), labels, "a", "ca"), labels, "b", "cb"), "held")
    left = held.where("ca <> cb").select("a", "b").join(weight.withColumnRenamed("cid", "a"), "a")
    second = left.groupBy("b").agg(F.max(F.struct("weight", (-F.col("a")).alias("c"))).alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1").select("b", (-F.col("x.c")).alias("hub"))
    second = materialize(second, "second-hubs")
    more = left.join(_small(second), "b").where("a <> hub").select("a", F.col("hub").alias("b")).distinct()
    more = materialize(_near(more, classes, percent), "second-stars")
    if not more.isEmpty():
        links = materialize(links.union(_confirm(docs, more, k, percent).where("linked").select("a", "b")), "links")
        labels = materialize(components(links), "components")

    # the exact rest
    held = materialize(_labelled(_labelled(starred.drop("star", "linked"), labels, "a", "ca"), labels, "b", "cb"), "held")
    split = held.groupBy("b").agg(F.min(F.least("ca", "cb")).alias("lo"), F.max(F.greatest("ca", "cb")).alias("hi")).where("lo <> hi").select("b")
    split = materialize(split, "split-hubs")
    rest = materialize(_rest(held.join(_small(split), "b").withColumnRenamed("b", "hub"), percent), "rest")
    if not rest.isEmpty():
        labels = materialize(components(links.union(rest)), "components")

    placed = _labelled(classes.select("cid", "f1", "f2", F.col("n").alias("n_shingles")), labels, "cid", "component_id")
    found = signed.select("doc_id", "n_shingles", "f1", "f2").join(placed.drop("cid"), ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but the first document of each component; all columns stay.  Rows
    that repeat a doc_id are one document and stay or go together."""
    gone = find_duplicates(docs, k, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_gone"))
    gone = materialize(gone.distinct(), "dropped")
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")


def op4_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the whole ``documents`` table: three-word shingles, similarity 0.85."""
    return find_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT doc_id, w0, lead(w0, 1) OVER x AS w1, lead(w0, 2) OVER x AS w2
  FROM (SELECT doc_id, unnest(w) AS w0, generate_subscripts(w, 1) AS i FROM d) WINDOW x AS (PARTITION BY doc_id ORDER BY i)
), s AS (
  SELECT doc_id, w0 || ' ' || w1 || ' ' || w2 AS e FROM g WHERE w2 IS NOT NULL
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.e = y.e AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, other) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.least, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
