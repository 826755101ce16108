"""A corpus, from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs.  All stages but the last keep the columns of ``documents``.

Edge cases: a null or empty text fails the quality rules; a null source is a source of its own; a
row with a null doc_id is no one's duplicate; rows that share a doc_id stay or go together in the
near-dedup; texts of any length are read whole; empty tables pass through; other columns stay as
they are until the last stage, which returns doc_id, n_tokens, the two digests and the ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import fm_decontaminate, lexicon_bpe, odd_sketch_dedup, rule_cascade, site_lines
from tidewater.llm.workspace import materialize

#: Share of a source's pages above which a line is boilerplate.  A host repeats a template on most
#: pages; a source mixes many hosts and templates, each on a small part of its pages, while running
#: text hardly says the same whole line on one page in twenty.
SOURCE_RATIO = 0.05
#: A line of a small source goes only if its share exceeds the ratio with this many deviations.
SOURCE_Z = 1.96


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet all quality rules."""
    return rule_cascade.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; a text left blank goes.  Copies count as
    one page: they are the next stage's, which keeps one of them."""
    cleaned = site_lines.drop_boilerplate(docs, F.col("source"), ratio=SOURCE_RATIO, z=SOURCE_Z, distinct_pages=True)
    return cleaned.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: five-word shingles, similarity 0.8."""
    return odd_sketch_dedup.keep_one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that benchmark items cover; a text left without words goes."""
    return fm_decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of ids and decoded text."""
    return lexicon_bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Components of near-duplicates and merges of a tokenizer are beyond SQL; tests/llm/test_pipeline.py
#: holds the rows of :func:`run` against a brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
