"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition that a good document meets.  On a bounded sample every rule is timed and
its rejections counted; the cascade then asks rules by rejections per second, each only of the
documents that all earlier ones passed.  The order changes the cost and never the verdict, which
is the conjunction of all rules.

Words are runs of characters outside white space (``[^\\x20\\x09-\\x0D]+``).

Edge cases: a null or empty text has no words and is rejected; texts are judged whole; repeated
rows and null ids stay and are judged alike; an empty table gives an empty result, in the order
the rules are listed; other columns pass through :func:`keep_good` untouched, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.workspace import materialize

#: Text of the sample on which costs and selectivities are estimated (expected bytes; rows are
#: drawn where they lie), and the partitions that it is timed on.
SAMPLE_BYTES, SAMPLE_PARTS = 12 << 20, 2

LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20
MOST_SYMBOL_PERCENT = 20
MOST_DUP_LINE_PERCENT = 50
WORD_LENGTH = (2, 20)
#: Of 100 words, so many hold a letter at least; so many are longer than LONG_WORD at most.
LEAST_LETTER_PERCENT, MOST_LONG_PERCENT, LONG_WORD = 50, 10, 40
WINDOW = 5

_SPACES = r"[\x20\x09-\x0D]+"
_SYMBOL_ELSE = r"[^#*$%&|<>]+"
_LETTER = r"\p{L}"
_PLACEHOLDER = r"[Ll]orem[\x20\x09-\x0D]+[Ii]psum"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACES), "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), _SYMBOL_ELSE, "")).cast("long")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(words: Column) -> Column:
    """A hash of each window of five words, in order; empty with fewer words."""
    codes = F.transform(words, lambda w: F.xxhash64(w))
    # ``codes`` must be evaluated once, so the array travels as the value of a one-element array
    made = F.transform(F.array(codes), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - WINDOW), lambda i: F.xxhash64(*[F.get(c, i + k) for k in range(WINDOW)])))
    return F.when(F.size(words) >= WINDOW, made[0]).otherwise(F.array().cast("array<bigint>"))


def repeat_words(hashes: Column) -> Column:
    """Words in windows found twice or more, from the hashes of all windows."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]))
        return F.array_sort(F.filter(same, lambda i: i.isNotNull()))

    starts = F.transform(F.array(placed), repeated)[0]
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(starts, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered["n"])


def once(made: Column, use: Callable[[Column], Column]) -> Column:
    """``use(made)`` with ``made`` evaluated once however often it is used: within a lambda function
    Spark does not share what is written twice."""
    return F.transform(F.array(made), use)[0]


BASE_RULES = ["enough_words", "few_repeats"]
OWN_RULES = ["word_length", "few_symbols", "few_dup_lines", "mostly_letters", "few_long_words", "no_placeholder"]


def rules(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Every rule as a condition, true for a document that passes; ``words`` and ``lines`` are
    those of ``text``."""
    n = F.size(words)
    return {
        "enough_words": n >= LEAST_WORDS,
        "few_repeats": once(window_hashes(words), repeat_words) * 100 <= n * MOST_REPEAT_PERCENT,
        "word_length": once(word_chars(words), lambda c: c.between(n * WORD_LENGTH[0], n * WORD_LENGTH[1])),
        "few_symbols": symbols(text) * 100 <= word_chars(words) * MOST_SYMBOL_PERCENT,
        "few_dup_lines": dup_lines(lines) * 100 <= F.size(lines) * MOST_DUP_LINE_PERCENT,
        "mostly_letters": F.size(F.filter(words, lambda w: w.rlike(_LETTER))) * 100 >= n * LEAST_LETTER_PERCENT,
        "few_long_words": F.size(F.filter(words, lambda w: F.length(w) > LONG_WORD)) * 100 <= n * MOST_LONG_PERCENT,
        "no_placeholder": ~text.rlike(_PLACEHOLDER),
    }


def chain(conditions: dict[str, Column], order: list[str]) -> Column:
    """The conjunction of ``conditions``, each evaluated only where all before it hold."""
    verdict = F.lit(True)
    for name in reversed(order):
        verdict = F.when(conditions[name], verdict).otherwise(F.lit(False))
    return verdict


def cascade_order(docs: DataFrame, text_col: str = "text", sample_bytes: int = SAMPLE_BYTES, among: list[str] | None = None) -> list[str]:
    """Names of the rules (or of those in ``among``), the most rejections per second of the sample
    first; a rule costs what its job takes beyond one that only reads the sample."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    drawn = docs.select(text.alias("text")).sample(min(1.0, sample_bytes / max(1, total)), seed=7).repartition(SAMPLE_PARTS)
    sample = materialize(drawn.select("text", words_of(F.col("text")).alias("words"), lines_of(F.col("text")).alias("lines")), "rule-sample")

    def timed(failed: Column) -> tuple[float, int]:
        took, count = [], 0
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            count = sample.agg(F.count_if(failed)).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), count

    conditions = rules(F.col("text"), F.col("words"), F.col("lines"))
    reading, _ = timed(F.size("words") + F.size("lines") + F.octet_length("text") < 0)
    worth = {}
    for name in among or conditions:
        took, rejected = timed(~F.coalesce(conditions[name], F.lit(False)))
        worth[name] = rejected / max(took - reading, 1e-3)
    return sorted(worth, key=worth.get, reverse=True)


def keep_good(docs: DataFrame, text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The documents that meet all rules, with all their columns."""
    order = cascade_order(docs, text_col, sample_bytes)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    # the split text travels as the one element of an array, so that all rules share it
    split = F.array(F.struct(text.alias("text"), words_of(text).alias("words"), lines_of(text).alias("lines")))
    return docs.where(F.transform(split, lambda d: chain(rules(d["text"], d["words"], d["lines"]), order))[0])


def measure(docs: DataFrame, order: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All measures of every document, with the base verdict and that of the cascade.  Rules on
    measures that are reported anyway cost nothing more; the others are asked in ``order``, of
    documents that the base rules and all earlier ones passed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    split = own.select("doc_id", text.alias("text"), words_of(text).alias("words"), lines_of(text).alias("lines"))
    hashed = split.select("*", F.size("words").cast("long").alias("n_words"), word_chars(F.col("words")).alias("word_chars"), symbols(F.col("text")).alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"), dup_lines(F.col("lines")).alias("n_dup_lines"), window_hashes(F.col("words")).alias("windows"))
    counted = hashed.select("doc_id", "text", "words", "lines", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeat_words(F.col("windows")).alias("n_repeat_words"))
    n = F.col("n_words")
    conditions = rules(F.col("text"), F.col("words"), F.col("lines")) | {
        "enough_words": n >= LEAST_WORDS,
        "few_repeats": F.col("n_repeat_words") * 100 <= n * MOST_REPEAT_PERCENT,
        "word_length": F.col("word_chars").between(n * WORD_LENGTH[0], n * WORD_LENGTH[1]),
        "few_symbols": F.col("n_symbols") * 100 <= F.col("word_chars") * MOST_SYMBOL_PERCENT,
        "few_dup_lines": F.col("n_dup_lines") * 100 <= F.col("n_lines") * MOST_DUP_LINE_PERCENT,
    }
    rest = [name for name in conditions if name not in order and name not in BASE_RULES]
    base_failed = ~(conditions["enough_words"] & conditions["few_repeats"])
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), chain(conditions, [*BASE_RULES, *order, *rest]).alias("kept"))


def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measure(docs, cascade_order(docs, among=OWN_RULES))


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT r, i, list_slice(w, i, i + 4) AS g FROM d, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS t(k) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '{_LETTER}'))) AS n_letter, len(list_filter(w, lambda x: length(x) > {LONG_WORD})) AS n_long,
         regexp_matches(text, '{_PLACEHOLDER}') AS placeholder
  FROM d LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words) AS base_failed,
       (n_words >= {LEAST_WORDS} AND 100 * n_repeat_words <= {MOST_REPEAT_PERCENT} * n_words
        AND word_chars BETWEEN {WORD_LENGTH[0]} * n_words AND {WORD_LENGTH[1]} * n_words
        AND 100 * n_symbols <= {MOST_SYMBOL_PERCENT} * word_chars
        AND 100 * n_dup_lines <= {MOST_DUP_LINE_PERCENT} * n_lines
        AND 100 * n_letter >= {LEAST_LETTER_PERCENT} * n_words AND 100 * n_long <= {MOST_LONG_PERCENT} * n_words AND NOT placeholder) AS kept
FROM m
"""
