"""Line dedup by site-relative frequency, in DataFrame functions only.

Within each host, the pages that contain a line are divided by the host's pages; lines above a
boilerplate ratio are dropped from all its pages.  A page counts a line once.  A line that stands
on one page only is no repeat, whatever its share of a tiny host.

Scale: lines are counted by (host, hash of line) with partial sums before the shuffle, so neither
a hot host nor a hot line gathers in one task.  A host has fewer than (its mean distinct lines a
page) / ratio boilerplate lines, so the list of a host stays small; the lists are broadcast while
they are few and joined by host, with skew splitting, beyond that.

Edge cases: a null host is a host of its own; a null or empty text has no lines and stays as it is
(null stays null); lines are compared without outer white space, and blank lines are neither
counted nor dropped; repeated rows are pages like others; an empty table gives an empty result;
other columns pass through :func:`drop_boilerplate` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.workspace import fresh_names, materialize

RATIO = 0.2
#: Boilerplate lines (8 bytes each, beside their host's name) up to which the lists are broadcast.
BROADCAST_LINES = 1_000_000

_OUTER = "\t\n\x0b\x0c\r "


def trimmed(line: Column) -> Column:
    """``line`` without outer white space.  A pattern with ``$`` costs more, and takes also what
    stands before a last U+2028 or U+0085."""
    return F.btrim(line, F.lit(_OUTER))


def line_hashes(text: Column) -> Column:
    """Hashes of the distinct lines of a text, blank ones left out."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trimmed), lambda x: x != "")
    return F.transform(F.array_distinct(lines), lambda x: F.xxhash64(x))


def least_share(n: Column, pages: Column, z: float) -> Column:
    """The share ``n / pages``, or with ``z`` > 0 the lower end of its Wilson interval: what a
    count of few pages vouches for."""
    if not z:
        return n / pages
    spread = F.sqrt(n * (pages - n) / pages + z * z / 4)
    return (n + z * z / 2 - z * spread) / (pages + z * z)


def boilerplate(pages: DataFrame, ratio: float = RATIO, z: float = 0.0, distinct_pages: bool = False) -> DataFrame:
    """(host, line): hashes of the boilerplate lines of ``pages(host, text)``: those on more than
    ``ratio`` of the host's pages (see :func:`least_share`).  A line on one page only repeats
    nothing and is none.  With ``distinct_pages`` equal texts of a host are one page, so that
    copies of a page do not make boilerplate of it."""
    lined = pages.select("host", line_hashes(F.col("text")).alias("lines"), F.xxhash64("text").alias("page"))
    if distinct_pages:
        lined = lined.groupBy("host", "page").agg(F.first("lines").alias("lines"))
    totals = lined.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumnRenamed("host", "total_host")
    counts = lined.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = counts.join(totals, counts["host"].eqNullSafe(totals["total_host"]))
    return joined.where(least_share(F.col("n"), F.col("pages"), z) > ratio).select("host", "line")


def drop_boilerplate(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, z: float = 0.0, distinct_pages: bool = False, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the boilerplate lines of each host (see :func:`boilerplate`) taken out of
    ``text_col``; ``counts`` names two columns to add, the lines with content before and those
    dropped."""
    pages = docs.select(host.alias("host"), F.col(text_col).alias("text"))
    found = materialize(boilerplate(pages, ratio, z, distinct_pages), "boilerplate")
    site, listed, listed_site = fresh_names(docs, "site", "listed", "listed_site")
    lists = found.groupBy("host").agg(F.collect_set("line").alias(listed)).withColumnRenamed("host", listed_site)
    if found.count() <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    marked = docs.withColumn(site, host)
    joined = marked.join(lists, marked[site].eqNullSafe(lists[listed_site]), "left")
    text, lines = F.col(text_col), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    drop = lambda line: F.array_contains(listed, F.xxhash64(trimmed(line)))
    kept = F.array_join(F.filter(lines, lambda line: ~drop(line)), "\n")
    columns = {text_col: F.when(F.col(listed).isNull() | text.isNull(), text).otherwise(kept)}
    if counts:
        full = F.filter(lines, lambda line: trimmed(line) != "")
        dropped = F.when(F.col(listed).isNull(), F.lit(0)).otherwise(F.size(F.filter(full, drop)))
        columns |= {counts[0]: F.size(full).cast("long"), counts[1]: dropped.cast("long")}
    return joined.withColumns(columns).drop(site, listed, listed_site)


_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
_BLOCK = r"(?i)</?(?:p|div|li|ul|ol|nav|article|section|header|footer|main|h[1-6]|br|hr|tr|table|title|head|body|html|aside|blockquote|pre)\b[^>]*>"
_TAG = r"<[^>]*>"
#: _HIDDEN for the scan: one branch, so that it tries its words only where a ``<`` stands.
_HIDDEN_SCAN = r"(?is)<(?:script\b.*?</script>|style\b.*?</style>|!--.*?-->)"


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), _HOST, 1)


def visible_lines(html: Column) -> Column:
    """The text of a page, a line for each block."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _HIDDEN_SCAN, " "), _BLOCK, "\n"), _TAG, "")


def op2_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each host dropped from the visible text of the whole ``pages`` table:
    page_id, host, n_lines, n_dropped and the SHA-256 of what is kept."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("site"), visible_lines(F.col("html")).alias("text"))
    cleaned = drop_boilerplate(texts, F.col("site"), counts=("n_lines", "n_dropped"))
    return cleaned.select("page_id", F.col("site").alias("host"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = rf"""
WITH t AS (
  SELECT page_id, row_number() OVER () AS r, regexp_extract(lower(url), '{_HOST}', 1) AS host,
         regexp_replace(regexp_replace(regexp_replace(html, '{_HIDDEN}', ' ', 'g'), '{_BLOCK}', chr(10), 'g'), '{_TAG}', '', 'g') AS text
  FROM pages
), l AS (
  SELECT page_id, r, host, i, line, regexp_replace(line, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') AS trimmed
  FROM (SELECT page_id, r, host, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS a FROM t))
), totals AS (SELECT host, count(*) AS pages FROM t GROUP BY host),
flagged AS (
  SELECT l.host, trimmed FROM l JOIN totals ON totals.host IS NOT DISTINCT FROM l.host WHERE trimmed <> ''
  GROUP BY l.host, trimmed, pages HAVING count(DISTINCT r) > 1 AND count(DISTINCT r) > pages * {RATIO}::DOUBLE
)
SELECT any_value(l.page_id) AS page_id, any_value(l.host) AS host, count(*) FILTER (WHERE l.trimmed <> '')::BIGINT AS n_lines,
       count(f.trimmed)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE f.trimmed IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN flagged f ON f.host IS NOT DISTINCT FROM l.host AND f.trimmed = l.trimmed
GROUP BY l.r
"""
