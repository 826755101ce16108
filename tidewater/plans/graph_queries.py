"""Closures, hierarchies and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import flows, graph
from tidewater.plans.registry import query
from tidewater.plans.selection_queries import _ABOVE, _OVERRIDES
from tidewater.sources import facts
from tidewater.sources.facts import CALLS_SQL, EDGES_SQL, METHODS_SQL, TYPES_SQL

SOURCE_BRAND, SINK_BRAND, HOPS = "Brand#7", "Brand#13", 7

_REACH = f"""WITH RECURSIVE {METHODS_SQL}, {EDGES_SQL},
reach(node, distance) AS (
  SELECT method_id, 0 FROM methods WHERE class = '{SOURCE_BRAND}'
  UNION SELECT e.b, r.distance + 1 FROM reach r JOIN edges e ON e.a = r.node WHERE r.distance < {{hops}}),
least AS (SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM reach GROUP BY node)"""


def _sources(spark, sf_dir):
    return facts.methods(spark, sf_dir).where(F.col("class") == SOURCE_BRAND).select(F.col("method_id").alias("node"))


@query(f"{_REACH.format(hops=HOPS)} SELECT 1 AS rule, node AS sink_id, distance AS min_distance FROM least JOIN methods ON node = method_id WHERE class = '{SINK_BRAND}'")
def issues_source_sink(spark, sf_dir):
    """Sinks that a source reaches in at most seven hops, at their least distance."""
    found = graph.reach(facts.edges(spark, sf_dir), _sources(spark, sf_dir), HOPS)
    kinds = facts.methods(spark, sf_dir).where(F.col("class") == SINK_BRAND).select(F.col("method_id").alias("node"), F.lit("Sink").alias("sink_kind"))
    rules = spark.createDataFrame([(1, "Source", "Sink")], "rule int, source string, sink_kind string")
    issues = found.withColumn("source", F.lit("Source")).join(kinds, "node").join(F.broadcast(rules), ["source", "sink_kind"])
    return issues.groupBy("rule", F.col("node").alias("sink_id")).agg(F.min("distance").alias("min_distance"))


@query(f"{_REACH.format(hops=HOPS)} SELECT node, distance FROM least")
def reach_min_distance(spark, sf_dir):
    return graph.reach(facts.edges(spark, sf_dir), _sources(spark, sf_dir), HOPS)


@query(f"{_REACH.format(hops=2)} SELECT distance, count(*) AS n FROM least GROUP BY distance")
def reach_cap_k(spark, sf_dir):
    return graph.reach(facts.edges(spark, sf_dir), _sources(spark, sf_dir), 2).groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_ABOVE} SELECT above AS ancestor, count(*) AS n, min(type) AS first_type, max(type) AS last_type FROM up GROUP BY above")
def extends_closure(spark, sf_dir):
    closure = graph.extends_closure(facts.types(spark, sf_dir))
    return closure.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"), F.min("type").alias("first_type"), F.max("type").alias("last_type"))


@query(f"{_OVERRIDES} SELECT base, method FROM ov")
def overrides(spark, sf_dir):
    return graph.overrides(facts.declarations(spark, sf_dir), graph.extends_closure(facts.types(spark, sf_dir)))


@query(f"{_OVERRIDES} SELECT base, bool_or(NOT d.has_code) AS obscure FROM ov JOIN decls d ON d.method_id = ov.method GROUP BY base")
def has_obscure_override(spark, sf_dir):
    decls = facts.declarations(spark, sf_dir).withColumn("obscure", ~F.col("has_code"))
    return graph.any_override(decls, graph.extends_closure(facts.types(spark, sf_dir)), "obscure")


@query(f"WITH {EDGES_SQL} SELECT b AS callee, count(*) AS n_callers, min(a) AS first_caller, max(a) AS last_caller FROM edges GROUP BY b")
def dependencies_reverse(spark, sf_dir):
    return facts.edges(spark, sf_dir).groupBy(F.col("b").alias("callee")).agg(F.count(F.lit(1)).alias("n_callers"), F.min("a").alias("first_caller"), F.max("a").alias("last_caller"))


@query(f"""WITH RECURSIVE {TYPES_SQL}, sub(top, type) AS (SELECT type, type FROM types UNION ALL SELECT sub.top, t.type FROM sub JOIN types t ON t.super = sub.type),
sizes AS (SELECT top AS type, count(*) AS size FROM sub GROUP BY top),
off AS (SELECT t.type, t.super, size, 1 + 2 * coalesce(sum(size) OVER (PARTITION BY t.super ORDER BY t.type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM types t JOIN sizes USING (type)),
num(type, lo, size) AS (SELECT type, CAST(0 AS HUGEINT), size FROM off WHERE super IS NULL UNION ALL SELECT off.type, num.lo + off.o, off.size FROM num JOIN off ON off.super = num.type)
SELECT type, CAST(lo AS BIGINT) AS lo, CAST(lo + 2 * size - 1 AS BIGINT) AS hi FROM num""")
def class_intervals(spark, sf_dir):
    types = facts.types(spark, sf_dir)
    return graph.class_intervals(types, graph.extends_closure(types))


@query("SELECT l_suppkey AS caller, l_partkey AS callee, l_orderkey * 100 + l_linenumber AS pos, CAST(row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 100 + l_linenumber) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem)")
def textual_index(spark, sf_dir):
    sites = facts.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS caller", "l_partkey AS callee", "l_orderkey * 100 + l_linenumber AS pos").distinct()
    return graph.textual_index(sites)


@query(f"""WITH RECURSIVE {METHODS_SQL}, {EDGES_SQL}, t AS (SELECT method_id AS node, n_params = 0 AS exported FROM methods WHERE class = 'Brand#5'),
r(target, exported, node, d) AS (SELECT node, exported, node, 0 FROM t UNION SELECT r.target, r.exported, e.a, d + 1 FROM r JOIN edges e ON e.b = r.node WHERE d < 4),
best AS (SELECT node, target, exported, min(d) AS d FROM r GROUP BY node, target, exported),
ranked AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, NOT exported, target) AS k FROM best)
SELECT node, target, CAST(d AS INTEGER) AS distance, exported FROM ranked WHERE k = 1""")
def nearest_exported(spark, sf_dir):
    targets = facts.methods(spark, sf_dir).where("class = 'Brand#5'").select(F.col("method_id").alias("node"), (F.col("n_params") == 0).alias("exported"))
    return graph.nearest(facts.edges(spark, sf_dir), targets, 4)


@query(f"""WITH RECURSIVE {EDGES_SQL}, r(s, t) AS (SELECT a, b FROM edges UNION SELECT r.s, e.b FROM r JOIN edges e ON e.a = r.t),
nodes AS (SELECT a AS node FROM edges UNION SELECT b FROM edges),
mutual AS (SELECT x.s AS node, min(x.t) AS least FROM r x JOIN r y ON y.s = x.t AND y.t = x.s GROUP BY x.s)
SELECT node, least(node, coalesce(mutual.least, node)) AS component FROM nodes LEFT JOIN mutual USING (node)""")
def scc_labels(spark, sf_dir):
    """Strongly connected components of the call graph."""
    return graph.strong_components(facts.edges(spark, sf_dir))


_FRAMES = f"""{CALLS_SQL}, frames AS (
  SELECT DISTINCT a AS method, flag AS kind, CASE WHEN b % 5 = 0 THEN NULL ELSE b END AS callee FROM calls WHERE a < b)"""


@query(f"""WITH RECURSIVE {_FRAMES}, alive(method, kind) AS (
  SELECT method, kind FROM frames WHERE callee IS NULL UNION SELECT f.method, f.kind FROM frames f JOIN alive a ON f.callee = a.method AND f.kind = a.kind)
SELECT f.method, f.kind, f.callee FROM frames f LEFT JOIN alive a ON f.callee = a.method AND f.kind = a.kind WHERE f.callee IS NULL OR a.method IS NOT NULL""")
def trace_cull(spark, sf_dir):
    """Frames that still lead to a leaf; ids grow along these calls, so there are no cycles."""
    frames = facts.calls(spark, sf_dir).where("a < b").selectExpr("a AS method", "flag AS kind", "CASE WHEN b % 5 = 0 THEN NULL ELSE b END AS callee").distinct()
    return graph.cull_frames(frames)


@query(f"""{_REACH.format(hops=2)}, back(sink, node, d) AS (
  SELECT node, node, 0 FROM least JOIN methods ON node = method_id WHERE class = '{SINK_BRAND}'
  UNION SELECT k.sink, e.a, k.d + 1 FROM back k JOIN edges e ON e.b = k.node WHERE k.d < 2)
SELECT node AS entry, sink, CAST(min(d) AS INTEGER) AS distance FROM back JOIN methods ON node = method_id WHERE visibility = 'public' AND n_params = 0 GROUP BY node, sink""")
def exploitability(spark, sf_dir):
    """Two phases: confirmed flows, then call chains from exported methods to them."""
    edges = facts.edges(spark, sf_dir)
    methods = facts.methods(spark, sf_dir)
    found = graph.reach(edges, _sources(spark, sf_dir), 2).join(methods.where(F.col("class") == SINK_BRAND).select(F.col("method_id").alias("node")), "node")
    entries = methods.where("visibility = 'public' AND n_params = 0").select(F.col("method_id").alias("node"))
    return flows.exploitable(found.select(F.col("node").alias("sink"), "node"), edges, entries, 2)


@query("""WITH spans AS (SELECT DISTINCT l_orderkey AS line, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS e FROM lineitem)
SELECT line, s, e FROM spans x WHERE NOT EXISTS (SELECT 1 FROM spans y WHERE y.line = x.line AND y.s <= x.e AND x.s <= y.e AND (y.e - y.s < x.e - x.s OR (y.e - y.s = x.e - x.s AND y.s < x.s)))""")
def highlight_overlap(spark, sf_dir):
    """On each line, ranges that no overlapping shorter (then earlier) range displaces."""
    spans = facts.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS line", "l_linenumber * 10 AS s", "l_linenumber * 10 + CAST(l_quantity AS INT) AS e").distinct()
    return graph.shorter_ranges(spans)
