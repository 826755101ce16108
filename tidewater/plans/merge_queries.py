"""Lattice merges and joins between calls, summaries and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import augment, flows, graph, lattice, reports
from tidewater.plans.registry import query
from tidewater.plans.selection_queries import _ABOVE, _OVERRIDES
from tidewater.sources import facts
from tidewater.sources.facts import CALLS_SQL, EDGES_SQL, METHODS_SQL, SITES_SQL

_FRAMES_SQL = "frames AS (SELECT l_partkey AS method, l_returnflag AS kind, l_linenumber AS distance, 'S' || l_suppkey AS origin, l_orderkey % 10 AS lo, l_orderkey % 10 + l_linenumber AS hi FROM lineitem)"


def _frames(spark, sf_dir):
    return facts.table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS method", "l_returnflag AS kind", "l_linenumber AS distance", "array('S' || l_suppkey) AS origins", "l_orderkey % 10 AS lo", "l_orderkey % 10 + l_linenumber AS hi")


@query(f"WITH {_FRAMES_SQL} SELECT method, kind, min(distance) AS distance, count(*) AS n_frames, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins FROM frames GROUP BY method, kind")
def frames_join_lattice(spark, sf_dir):
    """Frames of a key merged: least distance, union of origins."""
    return lattice.join_frames(_frames(spark, sf_dir), ["method", "kind"]).withColumn("origins", F.array_join("origins", ","))


@query(f"WITH {_FRAMES_SQL} SELECT kind, count(DISTINCT origin) AS n_origins, min(origin) AS first_origin FROM frames GROUP BY kind")
def origins_union(spark, sf_dir):
    found = _frames(spark, sf_dir).select("kind", F.explode("origins").alias("origin")).distinct()
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n_origins"), F.min("origin").alias("first_origin"))


@query(f"""WITH {CALLS_SQL}, rows_ AS (SELECT a, b || flag AS frame, 'via-' || status AS tag, status = 'F' AS always FROM calls),
total AS (SELECT a, count(DISTINCT frame) AS n FROM rows_ GROUP BY a)
SELECT r.a AS method, tag, CASE WHEN count(DISTINCT CASE WHEN always THEN frame END) = any_value(n) THEN 'always' ELSE 'may' END AS kind
FROM rows_ r JOIN total t ON r.a = t.a GROUP BY r.a, tag""")
def features_may_always(spark, sf_dir):
    """A feature that every frame of a method always has is 'always', any other one 'may'."""
    tags = facts.calls(spark, sf_dir).selectExpr("a AS method", "b || flag AS frame", "'via-' || status AS tag", "status = 'F' AS always")
    return lattice.may_always(tags, ["method"], "frame")


@query("SELECT 1 + CAST(o_orderkey % 3 AS INTEGER) AS rule, o_custkey AS callee, o_orderstatus AS sink_index, count(*) AS n, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS sources FROM orders GROUP BY ALL")
def issue_group(spark, sf_dir):
    """Issues of one rule, callee and sink merged, with the union of their sources."""
    flows_ = facts.table(spark, sf_dir, "orders").selectExpr("1 + CAST(o_orderkey % 3 AS INT) AS rule", "o_custkey AS callee", "o_orderstatus AS sink_index", "o_orderpriority AS source")
    return flows_.groupBy("rule", "callee", "sink_index").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("""WITH m AS (SELECT o_custkey AS method, o_orderstatus AS role, o_orderpriority AS fact, o_orderpriority = '1-URGENT' AS frozen FROM orders)
SELECT method, role, count(*) AS n, min(fact) AS fact FROM m WHERE frozen OR NOT EXISTS (SELECT 1 FROM m f WHERE f.method = m.method AND f.role = m.role AND f.frozen) GROUP BY method, role""")
def frozen_roles(spark, sf_dir):
    """Where a role is frozen for a method, only its frozen facts count."""
    rows = facts.table(spark, sf_dir, "orders").selectExpr("o_custkey AS method", "o_orderstatus AS role", "o_orderpriority AS fact", "o_orderpriority = '1-URGENT' AS frozen")
    return lattice.resolve_frozen(rows, ["method", "role"]).groupBy("method", "role").agg(F.count(F.lit(1)).alias("n"), F.min("fact").alias("fact"))


@query(f"WITH {_FRAMES_SQL} SELECT method, kind, min(distance) AS distance, count(DISTINCT (lo, hi)) AS n_intervals FROM frames GROUP BY method, kind")
def collapse_intervals(spark, sf_dir):
    return lattice.collapse_intervals(_frames(spark, sf_dir), ["method", "kind"])


@query(f"""WITH {CALLS_SQL}, n AS (SELECT a, count(*) AS n FROM calls GROUP BY a), l AS (SELECT list_sort(list(n)) AS v FROM n)
SELECT len(v) AS total, round(list_sum(v) / len(v), 4) AS average, v[1] AS least, v[-1] AS greatest,
  v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(len(v) * 0.9) AS BIGINT) + 1] AS p90, v[CAST(floor(len(v) * 0.99) AS BIGINT) + 1] AS p99 FROM l""")
def call_graph_stats(spark, sf_dir):
    """Quantiles are the elements at the floored index, without interpolation."""
    counts = facts.calls(spark, sf_dir).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    return lattice.floor_quantiles(counts, "n", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query(f"WITH {METHODS_SQL}, {CALLS_SQL} SELECT a AS method, count(*) AS cost FROM calls GROUP BY a ORDER BY cost DESC, a LIMIT 10")
def slowest_methods(spark, sf_dir):
    """A top-k report."""
    return facts.calls(spark, sf_dir).groupBy(F.col("a").alias("method")).agg(F.count(F.lit(1)).alias("cost")).orderBy(F.desc("cost"), "method").limit(10)


@query(f"""{_OVERRIDES}, {EDGES_SQL}, few AS (SELECT base FROM ov GROUP BY base HAVING count(*) < 4)
SELECT a, b AS target FROM edges UNION SELECT a, ov.method FROM edges JOIN ov ON ov.base = b WHERE b IN (SELECT base FROM few)""")
def virtual_join_capped(spark, sf_dir):
    """Calls with the overrides of their callee, where these are fewer than the limit."""
    decls, closure = facts.declarations(spark, sf_dir), graph.extends_closure(facts.types(spark, sf_dir))
    few = graph.override_counts(decls, closure).where("n < 4")
    return flows.virtual_targets(facts.edges(spark, sf_dir), graph.overrides(decls, closure, few), 4)


@query(f"""{_OVERRIDES}, {SITES_SQL}, c AS (SELECT site AS call, callee AS base, 'N' || s_nationkey AS receiver FROM sites JOIN supplier ON s_suppkey = receiver),
below AS (SELECT above AS receiver, type FROM up UNION SELECT type, type FROM decls)
SELECT c.call, ov.method AS target FROM c JOIN ov ON ov.base = c.base JOIN decls d ON d.method_id = ov.method JOIN below ON below.receiver = c.receiver AND below.type = d.type""")
def receiver_semi_join(spark, sf_dir):
    """Overrides kept where the receiver's type is theirs or above it."""
    decls, closure = facts.declarations(spark, sf_dir), graph.extends_closure(facts.types(spark, sf_dir))
    nations = facts.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS receiver", "s_nationkey")
    calls = facts.sites(spark, sf_dir).join(nations, "receiver").selectExpr("site AS call", "callee AS base", "'N' || s_nationkey AS receiver")
    return graph.overrides_below(calls, decls, closure)


@query("""WITH s AS (SELECT DISTINCT l_partkey AS k, l_orderkey AS id, l_orderkey % 97 AS lo, l_orderkey % 97 + l_linenumber AS hi FROM lineitem WHERE l_returnflag = 'R'),
t AS (SELECT DISTINCT l_partkey AS k, l_orderkey AS id, l_orderkey % 89 AS lo, l_orderkey % 89 + 2 * l_linenumber AS hi FROM lineitem WHERE l_returnflag = 'A')
SELECT s.k, s.id AS a, t.id AS b, greatest(s.lo, t.lo) AS lo, least(s.hi, t.hi) AS hi FROM s JOIN t ON s.k = t.k AND s.lo <= t.hi AND t.lo <= s.hi""")
def interval_overlap(spark, sf_dir):
    """Frames of a key whose class intervals meet, dealt into buckets instead of compared all."""
    lines = facts.table(spark, sf_dir, "lineitem")
    left = lines.where("l_returnflag = 'R'").selectExpr("l_partkey AS k", "l_orderkey AS id", "l_orderkey % 97 AS lo", "l_orderkey % 97 + l_linenumber AS hi").distinct()
    right = lines.where("l_returnflag = 'A'").selectExpr("l_partkey AS k", "l_orderkey AS id", "l_orderkey % 89 AS lo", "l_orderkey % 89 + 2 * l_linenumber AS hi").distinct()
    return flows.overlapping(left, right, ["k"], 8)


_RULES = [(2, "A", "O"), (2, "N", "F"), (3, "R", "O")]


@query("""WITH r(rule, source, sink) AS (VALUES (2, 'A', 'O'), (2, 'N', 'F'), (3, 'R', 'O')),
src AS (SELECT DISTINCT l_orderkey AS site, l_returnflag AS kind FROM lineitem), snk AS (SELECT DISTINCT l_orderkey AS site, l_linestatus AS kind FROM lineitem)
SELECT site, rule, source, sink FROM src JOIN r ON src.kind = r.source JOIN snk USING (site) WHERE snk.kind = r.sink""")
def match_rules(spark, sf_dir):
    """Sources and sinks of a site that a rule forbids together."""
    lines = facts.table(spark, sf_dir, "lineitem")
    rules = F.broadcast(spark.createDataFrame(_RULES, "rule int, source string, sink string"))
    sources = lines.selectExpr("l_orderkey AS site", "l_returnflag AS kind").distinct()
    sinks = lines.selectExpr("l_orderkey AS site", "l_linestatus AS kind").distinct()
    return flows.match_rules(sources, sinks, rules, ["site"]).select("site", "rule", "source", "sink")


@query("""WITH r(rule, label, kind) AS (VALUES (1, 'x', 'A'), (1, 'y', 'R'), (2, 'x', 'A'), (2, 'x', 'N'), (2, 'y', 'R'))
SELECT l_orderkey AS site, rule FROM lineitem JOIN r ON l_returnflag = kind GROUP BY l_orderkey, rule HAVING count(DISTINCT label) = 2""")
def multi_source_pairs(spark, sf_dir):
    """Sites where both labels of a rule are fulfilled."""
    rules = F.broadcast(spark.createDataFrame([(1, "x", "A"), (1, "y", "R"), (2, "x", "A"), (2, "x", "N"), (2, "y", "R")], "rule int, label string, kind string"))
    return flows.both_labels(facts.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS site", "l_returnflag AS kind"), rules)


@query("""SELECT p_partkey AS id, k AS kind FROM part, (VALUES ('red .*', 'Red'), ('.* (bolt|ring)', 'Round'), ('blue.*', 'Blue')) AS t(p, k) WHERE regexp_full_match(p_name, p)""")
def literal_regex_join(spark, sf_dir):
    """Literals with the kinds of all patterns that they match."""
    literals = facts.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS value")
    return flows.with_literals(literals, [("red .*", "Red"), (".* (bolt|ring)", "Round"), ("blue.*", "Blue")])


@query(f"""WITH {METHODS_SQL}, {EDGES_SQL} SELECT a, b, 'Normal' AS call_kind FROM edges
UNION ALL SELECT e.a, t.method_id, 'Shim' FROM edges e JOIN methods s ON e.b = s.method_id AND s.class = 'Brand#2' JOIN methods t ON t.name = s.name AND t.class = 'Brand#9'""")
def shim_edges(spark, sf_dir):
    """A call of a shimmed method also calls the methods that the shim names."""
    methods, edges = facts.methods(spark, sf_dir), facts.edges(spark, sf_dir)
    shims = methods.where("class = 'Brand#2'").select(F.col("method_id").alias("shimmed"), F.lit("Brand#9").alias("class"), "name")
    return augment.with_shims(edges, shims, methods)


@query("""WITH sends AS (SELECT DISTINCT l_suppkey AS sender, c_nationkey AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey), recv AS (SELECT n_nationkey AS target, n_name AS receiver FROM nation)
SELECT sender, receiver FROM sends JOIN recv USING (target)""")
def intent_routing(spark, sf_dir):
    """Send points joined with the components that receive for their target class."""
    targets = facts.table(spark, sf_dir, "orders").join(facts.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("target"))
    sends = facts.table(spark, sf_dir, "lineitem").join(targets, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("sender"), "target")
    receivers = facts.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS target", "n_name AS receiver")
    return augment.route_intents(sends, receivers, ["target"])


@query(f"""{_ABOVE}, sets AS (SELECT DISTINCT l_partkey AS key, 'S' || l_suppkey AS type FROM lineitem),
size AS (SELECT key, count(*) AS n FROM sets GROUP BY key),
lifted AS (SELECT key, type AS above FROM sets UNION ALL SELECT key, up.above FROM sets JOIN up USING (type)),
shared AS (SELECT l.key, l.above FROM lifted l JOIN size USING (key) GROUP BY l.key, l.above, n HAVING count(*) = n),
depth AS (SELECT type, count(*) AS d FROM up GROUP BY type),
best AS (SELECT key, above, row_number() OVER (PARTITION BY key ORDER BY coalesce(d, 0) DESC, above DESC) AS k FROM shared LEFT JOIN depth ON depth.type = above)
SELECT size.key, CASE WHEN n <= 40 THEN coalesce(above, 'Object') END AS super FROM size LEFT JOIN best ON best.key = size.key AND k = 1""")
def type_join_lca(spark, sf_dir):
    """The deepest common type of each set of types; sets of more than forty stand for any."""
    sets = facts.table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS key", "'S' || l_suppkey AS type").distinct()
    return lattice.common_super(sets, graph.extends_closure(facts.types(spark, sf_dir)), 40)


@query(f"""WITH {METHODS_SQL}, old AS (SELECT l_partkey AS method, min(l_linenumber) AS distance FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
new AS (SELECT l_partkey AS method, min(l_linenumber) AS distance FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT method, min(distance) AS distance, count(*) AS n FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY method""")
def cached_models_merge(spark, sf_dir):
    """Facts of an earlier run merged with new ones: only the new part is computed again."""
    lines = facts.table(spark, sf_dir, "lineitem")
    part = lambda flag: lines.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("method")).agg(F.min("l_linenumber").alias("distance"))
    return reports.by_mode("cached_models", part("R"), part("A")).groupBy("method").agg(F.min("distance").alias("distance"), F.count(F.lit(1)).alias("n"))
