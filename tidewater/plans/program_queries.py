"""Resolution, visibility, reachability and generators that read the whole program."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import augment, graph, program
from tidewater.plans.registry import query
from tidewater.plans.selection_queries import _ABOVE
from tidewater.sources import facts
from tidewater.sources.facts import BODY_SQL, CALLS_SQL, DECLS_SQL, EDGES_SQL, METHODS_SQL, SITES_SQL

_DEPTHS = _ABOVE.replace("up(type, above) AS (SELECT type, super FROM", "up(type, above, depth) AS (SELECT type, super, 1 FROM").replace("UNION SELECT up.type, types.super FROM", "UNION SELECT up.type, types.super, depth + 1 FROM")


def _closure(spark, sf_dir):
    return graph.extends_closure(facts.types(spark, sf_dir))


@query(f"""{_DEPTHS}, {SITES_SQL}, named AS (SELECT site, 'S' || receiver AS type, p_name AS name FROM sites JOIN part ON p_partkey = callee),
seen AS (SELECT site, name, type, 0 AS depth FROM named UNION ALL SELECT site, name, above, depth FROM named JOIN up USING (type)),
ranked AS (SELECT site, method_id, row_number() OVER (PARTITION BY site ORDER BY depth, method_id) AS k FROM seen JOIN decls USING (name, type))
SELECT site, method_id AS method FROM ranked WHERE k = 1""")
def call_target_resolution(spark, sf_dir):
    """Virtual calls resolved to the declaration nearest above the receiver's type."""
    parts = facts.table(spark, sf_dir, "part").selectExpr("p_partkey AS callee", "p_name AS name")
    named = facts.sites(spark, sf_dir).join(parts, "callee").selectExpr("site", "'S' || receiver AS type", "name")
    return program.resolve_targets(named, facts.declarations(spark, sf_dir), _closure(spark, sf_dir))


@query(f"""{_DEPTHS}, fields AS (SELECT DISTINCT 'N' || (p_partkey % 25) AS type, 'f' || (p_size % 6) AS field FROM part WHERE p_size < 9 UNION SELECT DISTINCT type, 'f' || (p_size % 4) FROM decls JOIN part ON p_partkey = method_id WHERE p_size = 7),
seen AS (SELECT type, field, 0 AS depth, type AS owner FROM fields UNION ALL SELECT up.type, field, depth, above FROM fields JOIN up ON fields.type = up.above),
ranked AS (SELECT *, row_number() OVER (PARTITION BY type, field ORDER BY depth, owner) AS k FROM seen)
SELECT type, field, owner FROM ranked WHERE k = 1""")
def field_visibility(spark, sf_dir):
    """Fields of a type and those that it inherits from the nearest owner."""
    parts = facts.table(spark, sf_dir, "part")
    owned = facts.declarations(spark, sf_dir).join(parts.where("p_size = 7").selectExpr("p_partkey AS method_id", "p_size"), "method_id").selectExpr("type", "'f' || (p_size % 4) AS field")
    fields = parts.where("p_size < 9").selectExpr("'N' || (p_partkey % 25) AS type", "'f' || (p_size % 6) AS field").union(owned).distinct()
    return program.visible_fields(fields, _closure(spark, sf_dir))


@query("""WITH w AS (SELECT DISTINCT l_partkey AS key, 'S' || l_suppkey AS type FROM lineitem)
SELECT key, count(*) AS n, CASE WHEN count(*) <= 6 THEN string_agg(type, ',' ORDER BY type) END AS types FROM w GROUP BY key""")
def global_types_cap(spark, sf_dir):
    """The types that reach a field, any type beyond a cap."""
    writes = facts.table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS key", "'S' || l_suppkey AS type")
    return program.capped_types(writes, 6).withColumn("types", F.array_join("types", ","))


@query(f"""{_ABOVE}, l AS (SELECT o_orderkey AS key, 'N' || (o_custkey % 25) AS local FROM orders), g AS (SELECT l_orderkey AS key, 'S' || min(l_suppkey) AS global FROM lineitem GROUP BY l_orderkey)
SELECT key, CASE WHEN up.type IS NOT NULL THEN global ELSE local END AS type FROM l LEFT JOIN g USING (key) LEFT JOIN up ON up.type = global AND up.above = local""")
def refine_types(spark, sf_dir):
    """A local type gives way to a narrower global one; an incompatible one is ignored."""
    orders = facts.table(spark, sf_dir, "orders")
    local = orders.selectExpr("o_orderkey AS key", "'N' || (o_custkey % 25) AS local")
    found = facts.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_suppkey").alias("s")).selectExpr("key", "'S' || s AS global")
    return program.refine_types(local, found, _closure(spark, sf_dir))


@query(f"""WITH RECURSIVE {METHODS_SQL}, {EDGES_SQL}, r(node) AS (SELECT method_id FROM methods WHERE class IN ('Brand#1', 'Brand#2') UNION SELECT e.b FROM r JOIN edges e ON e.a = r.node)
SELECT method_id AS node FROM methods WHERE method_id NOT IN (SELECT node FROM r)""")
def unreachable_methods(spark, sf_dir):
    """Methods that no root reaches, which a shrunk program leaves out."""
    methods = facts.methods(spark, sf_dir)
    ids = methods.select(F.col("method_id").alias("node"))
    return program.unreachable(ids, facts.edges(spark, sf_dir), ids.join(methods.where(F.col("class").isin("Brand#1", "Brand#2")).select(F.col("method_id").alias("node")), "node", "left_semi"))


@query(f"""WITH {BODY_SQL}, w AS (SELECT *, last_value(CASE WHEN op = 'signup' THEN pos % 17 END IGNORE NULLS) OVER (PARTITION BY method_id, reg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS constant FROM body)
SELECT method_id, pos, 'via-value:' || coalesce(CAST(constant AS VARCHAR), 'unknown') AS feature FROM w WHERE op = 'click'""")
def constant_argument(spark, sf_dir):
    """The constant last loaded into a call's register, as a feature."""
    before = Window.partitionBy("method_id", "reg").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    loaded = facts.body(spark, sf_dir).withColumn("constant", F.last(F.when(F.col("op") == "signup", F.col("pos") % 17), ignorenulls=True).over(before))
    return loaded.where("op = 'click'").select("method_id", "pos", F.concat(F.lit("via-value:"), F.coalesce(F.col("constant").cast("string"), F.lit("unknown"))).alias("feature"))


@query(f"""WITH {METHODS_SQL}, parts AS (SELECT 'Brand#' || (1 + s_suppkey % 25) AS class, min(s_nationkey) AS permission, bool_or(s_acctbal > 5000) AS exported FROM supplier GROUP BY 1)
SELECT m.method_id, 'Exploitability' AS kind, 'via-' || lower(m.package) AS feature FROM methods m JOIN parts p USING (class) WHERE p.exported AND p.permission > 2 AND m.visibility <> 'private'""")
def manifest_sources(spark, sf_dir):
    """Methods of exported components without a permission become sources, but private ones."""
    components = facts.table(spark, sf_dir, "supplier").groupBy(F.expr("'Brand#' || (1 + s_suppkey % 25)").alias("class")).agg(F.min("s_nationkey").alias("nation"), F.bool_or(F.col("s_acctbal") > 5000).alias("exported"))
    components = components.withColumn("permission", F.when(F.col("nation") <= 2, F.concat(F.lit("P"), F.col("nation").cast("string"))))
    return augment.exported_sources(facts.methods(spark, sf_dir), components)


@query(f"""WITH {CALLS_SQL}, {METHODS_SQL}, registered AS (SELECT DISTINCT t.class FROM calls JOIN methods s ON b = s.method_id AND s.name = 'red widget' JOIN methods t ON a = t.method_id)
SELECT method_id, 'Argument(' || 2 || ')' AS port FROM methods JOIN registered USING (class) WHERE name = 'blue bolt' AND n_params >= 2""")
def receiver_sources(spark, sf_dir):
    """Callbacks of classes that register themselves become sources."""
    methods = facts.methods(spark, sf_dir)
    classes = augment.registering_classes(methods, facts.edges(spark, sf_dir), F.col("name") == "red widget")
    return augment.callback_sources(methods, classes, ["blue bolt"], 2)


@query(f"""WITH RECURSIVE {METHODS_SQL}, {EDGES_SQL}, {SITES_SQL}, t AS (SELECT method_id AS node, n_params = 0 AS exported FROM methods WHERE class = 'Brand#5'),
r(target, exported, node, d) AS (SELECT node, exported, node, 0 FROM t UNION SELECT r.target, r.exported, e.a, d + 1 FROM r JOIN edges e ON e.b = r.node WHERE d < 3),
best AS (SELECT node, target, exported, min(d) AS d FROM r GROUP BY node, target, exported),
one AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, NOT exported, target) AS k FROM best)
SELECT site AS issue, CASE WHEN exported THEN 'via-exported,' WHEN NOT exported THEN 'via-unexported,' ELSE '' END || coalesce('via-class:' || target, '') || CASE WHEN d > 1 THEN ',via-distant' ELSE '' END AS features
FROM sites LEFT JOIN one ON node = callee AND k = 1""")
def issue_class_features(spark, sf_dir):
    """Issues tagged by the nearest component."""
    targets = facts.methods(spark, sf_dir).where("class = 'Brand#5'").select(F.col("method_id").alias("node"), (F.col("n_params") == 0).alias("exported"))
    nearest = graph.nearest(facts.edges(spark, sf_dir), targets, 3)
    issues = facts.sites(spark, sf_dir).selectExpr("site AS issue", "callee AS node")
    return program.component_features(issues, nearest, 1).select("issue", F.array_join("features", ",").alias("features"))


@query(f"WITH {DECLS_SQL} SELECT CASE WHEN type LIKE 'N%' THEN 'nation' ELSE 'supplier' END AS kind, count(*) AS n, count(DISTINCT name) AS names FROM decls GROUP BY 1")
def listing(spark, sf_dir):
    """What a listing command reports."""
    return facts.declarations(spark, sf_dir).groupBy(F.when(F.col("type").startswith("N"), "nation").otherwise("supplier").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


@query("""WITH a AS (SELECT n_nationkey AS id, n_nationkey * 4 AS lo, n_nationkey * 4 + 20 AS hi FROM nation), b AS (SELECT s_suppkey AS id, s_suppkey % 90 AS lo, s_suppkey % 90 + s_suppkey % 7 AS hi FROM supplier)
SELECT a.id AS outer_id, b.id AS inner_id FROM a JOIN b ON a.lo <= b.lo AND b.hi <= a.hi""")
def interval_containment(spark, sf_dir):
    """Subtype tests by nested intervals: a contained interval lies in the bucket of its start."""
    width = 8
    outer = facts.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS outer_id", "n_nationkey * 4 AS alo", "n_nationkey * 4 + 20 AS ahi").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("alo") / width), F.floor(F.col("ahi") / width))))
    inner = facts.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS inner_id", "s_suppkey % 90 AS blo", "s_suppkey % 90 + s_suppkey % 7 AS bhi").withColumn("bucket", F.floor(F.col("blo") / width))
    return outer.join(inner, "bucket").where("alo <= blo AND bhi <= ahi").select("outer_id", "inner_id")
