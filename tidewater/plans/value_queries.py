"""Access paths, kinds and transforms, method bodies, local flow, and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.joins import dealt
from tidewater.operators import augment, bodies, kinds, localflow, paths, reports
from tidewater.plans.registry import query
from tidewater.sources import facts
from tidewater.sources.facts import BODY_SQL, CALLS_SQL, METHODS_SQL

# --- paths: the fields of a line item's tree are its order, line and flag -------------------

_TREE_SQL = """tree AS (SELECT DISTINCT l_partkey AS key,
  CASE l_linenumber % 4 WHEN 0 THEN [] WHEN 1 THEN ['.f' || (l_suppkey % 3)] WHEN 2 THEN ['.f' || (l_suppkey % 3), '.g' || (l_orderkey % 3)] ELSE ['.f' || (l_suppkey % 3), '.g' || (l_orderkey % 3), '.h' || (l_orderkey % 2)] END AS path,
  l_returnflag AS element FROM lineitem)"""


def _tree(spark, sf_dir):
    path = """CASE l_linenumber % 4 WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array('.f' || (l_suppkey % 3)) WHEN 2 THEN array('.f' || (l_suppkey % 3), '.g' || (l_orderkey % 3))
      ELSE array('.f' || (l_suppkey % 3), '.g' || (l_orderkey % 3), '.h' || (l_orderkey % 2)) END AS path"""
    return dealt(facts.table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS key", path, "l_returnflag AS element"), "key").distinct()


def _shown(df):
    return df.withColumn("path", F.array_join("path", ""))


@query(f"""WITH {_TREE_SQL} SELECT DISTINCT key, array_to_string(path[2:], '') AS path, element FROM tree WHERE len(path) >= 1 AND path[1] = '.f1'
UNION SELECT key, '' AS path, element FROM tree WHERE len(path) = 0""")
def path_read(spark, sf_dir):
    """The subtree under a field, with what its ancestors hold."""
    return _shown(paths.read(_tree(spark, sf_dir), [".f1"]))


@query(f"""WITH {_TREE_SQL} SELECT key, array_to_string(path, '') AS path, element FROM tree WHERE NOT (len(path) >= 1 AND path[1] = '.f1' AND key % 2 = 0)
UNION SELECT DISTINCT key, '.f1', 'new' FROM tree WHERE key % 2 = 0""")
def path_write_strong(spark, sf_dir):
    """A strong write replaces the subtree."""
    tree = _tree(spark, sf_dir)
    new = tree.where("key % 2 = 0").select("key", F.lit("new").alias("element")).distinct()
    return _shown(paths.write_strong(tree, new, [".f1"]))


_PRUNED = "SELECT key, array_to_string(path, '') AS path, element FROM {t} x WHERE NOT EXISTS (SELECT 1 FROM {t} y WHERE y.key = x.key AND y.element = x.element AND len(y.path) < len(x.path) AND x.path[1:len(y.path)] = y.path)"


@query(f"WITH {_TREE_SQL}, more AS (SELECT * FROM tree UNION SELECT key, ['.f1'] AS path, 'R' AS element FROM tree) {_PRUNED.format(t='more')}")
def path_write_weak(spark, sf_dir):
    """A weak write joins the elements; what an ancestor holds is not repeated."""
    tree = _tree(spark, sf_dir)
    return _shown(paths.write_weak(tree, tree.select("key", F.lit("R").alias("element")).distinct(), [".f1"]))


@query(f"WITH {_TREE_SQL} {_PRUNED.format(t='tree')}")
def path_prune(spark, sf_dir):
    return _shown(paths.prune(_tree(spark, sf_dir)))


@query(f"WITH {_TREE_SQL} SELECT key, array_to_string(path[1:2], '') AS path, element, bool_or(len(path) > 2) AS broadened FROM tree GROUP BY key, array_to_string(path[1:2], ''), element")
def path_collapse(spark, sf_dir):
    return _shown(paths.collapse_deeper(_tree(spark, sf_dir), 2))


@query(f"""WITH {_TREE_SQL}, p AS (SELECT DISTINCT key, path FROM tree WHERE len(path) > 0),
leaves AS (SELECT * FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.key = x.key AND len(y.path) > len(x.path) AND y.path[1:len(x.path)] = x.path)),
cuts AS (SELECT key, k, count(DISTINCT path[1:k]) AS n FROM leaves, unnest(range(1, 4)) AS t(k) GROUP BY key, k)
SELECT key, CAST(min(k) - 1 AS INTEGER) AS height FROM cuts WHERE n > 6 GROUP BY key""")
def path_limit_leaves(spark, sf_dir):
    """The height to which a tree is cut so that few leaves remain."""
    return paths.limit_leaves(_tree(spark, sf_dir), 6, 3)


@query(f"""WITH {_TREE_SQL} SELECT DISTINCT key, array_to_string(list_concat(['.out'], path[2:]), '') AS path, element FROM tree WHERE len(path) = 0 OR path[1] = '.f2'""")
def path_propagate(spark, sf_dir):
    """Elements under an input path move under an output path, with what is left of theirs."""
    tree = _tree(spark, sf_dir)
    rules = tree.select("key").distinct().select("key", F.array(F.lit(".f2")).alias("input"), F.array(F.lit(".out")).alias("output"))
    return _shown(paths.propagate(tree, rules))


@query(f"WITH {_TREE_SQL} SELECT DISTINCT key, CASE WHEN len(path) >= 2 AND path[2] = '.g1' THEN array_to_string(path[1:2], '') WHEN len(path) >= 1 AND path[1] = '.f0' THEN '.f0' ELSE '' END AS path, element FROM (SELECT * FROM tree WHERE len(path) = 0 OR path[1] = '.f0')")
def path_shape(spark, sf_dir):
    """Paths cut to their longest prefix in a mold."""
    tree = _tree(spark, sf_dir).where("size(path) = 0 OR path[0] = '.f0'")
    mold = tree.select("key").distinct().select("key", F.explode(F.array(F.array(F.lit(".f0")), F.array(F.lit(".f0"), F.lit(".g1")))).alias("path"))
    return _shown(paths.shape_with(tree, mold))


@query(f"""WITH {_TREE_SQL} SELECT DISTINCT key, array_to_string(CASE WHEN len(path) >= 2 AND path[1] = '.f0' AND path[2] = '.g2' THEN path[1:1] ELSE path END, '') AS path, element FROM tree""")
def path_drop_invalid(spark, sf_dir):
    """A step that its owner does not declare cuts the path; unknown owners let all pass."""
    fields = spark.createDataFrame([(".f0", ".g0"), (".f0", ".g1")], "owner string, step string")
    return _shown(paths.drop_invalid(_tree(spark, sf_dir), fields))


# --- kinds ----------------------------------------------------------------------------------

_KINDS = ["s_suppkey AS id", "CASE s_suppkey % 3 WHEN 0 THEN 'T1:T2@' WHEN 1 THEN '@' ELSE '!S:T3@' END || CASE s_suppkey % 2 WHEN 0 THEN 'G1:' ELSE '' END || 'Kind' || (s_suppkey % 4) || CASE s_suppkey % 5 WHEN 0 THEN '(sub)' ELSE '' END AS kind"]


@query(f"""WITH k AS (SELECT {', '.join(_KINDS)} FROM supplier), p AS (SELECT id, string_split(split_part(kind, '@', 1), ':') AS l, string_split(split_part(kind, '@', 2), ':') AS r FROM k)
SELECT id, array_to_string(list_filter(l, lambda x: x <> ''), ':') AS local, array_to_string(r[1:len(r) - 1], ':') AS global, regexp_replace(r[-1], '\\(.*\\)$', '') AS base, regexp_extract(r[-1], '\\((.*)\\)$', 1) AS subkind FROM p""")
def kind_trace_parse(spark, sf_dir):
    parsed = facts.table(spark, sf_dir, "supplier").selectExpr(*_KINDS).select("id", kinds.parse_kind(F.col("kind")).alias("k"))
    return parsed.select("id", F.array_join("k.local", ":").alias("local"), F.array_join("k.global", ":").alias("global"), "k.base", "k.subkind")


@query(f"""WITH k AS (SELECT {', '.join(_KINDS)} FROM supplier), p AS (SELECT id, list_filter(string_split(split_part(kind, '@', 1), ':'), lambda x: x <> '') AS l FROM k)
SELECT id, array_to_string(list_filter(list_concat(list_reverse(list_concat(l, ['G'])), ['X', 'Y']), lambda x: NOT starts_with(x, '!')), ':') AS canonical FROM p""")
def transform_canonical(spark, sf_dir):
    """The transforms of a whole flow: the source's reversed, then the sink's, no sanitizers."""
    local = kinds.parse_kind(F.col("kind"))["local"]
    one = lambda *t: F.array(*map(F.lit, t))
    return facts.table(spark, sf_dir, "supplier").selectExpr(*_KINDS).select("id", F.array_join(kinds.canonical_sink(local, one("G"), one("X"), one("Y")), ":").alias("canonical"))


@query("""WITH r AS (SELECT n_nationkey AS rule, [ 'T' || ((n_nationkey + i) % 5) FOR i IN range(0, n_nationkey % 4) ] AS t FROM nation)
SELECT DISTINCT rule, array_to_string(t[s : s + k - 1], ':') AS part FROM r, unnest(range(1, len(t) + 2)) AS a(s), unnest(range(0, len(t) - s + 2)) AS b(k)""")
def transform_partitions(spark, sf_dir):
    """All contiguous parts of each rule's transforms."""
    listed = F.when(F.col("n_nationkey") % 4 > 0, F.transform(F.sequence(F.lit(0), F.col("n_nationkey") % 4 - 1), lambda i: F.concat(F.lit("T"), ((F.col("n_nationkey") + i) % 5).cast("string")))).otherwise(F.array().cast("array<string>"))
    rules = facts.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rule"), listed.alias("transforms"))
    return kinds.useful_parts(rules).select("rule", F.array_join("part", ":").alias("part"))


@query("SELECT c_custkey AS key, c_mktsegment AS base, 'T0:' || t AS transforms FROM (SELECT *, 'T' || (c_custkey % 3) AS t FROM customer) WHERE (c_mktsegment, t) IN (('BUILDING', 'T1'), ('MACHINERY', 'T2'))")
def transform_apply(spark, sf_dir):
    """A transform put ahead of the lists that some rule can still use."""
    rows = facts.table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_mktsegment AS base", "array('T' || (c_custkey % 3)) AS transforms")
    useful = F.broadcast(spark.createDataFrame([("BUILDING", ["T0", "T1"]), ("MACHINERY", ["T0", "T2"])], "base string, transforms array<string>"))
    return kinds.apply_transform(rows, F.lit("T0"), useful).select("key", "base", F.array_join("transforms", ":").alias("transforms"))


@query("""WITH f AS (SELECT DISTINCT l_partkey AS method, l_linestatus AS port, l_returnflag AS kind FROM lineitem)
SELECT * FROM f WHERE NOT (method % 4 = 0 AND port = 'O' AND kind = 'A') AND NOT (method % 4 = 1 AND port = 'F') AND NOT (method % 4 = 2 AND kind = 'R') AND NOT (method % 40 = 3)""")
def sanitizer_anti_join(spark, sf_dir):
    """Flows that no sanitizer stops, for all four of its scopes."""
    rows = facts.table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS method", "l_linestatus AS port", "l_returnflag AS kind").distinct()
    ids = rows.select("method").distinct()
    scopes = [("method % 4 = 0", "O", "A"), ("method % 4 = 1", "F", None), ("method % 4 = 2", None, "R"), ("method % 40 = 3", None, None)]
    sanitizers = None
    for condition, port, kind in scopes:
        part = ids.where(condition).select("method", F.lit(port).cast("string").alias("port"), F.lit(kind).cast("string").alias("kind"))
        sanitizers = part if sanitizers is None else sanitizers.unionByName(part)
    return kinds.drop_sanitized(rows, sanitizers)


@query("SELECT c_custkey AS id, c_mktsegment IN ('BUILDING', 'FURNITURE') OR c_custkey % 6 = 5 AS stopped FROM customer")
def sanitizes_test(spark, sf_dir):
    """Whether the sanitizers at the head of a transform list stop a kind."""
    leading = F.when(F.col("c_custkey") % 6 == 5, F.array(F.lit("!*"), F.lit("T"))).otherwise(F.array(F.lit("!BUILDING"), F.lit("!FURNITURE"), F.lit("T"), F.lit("!MACHINERY")))
    return facts.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), kinds.sanitized(leading, F.col("c_mktsegment")).alias("stopped"))


@query("SELECT o_orderkey AS id, o_orderpriority AS kind FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')")
def kind_prune(spark, sf_dir):
    """Frames of kinds that no rule names leave before any loop."""
    rules = spark.createDataFrame([("1-URGENT", "2-HIGH"), ("5-LOW", "2-HIGH")], "source string, sink string")
    frames = facts.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS kind")
    return kinds.prune_kinds(frames, rules).select("id", "kind")


# --- bodies ---------------------------------------------------------------------------------


@query(f"""WITH {BODY_SQL}, w AS (SELECT *, last_value(CASE WHEN op IN ('view', 'error', 'signup') THEN pos END IGNORE NULLS) OVER (PARTITION BY method_id, reg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_pos FROM body)
SELECT w.method_id, w.pos, w.reg, w.op, b.op AS last_op, w.last_pos FROM w LEFT JOIN body b ON b.pos = w.last_pos WHERE w.op = 'purchase'""")
def last_write_taint(spark, sf_dir):
    """The last write before each read of a register."""
    return bodies.last_write(facts.body(spark, sf_dir), ["view", "error", "signup"], ["purchase"])


@query(f"""WITH {BODY_SQL}, w AS (SELECT *, last_value(CASE WHEN op IN ('view', 'error') THEN pos END IGNORE NULLS) OVER (PARTITION BY method_id, reg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_pos FROM body)
SELECT w.method_id, w.pos, w.reg, w.last_pos AS source_pos FROM w JOIN body b ON b.pos = w.last_pos WHERE w.op = 'purchase' AND b.op = 'view'""")
def body_issue_windows(spark, sf_dir):
    """Sinks reached by a source that nothing cleaned in between."""
    return bodies.tainted_sinks(facts.body(spark, sf_dir), "view", "error", "purchase")


@query(f"WITH {BODY_SQL} SELECT method_id, reg, count(*) AS n_writes, arg_max(op, pos) AS final FROM body WHERE op IN ('view', 'error', 'signup') GROUP BY method_id, reg")
def body_final_state(spark, sf_dir):
    return bodies.fold_states(facts.body(spark, sf_dir), ["view", "error", "signup"])


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS method, 'P' || (l_partkey % 4) AS src, '+f' || (l_orderkey % 3) AS put FROM lineitem WHERE l_returnflag = 'R'),
r AS (SELECT DISTINCT l_suppkey AS method, 'R' || (l_partkey % 3) AS dst, '.f' || (l_orderkey % 4) AS get FROM lineitem WHERE l_returnflag <> 'R')
SELECT DISTINCT method, src, dst FROM e JOIN r USING (method) WHERE substr(put, 2) = substr(get, 2)""")
def localflow_compose(spark, sf_dir):
    """A store into a field of a temporary and a read of the same field cancel."""
    lines = facts.table(spark, sf_dir, "lineitem")
    none = "CAST(array() AS array<string>) AS calls"
    stores = lines.where("l_returnflag = 'R'").selectExpr("l_suppkey AS method", "'P' || (l_partkey % 4) AS src", "'tmp' AS dst", "array('+f' || (l_orderkey % 3)) AS fields", none).distinct()
    reads = lines.where("l_returnflag <> 'R'").selectExpr("l_suppkey AS method", "'tmp' AS src", "'R' || (l_partkey % 3) AS dst", "array('.f' || (l_orderkey % 4)) AS fields", none).distinct()
    temps = lines.selectExpr("l_suppkey AS method", "'tmp' AS node").distinct()
    return localflow.eliminate(stores.unionByName(reads), temps).where("size(fields) = 0").select("method", "src", "dst").distinct()


# --- generators and reports -----------------------------------------------------------------


@query(f"""WITH {METHODS_SQL} SELECT method_id, 'Argument(' || i || ')' AS input, 'Return' AS output, 'via-obscure-taint-in-taint-out' AS feature FROM methods, unnest(range(0, n_params)) AS t(i)
WHERE NOT has_code AND name NOT IN ('red widget', 'small ring')""")
def generator_taint_in_taint_out(spark, sf_dir):
    """Methods without code pass every argument to their result, but for a few known ones."""
    return augment.pass_through(facts.methods(spark, sf_dir), ["red widget", "small ring"])


@query(f"WITH {METHODS_SQL}, n AS (SELECT class, name, count(*) AS n FROM methods GROUP BY class, name) SELECT class, name, n, n >= CASE WHEN class LIKE 'Brand#1%' THEN 10 ELSE 40 END AS no_join FROM n")
def generator_join_override(spark, sf_dir):
    """A mode set where overrides are too many, with a lower limit for platform classes."""
    counts = facts.methods(spark, sf_dir).groupBy("class", "name").agg(F.count(F.lit(1)).alias("n"))
    return augment.join_modes(counts, F.col("class").startswith("Brand#1"))


@query("""WITH d AS (SELECT DISTINCT s_nationkey AS cls, s_suppkey % 5 AS callback FROM supplier), step(i, callback) AS (VALUES (1, 3), (2, 0), (3, 1)),
h AS (SELECT cls, i, step.callback FROM d JOIN step USING (callback)), n AS (SELECT cls FROM h GROUP BY cls HAVING count(*) >= 2)
SELECT cls, CAST(row_number() OVER (PARTITION BY cls ORDER BY i) AS INTEGER) AS step, callback FROM h JOIN n USING (cls)""")
def lifecycle_wrappers(spark, sf_dir):
    """Classes with at least two of a lifecycle's callbacks, which are then called in its order."""
    declared = facts.table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS cls", "s_suppkey % 5 AS callback").distinct()
    steps = spark.createDataFrame([(1, 3), (2, 0), (3, 1)], "i int, callback long")
    return augment.lifecycle_steps(declared, steps).withColumn("callback", F.col("callback").cast("int"))


@query(f"""WITH {METHODS_SQL} SELECT package AS file, bool_or(has_code AND visibility <> 'private') OR NOT bool_or(has_code) AS covered, count(*) FILTER (WHERE has_code) AS n_with_code FROM methods GROUP BY package""")
def files_coverage(spark, sf_dir):
    """Files with an analysed method, or with no implementation at all."""
    return reports.files_coverage(facts.methods(spark, sf_dir).withColumnRenamed("package", "file"), F.col("visibility") != "private")


@query(f"""WITH {CALLS_SQL}, r(rule, side, kind) AS (VALUES (1, 'source', 'A'), (1, 'sink', 'O'), (2, 'source', 'X'), (2, 'sink', 'F'), (3, 'source', 'R'), (3, 'source', 'X'), (3, 'sink', 'F')),
used AS (SELECT flag AS kind FROM calls UNION SELECT status FROM calls), hit AS (SELECT rule, side, bool_or(kind IN (SELECT kind FROM used)) AS hit FROM r GROUP BY rule, side)
SELECT rule, bool_and(hit) AS covered FROM hit GROUP BY rule""")
def rules_coverage(spark, sf_dir):
    """Rules of which every side has a kind in use."""
    rules = spark.createDataFrame([(1, "source", "A"), (1, "sink", "O"), (2, "source", "X"), (2, "sink", "F"), (3, "source", "R"), (3, "source", "X"), (3, "sink", "F")], "rule int, side string, kind string")
    calls = facts.calls(spark, sf_dir)
    used = calls.select(F.col("flag").alias("kind")).union(calls.select("status"))
    return reports.rules_coverage(rules.withColumn("case", F.lit(0)), used)


@query("SELECT rule, arg_min(name, pos) AS name FROM (VALUES (1, 'a', 0), (2, 'b', 1), (1, 'c', 2), (3, 'd', 3)) AS t(rule, name, pos) WHERE rule IN (1, 3) GROUP BY rule")
def rules_loaded(spark, sf_dir):
    """Only the chosen rules; of a repeated code the first."""
    listed = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (1, "c", 2), (3, "d", 3)], "rule int, name string, pos int")
    return listed.where(F.col("rule").isin(1, 3)).groupBy("rule").agg(F.min_by("name", "pos").alias("name"))


@query(f"WITH {METHODS_SQL} SELECT class, count(*) AS n, min(name) AS first_name FROM methods WHERE contains(name, 'bolt') AND regexp_matches(class, '2') GROUP BY class")
def explore_contains(spark, sf_dir):
    found = facts.methods(spark, sf_dir).where(F.col("name").contains("bolt") & F.col("class").rlike("2"))
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


@query("""WITH a AS (SELECT l_partkey AS method, l_returnflag AS kind FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT l_partkey AS method, l_returnflag AS kind FROM lineitem WHERE l_linestatus = 'O')
SELECT 'removed' AS side, method, kind, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY method, kind
UNION ALL SELECT 'added', method, kind, count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY method, kind""")
def model_diff(spark, sf_dir):
    """Rows that one of two results has more often than the other."""
    lines = facts.table(spark, sf_dir, "lineitem")
    a = lines.where("l_linestatus = 'F'").selectExpr("l_partkey AS method", "l_returnflag AS kind")
    b = lines.where("l_linestatus = 'O'").selectExpr("l_partkey AS method", "l_returnflag AS kind")
    return reports.differences(a, b, ["method", "kind"])


@query("""WITH e AS (SELECT o_custkey AS method, list_sort(list(DISTINCT o_orderstatus)) AS expected FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1),
a AS (SELECT o_custkey AS method, list_sort(list(DISTINCT o_orderstatus)) AS actual FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT method, len(list_filter(expected, lambda x: NOT list_contains(coalesce(actual, []), x))) = 0 AS passed FROM e LEFT JOIN a USING (method)""")
def expected_issues(spark, sf_dir):
    """Declared expectations hold if what is expected is among what was found."""
    orders = facts.table(spark, sf_dir, "orders")
    kinds_of = lambda condition, name: orders.where(condition).groupBy(F.col("o_custkey").alias("method")).agg(F.collect_set("o_orderstatus").alias(name))
    both = kinds_of("o_orderkey % 5 = 0", "expected").join(kinds_of("o_orderkey % 2 = 0", "actual"), "method", "left")
    return both.select("method", (F.size(F.array_except("expected", F.coalesce("actual", F.array().cast("array<string>")))) == 0).alias("passed"))
