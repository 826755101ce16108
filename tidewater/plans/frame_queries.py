"""Frames with lattice values, paths with indices, and the algebra of transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import strings
from tidewater.functions.joins import dealt
from tidewater.operators import bodies, flows, frames, kinds, lattice, paths
from tidewater.plans.registry import query
from tidewater.sources import facts
from tidewater.sources.facts import BODY_SQL, CALLS_SQL, METHODS_SQL

_LEAVES = "leaves AS (SELECT method_id AS method, 'K' || (n_params % 2) AS kind, [lower(package), visibility] AS features FROM methods WHERE class = 'Brand#13')"
_HOPS = "hops AS (SELECT DISTINCT a, b, CASE WHEN flag = 'N' AND a < b THEN 0 ELSE 1 END AS cost, CASE WHEN status = 'O' THEN ['via-' || flag] ELSE [] END AS features FROM calls)"


@query(f"""WITH RECURSIVE {METHODS_SQL}, {CALLS_SQL}, {_LEAVES}, {_HOPS},
d(method, kind, d) AS (SELECT method, kind, 0 FROM leaves UNION SELECT h.a, d.kind, d.d + h.cost FROM d JOIN hops h ON h.b = d.method WHERE d.d + h.cost <= 2),
least AS (SELECT method, kind, min(d) AS distance FROM d GROUP BY ALL),
live AS (SELECT h.a, h.b, l.kind, h.features FROM hops h JOIN least l ON l.method = h.b WHERE l.distance + h.cost <= 2),
seen(method, kind, feature) AS (SELECT method, kind, unnest(features) FROM leaves UNION SELECT a, kind, unnest(features) FROM live UNION SELECT v.a, s.kind, s.feature FROM seen s JOIN live v ON v.b = s.method AND v.kind = s.kind),
names AS (SELECT DISTINCT kind, feature FROM seen),
lacks(method, kind, feature) AS (SELECT l.method, l.kind, n.feature FROM leaves l JOIN names n USING (kind) WHERE NOT list_contains(l.features, n.feature)
  UNION SELECT v.a, s.kind, s.feature FROM lacks s JOIN live v ON v.b = s.method AND v.kind = s.kind WHERE NOT list_contains(v.features, s.feature)),
judged AS (SELECT s.method, s.kind, s.feature, l.feature IS NOT NULL AS bare FROM seen s LEFT JOIN lacks l ON l.method = s.method AND l.kind = s.kind AND l.feature = s.feature)
SELECT method, kind, CAST(any_value(distance) AS INTEGER) AS distance, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE bare), '') AS may, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE NOT bare), '') AS always
FROM least LEFT JOIN judged USING (method, kind) GROUP BY method, kind""")
def frames_fixpoint(spark, sf_dir):
    """Frames carried back along calls, some of which cost nothing, with their features."""
    leaves = facts.methods(spark, sf_dir).where("class = 'Brand#13'").selectExpr("method_id AS method", "'K' || (n_params % 2) AS kind", "array(lower(package), visibility) AS features")
    hops = facts.calls(spark, sf_dir).selectExpr("a", "b", "CASE WHEN flag = 'N' AND a < b THEN 0 ELSE 1 END AS cost", "CASE WHEN status = 'O' THEN array('via-' || flag) ELSE CAST(array() AS array<string>) END AS features")
    found = frames.frames_fixpoint(leaves, hops, 2)
    return found.withColumns({"may": F.array_join("may", ","), "always": F.array_join("always", ",")})


_FRAMES = "f AS (SELECT l_partkey AS method, l_returnflag AS kind, l_linenumber AS distance, [l_linestatus, 'm' || (l_suppkey % 3)] AS always, ['p' || (l_linenumber % 2)] AS may FROM lineitem)"


@query(f"""WITH {_FRAMES}, n AS (SELECT method, kind, count(*) AS n, min(distance) AS distance FROM f GROUP BY ALL),
x AS (SELECT method, kind, unnest(always) AS t, true AS sure FROM f UNION ALL SELECT method, kind, unnest(may), false FROM f),
c AS (SELECT method, kind, t, count(*) FILTER (WHERE sure) AS k FROM x GROUP BY ALL)
SELECT method, kind, any_value(n) AS n, any_value(distance) AS distance, coalesce(string_agg(t, ',' ORDER BY t) FILTER (WHERE k < n), '') AS may, coalesce(string_agg(t, ',' ORDER BY t) FILTER (WHERE k = n), '') AS always
FROM n JOIN c USING (method, kind) GROUP BY method, kind""")
def partition_by_kind(spark, sf_dir):
    """Frames merged by kind: features that all have, and that any has."""
    rows = facts.table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS method", "l_returnflag AS kind", "l_linenumber AS distance", "array(l_linestatus, 'm' || (l_suppkey % 3)) AS always", "array('p' || (l_linenumber % 2)) AS may")
    found = frames.partition_by(rows, ["method", "kind"])
    return found.withColumns({"may": F.array_join("may", ","), "always": F.array_join("always", ",")})


# --- paths with indices ----------------------------------------------------------------------

def _tree_sql(name: str, side: int) -> str:
    return f"""{name} AS (SELECT DISTINCT l_partkey AS key, CASE (l_linenumber + l_suppkey) % 5 WHEN 0 THEN [] WHEN 1 THEN ['[*]'] WHEN 2 THEN ['[a' || (l_suppkey % 3) || ']'] WHEN 3 THEN ['[a' || (l_suppkey % 4) || ']', '.g'] ELSE ['[*]', '.g'] END AS path,
  l_returnflag || (l_linenumber % 2) AS element FROM lineitem WHERE l_orderkey % 2 = {side})"""


def _index_tree(spark, sf_dir, side: int):
    path = """CASE (l_linenumber + l_suppkey) % 5 WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array('[*]') WHEN 2 THEN array('[a' || (l_suppkey % 3) || ']') WHEN 3 THEN array('[a' || (l_suppkey % 4) || ']', '.g') ELSE array('[*]', '.g') END AS path"""
    rows = facts.table(spark, sf_dir, "lineitem").where(f"l_orderkey % 2 = {side}").selectExpr("l_partkey AS key", path, "l_returnflag || (l_linenumber % 2) AS element")
    return dealt(rows, "key").distinct()


def _shown(df):
    return df.withColumn("path", F.array_join("path", ""))


_TREE = _tree_sql("tree", 0)
_PRUNE = "SELECT key, array_to_string(path, '') AS path, element FROM {t} x WHERE NOT EXISTS (SELECT 1 FROM {t} y WHERE y.key = x.key AND y.element = x.element AND len(y.path) < len(x.path) AND x.path[1:len(y.path)] = y.path)"
_SPELLED = "SELECT key, path, element FROM {t} UNION SELECT t.key, list_concat([i.step], t.path[2:]), t.element FROM {t} t JOIN {i} i ON i.key = t.key WHERE t.path[1] = '[*]' AND NOT EXISTS (SELECT 1 FROM {t} z WHERE z.key = t.key AND z.path[1] = i.step)"


@query(f"""WITH {_TREE}, listed AS (SELECT DISTINCT key FROM tree WHERE path[1] = '[a1]')
SELECT DISTINCT key, array_to_string(path[2:], '') AS path, element FROM tree WHERE path[1] = '[a1]' UNION SELECT key, '', element FROM tree WHERE len(path) = 0
UNION SELECT key, array_to_string(path[2:], ''), element FROM tree WHERE path[1] = '[*]' AND key NOT IN (SELECT key FROM listed)""")
def path_read_index(spark, sf_dir):
    """An index that a tree does not list is read through ``[*]``."""
    return _shown(paths.read(_index_tree(spark, sf_dir, 0), ["[a1]"]))


@query(f"WITH {_TREE} SELECT DISTINCT key, array_to_string(path[2:], '') AS path, element FROM tree WHERE path[1] = '[a1]'")
def path_raw_read(spark, sf_dir):
    """Without what flows down from ancestors."""
    return _shown(paths.raw_read(_index_tree(spark, sf_dir, 0), ["[a1]"]))


@query(f"""WITH {_TREE}, q AS (SELECT DISTINCT l_partkey AS key, ['[a' || (l_suppkey % 5) || ']', '.g', '.h'] AS path FROM lineitem),
heads AS (SELECT DISTINCT key, path[1:k] AS head FROM tree, unnest(range(0, len(path) + 1)) AS t(k)), fit AS (SELECT q.key, q.path, max(len(head)) AS n FROM q JOIN heads ON heads.key = q.key AND q.path[1:len(head)] = head GROUP BY ALL)
SELECT key, array_to_string(path[1:n], '') AS found, array_to_string(path[n + 1:], '') AS remainder FROM fit""")
def path_raw_read_longest(spark, sf_dir):
    """The longest part of a path that a tree has, and the rest."""
    queries = facts.table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS key", "array('[a' || (l_suppkey % 5) || ']', '.g', '.h') AS path").distinct()
    found = paths.raw_read_longest(_index_tree(spark, sf_dir, 0), queries)
    return found.select("key", F.array_join("found", "").alias("found"), F.array_join("remainder", "").alias("remainder"))


@query(f"""WITH {_TREE}, keys AS (SELECT DISTINCT key, '[a2]' AS step FROM tree WHERE key % 2 = 0), spelled AS ({_SPELLED.format(t='tree', i='keys')}), more AS (SELECT * FROM spelled UNION SELECT key, ['[a2]'], 'new' FROM keys) {_PRUNE.format(t='more')}""")
def path_write_index_weak(spark, sf_dir):
    """A new index starts as a copy of ``[*]``."""
    tree = _index_tree(spark, sf_dir, 0)
    return _shown(paths.write_index(tree, tree.where("key % 2 = 0").select("key", F.lit("new").alias("element")).distinct(), ["[a2]"]))


@query(f"""WITH {_TREE}, keys AS (SELECT DISTINCT key FROM tree WHERE key % 2 = 0), targets AS (SELECT key, '[*]' AS step FROM keys UNION SELECT DISTINCT key, path[1] FROM tree WHERE key % 2 = 0 AND starts_with(path[1], '[')),
more AS (SELECT * FROM tree UNION SELECT key, [step], 'new' FROM targets) {_PRUNE.format(t='more')}""")
def path_write_index_strong(spark, sf_dir):
    """A strong write through ``[*]`` goes to every index and replaces nothing."""
    tree = _index_tree(spark, sf_dir, 0)
    return _shown(paths.write_index(tree, tree.where("key % 2 = 0").select("key", F.lit("new").alias("element")).distinct(), ["[*]"], strong=True))


_TWO = f"""{_tree_sql('l0', 0)}, {_tree_sql('r0', 1)}, li AS (SELECT DISTINCT key, path[1] AS step FROM l0 WHERE starts_with(path[1], '[a')), ri AS (SELECT DISTINCT key, path[1] AS step FROM r0 WHERE starts_with(path[1], '[a')),
l1 AS ({_SPELLED.format(t='l0', i='ri')}), r1 AS ({_SPELLED.format(t='r0', i='li')}), both_ AS (SELECT * FROM l1 UNION SELECT * FROM r1)"""


@query(f"WITH {_TWO} {_PRUNE.format(t='both_')}")
def path_merge_index(spark, sf_dir):
    """An index of one tree meets the ``[*]`` of the other."""
    return _shown(paths.merge(_index_tree(spark, sf_dir, 0), _index_tree(spark, sf_dir, 1), 2))


@query(f"""WITH {_TWO}, m AS ({_PRUNE.format(t='both_')}), r AS ({_PRUNE.format(t='r1')}), more AS (SELECT DISTINCT key FROM (SELECT * FROM m EXCEPT SELECT * FROM r))
SELECT key, key NOT IN (SELECT key FROM more) AS leq FROM (SELECT key FROM l0 UNION SELECT key FROM r0)""")
def path_leq(spark, sf_dir):
    """Whether a tree adds nothing to another."""
    return paths.leq(_index_tree(spark, sf_dir, 0), _index_tree(spark, sf_dir, 1), 2)


@query(f"""WITH {_TREE}, p AS (SELECT DISTINCT key, path FROM tree WHERE len(path) > 0),
leaves AS (SELECT * FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.key = x.key AND len(y.path) > len(x.path) AND y.path[1:len(x.path)] = x.path)),
cuts AS (SELECT key, k, count(DISTINCT path[1:k]) AS n FROM leaves, unnest(range(1, 3)) AS t(k) GROUP BY key, k), h AS (SELECT key, min(k) - 1 AS height FROM cuts WHERE n > 4 GROUP BY key)
SELECT key, array_to_string(path[1:coalesce(height, 9)], '') AS path, element, bool_or(len(path) > coalesce(height, 9)) AS broadened FROM tree LEFT JOIN h USING (key) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY key, array_to_string(path[1:coalesce(height, 9)], ''), element"))
def path_cut_leaves(spark, sf_dir):
    """Trees with too many leaves are cut to the height that leaves few."""
    return _shown(paths.cut_to_leaves(_index_tree(spark, sf_dir, 0), 4, 2))


@query("""SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN '.f[c' || (o_custkey % 7) || ']' WHEN 1 THEN '.f[*]' ELSE '.f[k]' END AS path FROM orders""")
def path_resolve_arguments(spark, sf_dir):
    """An index named by an argument becomes its constant, or any."""
    step = F.when(F.col("o_custkey") % 3 == 2, "[k]").otherwise("[<Argument(1)>]")
    constants = F.when(F.col("o_custkey") % 3 == 0, F.create_map(F.lit(1), F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")))).otherwise(F.create_map(F.lit(2), F.lit("x")))
    path = paths.resolve_arguments(F.array(F.lit(".f"), step), constants)
    return facts.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(path, "").alias("path"))


# --- transforms ------------------------------------------------------------------------------

_LIST = "[ CASE (s_suppkey // i) % 4 WHEN 0 THEN 'T' || i WHEN 1 THEN '!source:' || chr(CAST(97 + (s_suppkey + i) % 3 AS INTEGER)) ELSE '!sink:' || chr(CAST(97 + (s_suppkey * i) % 3 AS INTEGER)) END FOR i IN range(1, 7) ]"


def _lists(spark, sf_dir):
    item = lambda i: F.expr(f"CASE (s_suppkey div {i}) % 4 WHEN 0 THEN 'T' || {i} WHEN 1 THEN '!source:' || char(97 + (s_suppkey + {i}) % 3) ELSE '!sink:' || char(97 + (s_suppkey * {i}) % 3) END")
    return facts.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(*map(item, range(1, 7))).alias("t"))


@query(f"""WITH l AS (SELECT s_suppkey AS id, {_LIST} AS t FROM supplier), e AS (SELECT id, i, t[i] AS x, starts_with(t[i], '!') AS s, sum(CASE WHEN starts_with(t[i], '!') THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS g FROM l, unnest(range(1, 7)) AS u(i)),
d AS (SELECT id, g, s, x, min(i) AS i FROM e GROUP BY id, g, s, x) SELECT id, string_agg(x, ',' ORDER BY g, s, x) AS canonical FROM d GROUP BY id""")
def transform_canonical_list(spark, sf_dir):
    """Neighbouring sanitizers merge into a set."""
    return _lists(spark, sf_dir).select("id", F.array_join(kinds.canonical_list(F.col("t")), ",").alias("canonical"))


@query(f"SELECT s_suppkey AS id, array_to_string(list_filter({_LIST}, lambda x: NOT starts_with(x, '!source:')), ',') AS forward, array_to_string(list_filter({_LIST}, lambda x: NOT starts_with(x, '!sink:')), ',') AS backward FROM supplier")
def transform_discard_unmatched(spark, sf_dir):
    rows = _lists(spark, sf_dir)
    return rows.select("id", F.array_join(kinds.discard_unmatched(F.col("t"), True), ",").alias("forward"), F.array_join(kinds.discard_unmatched(F.col("t"), False), ",").alias("backward"))


@query(f"""WITH l AS (SELECT s_suppkey AS id, {_LIST} AS t FROM supplier), k AS (SELECT id, t, coalesce(list_max(list_filter([ CASE WHEN starts_with(t[i], '!') THEN 0 ELSE i END FOR i IN range(1, 7) ], lambda x: x > 0)), 0) AS last FROM l)
SELECT id, array_to_string(list_concat(t[1:last], list_filter(t[last + 1:], lambda x: x NOT IN ('!sink:a', '!source:b'))), ',') AS kept FROM k""")
def transform_filter_global(spark, sf_dir):
    """Sanitizers at the end of a list that the list ahead has already."""
    held = F.array(F.lit("!sink:a"), F.lit("!source:b"), F.lit("T"), F.lit("!sink:b"))
    return _lists(spark, sf_dir).select("id", F.array_join(kinds.filter_global(F.col("t"), held), ",").alias("kept"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN 'SAT[' || c_mktsegment || '],T' || (c_custkey % 4) END AS transforms FROM customer")
def source_as_transform(spark, sf_dir):
    """A matched source that the sink carries on; a list carries one at most."""
    sink = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("SAT[X]"))).otherwise(F.array(F.concat(F.lit("T"), (F.col("c_custkey") % 4).cast("string"))))
    return facts.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(kinds.source_as_transform(F.col("c_mktsegment"), sink), ",").alias("transforms"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'T1:T2@' ELSE '' END || CASE s_suppkey % 2 WHEN 0 THEN 'G1:' ELSE '' END || 'Kind' || (s_suppkey % 4) || CASE s_suppkey % 5 WHEN 0 THEN '(sub)' ELSE '' END AS kind FROM supplier")
def kind_print(spark, sf_dir):
    """A kind parsed and printed is itself."""
    text = F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'T1:T2@' ELSE '' END || CASE s_suppkey % 2 WHEN 0 THEN 'G1:' ELSE '' END || 'Kind' || (s_suppkey % 4) || CASE s_suppkey % 5 WHEN 0 THEN '(sub)' ELSE '' END")
    return facts.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), kinds.print_kind(kinds.parse_kind(text)).alias("kind"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'T:U:G' ELSE 'T:U' END AS \"global\", 0 AS n_local FROM customer")
def kind_hop(spark, sf_dir):
    """On a call the local transforms move ahead of the global ones."""
    rows = facts.table(spark, sf_dir, "customer")
    local, global_ = kinds.hop(F.array(F.lit("T"), F.lit("U")), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("G"))).otherwise(F.array().cast("array<string>")))
    return rows.select(F.col("c_custkey").alias("id"), F.array_join(global_, ":").alias("global"), F.size(local).alias("n_local"))


# --- bodies, fields, traces and texts --------------------------------------------------------


@query(f"""WITH {BODY_SQL}, w AS (SELECT *, last_value(CASE WHEN op IN ('view', 'error', 'signup') THEN pos END IGNORE NULLS) OVER (PARTITION BY method_id, reg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_pos FROM body)
SELECT DISTINCT method_id, reg FROM w WHERE op = 'purchase' AND last_pos IS NULL""")
def body_infer_sinks(spark, sf_dir):
    """Parameters that reach a sink unwritten."""
    return bodies.infer_sinks(facts.body(spark, sf_dir), ["view", "error", "signup"], "purchase")


@query(f"""WITH {BODY_SQL}, w AS (SELECT *, last_value(CASE WHEN op IN ('view', 'error') THEN op END IGNORE NULLS) OVER (PARTITION BY method_id, reg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_op FROM body)
SELECT DISTINCT method_id, reg FROM w WHERE op = 'click' AND last_op = 'view'""")
def body_infer_generations(spark, sf_dir):
    """Results that a source wrote last."""
    return bodies.infer_generations(facts.body(spark, sf_dir), "view", ["error"], "click")


@query("""WITH m AS (SELECT s_suppkey AS field, ['K' || (s_suppkey % 3)] AS kinds FROM supplier WHERE s_acctbal > 0)
SELECT l_orderkey * 10 + l_linenumber AS site, l_suppkey AS field, coalesce(array_to_string(kinds, ','), '') AS kinds FROM lineitem LEFT JOIN m ON m.field = l_suppkey""")
def field_model_join(spark, sf_dir):
    """Field accesses with their model, an empty one where there is none."""
    accesses = facts.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS site", "l_suppkey AS field")
    models = facts.table(spark, sf_dir, "supplier").where("s_acctbal > 0").selectExpr("s_suppkey AS field", "array('K' || (s_suppkey % 3)) AS kinds")
    return flows.with_field_models(accesses, models).select("site", "field", F.array_join("kinds", ",").alias("kinds"))


@query(f"""WITH RECURSIVE {METHODS_SQL}, {CALLS_SQL}, f AS (SELECT DISTINCT a AS method, flag AS kind, b AS callee FROM calls WHERE status = 'F'),
r(method, kind) AS (SELECT method_id, 'A' FROM methods WHERE class = 'Brand#7' UNION SELECT f.callee, f.kind FROM r JOIN f ON f.method = r.method AND f.kind = r.kind) SELECT method, kind FROM r""")
def issue_trace_methods(spark, sf_dir):
    """All methods that the traces of issues run through."""
    frames_ = facts.calls(spark, sf_dir).where("status = 'F'").selectExpr("a AS method", "flag AS kind", "b AS callee").distinct()
    issues = facts.methods(spark, sf_dir).where("class = 'Brand#7'").selectExpr("method_id AS method", "'A' AS kind")
    return flows.issue_methods(issues, frames_)


@query("""SELECT method, position FROM (SELECT method, position, row_number() OVER (PARTITION BY method ORDER BY position) AS k FROM (SELECT DISTINCT l_partkey AS method, l_orderkey AS position FROM lineitem)) WHERE k <= 20""")
def first_positions(spark, sf_dir):
    """Twenty positions of a frame at most."""
    return lattice.first_positions(facts.table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS method", "l_orderkey AS position"), ["method"])


@query(f"WITH {_TREE} SELECT key, '' AS path, element, bool_or(len(path) > 0) AS broadened FROM tree GROUP BY key, element")
def path_collapse_root(spark, sf_dir):
    """All elements at the root."""
    return _shown(paths.collapse_deeper(_index_tree(spark, sf_dir, 0), 0))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, array_to_string(list_sort(list_distinct(list_filter([l_returnflag, 'm' || (l_suppkey % 2), 'p'], lambda x: x NOT IN (l_linestatus, 'm1')))), ',') AS may,
array_to_string(list_sort(list_distinct([l_linestatus, 'm1'])), ',') AS always FROM lineitem""")
def features_joined(spark, sf_dir):
    """Features added in sequence: what either has for sure is always there."""
    left = F.struct(F.array("l_returnflag", F.concat(F.lit("m"), (F.col("l_suppkey") % 2).cast("string"))).alias("may"), F.array("l_linestatus").alias("always"))
    right = F.struct(F.array(F.lit("p")).alias("may"), F.array(F.lit("m1")).alias("always"))
    both = lattice.add_features(left, right)
    return facts.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.array_join(both["may"], ",").alias("may"), F.array_join(both["always"], ",").alias("always"))


_NAME = "'La/' || replace(p_name, ' ', '$') || '$' || (p_size % 3) || ';'"


@query(f"""SELECT p_partkey AS id, 'La/' || replace(p_name, ' ', '$') || ';' AS out, 'La/' || split_part(p_name, ' ', 1) || ';' AS outer_class, {_NAME} || '||f:()V' AS barred, {_NAME} AS class,
'via-' || p_type || '-' || CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE p_brand END AS filled FROM part""")
def signature_texts(spark, sf_dir):
    """Inner classes, separators and markers."""
    from tidewater.operators.augment import outer_class

    name = F.expr(_NAME)
    signature = F.concat(name, F.lit(".f:()V"))
    brand = F.when(F.col("p_size") % 4 != 0, F.col("p_brand"))
    return facts.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), strings.one_level_out(name).alias("out"), outer_class(name).alias("outer_class"), strings.barred(signature).alias("barred"),
                                                     strings.class_of(signature).alias("class"), strings.filled(F.lit("via-%type%-%brand%"), {"type": F.col("p_type"), "brand": brand}).alias("filled"))


@query("""SELECT c_custkey AS id, c_custkey % 4 AS "first", c_custkey % 4 + length(c_mktsegment) + CASE WHEN c_custkey % 2 = 0 THEN 6 ELSE 4 END - 1 AS "last",
CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 + length(c_mktsegment) + 5 END AS closing FROM customer""")
def source_line_bounds(spark, sf_dir):
    """The bounds of a line's text, and of a call's arguments."""
    call = F.concat(F.lpad(F.lit(""), (F.col("c_custkey") % 4).cast("int"), " "), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "(a(b))").otherwise("(a(b"), F.lit("  "))
    bounds, opening = strings.text_bounds(call), ((F.col("c_custkey") % 4) + F.length("c_mktsegment")).cast("int")
    return facts.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), bounds["first"].alias("first"), bounds["last"].alias("last"), strings.closing_paren(call, opening).alias("closing"))
