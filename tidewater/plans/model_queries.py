"""Constraints with nested types, parameters and fields, JSON generators, templates and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.predicates import INFORMED, field_where, where, with_type_infos
from tidewater.operators import augment, graph, reports, templates
from tidewater.plans.registry import query
from tidewater.sources import facts, generators, models
from tidewater.sources.facts import CALLS_SQL, EDGES_SQL, METHODS_SQL, TYPES_SQL

# --- types, parameters and fields ------------------------------------------------------------

_FLAGS = ["type LIKE 'S%' OR type LIKE 'C%' AS is_class", "type LIKE 'R%' AS is_interface", "type LIKE 'N%' AS is_enum"]
_UP = f"WITH RECURSIVE {TYPES_SQL}, up(type, above) AS (SELECT type, super FROM types WHERE super <> 'Object' UNION SELECT up.type, types.super FROM up JOIN types ON up.above = types.type WHERE types.super <> 'Object')"
_KNOWN = f"{_UP}, infos AS (SELECT type, super, {', '.join(_FLAGS)} FROM types)"

#: Methods whose class, result and parameters are types of the hierarchy.
_TYPED = [
    "p_partkey AS method_id", "p_name AS name", "p_size % 7 <> 0 AS has_code", "p_size % 2 = 0 AS is_static",
    "'N' || (p_partkey % 25) AS class", "CASE p_partkey % 4 WHEN 0 THEN 'V' ELSE 'S' || (1 + p_partkey % 90) END AS ret",
]
_TYPED_SQL = f"typed AS (SELECT {', '.join(_TYPED)}, [ CASE i WHEN 1 THEN 'R' || (p_partkey % 5) ELSE 'N' || ((p_partkey + i) % 25) END FOR i IN range(1, p_size % 5 + 1) ] AS params FROM part)"
_FIELDS = ["c_custkey AS field_id", "'f' || (c_custkey % 40) AS name", "'N' || c_nationkey AS class", "c_mktsegment AS type", "c_custkey % 2 = 0 AS is_static"]
_FIELDS_SQL = f"fields AS (SELECT {', '.join(_FIELDS)} FROM customer)"


def _infos(spark, sf_dir):
    types = facts.types(spark, sf_dir)
    closure = graph.extends_closure(types)
    named = types.withColumnRenamed("type", "class")
    notes = "array(named_struct('type', 'Kind', 'value', substr(type, 1, 1))) AS annotations"
    return graph.with_ancestors(named, closure).withColumnRenamed("class", "type").selectExpr("type", "super", "ancestors", *_FLAGS, notes)


def _typed(spark, sf_dir):
    n = F.col("p_size") % 5
    params = F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.when(i == 1, F.concat(F.lit("R"), (F.col("p_partkey") % 5).cast("string"))).otherwise(F.concat(F.lit("N"), ((F.col("p_partkey") + i) % 25).cast("string")))))
    parts = facts.table(spark, sf_dir, "part").selectExpr("*").withColumn("params", F.coalesce(params, F.array().cast("array<string>")))
    return with_type_infos(parts.selectExpr(*_TYPED, "params", "size(params) AS n_params"), _infos(spark, sf_dir))


def _picked(spark, sf_dir, constraint):
    return _typed(spark, sf_dir).where(where(constraint, INFORMED)).select("method_id")


@query("SELECT p_partkey AS method_id FROM part WHERE regexp_full_match(p_name, '[gG]re+n .*') OR regexp_full_match(p_name, 'bl+ue .*')")
def where_regex_plus(spark, sf_dir):
    """A repeated character ends a run: 'blue' matches though 'bl+ue' stands nowhere in it."""
    inners = [{"constraint": "name", "pattern": "[gG]re+n .*"}, {"constraint": "name", "pattern": "bl+ue .*"}]
    return facts.methods(spark, sf_dir).where(where({"constraint": "any_of", "inners": inners})).select("method_id")


@query(f"{_KNOWN}, {_TYPED_SQL} SELECT method_id FROM typed WHERE class IN (SELECT type FROM up WHERE above IN ('R1', 'R3'))")
def where_type_extends(spark, sf_dir):
    return _picked(spark, sf_dir, {"constraint": "parent", "inner": {"constraint": "extends", "include_self": False, "inner": {"constraint": "name", "pattern": "R[13]"}}})


@query(f"{_KNOWN}, {_TYPED_SQL} SELECT method_id FROM typed JOIN infos ON type = ret WHERE NOT (super = 'N3' OR super = 'N4') AND is_class")
def where_type_super(spark, sf_dir):
    """Results whose direct super is neither of two, among the classes."""
    two = {"constraint": "any_of", "inners": [{"constraint": "name", "pattern": "N3"}, {"constraint": "name", "pattern": "N4"}]}
    return _picked(spark, sf_dir, {"constraint": "return", "inner": {"constraint": "all_of", "inners": [{"constraint": "is_class"}, {"constraint": "not", "inner": {"constraint": "super", "inner": two}}]}})


@query(f"{_KNOWN}, {_TYPED_SQL} SELECT method_id FROM typed WHERE NOT EXISTS (SELECT 1 FROM infos WHERE type = ret AND substr(type, 1, 1) = 'S')")
def where_type_annotation(spark, sf_dir):
    """Results without an annotation; of 'V' nothing is known, so it has none."""
    return _picked(spark, sf_dir, {"constraint": "not", "inner": {"constraint": "return", "inner": {"constraint": "has_annotation", "type": "Kind", "pattern": "S"}}})


@query(f"{_KNOWN}, {_TYPED_SQL} SELECT method_id FROM typed WHERE len(params) > 1 AND (params[2] IN (SELECT type FROM up WHERE above = 'R2') OR params[2] = 'R2')")
def where_parameter_type(spark, sf_dir):
    return _picked(spark, sf_dir, {"constraint": "parameter", "idx": 1, "inner": {"constraint": "extends", "inner": {"constraint": "name", "pattern": "R2"}}})


@query(f"{_KNOWN}, {_TYPED_SQL} SELECT method_id FROM typed WHERE len(list_filter(params[2:], lambda p: p IN ('N7', 'N8'))) > 0 AND len(params) <= 3")
def where_any_parameter_type(spark, sf_dir):
    names = {"constraint": "any_of", "inners": [{"constraint": "name", "pattern": "N7"}, {"constraint": "all_of", "inners": [{"constraint": "is_enum"}, {"constraint": "name", "pattern": "N8"}]}]}
    return _picked(spark, sf_dir, [{"constraint": "any_parameter", "start_idx": 1, "inner": names}, {"constraint": "number_parameters", "inner": {"constraint": "<=", "value": 3}}])


@query(f"{_KNOWN}, {_TYPED_SQL} SELECT method_id FROM typed WHERE regexp_full_match(class || '.' || name || ':(' || array_to_string(params, '') || ')' || ret, 'N1\\..*:\\(R[0-2].*\\)S.*')")
def where_signature_full(spark, sf_dir):
    return _picked(spark, sf_dir, {"constraint": "signature_pattern", "pattern": r"N1\..*:\(R[0-2].*\)S.*"})


def _fields(spark, sf_dir):
    return with_type_infos(facts.table(spark, sf_dir, "customer").selectExpr(*_FIELDS), _infos(spark, sf_dir), "field_id", returned=False, parameters=False)


@query(f"{_KNOWN}, {_FIELDS_SQL} SELECT field_id FROM fields JOIN types ON types.type = class WHERE super = 'R1' AND NOT is_static")
def where_field_parent(spark, sf_dir):
    wanted = [{"constraint": "parent", "inner": {"constraint": "super", "inner": {"constraint": "name", "pattern": "R1"}}}, {"constraint": "is_static", "value": False}]
    return _fields(spark, sf_dir).where(field_where(wanted, INFORMED)).select("field_id")


@query(f"WITH {_FIELDS_SQL} SELECT field_id FROM fields WHERE regexp_full_match(class || '.' || name || ':' || type, 'N[12]\\.f3.?:(BUILDING|MACHINERY)') OR name = 'f7'")
def where_field_signature(spark, sf_dir):
    wanted = {"constraint": "any_of", "inners": [{"constraint": "signature", "pattern": r"N[12]\.f3.?:(BUILDING|MACHINERY)"}, {"constraint": "name", "pattern": "f7"}]}
    return _fields(spark, sf_dir).where(field_where(wanted, INFORMED)).select("field_id")


# --- templates and generators ----------------------------------------------------------------

_MODEL = {
    "propagation": [{"input": "Argument(1)", "output": "Return", "features": ["via-x"]}, {"input": "Argument(2)", "output": "Argument(0)", "collapse": False, "transforms": ["T1", "T2"]}],
    "sanitizers": [{"sanitize": "sources", "kinds": ["A", "B"]}, {"sanitize": "sinks", "port": "Argument(1)"}],
    "attach_to_sinks": [{"port": "Argument(1)", "features": ["y", "z"]}],
    "add_features_to_arguments": [{"port": "Argument(0)", "features": ["w"]}],
    "sources": [{"kind": "K", "subkind": "s", "port": "Argument(1)"}, {"kind": "K"}],
    "modes": ["skip-analysis"],
}
_MODEL_SQL = """(VALUES ('propagation', NULL, 'Argument(1)', 'Return', 'via-x'), ('propagation', 'T1:T2', 'Argument(2)', 'Argument(0)', 'no-collapse'),
 ('sanitize_sources', 'A', NULL, NULL, ''), ('sanitize_sources', 'B', NULL, NULL, ''), ('sanitize_sinks', NULL, 'Argument(1)', NULL, ''),
 ('attach_to_sinks', NULL, 'Argument(1)', NULL, 'y,z'), ('add_features_to_arguments', NULL, 'Argument(0)', NULL, 'w'),
 ('parameter_sources', 'K(s)', 'Argument(1)', NULL, ''), ('generations', 'K', 'Return', NULL, ''), ('modes', 'skip-analysis', NULL, NULL, '')) AS t(role, kind, port, output, features)"""


@query(f"WITH {METHODS_SQL} SELECT method_id AS id, role, kind, port, output, features FROM methods, {_MODEL_SQL} WHERE class = 'Brand#4'")
def template_rows(spark, sf_dir):
    """Every part of a template that does not depend on its method."""
    matched = facts.methods(spark, sf_dir).where("class = 'Brand#4'")
    return templates.instantiate(matched, _MODEL).withColumn("features", F.array_join("features", ","))


_GENERATORS = [
    {"find": "methods", "where": [{"constraint": "parent", "inner": {"constraint": "extends", "inner": {"constraint": "name", "pattern": "R1"}}}, {"constraint": "has_code"}], "model": {"sinks": [{"kind": "Log", "port": "Argument(1)"}]}},
    {"find": "methods", "where": [{"constraint": "any_of", "inners": [{"constraint": "name", "pattern": "red .*"}, {"constraint": "return", "inner": {"constraint": "is_class"}}]}],
     "model": {"for_all_parameters": [{"variable": "x", "where": [{"constraint": "not", "inner": {"constraint": "is_interface"}}], "sources": [{"kind": "Given", "port": "Argument(x)"}]}]}},
]


@query(f"""{_KNOWN}, {_TYPED_SQL}
SELECT 'methods' AS find, method_id AS id, 'sinks' AS role, 'Log' AS kind, 'Argument(1)' AS port FROM typed WHERE has_code AND class IN (SELECT type FROM up WHERE above = 'R1')
UNION ALL SELECT 'methods', method_id, 'parameter_sources', 'Given', 'Argument(' || (i - 1) || ')' FROM typed, unnest(range(1, len(params) + 1)) AS t(i)
WHERE (regexp_full_match(name, 'red .*') OR ret IN (SELECT type FROM infos WHERE is_class)) AND params[i] NOT LIKE 'R%'""")
def generator_json_methods(spark, sf_dir):
    """Generators as users write them, over the whole table of methods."""
    return generators.run_generators(_GENERATORS, _typed(spark, sf_dir)).select("find", "id", "role", "kind", "port")


@query(f"""{_KNOWN}, {_FIELDS_SQL} SELECT 'fields' AS find, field_id AS id, 'sinks' AS role, 'Kept' AS kind FROM fields JOIN types ON types.type = class WHERE super = 'R2' AND name = 'f9'
UNION ALL SELECT 'fields', field_id, 'generations', 'Static' FROM fields WHERE is_static AND type = 'BUILDING'""")
def generator_json_fields(spark, sf_dir):
    config = [
        {"find": "fields", "where": [{"constraint": "parent", "inner": {"constraint": "super", "inner": {"constraint": "name", "pattern": "R2"}}}, {"constraint": "name", "pattern": "f9"}], "model": {"sinks": [{"kind": "Kept"}]}},
        {"find": "fields", "where": [{"constraint": "is_static"}, {"constraint": "signature", "pattern": ".*:BUILDING"}], "model": {"sources": [{"kind": "Static"}]}},
    ]
    return generators.run_generators(config, _typed(spark, sf_dir), _fields(spark, sf_dir)).select("find", "id", "role", "kind")


@query(f"{_KNOWN}, {_TYPED_SQL} SELECT method_id, 'Argument(' || i || ')' AS input, 'Argument(0)' AS output FROM typed, unnest(range(1, len(params) + 1)) AS t(i) WHERE NOT has_code AND NOT is_static AND (name LIKE 'small%' OR name LIKE 'large%')")
def generator_taint_in_taint_this(spark, sf_dir):
    return augment.setters(_typed(spark, sf_dir), ["small", "large"])


@query(f"{_KNOWN}, {_TYPED_SQL} SELECT method_id, 'Argument(' || i || ')' AS input, 'Return' AS output, f AS feature FROM typed, unnest(range(0, len(params))) AS t(i), (VALUES ('via-obscure-taint-in-taint-out')) AS v(f) WHERE NOT has_code AND ret <> 'V'")
def generator_pass_through_typed(spark, sf_dir):
    """Results of type void pass nothing on."""
    return augment.pass_through(_typed(spark, sf_dir), [], "ret")


@query(f"""WITH {METHODS_SQL}, p AS (SELECT DISTINCT 'Brand#' || (1 + s_suppkey % 25) AS class FROM supplier WHERE s_acctbal > 9000), f AS (SELECT * FROM methods JOIN p USING (class) WHERE regexp_full_match(name, '(red|blue) .*'))
SELECT method_id, 'parameter_sources' AS role, 'Argument(' || i || ')' AS port FROM f, unnest(range(1, n_params + 1)) AS t(i) UNION ALL SELECT method_id, 'sinks', 'Return' FROM f""")
def provider_sources(spark, sf_dir):
    providers = facts.table(spark, sf_dir, "supplier").where("s_acctbal > 9000").selectExpr("'Brand#' || (1 + s_suppkey % 25) AS class")
    return augment.provider_models(facts.methods(spark, sf_dir), providers, "(red|blue) .*")


@query(f"""WITH {METHODS_SQL}, s AS (SELECT DISTINCT 'Brand#' || (1 + s_suppkey % 25) AS class FROM supplier WHERE s_acctbal > 8000) SELECT method_id, 'Argument(1)' AS port FROM methods JOIN s USING (class) WHERE name IN ('red widget', 'blue bolt') AND n_params >= 1""")
def service_sources(spark, sf_dir):
    services = facts.table(spark, sf_dir, "supplier").where("s_acctbal > 8000").selectExpr("'Brand#' || (1 + s_suppkey % 25) AS class")
    return augment.callback_sources(facts.methods(spark, sf_dir), services, ["red widget", "blue bolt"], 1)


@query(f"""WITH {METHODS_SQL}, a AS (SELECT DISTINCT 'Brand#' || (1 + s_suppkey % 25) AS class FROM supplier WHERE s_nationkey = 7) SELECT method_id, 'DeepLink' AS kind, 'Argument(1)' AS port FROM methods JOIN a USING (class) WHERE visibility <> 'private'""")
def link_sources(spark, sf_dir):
    annotated = facts.table(spark, sf_dir, "supplier").where("s_nationkey = 7").selectExpr("'Brand#' || (1 + s_suppkey % 25) AS class", "s_name AS value")
    return augment.linked_sources(facts.methods(spark, sf_dir), annotated)


@query("SELECT o_custkey AS method FROM orders GROUP BY o_custkey HAVING bool_and(o_orderstatus = 'F')")
def builder_pattern(spark, sf_dir):
    """Methods that return nothing but their own object."""
    returned = facts.table(spark, sf_dir, "orders").selectExpr("o_custkey AS method", "CASE o_orderstatus WHEN 'F' THEN 'this' ELSE o_orderstatus END AS node")
    return augment.returns_this(returned)


@query(f"""WITH {METHODS_SQL}, {EDGES_SQL}, args AS (SELECT DISTINCT a AS caller, t.class AS type FROM edges JOIN methods t ON t.method_id = b WHERE t.n_params = 4)
SELECT DISTINCT caller, method_id AS callee FROM args JOIN methods ON class = type WHERE class IN ('Brand#3', 'Brand#8') AND NOT is_static AND has_code""")
def anonymous_calls(spark, sf_dir):
    methods = facts.methods(spark, sf_dir)
    # repeated calls go when callers and types are made distinct
    passed = facts.calls(spark, sf_dir).select("a", "b").join(methods.where("n_params = 4").selectExpr("method_id AS b", "class AS type"), "b").selectExpr("a AS caller", "type")
    types = methods.selectExpr("class AS type", "class IN ('Brand#3', 'Brand#8') AS anonymous").distinct()
    return augment.anonymous_calls(passed, types, methods.where("has_code"))


@query(f"""WITH {METHODS_SQL}, s AS (SELECT l_orderkey * 10 + l_linenumber AS site, l_partkey AS callee, 'Brand#' || (1 + l_suppkey % 25) AS type FROM lineitem)
SELECT DISTINCT s.site, t.method_id AS target FROM s JOIN methods m ON s.callee = m.method_id AND m.class = 'Brand#2' JOIN s a ON a.site = s.site JOIN methods t ON t.class = a.type AND t.name = m.name""")
def type_shims(spark, sf_dir):
    """A shim that calls a method of the type of an argument."""
    lines, methods = facts.table(spark, sf_dir, "lineitem"), facts.methods(spark, sf_dir)
    site = "l_orderkey * 10 + l_linenumber AS site"
    arguments = lines.selectExpr(site, "1 AS argument", "'Brand#' || (1 + l_suppkey % 25) AS type")
    shims = methods.where("class = 'Brand#2'").selectExpr("method_id AS shimmed", "1 AS argument", "name")
    return augment.type_shims(lines.selectExpr(site, "l_partkey AS callee"), shims, arguments, methods)


@query("""WITH RECURSIVE d AS (SELECT DISTINCT s_nationkey AS cls, 'c' || (s_suppkey % 5) AS callback FROM supplier), g(a, b) AS (VALUES ('c0', 'c1'), ('c1', 'c2'), ('c2', 'c3'), ('c3', 'c1'), ('c1', 'c4')),
w(cls, a, b) AS (SELECT cls, a, b FROM d JOIN g ON d.callback = a UNION SELECT w.cls, w.a, g.b FROM w JOIN g ON g.a = w.b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.cls = w.cls AND d.callback = w.b))
SELECT cls, w.a, w.b FROM w JOIN d USING (cls) WHERE d.callback = w.b""")
def lifecycle_graph(spark, sf_dir):
    """The calls of a lifecycle graph between the callbacks that a class has."""
    declared = facts.table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS cls", "'c' || (s_suppkey % 5) AS callback").distinct()
    return augment.lifecycle_graph(declared, [("c0", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c1", "c4")])


# --- rules -----------------------------------------------------------------------------------

_RULES_SQL = """rules AS (SELECT r_regionkey AS code, list_sort(list(DISTINCT n_name)) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey)"""


def _rules(spark, sf_dir):
    """A rule for each region: its first nations are sources, the last a sink, and so on."""
    names = facts.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("int").alias("code")).agg(F.array_sort(F.collect_set("n_name")).alias("names"))
    case = "named_struct('sources', slice(names, 2, 1), 'sinks', slice(names, -1, 1), 'effect_sources', slice(names, 3, 1), 'transforms', CAST(array() AS array<string>))"
    return names.selectExpr("code", "slice(names, 1, 2) AS sources", "slice(names, -1, 1) AS sinks", "array('T0', 'T1') AS transforms", "slice(names, 3, 1) AS effect_sources",
                            "map('x', slice(names, 1, 1), 'y', slice(names, 2, 2)) AS multi_sources", "slice(names, -2, 1) AS partial_sinks", f"array({case}) AS cases")


@query(f"""WITH {_RULES_SQL} SELECT code, "case", side, kind FROM (
SELECT code, 0 AS "case", 'source' AS side, unnest(names[1:2]) AS kind FROM rules UNION ALL SELECT code, 0, 'sink', names[-1] FROM rules UNION ALL SELECT code, 0, 'effect_source', names[3] FROM rules
UNION ALL SELECT code, 0, 'transform:0', 'T0' FROM rules UNION ALL SELECT code, 0, 'transform:1', 'T1' FROM rules
UNION ALL SELECT code, 0, 'source:x', names[1] FROM rules UNION ALL SELECT code, 0, 'source:y', unnest(names[2:3]) FROM rules UNION ALL SELECT code, 0, 'partial_sink', names[-2] FROM rules
UNION ALL SELECT code, 1, 'source', names[2] FROM rules UNION ALL SELECT code, 1, 'sink', names[-1] FROM rules UNION ALL SELECT code, 1, 'effect_source', names[3] FROM rules)""")
def rules_parts(spark, sf_dir):
    """All sides of every rule, its labels, partial sinks, effect sources and cases included."""
    return models.rule_parts(_rules(spark, sf_dir)).select("code", "case", "side", "kind")


@query(f"""WITH {_RULES_SQL}, labels AS (SELECT code AS rule, 'x' AS label, names[1] AS kind FROM rules UNION ALL SELECT code, 'y', unnest(names[2:3]) FROM rules),
found AS (SELECT DISTINCT o_orderkey AS site, n_name AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT site, rule FROM found JOIN labels USING (kind) GROUP BY site, rule HAVING count(DISTINCT label) = 2""")
def rules_multi_source(spark, sf_dir):
    """Sites that meet both labels of a rule, the labels read from the rules."""
    from tidewater.operators import flows

    nations = facts.table(spark, sf_dir, "supplier").join(facts.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("kind"))
    found = facts.table(spark, sf_dir, "lineitem").join(nations, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("site"), "kind").distinct()
    return flows.both_labels(found, models.rule_labels(_rules(spark, sf_dir)))


@query(f"""WITH {_RULES_SQL}, pairs AS (SELECT code, unnest(names[1:2]) AS source, names[-1] AS sink FROM rules UNION SELECT code, names[2], names[-1] FROM rules)
SELECT code, source, sink, transforms FROM (SELECT code, unnest(names[1:2]) AS source, names[-1] AS sink, 'T0:T1' AS transforms FROM rules UNION SELECT code, names[2], names[-1], '' FROM rules)""")
def rules_multi_case(spark, sf_dir):
    """A rule and its cases under one code."""
    return models.rule_cases(_rules(spark, sf_dir)).withColumn("transforms", F.array_join("transforms", ":"))


@query(f"""WITH {CALLS_SQL}, used AS (SELECT DISTINCT flag AS kind FROM calls UNION SELECT DISTINCT status FROM calls),
r AS (SELECT o_orderkey AS rule, o_custkey % 2 AS "case", CASE WHEN o_orderkey % 3 = 0 THEN 'source' ELSE 'sink' END AS side, substr(o_orderpriority, 3, 1) AS kind FROM orders UNION ALL SELECT o_orderkey, o_custkey % 2, 'sink', o_orderstatus FROM orders),
s AS (SELECT rule, "case", side, bool_or(kind IN (SELECT kind FROM used)) AS hit FROM r GROUP BY ALL), c AS (SELECT rule, "case", bool_and(hit) AS hit FROM s GROUP BY ALL)
SELECT rule, bool_or(hit) AS covered FROM c GROUP BY rule""")
def rules_coverage_cases(spark, sf_dir):
    """Rules of which some case has a kind in use on every side."""
    orders, calls = facts.table(spark, sf_dir, "orders"), facts.calls(spark, sf_dir)
    case = "o_custkey % 2 AS case"
    rules = orders.selectExpr("o_orderkey AS rule", case, "CASE WHEN o_orderkey % 3 = 0 THEN 'source' ELSE 'sink' END AS side", "substr(o_orderpriority, 3, 1) AS kind").unionByName(orders.selectExpr("o_orderkey AS rule", case, "'sink' AS side", "o_orderstatus AS kind"))
    return reports.rules_coverage(rules, calls.select(F.col("flag").alias("kind")).union(calls.select("status")))


@query("""WITH e AS (SELECT o_custkey AS method, list_sort(list(DISTINCT o_orderstatus)) AS expected, o_custkey % 3 <> 0 AS issue FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
a AS (SELECT o_custkey AS method, list_sort(list(DISTINCT o_orderstatus)) AS actual FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1)
SELECT method, (len(list_filter(expected, lambda x: NOT list_contains(coalesce(actual, []), x))) = 0) = issue AS passed FROM e LEFT JOIN a USING (method)""")
def expected_no_issue(spark, sf_dir):
    """Expectations of an issue, and of none."""
    orders = facts.table(spark, sf_dir, "orders")
    kinds_of = lambda condition: orders.where(condition).groupBy(F.col("o_custkey").alias("method")).agg(F.collect_set("o_orderstatus").alias("kinds"))
    expected = kinds_of("o_orderpriority = '1-URGENT'").withColumn("issue", F.col("method") % 3 != 0)
    return reports.expectations(expected, kinds_of("o_orderpriority <> '1-URGENT'"), ["method"])


@query(f"""WITH {METHODS_SQL}, {EDGES_SQL}, k AS (SELECT l_partkey AS method_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds FROM lineitem GROUP BY 1),
i AS (SELECT b AS method_id, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT a AS method_id, count(*) AS n FROM edges GROUP BY 1)
SELECT method_id, coalesce(kinds, '') AS kinds, coalesce(i.n, 0) AS n_callers, coalesce(o.n, 0) AS n_callees FROM methods LEFT JOIN k USING (method_id) LEFT JOIN i USING (method_id) LEFT JOIN o USING (method_id)""")
def explore_models(spark, sf_dir):
    """What an explorer shows of each method: kinds, callers and callees."""
    frames = facts.table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS method", "l_returnflag AS kind")
    return reports.model_of(frames, facts.edges(spark, sf_dir), facts.methods(spark, sf_dir)).withColumn("kinds", F.array_join("kinds", ","))
