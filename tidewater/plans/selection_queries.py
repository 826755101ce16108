"""Constraints and templates (selection and projection)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.predicates import where
from tidewater.operators import graph
from tidewater.plans.registry import query
from tidewater.sources import facts
from tidewater.sources.facts import DECLS_SQL, METHODS_SQL, TYPES_SQL

_M = f"WITH {METHODS_SQL}"


def _selected(spark, sf_dir, constraint):
    return facts.methods(spark, sf_dir).where(where(constraint)).select("method_id", "name", "class")


@query(f"{_M} SELECT method_id, name, class FROM methods WHERE regexp_full_match(name, 'red .*')")
def where_name_regex(spark, sf_dir):
    return _selected(spark, sf_dir, {"constraint": "name", "pattern": "red .*"})


@query(f"{_M} SELECT method_id, name, class FROM methods WHERE name = 'red widget'")
def where_name_exact(spark, sf_dir):
    """A pattern without special characters becomes an equality that the scan can use."""
    return _selected(spark, sf_dir, {"constraint": "name", "pattern": "red widget"})


@query(f"{_M} SELECT method_id, name, class FROM methods WHERE name IN ('red widget', 'blue bolt') AND class IN ('Brand#4', 'Brand#7')")
def where_signature_match(spark, sf_dir):
    return _selected(spark, sf_dir, {"constraint": "signature_match", "names": ["red widget", "blue bolt"], "parents": ["Brand#4", "Brand#7"]})


@query(f"{_M} SELECT method_id, name, class FROM methods WHERE regexp_full_match(class || '.' || name, 'Brand#1[0-9]\\..*bolt')")
def where_signature_pattern(spark, sf_dir):
    return _selected(spark, sf_dir, {"constraint": "signature_pattern", "pattern": r"Brand#1[0-9]\..*bolt"})


@query(f"{_M} SELECT method_id, name, class FROM methods")
def where_any_of_empty(spark, sf_dir):
    return _selected(spark, sf_dir, {"constraint": "any_of", "inners": []})


@query(f"{_M} SELECT method_id, name, class FROM methods WHERE name = 'red widget' OR n_params = 0")
def where_any_of(spark, sf_dir):
    return _selected(spark, sf_dir, {"constraint": "any_of", "inners": [{"constraint": "name", "name": "red widget"}, {"constraint": "number_parameters", "operator": "==", "value": 0}]})


@query(f"{_M} SELECT method_id, name, class FROM methods WHERE NOT (visibility = 'public' AND has_code)")
def where_not(spark, sf_dir):
    return _selected(spark, sf_dir, {"constraint": "not", "inner": {"constraint": "all_of", "inners": [{"constraint": "visibility", "is": "public"}, {"constraint": "has_code"}]}})


@query(f"{_M} SELECT method_id, name, class FROM methods WHERE n_params >= 3 AND n_params <> 4")
def where_number_params(spark, sf_dir):
    return _selected(spark, sf_dir, [{"constraint": "number_parameters", "operator": ">=", "value": 3}, {"constraint": "number_parameters", "operator": "!=", "value": 4}])


@query(f"{_M} SELECT method_id, name, class FROM methods WHERE visibility = 'private' AND is_static AND NOT has_code")
def where_visibility(spark, sf_dir):
    return _selected(spark, sf_dir, [{"constraint": "visibility", "is": "private"}, {"constraint": "is_static"}, {"constraint": "has_code", "value": False}])


def _with_params(spark, sf_dir):
    params = F.when(F.col("n_params") > 0, F.transform(F.sequence(F.lit(1), "n_params"), lambda i: F.concat(F.lit("T"), ((F.col("method_id") + i) % 7).cast("string")))).otherwise(F.array().cast("array<string>"))
    return facts.methods(spark, sf_dir).withColumn("params", params)


_PARAMS = f"{_M}, p AS (SELECT *, [ 'T' || ((method_id + i) % 7) FOR i IN range(1, n_params + 1) ] AS params FROM methods)"


@query(f"{_PARAMS} SELECT method_id, name FROM p WHERE len(list_filter(params[2:], lambda x: x = 'T3')) > 0")
def where_any_parameter(spark, sf_dir):
    return _with_params(spark, sf_dir).where(where({"constraint": "any_parameter", "start_idx": 1, "pattern": "T3"})).select("method_id", "name")


@query(f"{_PARAMS} SELECT method_id, name FROM p WHERE params[1] IN ('T1', 'T2')")
def where_parameter(spark, sf_dir):
    return _with_params(spark, sf_dir).where(where({"constraint": "parameter", "idx": 0, "pattern": "T[12]"})).select("method_id", "name")


@query(f"{_M} SELECT method_id, name FROM methods WHERE regexp_full_match(package, 'S.*') AND class = 'Brand#3'")
def where_annotation(spark, sf_dir):
    annotated = facts.methods(spark, sf_dir).withColumn("annotations", F.array(F.struct(F.col("class").alias("type"), F.col("package").alias("value"))))
    return annotated.where(where({"constraint": "has_annotation", "type": "Brand#3", "pattern": "S.*"})).select("method_id", "name")


def _classed(spark, sf_dir):
    closure = graph.extends_closure(facts.types(spark, sf_dir))
    decls = facts.declarations(spark, sf_dir).withColumnRenamed("type", "class")
    return graph.with_ancestors(decls, closure)


_ABOVE = f"WITH RECURSIVE {TYPES_SQL}, up(type, above) AS (SELECT type, super FROM types WHERE super <> 'Object' UNION SELECT up.type, types.super FROM up JOIN types ON up.above = types.type WHERE types.super <> 'Object'), {DECLS_SQL}"


@query(f"{_ABOVE} SELECT method_id, type AS class FROM decls WHERE type = 'N7' OR type IN (SELECT type FROM up WHERE above = 'N7')")
def where_extends_include_self(spark, sf_dir):
    return _classed(spark, sf_dir).where(where({"constraint": "extends", "pattern": "N7"})).select("method_id", "class")


@query(f"{_ABOVE} SELECT method_id, type AS class FROM decls WHERE type IN (SELECT type FROM up WHERE above = 'R1')")
def where_extends_strict(spark, sf_dir):
    return _classed(spark, sf_dir).where(where({"constraint": "extends", "pattern": "R1", "include_self": False})).select("method_id", "class")


@query(f"WITH {TYPES_SQL}, {DECLS_SQL} SELECT method_id, decls.type AS class FROM decls JOIN types ON decls.type = types.type WHERE super = 'N3'")
def where_super_direct(spark, sf_dir):
    decls = facts.declarations(spark, sf_dir).withColumnRenamed("type", "class")
    types = facts.types(spark, sf_dir).withColumnRenamed("type", "class")
    return decls.join(types, "class").where(where({"constraint": "super", "pattern": "N3"})).select("method_id", "class")


_OVERRIDES = f"{_ABOVE}, ov AS (SELECT DISTINCT b.method_id AS base, d.method_id AS method FROM decls b JOIN up ON up.above = b.type JOIN decls d ON d.type = up.type AND d.name = b.name)"


@query(f"{_OVERRIDES} SELECT d.method_id, CAST(coalesce(n, 0) AS BIGINT) AS n_overrides FROM decls d LEFT JOIN (SELECT base, count(*) AS n FROM ov GROUP BY base) o ON d.method_id = o.base WHERE coalesce(n, 0) < 2")
def where_number_overrides(spark, sf_dir):
    decls = facts.declarations(spark, sf_dir)
    counts = graph.override_counts(decls, graph.extends_closure(facts.types(spark, sf_dir))).select(F.col("base").alias("method_id"), F.col("n").alias("n_overrides"))
    counted = decls.join(counts, "method_id", "left").withColumn("n_overrides", F.coalesce("n_overrides", F.lit(0).cast("long")))
    return counted.where(where({"constraint": "number_overrides", "operator": "<", "value": 2})).select("method_id", "n_overrides")


@query(f"{_M} SELECT method_id, 'sink' AS role, k AS kind, 'Argument(1)' AS port FROM methods, (VALUES ('Log'), ('Network')) AS t(k) WHERE name = 'red widget' AND n_params >= 2")
def template_instantiate(spark, sf_dir):
    """A model template: each matched method gives a row for each sink of the template."""
    matched = facts.methods(spark, sf_dir).where(where([{"constraint": "name", "name": "red widget"}, {"constraint": "number_parameters", "operator": ">=", "value": 2}]))
    sinks = F.explode(F.array(*[F.struct(F.lit("sink").alias("role"), F.lit(k).alias("kind"), F.lit("Argument(1)").alias("port")) for k in ("Log", "Network")]))
    return matched.select("method_id", sinks.alias("s")).select("method_id", "s.role", "s.kind", "s.port")


@query(f"{_PARAMS} SELECT method_id, 'Argument(' || (i - 1) || ')' AS port, params[i] AS type FROM p, unnest(range(1, n_params + 1)) AS t(i) WHERE params[i] <> 'T0'")
def for_all_parameters(spark, sf_dir):
    ports = _with_params(spark, sf_dir).select("method_id", F.posexplode("params").alias("i", "type")).where("type <> 'T0'")
    return ports.select("method_id", F.format_string("Argument(%d)", "i").alias("port"), "type")


@query(f"{_M} SELECT method_id, CASE WHEN n_params = 0 THEN 'generation' ELSE 'parameter_source' END AS role, 'via-' || lower(package) AS feature FROM methods")
def source_split(spark, sf_dir):
    """Sources on Return become generations, those on an argument parameter sources; the value of
    an annotation becomes a feature."""
    port = F.when(F.col("n_params") == 0, "Return").otherwise("Argument(1)")
    return facts.methods(spark, sf_dir).select("method_id", F.when(port == "Return", "generation").otherwise("parameter_source").alias("role"), F.concat(F.lit("via-"), F.lower("package")).alias("feature"))


@query("SELECT c_custkey AS id, regexp_replace('Kind_' || c_mktsegment || '(' || (c_custkey % 5) || ')', '\\(.*\\)$', '') AS kind FROM customer")
def discard_subkind(spark, sf_dir):
    kinds = facts.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "'Kind_' || c_mktsegment || '(' || (c_custkey % 5) || ')' AS kind")
    return kinds.select("id", F.regexp_replace("kind", r"\(.*\)$", "").alias("kind"))


@query("SELECT p_partkey AS id, lower(regexp_replace(replace(p_type || 'Of' || upper(substr(p_name, 1, 1)) || substr(p_name, 2), ' ', ''), '([a-z])([A-Z])', '\\1_\\2', 'g')) AS canonical FROM part")
def canonical_name(spark, sf_dir):
    """Camel case to snake case."""
    raw = "replace(p_type || 'Of' || upper(substr(p_name, 1, 1)) || substr(p_name, 2), ' ', '')"
    return facts.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(F.regexp_replace(F.expr(raw), "([a-z])([A-Z])", "$1_$2")).alias("canonical"))
