"""Joins that make no more rows than the result needs, and results spread over tasks."""

import random

import pytest

from tidewater.functions.joins import dealt_join, split_single
from tidewater.operators import augment, flows, graph, program


def _nodes(plan):
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    children = plan.children()
    for child in inner + [children.apply(i) for i in range(children.size())]:
        yield from _nodes(child)
    yield plan


def _run(df):
    """The rows of ``df`` and the most rows that one of its joins made."""
    rows = df.collect()
    made = 0
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            made = max(made, node.metrics().apply("numOutputRows").value())
    return rows, made


def _wide(spark):
    """A type with many descendants and many declarations, of which few have an override."""
    types = spark.createDataFrame([("Object", None), ("Base", "Object"), *[(f"T{i}", "Base") for i in range(300)]], "type string, super string")
    decls = [(i, f"m{i}", "Base", True) for i in range(300)] + [(1000 + i, f"m{i % 150}", f"T{i}", i % 2 == 0) for i in range(300)]
    return spark.createDataFrame(decls, "method_id long, name string, type string, has_code boolean"), graph.extends_closure(types)


def test_overrides_make_no_pairs_of_other_names(spark):
    decls, closure = _wide(spark)
    rows, made = _run(graph.overrides(decls, closure))
    assert {(r.base, r.method) for r in rows} == {(i % 150, 1000 + i) for i in range(300)}
    assert made <= 600  # 300 declarations below 300 types are 90,000


def test_counts_and_flags_make_no_pairs(spark):
    decls = spark.createDataFrame([(i, "m", "Base", False) for i in range(100)] + [(1000 + i, "m", "T0", i > 0) for i in range(100)], "method_id long, name string, type string, bare boolean")
    closure = spark.createDataFrame([("Base", "T0", 1)], "ancestor string, type string, depth int")
    rows, made = _run(graph.override_counts(decls, closure))
    assert {(r.base, r.n) for r in rows} == {(i, 100) for i in range(100)} and made <= 200
    rows, made = _run(graph.any_override(decls, closure, "bare"))
    assert {(r.base, r.bare) for r in rows} == {(i, True) for i in range(100)} and made <= 200


def test_only_few_overrides_are_made(spark):
    decls = spark.createDataFrame([(i, "m", "Base") for i in range(50)] + [(1000 + i, "m", "T0") for i in range(50)] + [(2000, "n", "Base"), (2001, "n", "T0")], "method_id long, name string, type string")
    closure = spark.createDataFrame([("Base", "T0", 1)], "ancestor string, type string, depth int")
    few = graph.override_counts(decls, closure).where("n < 4")
    rows, made = _run(flows.virtual_targets(spark.createDataFrame([(7, 3), (7, 2000)], "a long, b long"), graph.overrides(decls, closure, few), 4))
    assert {(r.a, r.target) for r in rows} == {(7, 3), (7, 2000), (7, 2001)} and made <= 200


def test_receivers_keep_calls_from_other_overrides(spark):
    types = spark.createDataFrame([("Object", None), ("Base", "Object"), *[(f"T{i}", "Base") for i in range(100)]], "type string, super string")
    decls = spark.createDataFrame([(0, "m", "Base")] + [(1000 + i, "m", f"T{i}") for i in range(100)], "method_id long, name string, type string")
    calls = spark.createDataFrame([(i, 0, f"T{i}") for i in range(100)], "call long, base long, receiver string")
    rows, made = _run(graph.overrides_below(calls, decls, graph.extends_closure(types)))
    assert {(r.call, r.target) for r in rows} == {(i, 1000 + i) for i in range(100)}
    assert made <= 600  # each call with all overrides of its callee are 10,000


@pytest.mark.parametrize("seed", range(2))
def test_methods_declared_in_several_places(spark, seed):
    rng = random.Random(seed)
    names = ["A", "B", "C", "D", "E", "F"]
    supers = {t: "Object" if i == 0 else rng.choice(names[:i]) for i, t in enumerate(names)}
    above = {}
    for t in names:
        at = supers[t]
        while at != "Object":
            above.setdefault(t, set()).add(at)
            at = supers[at]
    rows = [(rng.randrange(12), rng.choice([None, "m", "n"]), rng.choice([*names, None]), rng.random() < 0.5) for _ in range(40)]
    rows = sorted(set(rows), key=str)
    decls = spark.createDataFrame(rows, "method_id long, name string, type string, has_code boolean")
    closure = graph.extends_closure(spark.createDataFrame([("Object", None), *supers.items()], "type string, super string"))
    pairs = {(b[0], d[0]) for b in rows for d in rows if b[1] is not None and b[1] == d[1] and b[2] in above.get(d[2], ())}
    assert sorted((r.base, r.method) for r in graph.overrides(decls, closure).collect()) == sorted(pairs)
    assert {r.base: r.n for r in graph.override_counts(decls, closure).collect()} == {b: sum(1 for x, _ in pairs if x == b) for b, _ in pairs}
    code = {b: any(d[3] for d in rows for x, m in pairs if x == b and d[0] == m) for b, _ in pairs}
    assert {r.base: r.has_code for r in graph.any_override(decls, closure, "has_code").collect()} == code
    calls = [(i, rng.randrange(12), rng.choice(names)) for i in range(60)]
    kept = sorted((c, m) for c, b, t in calls for x, m in pairs if x == b for d in rows if d[0] == m and d[2] is not None and (d[2] == t or t in above.get(d[2], ())))
    plain = decls.select("method_id", "name", "type")
    assert sorted((r.call, r.target) for r in graph.overrides_below(spark.createDataFrame(calls, "call long, base long, receiver string"), plain, closure).collect()) == kept


def test_a_target_is_resolved_once_for_all_its_sites(spark):
    sites = spark.createDataFrame([(i % 400, "S", "m") for i in range(500)], "site long, type string, name string")
    decls = spark.createDataFrame([(i, "m", "N") for i in range(5, 205)], "method_id long, name string, type string")
    closure = spark.createDataFrame([("N", "S", 1), ("R", "S", 2)], "ancestor string, type string, depth int")
    rows, made = _run(program.resolve_targets(sites, decls, closure))
    assert sorted((r.site, r.method) for r in rows) == [(i, 5) for i in range(400)]
    assert made <= 500  # sites with all declarations of their name are 100,000


def _spread(df):
    """How many of the tasks of ``df`` made a row, and the rows."""
    parts = [p for p in df.rdd.glom().collect() if p]
    return len(parts), sorted(tuple(r) for p in parts for r in p)


def test_calls_of_one_anonymous_type_are_spread(spark):
    passed = spark.createDataFrame([(i, "T") for i in range(40)] * 2 + [(0, "U"), (0, "V")], "caller long, type string")
    types = spark.createDataFrame([("T", True), ("U", True), ("V", False)], "type string, anonymous boolean")
    methods = spark.createDataFrame([(100 + i, "T", False) for i in range(30)] + [(100, "U", False), (131, "T", True), (132, "V", False)], "method_id long, class string, is_static boolean")
    found = augment.anonymous_calls(passed, types, methods)
    used, rows = _spread(found)
    assert rows == [(i, 100 + j) for i in range(40) for j in range(30)] and used > 8
    assert all(row[0] != 0 or row[1] != 132 for row in rows)


def test_pairs_come_in_runs_that_files_shrink(spark):
    left, right = spark.range(200).selectExpr("'k' AS key", "id AS a"), spark.range(300).selectExpr("'k' AS key", "id AS b")
    parts = dealt_join(left, right, ["key"], ["a"], 4).select("a", "b").rdd.glom().collect()
    assert sorted((r.a, r.b) for p in parts for r in p) == [(a, b) for a in range(200) for b in range(300)]
    assert sum(1 for p in parts for r, after in zip(p, [*p[1:], None]) if after is None or r.b != after.b) <= 4 * 300


def test_shims_of_one_name_are_spread(spark):
    methods = spark.createDataFrame([(1, "A", "m")] + [(100 + i, "B", "m") for i in range(30)] + [(100, "C", "m")], "method_id long, class string, name string")
    calls = spark.createDataFrame([(i, 1) for i in range(40)], "site long, callee long")
    shims = spark.createDataFrame([(1, 1, "m")], "shimmed long, argument int, name string")
    arguments = spark.createDataFrame([(i, 1, t) for i in range(40) for t in ("B", "B", "C")], "site long, argument int, type string")
    used, rows = _spread(augment.type_shims(calls, shims, arguments, methods))
    assert rows == [(i, 100 + j) for i in range(40) for j in range(30)] and used > 4
    edges = calls.toDF("a", "b")
    added = augment.with_shims(edges, spark.createDataFrame([(1, "B", "m")], "shimmed long, class string, name string"), methods).where("call_kind = 'Shim'")
    used, rows = _spread(added.select("a", "b"))
    assert rows == [(i, 100 + j) for i in range(40) for j in range(30)] and used > 4


def test_keys_with_one_value_are_told_apart(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y"), (3, None), (None, "x"), (None, "z")], "k long, v string")
    once, more = split_single(rows, "k", ["v"])
    assert [tuple(r) for r in once.collect()] == [(1, "x")]
    assert {tuple(r) for r in more.collect()} == {(2, "x"), (2, "y"), (None, "x"), (None, "z")}
