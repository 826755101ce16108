"""Nested constraints, JSON generators, rules, program files, and frames against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions.predicates import INFORMED, required_substring, where, with_type_infos
from tidewater.operators import augment, frames, kinds, paths, templates
from tidewater.sources import generators, models, program_files

INFO = "type string, super string, ancestors array<string>, is_class boolean, is_interface boolean, is_enum boolean, annotations array<struct<type:string,value:string>>"
TYPES = [("LA;", "LBase;", ["LA;", "LBase;", "LI;"], True, False, False, [("LNote;", "yes")]), ("LI;", None, ["LI;"], False, True, False, [])]
METHODS = [(1, "f", "LA;", "LI;", ["LA;", "I"], [[("LParam;", "p")], []], False, True), (2, "g", "LX;", "V", [], [], True, False)]
COLUMNS = "method_id long, name string, class string, ret string, params array<string>, param_annotations array<array<struct<type:string,value:string>>>, is_static boolean, has_code boolean"


@pytest.fixture(scope="module")
def methods(spark):
    rows = spark.createDataFrame(METHODS, COLUMNS).withColumn("n_params", F.size("params"))
    return with_type_infos(rows, spark.createDataFrame(TYPES, INFO))


NAMED = lambda n: {"constraint": "name", "pattern": n}


@pytest.mark.parametrize(
    ("constraint", "expected"),
    [
        ({"constraint": "parent", "inner": {"constraint": "extends", "inner": NAMED("LI;")}}, [1]),
        ({"constraint": "parent", "inner": {"constraint": "super", "inner": NAMED("LBase;")}}, [1]),
        ({"constraint": "not", "inner": {"constraint": "parent", "inner": {"constraint": "is_class"}}}, [2]),
        ({"constraint": "parent", "inner": {"constraint": "has_annotation", "type": "LNote;", "pattern": "y.*"}}, [1]),
        ({"constraint": "return", "inner": {"constraint": "is_interface"}}, [1]),
        ({"constraint": "parameter", "idx": 0, "inner": {"constraint": "parameter_has_annotation", "type": "LParam;", "pattern": "p"}}, [1]),
        ({"constraint": "any_parameter", "inner": {"constraint": "all_of", "inners": [NAMED("I"), {"constraint": "not", "inner": {"constraint": "is_class"}}]}}, [1]),
        ({"constraint": "any_parameter", "start_idx": 1, "inner": {"constraint": "parameter_has_annotation", "type": "LParam;"}}, []),
        ({"constraint": "number_parameters", "inner": {"constraint": "any_of", "inners": [{"constraint": "==", "value": 0}, {"constraint": ">", "value": 5}]}}, [2]),
        ({"constraint": "signature", "pattern": r"LA;\.f:\(LA;I\)LI;"}, [1]),
        ({"constraint": "signature_match", "name": "f", "extends": ["LNone;", "LBase;"]}, [1]),
    ],
)
def test_nested_constraints(methods, constraint, expected):
    assert sorted(r.method_id for r in methods.where(where(constraint, INFORMED)).collect()) == expected


@pytest.mark.parametrize("bad", [{"constraint": "parent"}, {"constraint": "name", "pattern": "a", "inner": {}}, {"constraint": "visibility", "is": "open"}, {"constraint": "signature_match", "name": "a", "names": ["b"]}])
def test_odd_constraints_are_refused(methods, bad):
    with pytest.raises((ValueError, KeyError)):
        where(bad, INFORMED)


@pytest.mark.parametrize(("pattern", "must"), [("foo+bar", "foo"), ("a+bcd+e", "bcd"), (r"\(abc\)", "(abc)"), (r"abc\d", None), ("ab?cde", "cde"), ("abc{2}", None), ("abc+?def", "abc"), ("abc\\", None)])
def test_required_substring(spark, pattern, must):
    assert required_substring(pattern) == must


def test_generators_from_files(spark, methods, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"model_generators": [
        {"find": "methods", "where": [{"constraint": "parent", "inner": NAMED("LA;")}], "model": {
            "for_all_parameters": [{"variable": "x", "where": [{"constraint": "is_class"}], "sinks": [{"kind": "K", "port": "Argument(x).f"}]}],
            "propagation": [{"input": "Argument(1)", "output": "Return"}]}},
        {"find": "fields", "where": [NAMED("f")], "model": {"sources": [{"kind": "S"}]}},
    ]}))
    fields = spark.createDataFrame([(7, "f", "LA;", "I", False), (8, "g", "LA;", "I", False)], "field_id long, name string, class string, type string, is_static boolean")
    found = generators.run_generators(generators.read_generators(spark, str(tmp_path)), methods, fields).collect()
    assert sorted((r.find, r.id, r.role, r.kind, r.port, r.output) for r in found if r.role != "propagation") == [("fields", 7, "generations", "S", "Return", None), ("methods", 1, "sinks", "K", "Argument(0).f", None)]
    assert [(r.port, r.output) for r in found if r.role == "propagation"] == [("Argument(1)", "Return")]
    with pytest.raises(ValueError, match="does not take"):
        templates.entries({"sauces": []})
    (tmp_path / "g.json").write_text(json.dumps([{"find": "classes", "model": {}}]))
    with pytest.raises(ValueError, match="methods or fields"):
        generators.read_generators(spark, str(tmp_path))


def test_registry(spark, monkeypatch):
    monkeypatch.setattr(generators, "REGISTRY", {})
    generators.generator("one")(lambda spark, tables: tables["t"])
    rows = spark.createDataFrame([(1, "sinks")], "id long, role string")
    assert generators.run_registered(spark, ["one"], {"t": rows}).first().generator == "one"
    for names in (["two"], ["one", "one"]):
        with pytest.raises(ValueError):
            generators.run_registered(spark, names, {"t": rows})
    with pytest.raises(ValueError, match="already"):
        generators.generator("one")(lambda spark, tables: None)


def test_nested_keys_are_strict(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"method": "m", "sources": [{"kind": "S", "prot": "Return"}]}]))
    with pytest.raises(models.UnknownKey, match="sources.prot"):
        models.read_strict(spark, str(tmp_path / "m.json"), models.MODEL_SCHEMA)


def test_rules_whole(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([
        {"code": 1, "name": "a", "multi_sources": {"x": ["S"], "y": ["R", "Q"]}, "partial_sinks": ["P"]},
        {"code": 2, "name": "b", "cases": [{"sources": ["S"], "sinks": ["M"], "effect_sources": ["E"], "transforms": ["T", "U"]}]},
        {"code": 2, "name": "again", "sources": ["Z"], "sinks": ["Z"]},
    ]))
    rules, repeated = models.only_rules(models.read_strict(spark, str(tmp_path / "r.json"), models.RULE_SCHEMA))
    assert repeated == [2]
    assert sorted(tuple(r) for r in models.rule_parts(rules).collect()) == sorted([
        (1, 0, "source:x", "S"), (1, 0, "source:y", "R"), (1, 0, "source:y", "Q"), (1, 0, "partial_sink", "P"),
        (2, 1, "source", "S"), (2, 1, "sink", "M"), (2, 1, "effect_source", "E"), (2, 1, "transform:0", "T"), (2, 1, "transform:1", "U")])
    assert sorted(tuple(r) for r in models.rule_labels(rules).collect()) == [(1, "x", "S"), (1, "y", "Q"), (1, "y", "R")]


def test_field_and_literal_models(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"field": "LA;.f:I", "sources": [{"kind": "S"}], "sinks": [{"kind": "K"}]}]))
    rows = models.taint_rows(models.read_strict(spark, str(tmp_path / "f.json"), models.FIELD_MODEL_SCHEMA), "field")
    assert sorted((r.field, r.role, r.kind) for r in rows.collect()) == [("LA;.f:I", "sinks", "K"), ("LA;.f:I", "sources", "S")]
    (tmp_path / "l.json").write_text(json.dumps([{"pattern": ".*key.*", "sources": [{"kind": "S"}]}]))
    assert [(r.pattern, r.kind) for r in models.taint_rows(models.read_strict(spark, str(tmp_path / "l.json"), models.LITERAL_MODEL_SCHEMA), "pattern").collect()] == [(".*key.*", "S")]


def test_program_files(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"join_override_threshold": 7}')
    assert program_files.read_heuristics(spark, str(tmp_path / "h.json"))["join_override_threshold"] == 7
    (tmp_path / "h.json").write_text('{"colour": 7}')
    with pytest.raises(ValueError, match="colour"):
        program_files.read_heuristics(spark, str(tmp_path / "h.json"))
    (tmp_path / "m.xml").write_text("""<manifest xmlns:android="http://schemas.android.com/apk/res/android"><application>
      <activity android:name="A" android:exported="true" android:permission="P"/>
      <service android:name="S"><intent-filter><action android:name="x"/></intent-filter></service>
      <receiver android:name="R" android:exported="false"/></application></manifest>""")
    found = {(r.component, r["class"]): (r.exported, r.permission) for r in program_files.read_manifest(spark, str(tmp_path / "m.xml")).collect()}
    assert found == {("activity", "A"): (True, "P"), ("service", "S"): (True, None), ("receiver", "R"): (False, None)}
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.java").write_text("package com.x;\n\npublic final class One {\n  class Inner {}\n}\n/* a */ enum Two {}\n")
    (tmp_path / "src" / "B.kt").write_text("package com.y\n\ndata class Three(val a: Int)\ninternal object Four\n")
    assert {r["class"] for r in program_files.source_index(spark, str(tmp_path / "src")).collect()} == {"Lcom/x/One;", "Lcom/x/Two;", "Lcom/y/Three;", "Lcom/y/Four;"}


def _brute_frames(leaves, calls, most):
    state = {}
    for m, k, fs in leaves:
        d, contributions = state.setdefault((m, k), [0, []])
    best = {(m, k): 0 for m, k, _ in leaves}
    changed = True
    while changed:
        changed = False
        for (m, k), d in list(best.items()):
            for a, b, cost, _ in calls:
                if b == m and d + cost <= most and best.get((a, k), 99) > d + cost:
                    best[a, k], changed = d + cost, True
    seen = {key: set() for key in best}
    lacks = {key: set() for key in best}
    for m, k, fs in leaves:
        seen[m, k] |= set(fs)
    for _ in range(60):
        for a, b, cost, fs in calls:
            for k in {k for _, k in best}:
                if (b, k) in best and best[b, k] + cost <= most:
                    seen[a, k] |= seen[b, k] | set(fs)
    for m, k, fs in leaves:
        lacks[m, k] |= {f for key in best if key[1] == k for f in seen[key]} - set(fs)
    for _ in range(60):
        for a, b, cost, fs in calls:
            for k in {k for _, k in best}:
                if (b, k) in best and best[b, k] + cost <= most:
                    lacks[a, k] |= lacks[b, k] - set(fs)
    return sorted((m, k, d, sorted(seen[m, k] & lacks[m, k]), sorted(seen[m, k] - lacks[m, k])) for (m, k), d in best.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_frames_on_a_cyclic_graph(spark, seed):
    rng = random.Random(seed)
    calls = [(rng.randrange(10), rng.randrange(10), rng.randrange(2), rng.sample("pqr", rng.randrange(3))) for _ in range(24)]
    leaves = [(0, "K", ["a", "b"]), (1, "K", ["b"]), (2, "L", []), (2, "L", ["c"])]
    found = frames.frames_fixpoint(spark.createDataFrame(leaves, "method int, kind string, features array<string>"), spark.createDataFrame(calls, "a int, b int, cost int, features array<string>"), 3)
    assert sorted((r.method, r.kind, r.distance, r.may, r.always) for r in found.collect()) == _brute_frames(leaves, calls, 3)


def test_no_frames(spark):
    none = spark.createDataFrame([], "method int, kind string, features array<string>")
    assert frames.frames_fixpoint(none, spark.createDataFrame([(1, 2, 1, ["x"])], "a int, b int, cost int, features array<string>")).count() == 0


def _tree(spark, rows):
    return spark.createDataFrame(rows, "key int, path array<string>, element string")


def _rows(df):
    return sorted((r.key, "".join(r.path), r.element) for r in df.collect())


def test_paths_with_indices(spark):
    tree = _tree(spark, [(1, ["[*]"], "s"), (1, ["[*]", ".g"], "sg"), (1, ["[a]"], "a"), (2, [".f", "[*]"], "deep")])
    new = spark.createDataFrame([(1, "n")], "key int, element string")
    assert _rows(paths.write_index(tree, new, ["[b]"])) == [(1, "[*]", "s"), (1, "[*].g", "sg"), (1, "[a]", "a"), (1, "[b]", "n"), (1, "[b]", "s"), (1, "[b].g", "sg"), (2, ".f[*]", "deep")]
    assert _rows(paths.write_index(tree, new, ["[b]"], strong=True)) == [(1, "[*]", "s"), (1, "[*].g", "sg"), (1, "[a]", "a"), (1, "[b]", "n"), (2, ".f[*]", "deep")]
    through = paths.write_index(tree, new, ["[*]"], strong=True)  # demoted to a weak write
    assert _rows(through) == [(1, "[*]", "n"), (1, "[*]", "s"), (1, "[*].g", "sg"), (1, "[a]", "a"), (1, "[a]", "n"), (2, ".f[*]", "deep")]
    other = _tree(spark, [(1, ["[c]"], "c"), (2, [".f", "[d]"], "d")])
    assert _rows(paths.merge(tree, other, 2)) == [(1, "[*]", "s"), (1, "[*].g", "sg"), (1, "[a]", "a"), (1, "[c]", "c"), (1, "[c]", "s"), (1, "[c].g", "sg"), (2, ".f[*]", "deep"), (2, ".f[d]", "d"), (2, ".f[d]", "deep")]
    below = {r.key: r.leq for r in paths.leq(_tree(spark, [(1, ["[z]"], "s"), (2, [".f"], "deep")]), tree, 2).collect()}
    assert below == {1: True, 2: False}
    queries = spark.createDataFrame([(1, ["[a]", ".x"]), (1, [".q"])], "key int, path array<string>")
    assert sorted((r.found, r.remainder) for r in paths.raw_read_longest(tree, queries).collect()) == [([], [".q"]), (["[a]"], [".x"])]


def test_transform_lists(spark):
    arrays = lambda *t: F.array(*map(F.lit, t)) if t else F.array().cast("array<string>")
    row = spark.range(1).select(
        kinds.canonical_list(arrays("!b", "!a", "!b", "T", "!c")).alias("canonical"), kinds.canonical_list(arrays()).alias("none"),
        kinds.filter_global(arrays("T", "!a", "!b"), arrays("!b", "G", "!a")).alias("filtered"), kinds.discard_unmatched(arrays("!source:k", "!sink:k", "T"), True).alias("forward"),
        kinds.source_as_transform(F.lit("K"), arrays("T")).alias("sat"), kinds.source_as_transform(F.lit("K"), arrays("SAT[J]")).alias("held"),
    ).first()
    assert row.canonical == ["!a", "!b", "T", "!c"] and row.none == [] and row.filtered == ["T", "!a"] and row.forward == ["!sink:k", "T"] and row.sat == ["SAT[K]", "T"] and row.held is None


def test_inner_classes_and_builders(spark):
    row = spark.range(1).select(augment.outer_class(F.lit("La/B$C$D;")).alias("c")).first()
    assert row.c == "La/B;"
    methods = spark.createDataFrame([(1, "run", "LA$In;", "pkg", "public"), (2, "run", "LA;", "pkg", "private"), (3, "run", "LB;", "pkg", "public")], "method_id long, name string, class string, package string, visibility string")
    components = spark.createDataFrame([("LA;", True, None), ("LB;", True, "P")], "class string, exported boolean, permission string")
    assert [r.method_id for r in augment.exported_sources(methods, components).collect()] == [1]
    returned = spark.createDataFrame([("m", "this"), ("m", "this"), ("n", "this"), ("n", "x")], "method string, node string")
    assert [r.method for r in augment.returns_this(returned).collect()] == ["m"]
    declared = spark.createDataFrame([("A", "a"), ("A", "c"), ("A", "d")], "cls string, callback string")
    found = augment.lifecycle_graph(declared, [("a", "b"), ("b", "c"), ("c", "d")])
    assert sorted((r.a, r.b) for r in found.collect()) == [("a", "c"), ("c", "d")]  # b is passed over
