"""Graph, lattice, path, kind and flow operators on small cases."""

import random

from pyspark.sql import functions as F

from tidewater.operators import bodies, flows, graph, kinds, lattice, localflow, paths

TYPES = [("Base", "Object"), ("A", "Base"), ("AA", "A"), ("B", "Base")]


def _types(spark):
    return spark.createDataFrame([("Object", None), *TYPES], "type string, super string")


def test_class_intervals_nest(spark):
    types = _types(spark)
    found = {r.type: (r.lo, r.hi) for r in graph.class_intervals(types, graph.extends_closure(types)).collect()}
    assert found == {"Object": (0, 9), "Base": (1, 8), "A": (2, 5), "AA": (3, 4), "B": (6, 7)}


def test_reach_is_bounded_and_partition_free(spark):
    chain = [(i, i + 1) for i in range(12)] + [(3, 0)]
    edges = spark.createDataFrame(chain, "a long, b long")
    seeds = spark.createDataFrame([(0,)], "node long")
    for parts in (1, 5):
        found = {r.node: r.distance for r in graph.reach(edges.repartition(parts), seeds, 7).collect()}
        assert found == {i: i for i in range(8)}  # seven hops stay, the eighth goes
    assert graph.reach(edges, seeds).count() == 13


def test_strong_components(spark):
    rng = random.Random(4)
    pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(26)}
    pairs = [(a, b) for a, b in pairs if a != b]
    nodes = {n for p in pairs for n in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    expected = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    assert {r.node: r.component for r in graph.strong_components(spark.createDataFrame(pairs, "a long, b long")).collect()} == expected


def test_nearest_prefers_exported(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "a long, b long")
    targets = spark.createDataFrame([(2, False), (3, True), (4, True)], "node long, exported boolean")
    found = {r.node: (r.target, r.distance, r.exported) for r in graph.nearest(edges, targets).collect()}
    assert found == {1: (3, 1, True), 2: (2, 0, False), 3: (3, 0, True), 4: (4, 0, True)}


def test_mutual_frames_keep_each_other(spark):
    rows = [("m1", "k", "m2"), ("m2", "k", "m1"), ("m3", "k", "m4"), ("m5", "k", None), ("m6", "k", "m5"), ("m7", "j", "m5")]
    alive = graph.cull_frames(spark.createDataFrame(rows, "method string, kind string, callee string"))
    assert sorted(r.method for r in alive.collect()) == ["m1", "m2", "m5", "m6"]


def test_textual_index(spark):
    sites = spark.createDataFrame([("m", "f", 9), ("m", "f", 2), ("m", "g", 5)], "caller string, callee string, pos int")
    assert {(r.callee, r.pos): r.idx for r in graph.textual_index(sites).collect()} == {("f", 2): 0, ("f", 9): 1, ("g", 5): 0}


def test_may_and_always(spark):
    tags = [(1, "x", "1", False), (1, "x", "2", True), (1, "y", "2", False), (1, "y", "1", True), (2, "x", "1", True), (2, "x", "2", True), (2, "y", "1", True), (2, "y", "3", True)]
    found = {(r.k, r.tag): r.kind for r in lattice.may_always(spark.createDataFrame(tags, "k int, frame string, tag string, always boolean"), ["k"], "frame").collect()}
    assert found == {(1, "1"): "may", (1, "2"): "may", (2, "1"): "always", (2, "2"): "may", (2, "3"): "may"}


def test_features_added_in_sequence(spark):
    row = spark.range(1).select(lattice.add_features(F.expr("named_struct('may', array('a', 'b'), 'always', array('c'))"), F.expr("named_struct('may', array('c'), 'always', array('a'))")).alias("f")).first()
    assert (row.f.may, row.f.always) == (["b"], ["a", "c"])


def test_join_of_frames_is_a_lattice_join(spark):
    rows = [("m", 3, ["b", "a"]), ("m", 1, ["c"]), ("m", 1, ["c"]), ("n", 2, ["z"])]
    frames = spark.createDataFrame(rows, "m string, distance int, origins array<string>")
    once = lattice.join_frames(frames, ["m"]).drop("n_frames")
    assert {r.m: (r.distance, r.origins) for r in once.collect()} == {"m": (1, ["a", "b", "c"]), "n": (2, ["z"])}
    again = lattice.join_frames(once.unionByName(once.repartition(3)), ["m"]).drop("n_frames")
    assert sorted(again.collect()) == sorted(once.collect())  # idempotent


def test_frozen_side_wins(spark):
    rows = [("m", "sink", "a", False), ("m", "sink", "b", True), ("m", "source", "c", False)]
    out = lattice.resolve_frozen(spark.createDataFrame(rows, "method string, role string, fact string, frozen boolean"), ["method", "role"])
    assert sorted(r.fact for r in out.collect()) == ["b", "c"]


def test_quantiles_at_floor(spark):
    values = [5, 1, 4, 1, 3, 9, 2, 6, 5, 3]
    row = lattice.floor_quantiles(spark.createDataFrame([(v,) for v in values], "v int"), "v", {"p50": 0.5, "p90": 0.9}).first()
    assert (row.total, row.least, row.greatest, row.p50, row.p90) == (10, 1, 9, sorted(values)[5], sorted(values)[9])


def test_common_super(spark):
    types = _types(spark)
    sets = spark.createDataFrame([(1, "AA"), (1, "A"), (2, "AA"), (2, "B"), (3, "A"), (4, "A"), (4, "B"), (4, "AA")], "key int, type string")
    found = {r.key: r.super for r in lattice.common_super(sets, graph.extends_closure(types), 2).collect()}
    assert found == {1: "A", 2: "Base", 3: "A", 4: None}


def _tree(spark, rows):
    return spark.createDataFrame(rows, "key int, path array<string>, element string")


def _rows(df):
    return sorted((r.key, tuple(r.path), r.element) for r in df.collect())


def test_read_flows_down_and_falls_back(spark):
    tree = _tree(spark, [(1, [], "r"), (1, [".f"], "f"), (1, [".f", ".g"], "g"), (1, ["[*]"], "s"), (1, ["[a]"], "a")])
    assert _rows(paths.read(tree, [".f"])) == [(1, (), "f"), (1, (), "r"), (1, (".g",), "g")]
    assert _rows(paths.read(tree, ["[a]"])) == [(1, (), "a"), (1, (), "r")]
    assert _rows(paths.read(tree, ["[z]"])) == [(1, (), "r"), (1, (), "s")]
    assert _rows(paths.read(tree, ["[*]"])) == [(1, (), "a"), (1, (), "r"), (1, (), "s")]


def test_writes(spark):
    tree = _tree(spark, [(1, [], "r"), (1, [".f"], "f"), (1, [".f", ".g"], "g"), (2, [".f"], "f")])
    new = spark.createDataFrame([(1, "n"), (1, "r")], "key int, element string")
    assert _rows(paths.write_strong(tree, new, [".f"])) == [(1, (), "r"), (1, (".f",), "n"), (1, (".f",), "r"), (2, (".f",), "f")]
    assert _rows(paths.write_weak(tree, new, [".f"])) == [(1, (), "r"), (1, (".f",), "f"), (1, (".f",), "n"), (1, (".f", ".g"), "g"), (2, (".f",), "f")]


def test_limits_and_shapes(spark):
    tree = _tree(spark, [(1, [".a", ".x"], "e"), (1, [".a", ".y"], "e"), (1, [".b"], "e"), (2, [], "e")])
    assert [(r.key, r.height) for r in paths.limit_leaves(tree, 2, 4).collect()] == [(1, 1)]
    assert {(r.key, tuple(r.path), r.broadened) for r in paths.collapse_deeper(tree, 1).collect()} == {(1, (".a",), True), (1, (".b",), False), (2, (), False)}
    mold = spark.createDataFrame([(1, [".a", ".x"])], "key int, path array<string>")
    assert _rows(paths.shape_with(tree, mold)) == [(1, (), "e"), (1, (".a", ".x"), "e"), (2, (), "e")]
    rules = spark.createDataFrame([(1, [".a"], [".o"])], "key int, input array<string>, output array<string>")
    assert _rows(paths.propagate(tree, rules)) == [(1, (".o", ".x"), "e"), (1, (".o", ".y"), "e")]


def test_canonical_sink_and_sanitizers(spark):
    arrays = lambda *t: F.array(*map(F.lit, t)) if t else F.array().cast("array<string>")
    row = spark.range(1).select(
        kinds.canonical_sink(arrays("T2", "!s"), arrays("T1"), arrays("T3"), arrays()).alias("c"),
        kinds.sanitized(arrays("!a", "!b", "T", "!c"), F.lit("b")).alias("yes"),
        kinds.sanitized(arrays("!a", "T", "!b"), F.lit("b")).alias("no"),
        kinds.parse_kind(F.lit("T1:T2@G:Kind(sub)")).alias("k"),
        kinds.parse_kind(F.lit("Kind")).alias("plain"),
    ).first()
    assert row.c == ["T1", "T2", "T3"] and row.yes and not row.no
    assert row.k.asDict() == {"local": ["T1", "T2"], "global": ["G"], "base": "Kind", "subkind": "sub"}
    assert row.plain.asDict() == {"local": [], "global": [], "base": "Kind", "subkind": ""}


def test_overlap_pairs_come_once(spark):
    rng = random.Random(1)
    rows = [(i, lo, lo + rng.randrange(20)) for i, lo in enumerate(rng.choices(range(60), k=40))]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, id int, lo int, hi int")
    found = sorted((r.a, r.b, r.lo, r.hi) for r in flows.overlapping(df, df, ["k"], 7).collect())
    assert found == sorted((a, b, max(la, lb), min(ha, hb)) for a, la, ha in rows for b, lb, hb in rows if max(la, lb) <= min(ha, hb))


def test_override_cap(spark):
    calls = spark.createDataFrame([(1, 10), (1, 20)], "a int, b int")
    over = spark.createDataFrame([(10, 100 + i) for i in range(39)] + [(20, 200 + i) for i in range(40)], "base int, method int")
    found = flows.virtual_targets(calls, over)
    assert found.count() == 2 + 39


def test_last_write(spark):
    body = spark.createDataFrame([(1, 1, "source", 0), (1, 2, "sink", 0), (1, 3, "clean", 0), (1, 4, "sink", 0), (1, 5, "sink", 1)], "method_id int, pos int, op string, reg int")
    assert [(r.pos, r.source_pos) for r in bodies.tainted_sinks(body, "source", "clean", "sink").collect()] == [(2, 1)]


def _edges(spark, rows):
    return spark.createDataFrame([("m", *r) for r in rows], "method string, src string, dst string, fields array<string>, calls array<string>")


def test_labels_cancel(spark):
    edges = _edges(spark, [("p", "t", ["+f"], []), ("t", "r", [".f"], []), ("t", "q", [".g"], []), ("t", "u", ["+h"], []), ("u", "v", [".*"], []), ("v", "w", [".f"], []), ("c", "t2", [], ["(1"]), ("t2", "d", [], [")1"]), ("t2", "e", [], [")2"])])
    temps = spark.createDataFrame([("m", t) for t in ("t", "u", "v", "t2")], "method string, node string")
    found = {(r.src, r.dst, tuple(r.fields), tuple(r.calls)) for r in localflow.eliminate(edges, temps).collect()}
    assert found == {("p", "r", (), ()), ("p", "w", (), ()), ("c", "d", (), ())}


def test_depth_stops_growth(spark):
    edges = _edges(spark, [("p", "t", ["+f"], []), ("t", "t", ["+f"], []), ("t", "r", [], [])])
    temps = spark.createDataFrame([("m", "t")], "method string, node string")
    assert localflow.eliminate(edges, temps, depth=3).count() == 3
    assert localflow.eliminate(edges, temps, depth=3, most_edges=2).count() == 0


def test_resolution_and_refinement(spark):
    from tidewater.operators import program

    closure = graph.extends_closure(_types(spark))
    decls = spark.createDataFrame([(1, "f", "Base"), (2, "f", "A"), (3, "g", "Base")], "method_id long, name string, type string")
    sites = spark.createDataFrame([(1, "AA", "f"), (2, "B", "f"), (3, "AA", "g"), (4, "AA", "h")], "site int, type string, name string")
    assert {r.site: r.method for r in program.resolve_targets(sites, decls, closure).collect()} == {1: 2, 2: 1, 3: 3}
    local = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "key int, local string")
    found = spark.createDataFrame([(1, "AA"), (2, "B")], "key int, global string")
    assert {r.key: r.type for r in program.refine_types(local, found, closure).collect()} == {1: "AA", 2: "A", 3: "B"}
