"""Large steps keep the tasks that the session asks for, whatever few bytes their rows take in a shuffle."""

import pytest

from tidewater.functions.rounds import DidNotSettle
from tidewater.operators import frames, graph, paths
from tidewater.plans import value_queries


@pytest.fixture
def shuffled(spark):
    """Joins of small tables are shuffled as those of large ones are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _tasks(df):
    """How many tasks the last stage of ``df`` has; Spark merges small partitions unless told not to."""
    return df.rdd.getNumPartitions()


def test_frames_are_not_merged_into_few_tasks(shuffled):
    spark = shuffled
    leaves = spark.createDataFrame([(i, "k", ["p", f"f{i % 3}"]) for i in range(20)], "method int, kind string, features array<string>")
    calls = spark.createDataFrame([(100 + i % 40, i % 20, 1, ["q"]) for i in range(80)], "a int, b int, cost int, features array<string>")
    found = frames.frames_fixpoint(leaves, calls, 2)
    assert _tasks(found) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = {r.method: (r.distance, r.may, r.always) for r in found.collect()}
    assert rows[0] == (0, [], ["f0", "p"]) and rows[101] == (1, [], ["f1", "p", "q"]) and len(rows) == 60


def test_frames_deal_calls_once_for_all_rounds(shuffled, monkeypatch):
    spark, read, kept = shuffled, [], shuffled.sparkContext._jsc.getPersistentRDDs().size()
    keep = frames.dealt
    monkeypatch.setattr(frames, "dealt", lambda df, *keys: read.append(keys) or keep(df, *keys))
    leaves = spark.createDataFrame([(0, "k", ["p"])], "method int, kind string, features array<string>")
    calls = spark.createDataFrame([(i + 1, i, 0, ["q"] if i == 2 else []) for i in range(5)] * 2 + [(2, 5, 0, [])], "a int, b int, cost int, features array<string>")
    rows = {r.method: (r.distance, r.may, r.always) for r in frames.frames_fixpoint(leaves, calls, 2).collect()}
    # 2 is also reached from 5, and so has q on some ways
    assert rows == {0: (0, [], ["p"]), 1: (0, [], ["p"]), 2: (0, ["q"], ["p"]), **{i: (0, [], ["p", "q"]) for i in (3, 4, 5)}}
    assert not {("b",), ("hop_kind", "from")} & set(read)
    assert shuffled.sparkContext._jsc.getPersistentRDDs().size() == kept


def _tree(spark, rows):
    return spark.createDataFrame(rows, "key int, path array<string>, element string")


def _rows(df):
    return sorted((r.key, tuple(r.path), r.element) for r in df.collect())


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_write_prunes_in_one_deal(shuffled):
    tree = _tree(shuffled, [(k, p, e) for k in range(30) for p, e in (([], "r"), (["[*]"], "s"), (["[a]"], "r"), (["[a]", ".g"], "t"))])
    new = tree.select("key").distinct().selectExpr("key", "'r' AS element").where("key % 2 = 0")
    found = paths.write_index(tree, new, ["[*]"], strong=True)
    assert _tasks(found) == int(shuffled.conf.get("spark.sql.shuffle.partitions"))
    assert _rows(found) == sorted((k, p, e) for k in range(30) for p, e in (((), "r"), (("[*]",), "s"), (("[a]", ".g"), "t")))
    odd = _tree(shuffled, [(None, [], "r"), (None, [".f"], "r"), (1, [], None), (1, [".f"], None), (1, None, "r"), (2, [], "r"), (2, [".f"], "r")])
    assert sorted(map(str, paths.prune(odd).collect())) == sorted(map(str, odd.where("key IS NULL OR key = 1 OR size(path) = 0").collect()))
    assert _shuffles(paths.prune(tree)) == 1


def test_steps_are_judged_where_their_tree_is(spark):
    lines = [(i, i % 40, i % 7, i % 9, "R") for i in range(400)]
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/lines"
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_returnflag string").write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    found = value_queries.path_drop_invalid(spark, folder)
    assert _tasks(found) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.where("path LIKE '.f0.g2%'").count() == 0 and found.where("path = '.f0'").count() > 0


def test_merge_reads_its_trees_few_times(spark):
    left, right = (_tree(spark, [(k, p, "e") for k in range(20) for p in (["[*]", ".g"], [index])]) for index in ("[a]", "[b]"))
    found = paths.merge(left, right, 2)
    scans = found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans <= 40  # spelling out each side for itself read them 96 times
    assert _rows(found) == sorted((k, p, "e") for k in range(20) for p in (("[*]", ".g"), ("[a]",), ("[b]",)))


def test_leq_spells_out_indices_below_indices(spark):
    right = [["[a]", "[*]"], ["[*]", "[*]"]]
    trees = _tree(spark, [(1, ["[*]", "[b]"], "x")]), _tree(spark, [(1, p, "x") for p in right])
    assert [(r.key, r.leq) for r in paths.leq(*trees, 2).collect()] == [(1, True)]  # [a][b] of the right is under its [a][*]
    assert [(r.key, r.leq) for r in paths.leq(*reversed(trees), 2).collect()] == [(1, False)]


def test_leaves_are_counted_in_one_deal(spark):
    tree = _tree(spark, [(k, p, "e") for k in range(30) for p in ([], [".a"], [".a", ".x"], [".a", ".y"], [".b"])])
    found = paths.limit_leaves(tree, 2, 4)
    assert _shuffles(found) == 1
    assert sorted((r.key, r.height) for r in found.collect()) == [(k, 1) for k in range(30)]


def test_components_do_not_deal_edges_every_round(spark, monkeypatch):
    read = []
    edges = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)] + [(6, 0), (7, 6), (8, 9), (9, 8), (None, 3)], "a long, b long")
    keep = graph.arranged
    monkeypatch.setattr(graph, "arranged", lambda df, *keys: read.append(keys) or keep(df, *keys))
    rows = {r.node: r.component for r in graph.strong_components(edges).collect()}
    assert rows == {**dict.fromkeys(range(6), 0), 6: 6, 7: 7, 8: 8, 9: 8, None: None}
    assert read == [("a",), ("b",)]  # one colouring of two components


def test_a_ring_beyond_the_rounds_is_no_result(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_ROUNDS", 4)
    ring = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)], "a long, b long")
    with pytest.raises(DidNotSettle):
        graph.strong_components(ring).collect()


def test_culling_joins_only_the_keys_that_died(spark, monkeypatch):
    read = []
    keep = graph.arranged
    monkeypatch.setattr(graph, "arranged", lambda df, *keys: read.append(keys) or keep(df, *keys))
    rows = [(1, "k", 2), (2, "k", 3), (2, "k", 4), (3, "k", 9), (4, "k", None), (5, "k", 3), (6, "k", 5), (6, "j", 4), (7, "k", 8), (8, "k", 7), (9, "j", None), (10, None, 4), (10, None, None), (None, "k", 4), (11, "k", 3), (11, "k", 5)]
    found = graph.cull_frames(spark.createDataFrame(rows, "method int, kind string, callee int"))
    assert sorted(map(str, found.collect())) == sorted(f"Row(method={m}, kind={k!r}, callee={c})" for m, k, c in [(1, "k", 2), (2, "k", 4), (4, "k", None), (7, "k", 8), (8, "k", 7), (9, "j", None), (10, None, None), (None, "k", 4)])
    assert read == [("callee", "kind")]
