"""JSON models and rules, sharded results, incremental distances."""

import json

import pytest

from tidewater.operators import graph
from tidewater.sources import models
from tidewater.streaming import increment


def test_models_and_unknown_keys(spark, tmp_path):
    (tmp_path / "models.json").write_text(json.dumps([
        {"method": "LA;.f:()V", "sources": [{"kind": "S", "port": "Argument(1)"}, {"kind": "R", "port": "Return"}], "modes": ["skip"]},
        {"method": "LB;.g:()V", "sinks": [{"kind": "K", "port": "Argument(0)", "features": ["via-x"]}]},
    ]))
    rows = models.taint_rows(models.read_strict(spark, str(tmp_path / "models.json"), models.MODEL_SCHEMA)).collect()
    assert sorted((r.method, r.role, r.kind, r.port, r.features) for r in rows) == [("LA;.f:()V", "generations", "R", "Return", []), ("LA;.f:()V", "parameter_sources", "S", "Argument(1)", []), ("LB;.g:()V", "sinks", "K", "Argument(0)", ["via-x"])]
    (tmp_path / "bad.json").write_text(json.dumps({"method": "LA;.f:()V", "sauces": []}))
    with pytest.raises(models.UnknownKey, match="sauces"):
        models.read_strict(spark, str(tmp_path / "bad.json"), models.MODEL_SCHEMA)


def test_rule_cases(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps([
        {"code": 1, "name": "a", "sources": ["S"], "sinks": ["K", "L"], "transforms": ["T"]},
        {"code": 2, "name": "b", "cases": [{"sources": ["S"], "sinks": ["M"]}, {"sources": ["R"], "sinks": ["M"]}]},
    ]))
    rules = models.read_strict(spark, str(tmp_path / "rules.json"), models.RULE_SCHEMA)
    found = {(r.code, r.source, r.sink, tuple(r.transforms)) for r in models.rule_cases(rules).collect()}
    assert found == {(1, "S", "K", ("T",)), (1, "S", "L", ("T",)), (2, "S", "M", ()), (2, "R", "M", ())}
    assert {r.code for r in models.rule_cases(rules, [2]).collect()} == {2}


def test_sharded_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"m{i}", [f"k{i}"]) for i in range(20)], "id int, name string, kinds array<string>")
    models.write_sharded(rows, str(tmp_path / "out"), 3)
    parts = sorted((tmp_path / "out").glob("model@*.json"))
    assert [p.name for p in parts] == [f"model@0000{i}-of-00003.json" for i in range(3)]
    parts[0].write_text("// header\n" + parts[0].read_text())
    (tmp_path / "out" / f".{parts[0].name}.crc").unlink()
    assert len(parts) == 3
    assert sorted(models.read_sharded(spark, str(tmp_path / "out"), "id int, name string, kinds array<string>").collect()) == sorted(rows.collect())


def test_merge_equals_full_evaluation(spark):
    old = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (7, 8)], "a long, b long")
    new = spark.createDataFrame([(0, 2), (3, 4), (4, 1)], "a long, b long")
    seeds = spark.createDataFrame([(0,)], "node long")
    merged = increment.merge_reach(graph.reach(old, seeds), old, new)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, graph.reach(old.union(new), seeds).collect()))


@pytest.mark.parametrize("whole", [2, 20])
def test_stream_of_edges(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(increment, "WHOLE_EVERY", whole)
    schema, seeds = "a long, b long", spark.createDataFrame([(0,)], "node long")
    batches = [[(0, 1), (1, 2)], [(2, 3), (0, 3)], [(5, 6)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = increment.follow_edges(spark, source, seeds, str(tmp_path / "state"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert query.exception() is None
    last = increment.distances_at(spark, str(tmp_path / "state"), 3)
    assert sorted(map(tuple, last.collect())) == [(0, 0), (1, 1), (2, 2), (3, 1)]
    assert spark.read.parquet(str(tmp_path / "state" / "edges" / "3")).count() == 1  # a batch writes its change
