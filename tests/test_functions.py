"""Constraints as Columns."""

import pytest

from tidewater.functions.predicates import literal_of, required_substring, where

ROWS = [
    (1, "getData", "LBase;", 2, True, ["LInt;", "LUri;"], ["LBase;"]),
    (2, "setData", "LSub;", 3, False, [], ["LSub;", "LBase;"]),
    (3, "a.b", "LSub;", 1, True, ["LUri;"], ["LSub;", "LBase;"]),
]


@pytest.fixture(scope="module")
def methods(spark):
    return spark.createDataFrame(ROWS, "id int, name string, class string, n_params int, is_static boolean, params array<string>, ancestors array<string>")


@pytest.mark.parametrize(
    ("constraint", "expected"),
    [
        ({"constraint": "name", "pattern": ".etData"}, [1, 2]),
        ({"constraint": "name", "pattern": r"a\.b"}, [3]),
        ({"constraint": "name", "pattern": "etData"}, []),
        ({"constraint": "any_of", "inners": []}, [1, 2, 3]),
        ({"constraint": "all_of", "inners": []}, [1, 2, 3]),
        ({"constraint": "not", "inner": {"constraint": "is_static"}}, [2]),
        ({"constraint": "is_static", "value": False}, [2]),
        ({"constraint": "extends", "pattern": "LBase;"}, [1, 2, 3]),
        ({"constraint": "extends", "pattern": "LBase;", "include_self": False}, [2, 3]),
        ({"constraint": "number_parameters", "operator": ">", "value": 1}, [1, 2]),
        ({"constraint": "parameter", "idx": 1, "pattern": "LUri;"}, [1]),
        ({"constraint": "any_parameter", "pattern": "LUri;"}, [1, 3]),
        ({"constraint": "any_parameter", "start_idx": 1, "pattern": "LUri;"}, [1]),
        ({"constraint": "signature_match", "names": ["getData", "setData"], "extends": "LBase;", "include_self": False}, [2]),
        ([{"constraint": "parent", "pattern": "LSub;"}, {"constraint": "is_static"}], [3]),
    ],
)
def test_where(methods, constraint, expected):
    assert sorted(r.id for r in methods.where(where(constraint)).collect()) == expected


def test_unknown_constraint():
    with pytest.raises(ValueError, match="unknown constraint"):
        where({"constraint": "colour"})


def test_patterns():
    assert literal_of("LClass;") == "LClass;" and literal_of(r"a\.b") == "a.b" and literal_of("a.b") is None
    assert required_substring(".*onCreate.*") == "onCreate" and required_substring("(a|b)long") is None and required_substring("ab.*") is None


def test_equality_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, "id int, name string, class string, n_params int, is_static boolean, params array<string>, ancestors array<string>").write.parquet(str(tmp_path / "m"))
    plan = spark.read.parquet(str(tmp_path / "m")).where(where({"constraint": "name", "pattern": "getData"})).select("id")._jdf.queryExecution().toString()
    assert "EqualTo(name,getData)" in plan and "ReadSchema: struct<id:int,name:string>" in plan
