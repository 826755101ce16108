"""JSON model generators: ``find`` / ``where`` / ``model`` turned into model rows.

A file holds ``{"model_generators": [...]}``.  Generators are configuration (a few hundred at
most) and are read on the driver; what they select stays in Spark: each becomes a filter and a
literal template over the table of methods or fields.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.predicates import INFORMED, Scope, field_where, where
from tidewater.operators.templates import ROW, instantiate

_KEYS = {"find", "where", "model", "verbosity", "code", "//"}

#: Generators in code, by name: functions of (spark, tables) that return model rows.
REGISTRY: dict[str, Callable[[SparkSession, dict[str, DataFrame]], DataFrame]] = {}


def generator(name: str) -> Callable:
    """Register a function (spark, tables) -> model rows; a name can be taken once."""

    def add(function: Callable) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"there is a generator {name!r} already")
        REGISTRY[name] = function
        return function

    return add


def read_generators(spark: SparkSession, path: str) -> list[dict]:
    """The generators of all JSON files under ``path``, in the order of their files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").orderBy("path").collect()
    found = []
    for file in files:
        content = json.loads(file["value"])
        for one in content["model_generators"] if isinstance(content, dict) else content:
            odd = set(one) - _KEYS
            if odd or one.get("find") not in ("methods", "fields"):
                raise ValueError(f"{file['path']}: a generator finds methods or fields, and does not take {', '.join(sorted(odd)) or one.get('find')}")
            found.append(one)
    return found


def run_generators(config: list[dict], methods: DataFrame, fields: DataFrame | None = None, scope: Scope = INFORMED) -> DataFrame:
    """Model rows (find, id, role, kind, port, output, features) of all generators, each once."""
    parts = []
    for one in config:
        if one["find"] == "methods":
            rows = instantiate(methods.where(where(one.get("where", []), scope)), one["model"], "method_id", scope)
        elif fields is None:
            raise ValueError("there is no table of fields")
        else:
            rows = instantiate(fields.where(field_where(one.get("where", []), scope)), one["model"], "field_id")
        parts.append(rows.select(F.lit(one["find"]).alias("find"), "id", "role", "kind", "port", "output", "features"))
    if not parts:
        return methods.sparkSession.createDataFrame([], f"find string, id long, {ROW}")
    return reduce(DataFrame.unionByName, parts).distinct()


def run_registered(spark: SparkSession, names: list[str], tables: dict[str, DataFrame]) -> DataFrame:
    """Model rows of the named generators, in order; an unknown or repeated name is an error."""
    unknown, repeated = [n for n in names if n not in REGISTRY], {n for n in names if names.count(n) > 1}
    if unknown or repeated:
        raise ValueError(f"unknown generators {unknown}, repeated {sorted(repeated)}")
    return reduce(DataFrame.unionByName, [REGISTRY[n](spark, tables).withColumn("generator", F.lit(n)) for n in names])
