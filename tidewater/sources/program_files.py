"""Files beside the program itself: tunables, the manifest and the index of source files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tunables and their defaults.
HEURISTICS: dict[str, int | None] = {
    "join_override_threshold": 40,
    "android_join_override_threshold": 10,
    "warn_override_threshold": None,
    "source_sink_tree_widening_height": 4,
    "generation_max_port_size": 4,
    "generation_max_output_path_leaves": 20,
    "parameter_source_max_port_size": 4,
    "parameter_source_max_output_path_leaves": 20,
    "sink_max_port_size": 4,
    "sink_max_input_path_leaves": 20,
    "call_effect_source_max_port_size": 4,
    "call_effect_source_max_output_path_leaves": 20,
    "call_effect_sink_max_port_size": 4,
    "call_effect_sink_max_input_path_leaves": 20,
    "max_number_iterations": 150,
    "max_depth_class_properties": 10,
    "max_call_chain_source_sink_distance": 10,
    "propagation_max_input_path_size": 4,
    "propagation_max_input_path_leaves": 4,
    "propagation_max_output_path_size": 4,
    "propagation_max_output_path_leaves": 4,
    "propagation_output_path_tree_widening_height": 4,
    "propagation_max_collapse_depth": 4,
}


def read_heuristics(spark: SparkSession, path: str) -> dict[str, int | None]:
    """The tunables, those of a JSON object under ``path`` in place of their defaults."""
    given = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    odd = [k for k, v in given.items() if k not in HEURISTICS or not isinstance(v, int) or isinstance(v, bool) or v < 0]
    if odd:
        raise ValueError(f"not tunables, or not counts: {', '.join(sorted(odd))}")
    return HEURISTICS | given


COMPONENTS = ["activity", "activity-alias", "receiver", "service", "provider"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(component, class, exported, permission) of every component of a manifest.  A component is
    exported if it says so, or if it says nothing and has an intent filter."""
    schema = "_name STRING, _exported STRING, _permission STRING, `intent-filter` ARRAY<STRUCT<_VALUE: STRING>>"
    parts = None
    for tag in COMPONENTS:
        rows = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)
        rows = rows.select(F.lit(tag).alias("component"), F.col("_name").alias("class"), F.coalesce(F.col("_exported") == "true", F.col("intent-filter").isNotNull()).alias("exported"), F.col("_permission").alias("permission"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def source_index(spark: SparkSession, path: str) -> DataFrame:
    """(class, path): the top-level classes that source files declare, with their packages; where
    several files declare a class, the first path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    package = F.regexp_extract("value", r"(?m)^package\s+([\w.]+)", 1)
    words = "public|private|protected|internal|abstract|final|sealed|open|data|annotation"
    names = F.regexp_extract_all("value", F.lit(rf"(?m)^(?:/\*.*?\*/\s*)?(?:(?:{words})\s+)*(?:class|enum class|enum|interface|object)\s+(\w+)"), F.lit(1))
    found = files.select("path", package.alias("package"), F.explode(names).alias("name"))
    named = F.concat(F.lit("L"), F.when(F.col("package") == "", "").otherwise(F.concat(F.replace("package", F.lit("."), F.lit("/")), F.lit("/"))), "name", F.lit(";"))
    return found.select(named.alias("class"), "path").groupBy("class").agg(F.min("path").alias("path"))
