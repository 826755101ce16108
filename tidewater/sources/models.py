"""Declarative models, rules and results as JSON: strict readers, sharded writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAINT = "ARRAY<STRUCT<kind: STRING, subkind: STRING, partial_label: STRING, port: STRING, features: ARRAY<STRING>>>"

#: Method models; other keys are errors.
MODEL_SCHEMA = f"""method STRING, generations {_TAINT}, parameter_sources {_TAINT}, sources {_TAINT}, sinks {_TAINT},
  effect_sources {_TAINT}, effect_sinks {_TAINT},
  propagation ARRAY<STRUCT<input: STRING, output: STRING, features: ARRAY<STRING>, transforms: ARRAY<STRING>, collapse: BOOLEAN>>,
  sanitizers ARRAY<STRUCT<sanitize: STRING, kinds: ARRAY<STRING>, port: STRING>>, modes ARRAY<STRING>, freeze ARRAY<STRING>"""
FIELD_MODEL_SCHEMA = f"field STRING, sources {_TAINT}, sinks {_TAINT}"
LITERAL_MODEL_SCHEMA = f"pattern STRING, description STRING, sources {_TAINT}"
RULE_SCHEMA = """code INT, name STRING, description STRING, sources ARRAY<STRING>, sinks ARRAY<STRING>, transforms ARRAY<STRING>,
  effect_sources ARRAY<STRING>, multi_sources MAP<STRING, ARRAY<STRING>>, partial_sinks ARRAY<STRING>,
  cases ARRAY<STRUCT<sources: ARRAY<STRING>, sinks: ARRAY<STRING>, effect_sources: ARRAY<STRING>, transforms: ARRAY<STRING>>>"""

#: Roles of a model's taint lists.
ROLES = ["generations", "parameter_sources", "sources", "sinks", "effect_sources", "effect_sinks"]


class UnknownKey(ValueError):
    """A JSON object has a key that its schema does not know."""


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON arrays or objects under ``path`` with the given columns; a malformed file or a key that
    the schema does not know, at any depth, is an error (Spark alone would drop it silently)."""
    objects = _objects(spark.read.text(path, wholetext=True))
    seen = objects.agg(F.schema_of_variant_agg("v")).first()[0]
    unknown = _unknown_keys(T._parse_datatype_string(seen.replace("OBJECT<", "STRUCT<")), T._parse_datatype_string(schema)) if seen else []
    if unknown:
        raise UnknownKey(f"unknown keys in {path}: {', '.join(sorted(unknown)[:20])}")
    return objects.select(F.from_json(F.to_json("v"), schema, {"mode": "FAILFAST"}).alias("o"), "pos").select("o.*")


def _unknown_keys(seen: T.DataType, known: T.DataType, at: str = "") -> list[str]:
    """Paths of the keys of ``seen`` that ``known`` does not have."""
    if isinstance(seen, T.ArrayType) and isinstance(known, T.ArrayType):
        return _unknown_keys(seen.elementType, known.elementType, at)
    if isinstance(seen, T.StructType) and isinstance(known, T.MapType):
        return [k for f in seen.fields for k in _unknown_keys(f.dataType, known.valueType, f"{at}{f.name}.")]
    if isinstance(seen, T.StructType) and isinstance(known, T.StructType):
        fields = {f.name: f.dataType for f in known.fields}
        out = [f"{at}{f.name}" for f in seen.fields if f.name not in fields]
        return out + [k for f in seen.fields if f.name in fields for k in _unknown_keys(f.dataType, fields[f.name], f"{at}{f.name}.")]
    return []


def _objects(files: DataFrame) -> DataFrame:
    """(pos, v): each JSON object of files that hold an array or a single object."""
    array = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    return files.select(F.posexplode(F.from_json(array, "array<variant>")).alias("pos", "v"))


def taint_rows(models: DataFrame, of: str = "method") -> DataFrame:
    """(method, role, kind, port, features): one row for each taint of each model.  ``sources`` on
    Return are generations, on an argument parameter sources.  ``of`` names what the models are of:
    method, field (whose sources have no port) or pattern."""
    parts = None
    for role in [r for r in ROLES if r in models.columns]:
        part = models.select(of, F.lit(role).alias("role"), F.explode(role).alias("t"))
        parts = part if parts is None else parts.unionByName(part)
    features = F.coalesce("t.features", F.array().cast("array<string>")).alias("features")
    if of != "method":
        return parts.select(of, "role", "t.kind", F.lit(None).cast("string").alias("port"), features)
    port = F.coalesce("t.port", F.when(F.col("role").isin("generations", "sources"), "Return"))
    split: Column = F.when((F.col("role") == "sources") & port.startswith("Argument"), "parameter_sources").when(F.col("role") == "sources", "generations").otherwise(F.col("role"))
    return parts.select("method", split.alias("role"), "t.kind", port.alias("port"), features)


_CASE = "struct<sources:array<string>,sinks:array<string>,effect_sources:array<string>,transforms:array<string>>"


def only_rules(rules: DataFrame, only: list[int] | None = None, pos: str | None = None) -> tuple[DataFrame, list[int]]:
    """(the rules with the codes in ``only``, the first of each code; the codes that stand twice).
    ``pos`` names a column with their order."""
    if only is not None:
        rules = rules.where(F.col("code").isin(only))
    numbered = rules if pos else rules.withColumn("__pos", F.monotonically_increasing_id())
    order = pos or "__pos"
    # rules are configuration: a few hundred rows
    repeated = [r["code"] for r in rules.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("code").orderBy("code").collect()]
    first = numbered.groupBy("code").agg(F.min_by(F.struct(*rules.columns), order).alias("r")).select("r.*")
    return first, repeated


def rule_parts(rules: DataFrame) -> DataFrame:
    """(code, case, side, kind): all that a rule names.  A rule's own kinds are case 0, its cases
    follow.  Sides are source, sink, effect_source, each transform by its place, each label of
    ``multi_sources`` and the partial sinks."""
    cases = F.concat(F.array(F.struct("sources", "sinks", "effect_sources", "transforms").cast(_CASE)), F.coalesce("cases", F.array().cast(f"array<{_CASE}>")))
    flat = rules.select("code", F.posexplode(cases).alias("case", "c"))
    parts = flat.select("code", "case", F.lit("source").alias("side"), F.explode("c.sources").alias("kind"))
    for side, column in (("sink", "c.sinks"), ("effect_source", "c.effect_sources")):
        parts = parts.unionByName(flat.select("code", "case", F.lit(side).alias("side"), F.explode(column).alias("kind")))
    parts = parts.unionByName(flat.select("code", "case", F.posexplode("c.transforms").alias("i", "kind")).select("code", "case", F.format_string("transform:%d", "i").alias("side"), "kind"))
    labels = rules.select("code", F.explode("multi_sources").alias("label", "kinds")).select("code", F.lit(0).alias("case"), F.concat(F.lit("source:"), "label").alias("side"), F.explode("kinds").alias("kind"))
    partial = rules.select("code", F.lit(0).alias("case"), F.lit("partial_sink").alias("side"), F.explode("partial_sinks").alias("kind"))
    return parts.unionByName(labels).unionByName(partial)


def rule_cases(rules: DataFrame, only: list[int] | None = None) -> DataFrame:
    """(code, source, sink, transforms): every rule as pairs of kinds; the cases of a rule and its
    own kinds count alike.  ``only`` keeps the rules with these codes.  Rules with labels or effect
    sources have more sides than a pair: see :func:`rule_parts` and :func:`rule_labels`."""
    if only is not None:
        rules = rules.where(F.col("code").isin(only))
    own = F.array(F.struct("sources", "sinks", "effect_sources", "transforms").cast(_CASE))
    cases = rules.select("code", F.explode(F.concat(own, F.coalesce("cases", F.array().cast(f"array<{_CASE}>")))).alias("c"))
    pairs = cases.select("code", F.explode("c.sources").alias("source"), "c.sinks", "c.transforms")
    return pairs.select("code", "source", F.explode("sinks").alias("sink"), F.coalesce("transforms", F.array().cast("array<string>")).alias("transforms")).distinct()


def rule_labels(rules: DataFrame) -> DataFrame:
    """(rule, label, kind) of the rules with exactly two labels, as multi-source matching needs."""
    labels = rules.where(F.size(F.map_keys("multi_sources")) == 2).select(F.col("code").alias("rule"), F.explode("multi_sources").alias("label", "kinds"))
    return labels.select("rule", "label", F.explode("kinds").alias("kind"))


def write_sharded(rows: DataFrame, path: str, shards: int, name: str = "model") -> None:
    """``rows`` as JSON lines in ``shards`` files ``name@i-of-n.json`` (five digits), each row a line."""
    numbered = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    numbered.repartition(shards).write.mode("errorifexists").text(path)
    context = rows.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    parts = sorted(str(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for i, part in enumerate(parts):
        files.rename(context._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}"), context._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}@{i:05d}-of-{len(parts):05d}.json"))


def read_sharded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines shards; lines that begin with ``//`` are comments."""
    lines = spark.read.text(path).where(~F.col("value").startswith("//") & (F.col("value") != ""))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("o")).select("o.*")


def metadata(issues: DataFrame, methods: DataFrame) -> DataFrame:
    """One row of counts for the report's header: issues, rules hit, methods with and without code."""
    counted = issues.agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("rule").alias("rules_hit"))
    return counted.crossJoin(methods.agg(F.count(F.lit(1)).alias("methods"), F.count_if(~F.col("has_code")).alias("without_code")))  # one row each
