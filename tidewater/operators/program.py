"""Facts about a program derived from its tables: resolution, visibility, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.graph import reach


def resolve_targets(sites: DataFrame, decls: DataFrame, closure: DataFrame) -> DataFrame:
    """(site, method): for ``sites(site, type, name)`` the declaration of the name in the type or
    else in its nearest ancestor (the smallest id where a type declares it twice)."""
    # a type's own declaration is settled before the join, and each (type, name) asked for only once
    first = decls.groupBy("name", "type").agg(F.min("method_id").alias("method_id"))
    asked = sites.select("name", "type").distinct()
    above = asked.join(closure, "type").select("name", "type", F.col("ancestor").alias("at"), "depth")
    found = asked.select("name", "type", F.col("type").alias("at"), F.lit(0).alias("depth")).unionByName(above).join(first.withColumnRenamed("type", "at"), ["name", "at"])
    nearest = found.groupBy("name", "type").agg(F.min(F.struct("depth", "method_id")).alias("x"))
    return sites.join(nearest, ["name", "type"]).groupBy("site").agg(F.min("x").alias("x")).select("site", F.col("x.method_id").alias("method"))


def visible_fields(fields: DataFrame, closure: DataFrame) -> DataFrame:
    """(type, field, owner): fields of a type and, where it does not redeclare them, of its nearest
    ancestor that has them.  ``fields(type, field)`` is distinct."""
    own = fields.select("type", "field", F.lit(0).alias("depth"), F.col("type").alias("owner"))
    inherited = fields.withColumnRenamed("type", "ancestor").join(closure, "ancestor").select("type", "field", "depth", F.col("ancestor").alias("owner"))
    return own.unionByName(inherited).groupBy("type", "field").agg(F.min(F.struct("depth", "owner")).alias("x")).select("type", "field", F.col("x.owner").alias("owner"))


def capped_types(writes: DataFrame, most: int) -> DataFrame:
    """(key, n, types) of ``writes(key, type)``: the set of types, null where it has over ``most``.

    The set is only collected where its size is known to be small.
    """
    distinct = writes.distinct()
    sizes = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    small = distinct.join(sizes.where(F.col("n") <= most).select("key"), "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("type")).alias("types"))
    return sizes.join(small, "key", "left")


def refine_types(local: DataFrame, found: DataFrame, closure: DataFrame) -> DataFrame:
    """(key, type): the type found globally where it is narrower than the local one."""
    narrower = closure.select(F.col("ancestor").alias("local"), F.col("type").alias("global"), F.lit(True).alias("narrower"))
    joined = local.join(found, "key", "left").join(narrower, ["local", "global"], "left")
    return joined.select("key", F.when(F.col("narrower"), F.col("global")).otherwise(F.col("local")).alias("type"))


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes(node)`` that no root reaches."""
    return nodes.join(reach(edges, roots).select("node"), "node", "left_anti")


def component_features(issues: DataFrame, nearest: DataFrame, far: int = 5) -> DataFrame:
    """(issue, features) of ``issues(issue, node)`` by the nearest component that can be reached."""
    joined = issues.join(nearest, "node", "left")
    features = F.array_compact(F.array(
        F.when(F.col("exported"), "via-exported").when(~F.col("exported"), "via-unexported"),
        F.when(F.col("target").isNotNull(), F.concat(F.lit("via-class:"), F.col("target").cast("string"))),
        F.when(F.col("distance") > far, "via-distant"),
    ))
    return joined.select("issue", features.alias("features"))
