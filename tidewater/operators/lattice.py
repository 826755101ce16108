"""Merging facts at the same key: least distances, set unions, may and always features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_of(arrays: str) -> Column:
    """The sorted union of an array column over a group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(arrays))))


def join_frames(frames: DataFrame, keys: list[str]) -> DataFrame:
    """One frame for each key: least ``distance``, union of ``origins``, number of frames joined."""
    # sets are exploded and made distinct first, so that no group gathers repeated elements
    sets = frames.select(*keys, F.explode_outer("origins").alias("origin")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_set("origin")).alias("origins"))
    numbers = frames.groupBy(*keys).agg(F.min("distance").alias("distance"), F.count(F.lit(1)).alias("n_frames"))
    return numbers.join(sets, keys)


def may_always(tags: DataFrame, keys: list[str], frame: str, tag: str = "tag", always: str = "always") -> DataFrame:
    """(*keys, tag, kind) of ``tags(*keys, frame, tag, always)``, one row a tag of a frame.

    A tag is 'always' if every frame of the key has it as always, and 'may' if it is seen at all.
    """
    total = tags.groupBy(*keys).agg(F.countDistinct(frame).alias("__n"))
    seen = tags.where(F.col(tag).isNotNull()).groupBy(*keys, tag).agg(F.countDistinct(F.when(F.col(always), F.col(frame))).alias("__k"))
    return seen.join(total, keys).select(*keys, tag, F.when(F.col("__k") == F.col("__n"), "always").otherwise("may").alias("kind"))


def add_features(left: Column, right: Column) -> Column:
    """Sequential addition of feature sets STRUCT<may, always>: both are united."""
    always = F.array_union(left["always"], right["always"])
    may = F.array_except(F.array_union(left["may"], right["may"]), always)
    return F.struct(F.array_sort(may).alias("may"), F.array_sort(always).alias("always"))


def resolve_frozen(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Where a key has frozen rows, only they count."""
    held = rows.where("frozen").select(*[F.col(k).alias(f"frozen_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"frozen_{k}")) for k in keys])
    return rows.where("frozen").unionByName(rows.where("NOT frozen").join(held, same, "left_anti"))


def floor_quantiles(values: DataFrame, col: str, quantiles: dict[str, float]) -> DataFrame:
    """Total, mean, least, greatest and the elements at index floor(n * q) of the sorted values.

    Equal values are counted first, so the running count is over distinct values only.
    """
    counts = values.groupBy(F.col(col).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("total") * q), F.col("v"))).alias(name) for name, q in quantiles.items()]
    return ranked.agg(F.sum("n").alias("total"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 4).alias("average"), F.min("v").alias("least"), F.max("v").alias("greatest"), *picks)


def collapse_intervals(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames rolled up over their intervals: the key loses the interval."""
    return frames.groupBy(*keys).agg(F.min("distance").alias("distance"), F.countDistinct("lo", "hi").alias("n_intervals"))


def common_super(sets: DataFrame, closure: DataFrame, most: int = 40) -> DataFrame:
    """(key, super): the deepest type above all of a key's types (self counts); null for more than
    ``most`` types, which stand for any type.  ``sets(key, type)`` is distinct."""
    sizes = sets.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    small = sets.join(sizes.where(F.col("n") <= most), "key")
    own = small.select("key", "n", F.col("type").alias("above"))
    strict = small.join(closure.select("ancestor", "type"), "type").select("key", "n", F.col("ancestor").alias("above"))
    shared = own.unionByName(strict).groupBy("key", "n", "above").agg(F.count(F.lit(1)).alias("k")).where("k = n")
    depth = closure.groupBy(F.col("type").alias("above")).agg(F.count(F.lit(1)).alias("depth"))
    deepest = shared.join(depth, "above", "left").groupBy("key").agg(F.max(F.struct(F.coalesce("depth", F.lit(0)).alias("d"), "above")).alias("x"))
    found = sizes.join(deepest, "key", "left")
    return found.select("key", F.when(F.col("n") <= most, F.coalesce(F.col("x.above"), F.lit("Object"))).alias("super"))


def first_positions(rows: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """The first ``most`` distinct positions of each key: a limit that belongs to the semantics."""
    order = Window.partitionBy(*keys).orderBy("position")
    return rows.select(*keys, "position").distinct().withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most).drop("__k")
