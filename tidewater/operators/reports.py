"""Reports over results: coverage, expectations, listings and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def files_coverage(methods: DataFrame, analysed: Column) -> DataFrame:
    """(file, covered, n_with_code) of ``methods(file, has_code)``: files with an analysed method,
    or with no implementation at all."""
    with_code = F.col("has_code")
    return methods.groupBy("file").agg((F.bool_or(with_code & analysed) | ~F.bool_or(with_code)).alias("covered"), F.count_if(with_code).alias("n_with_code"))


def rules_coverage(rules: DataFrame, used: DataFrame) -> DataFrame:
    """(rule, covered): rules of which, in some case, every side has a kind in use.

    ``rules(rule, case, side, kind)``, a transform being a side of its own; ``used(kind)``.
    """
    marked = rules.join(used.select("kind").distinct().withColumn("used", F.lit(True)), "kind", "left")
    sides = marked.groupBy("rule", "case", "side").agg(F.bool_or(F.coalesce("used", F.lit(False))).alias("hit"))
    cases = sides.groupBy("rule", "case").agg(F.bool_and("hit").alias("hit"))
    return cases.groupBy("rule").agg(F.bool_or("hit").alias("covered"))


def expectations(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """(*on, passed) of ``expected(*on, kinds, issue)``: an issue is expected if what is found at
    its place has all its kinds, and no issue (``issue`` false) if it lacks one of them."""
    joined = expected.join(found.withColumnRenamed("kinds", "found_kinds"), on, "left")
    held = F.size(F.array_except("kinds", F.coalesce("found_kinds", F.array().cast("array<string>")))) == 0
    return joined.select(*on, (held == F.col("issue")).alias("passed"))


def model_of(frames: DataFrame, edges: DataFrame, methods: DataFrame) -> DataFrame:
    """(method_id, kinds, n_callers, n_callees): what an explorer shows of ``methods(method_id)``."""
    kinds = frames.groupBy(F.col("method").alias("method_id")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    callers = edges.groupBy(F.col("b").alias("method_id")).agg(F.count(F.lit(1)).alias("n_callers"))
    callees = edges.groupBy(F.col("a").alias("method_id")).agg(F.count(F.lit(1)).alias("n_callees"))
    out = methods.select("method_id")
    for part in (kinds, callers, callees):
        out = out.join(part, "method_id", "left")
    return out.select("method_id", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_callers", "n_callees")])


def differences(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(side, *on, n): rows that one of two results has more often than the other."""
    side = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), *on, "n")
    a, b = left.select(*on), right.select(*on)
    return side(a.exceptAll(b), "removed").unionByName(side(b.exceptAll(a), "added"))


MODES = ("normal", "cached_models", "replay")


def by_mode(mode: str, computed: DataFrame, loaded: DataFrame) -> DataFrame:
    """The facts that an analysis starts from: those computed now, also those of an earlier run, or
    only the latter."""
    if mode not in MODES:
        raise ValueError(f"a mode is one of {', '.join(MODES)}")
    return computed if mode == "normal" else loaded if mode == "replay" else loaded.unionByName(computed)
