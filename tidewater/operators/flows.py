"""Joins between calls, summaries and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.graph import reach

#: Overrides from which a virtual call keeps only its direct callee.
JOIN_LIMIT = 40


def virtual_targets(calls: DataFrame, overrides: DataFrame, limit: int = JOIN_LIMIT) -> DataFrame:
    """(a, target): the callee of each call and its overrides, unless there are ``limit`` or more.

    The cap is part of the semantics; it is applied to the override counts before the join.
    """
    few = overrides.groupBy("base").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < limit).select("base")
    direct = calls.select("a", F.col("b").alias("target"))
    through = calls.join(overrides.join(few, "base", "left_semi"), calls["b"] == overrides["base"]).select("a", F.col("method").alias("target"))
    return direct.unionByName(through).distinct()


def overlapping(left: DataFrame, right: DataFrame, on: list[str], width: int) -> DataFrame:
    """Pairs of rows (id, lo, hi) of a key whose intervals meet, with the meet.

    Both sides are dealt into buckets of ``width`` that they touch; a pair is made in the bucket
    of the later start alone, so it comes once.  ``width`` near the usual length keeps both the
    copies and the candidates of a bucket few.
    """
    touch = lambda df: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    a = touch(left).select(*on, "bucket", F.col("id").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = touch(right).select(*on, "bucket", F.col("id").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    lo, hi = F.greatest("alo", "blo"), F.least("ahi", "bhi")
    return a.join(b, [*on, "bucket"]).where((lo <= hi) & (F.floor(lo / width) == F.col("bucket"))).select(*on, "a", "b", lo.alias("lo"), hi.alias("hi"))


def match_rules(sources: DataFrame, sinks: DataFrame, rules: DataFrame, site: list[str]) -> DataFrame:
    """Issues: sources and sinks that meet at a site and that a rule forbids together.

    ``rules(rule, source, sink)`` join the sources first: kinds that no rule names leave before
    the larger join by site.
    """
    wanted = sources.join(rules, sources["kind"] == rules["source"]).drop("kind")
    return wanted.join(sinks.withColumnRenamed("kind", "sink"), [*site, "sink"])


def both_labels(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """(site, rule): sites that fulfil both labels of a rule.

    ``flows(site, kind)``; ``rules(rule, label, kind)`` with exactly two labels a rule.
    """
    found = flows.join(rules, "kind").select("site", "rule", "label").distinct()
    return found.groupBy("site", "rule").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("site", "rule")


def exploitable(flow_sinks: DataFrame, callers: DataFrame, entries: DataFrame, most: int = 10) -> DataFrame:
    """(entry, sink, distance): entries whose call chain of at most ``most`` calls leads to a
    method with a confirmed flow (``flow_sinks(sink, node)``)."""
    back = callers.select(F.col("b").alias("a"), F.col("a").alias("b"))
    chains = reach(back, flow_sinks, most, ["sink"])
    return chains.join(entries.select(F.col("node")), "node").select(F.col("node").alias("entry"), "sink", "distance")


def with_literals(literals: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """``literals(id, value)`` with the kind of every pattern that matches the whole value.

    Patterns are configuration: one pass evaluates them all in code, with no join.
    """
    hits = F.array_compact(F.array(*[F.when(F.col("value").rlike(f"^(?:{p})$"), F.lit(kind)) for p, kind in patterns]))
    return literals.select("id", F.explode(hits).alias("kind"))


def with_field_models(accesses: DataFrame, models: DataFrame) -> DataFrame:
    """``accesses(site, field)`` with the ``kinds`` of their field's model, none where it has none."""
    return accesses.join(models.select("field", "kinds"), "field", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))


def issue_methods(issues: DataFrame, frames: DataFrame) -> DataFrame:
    """(method, kind): all that the traces of ``issues(method, kind)`` run through, along the next
    hops of ``frames(method, kind, callee)``."""
    hops = frames.where("callee IS NOT NULL").select(F.struct("method", "kind").alias("a"), F.struct(F.col("callee").alias("method"), "kind").alias("b"))
    found = reach(hops.distinct(), issues.select(F.struct("method", "kind").alias("node")))
    return found.select("node.method", "node.kind")
