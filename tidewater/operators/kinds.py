"""Kinds, transforms and sanitizers as arrays of tokens.

A sanitizer token is written ``!name``; other tokens are transforms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_sanitizer(token: Column) -> Column:
    return token.startswith("!")


def canonical_sink(source_local: Column, source_global: Column, sink_local: Column, sink_global: Column) -> Column:
    """Transforms of a whole flow in order: the source's list is stored reversed; sanitizers go."""
    whole = F.concat(F.reverse(F.concat(source_local, source_global)), sink_local, sink_global)
    return F.filter(whole, lambda t: ~is_sanitizer(t))


def hop(local: Column, global_: Column) -> tuple[Column, Column]:
    """(local, global) after a call: local transforms move ahead of the global ones."""
    return F.array().cast("array<string>"), F.concat(local, global_)


def apply_transform(kinds: DataFrame, token: Column, useful: DataFrame) -> DataFrame:
    """``kinds(key, base, transforms)`` with ``token`` ahead, where ``useful(base, transforms)``
    says that some rule can still use the result."""
    return kinds.select("key", "base", F.concat(F.array(token), F.col("transforms")).alias("transforms")).join(useful, ["base", "transforms"], "left_semi")


def useful_parts(rules: DataFrame) -> DataFrame:
    """(rule, part): all contiguous parts of each rule's transforms, the empty one included."""
    n = F.size("transforms")
    starts = rules.select("rule", "transforms", F.explode(F.sequence(F.lit(1), n + 1)).alias("s"))
    parts = starts.select("rule", "transforms", "s", F.explode(F.sequence(F.lit(0), F.size("transforms") - F.col("s") + 1)).alias("k"))
    return parts.select("rule", F.slice("transforms", F.col("s"), F.col("k")).alias("part")).distinct()


def sanitized(leading: Column, kind: Column) -> Column:
    """Whether the run of sanitizers at the head of a list stops ``kind``; ``!*`` stops all."""
    first = F.coalesce(F.array_position(F.transform(leading, lambda t: is_sanitizer(t)), False), F.lit(0))
    run = F.slice(leading, F.lit(1), F.when(first == 0, F.size(leading)).otherwise(first - 1).cast("int"))
    return F.array_contains(run, F.concat(F.lit("!"), kind)) | F.array_contains(run, "!*")


def drop_sanitized(flows: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """``flows(method, port, kind)`` that no ``sanitizers(method, port, kind)`` stops; a null port
    stands for every port, a null kind for all kinds."""
    exact = sanitizers.where("port IS NOT NULL AND kind IS NOT NULL").select("method", "port", "kind")
    any_kind = sanitizers.where("port IS NOT NULL AND kind IS NULL").select("method", "port")
    any_port = sanitizers.where("port IS NULL AND kind IS NOT NULL").select("method", "kind")
    every = sanitizers.where("port IS NULL AND kind IS NULL").select("method")
    for part, on in ((exact, ["method", "port", "kind"]), (any_kind, ["method", "port"]), (any_port, ["method", "kind"]), (every, ["method"])):
        flows = flows.join(part.distinct(), on, "left_anti")
    return flows


def prune_kinds(frames: DataFrame, rules: DataFrame) -> DataFrame:
    """``frames`` whose kind some rule names as source or sink."""
    used = rules.select(F.col("source").alias("kind")).union(rules.select("sink")).distinct()
    return frames.join(used, "kind", "left_semi")


def parse_kind(column: Column) -> Column:
    """``local@global:base(subkind)`` as a struct; lists are colon-separated before the base."""
    rest, at = F.regexp_extract(column, r"^(?:([^@]*)@)?(.*)$", 2), F.regexp_extract(column, r"^(?:([^@]*)@)?(.*)$", 1)
    body = F.split(rest, ":")
    base = F.element_at(body, -1)
    nonempty = lambda a: F.filter(a, lambda t: t != "")
    return F.struct(
        nonempty(F.split(at, ":")).alias("local"),
        F.slice(body, F.lit(1), F.size(body) - 1).alias("global"),
        F.regexp_replace(base, r"\(.*\)$", "").alias("base"),
        F.regexp_extract(base, r"\((.*)\)$", 1).alias("subkind"),
    )


def canonical_list(transforms: Column) -> Column:
    """Neighbouring sanitizers become a set: sorted, each once."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("run"))
    closed = lambda s: F.concat(s["out"], F.array_sort(F.array_distinct(s["run"])))
    step = lambda s, t: F.when(is_sanitizer(t), F.struct(s["out"].alias("out"), F.concat(s["run"], F.array(t)).alias("run"))).otherwise(F.struct(F.concat(closed(s), F.array(t)).alias("out"), none.alias("run")))
    return F.aggregate(transforms, start, step, closed)


def leading_sanitizers(transforms: Column) -> Column:
    """The run of sanitizers at the head of a list."""
    first = F.coalesce(F.array_position(F.transform(transforms, lambda t: is_sanitizer(t)), False), F.lit(0))
    return F.slice(transforms, F.lit(1), F.when(first == 0, F.size(transforms)).otherwise(first - 1).cast("int"))


def filter_global(incoming: Column, existing: Column) -> Column:
    """``incoming`` without those of its last sanitizers that stand at the head of ``existing``."""
    tail = F.reverse(leading_sanitizers(F.reverse(incoming)))
    head = F.slice(incoming, F.lit(1), F.size(incoming) - F.size(tail))
    held = leading_sanitizers(existing)
    return F.concat(head, F.filter(tail, lambda t: ~F.array_contains(held, t)))


def discard_unmatched(transforms: Column, forward: bool) -> Column:
    """Sanitizers that can match nothing any more leave: going forward those of source kinds
    (``!source:k``), going backward those of sink kinds (``!sink:k``)."""
    gone = "!source:" if forward else "!sink:"
    return F.filter(transforms, lambda t: ~t.startswith(gone))


def source_as_transform(kind: Column, sink_transforms: Column) -> Column:
    """A matched source carried on by the sink: its kind becomes a transform ahead of the sink's;
    null where the list carries one already."""
    held = F.exists(sink_transforms, lambda t: t.startswith("SAT["))
    return F.when(~held, F.concat(F.array(F.concat(F.lit("SAT["), kind, F.lit("]"))), sink_transforms))


def print_kind(kind: Column) -> Column:
    """The text that :func:`parse_kind` reads, from its struct."""
    before = F.when(F.size(kind["local"]) > 0, F.concat(F.array_join(kind["local"], ":"), F.lit("@"))).otherwise("")
    within = F.when(F.size(kind["global"]) > 0, F.concat(F.array_join(kind["global"], ":"), F.lit(":"))).otherwise("")
    return F.concat(before, within, kind["base"], F.when(kind["subkind"] != "", F.concat(F.lit("("), kind["subkind"], F.lit(")"))).otherwise(""))
