"""Access-path trees as rows (key, path ARRAY<STRING>, element).

An index step is written ``[f]`` and ``[*]`` stands for any index that is not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.joins import dealt

ANY = "[*]"


def starts_with(path: Column, prefix: Column) -> Column:
    return F.slice(path, F.lit(1), F.size(prefix)) == prefix


def _literal(path: list[str]) -> Column:
    return F.array(*map(F.lit, path)) if path else F.array().cast("array<string>")


def strict_prefixes(path: Column) -> Column:
    """All prefixes shorter than ``path``, the root first; none for the root."""
    heads = F.transform(F.sequence(F.lit(0), F.size(path) - 1), lambda n: F.slice(path, F.lit(1), n))
    return F.when(F.size(path) > 0, heads).otherwise(F.array().cast("array<array<string>>"))


def rest(path: Column, n: Column) -> Column:
    """``path`` after its first ``n`` steps."""
    return F.slice(path, n + 1, F.greatest(F.size(path) - n, F.lit(0)))


def read(tree: DataFrame, path: list[str]) -> DataFrame:
    """The subtree at ``path``: elements of ancestors flow down to its root, and an index that is
    not listed is read through ``[*]``."""
    query = _literal(path)
    exact = tree.where(starts_with(F.col("path"), query)).select("key", rest(F.col("path"), F.size(query)).alias("path"), "element")
    above = tree.where((F.size("path") < F.size(query)) & starts_with(query, F.col("path"))).select("key", _literal([]).alias("path"), "element")
    out = exact.unionByName(above)
    if path and path[-1].startswith("["):
        parent, any_path = _literal(path[:-1]), _literal([*path[:-1], ANY])
        below = tree.where(starts_with(F.col("path"), parent) & (F.size("path") > len(path) - 1))
        if path[-1] == ANY:  # every index
            step = F.get("path", F.lit(len(path) - 1))
            more = below.where(step.startswith("[") & (step != ANY))
        else:
            listed = tree.where(starts_with(F.col("path"), query)).select("key").distinct()
            more = below.where(starts_with(F.col("path"), any_path)).join(listed, "key", "left_anti")
        out = out.unionByName(more.select("key", rest(F.col("path"), F.lit(len(path))).alias("path"), "element"))
    return out.distinct()


def write_strong(tree: DataFrame, new: DataFrame, path: list[str]) -> DataFrame:
    """Elements of ``new(key, element)`` replace all at ``path`` and below it, for their keys."""
    query = _literal(path)
    gone = tree.join(new.select("key").distinct(), "key", "left_semi").where(starts_with(F.col("path"), query))
    kept = tree.join(gone.distinct(), ["key", "path", "element"], "left_anti")
    return kept.unionByName(new.select("key", query.alias("path"), "element")).distinct()


def write_weak(tree: DataFrame, new: DataFrame, path: list[str]) -> DataFrame:
    """Elements join those at ``path``; what an ancestor holds already is not repeated."""
    return prune(tree.unionByName(new.select("key", _literal(path).alias("path"), "element")).distinct())


def _judged(tree: DataFrame, *sums: Column) -> DataFrame:
    """(key, element, path, gone, *sums): rows of ``tree`` once each, and whether an ancestor of their
    path holds their element too.

    A row stands under its own path and under all above it, so that the rows of one place meet
    there: one deal by key and element serves all of it, and nothing is joined.
    """
    own = F.array(F.col("path"))
    stands = dealt(tree, "key", "element").withColumn("upper", F.explode(F.when(F.col("path").isNotNull(), F.concat(strict_prefixes(F.col("path")), own)).otherwise(own)))
    at_home = F.size("upper") == F.size("path")
    held = stands.withColumn("held", F.max(at_home).over(Window.partitionBy("key", "element", "upper")))
    gone = F.bool_or(F.col("held") & ~at_home & F.col("key").isNotNull() & F.col("element").isNotNull())
    return held.groupBy("key", "element", "path").agg(F.coalesce(gone, F.lit(False)).alias("gone"), *sums)


def prune(tree: DataFrame) -> DataFrame:
    """``tree``, a set of rows, without elements that an ancestor of their path holds."""
    return _judged(tree).where("NOT gone").select("key", "path", "element")


def collapse_deeper(tree: DataFrame, height: int) -> DataFrame:
    """Paths cut to ``height`` steps, with ``broadened`` where something was cut."""
    cut = tree.select("key", F.slice("path", 1, height).alias("path"), "element", (F.size("path") > height).alias("broadened"))
    return cut.groupBy("key", "path", "element").agg(F.bool_or("broadened").alias("broadened"))


def limit_leaves(tree: DataFrame, most: int, deepest: int) -> DataFrame:
    """(key, height): the height to which a key's tree is cut so that it keeps ``most`` leaves.

    The smallest k at which more than ``most`` distinct leaf paths remain gives height k - 1; a
    key without such a k is not listed.
    """
    # all steps group by the key and more, so they stay in the task to which the key is dealt
    heads = F.explode(F.concat(F.transform(strict_prefixes(F.col("path")), lambda p: F.struct(p.alias("path"), F.lit(True).alias("inner"))), F.array(F.struct("path", F.lit(False).alias("inner")))))
    rows = dealt(tree.select("key", "path"), "key").select("key", heads.alias("x")).select("key", "x.path", "x.inner").where("size(path) > 0")
    leaves = rows.groupBy("key", "path").agg(F.bool_or("inner").alias("inner")).where("NOT inner")
    cuts = leaves.select("key", F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("k"), "path").select("key", "k", F.slice("path", F.lit(1), F.col("k")).alias("head")).distinct()
    over = cuts.groupBy("key", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return over.groupBy("key").agg((F.min("k") - 1).alias("height"))


def cut_to_leaves(tree: DataFrame, most: int, deepest: int) -> DataFrame:
    """``tree`` with the paths of each key cut to the height of :func:`limit_leaves`, and
    ``broadened`` where something was cut."""
    heights = limit_leaves(tree, most, deepest)
    joined = tree.join(heights, "key", "left")
    cut = joined.select("key", F.when(F.col("height").isNull(), F.col("path")).otherwise(F.slice("path", F.lit(1), F.coalesce("height", F.lit(0)))).alias("path"), "element", F.coalesce(F.size("path") > F.col("height"), F.lit(False)).alias("broadened"))
    return cut.groupBy("key", "path", "element").agg(F.bool_or("broadened").alias("broadened"))


def raw_read(tree: DataFrame, path: list[str]) -> DataFrame:
    """The subtree at ``path`` alone: nothing flows down from its ancestors."""
    query = _literal(path)
    return tree.where(starts_with(F.col("path"), query)).select("key", rest(F.col("path"), F.size(query)).alias("path"), "element").distinct()


def raw_read_longest(tree: DataFrame, queries: DataFrame) -> DataFrame:
    """(key, found, remainder) of ``queries(key, path)``: the longest part of the path from the root
    that the tree of the key has, and what is left of the path."""
    heads = lambda: F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    there = tree.select("key", F.explode(heads()).alias("head")).distinct()
    asked = queries.select("key", "path", F.explode(heads()).alias("head"))
    best = asked.join(there, ["key", "head"], "left_semi").groupBy("key", "path").agg(F.max(F.struct(F.size("head").alias("n"), F.col("head").alias("h"))).alias("x"))
    return best.select("key", F.col("x.h").alias("found"), rest(F.col("path"), F.col("x.n")).alias("remainder"))


def is_index(step: Column) -> Column:
    return step.startswith("[") & (step != ANY)


def _indices(tree: DataFrame, depth: int) -> DataFrame:
    """(key, parent, step): the listed indices at a depth."""
    step = F.get("path", F.lit(depth))
    return tree.where(F.size("path") > depth).where(is_index(step)).select("key", F.slice("path", 1, depth).alias("parent"), step.alias("step")).distinct()


def spell_out(tree: DataFrame, indices: DataFrame, depth: int) -> DataFrame:
    """``tree`` where an index of ``indices(key, parent, step)`` that it does not list gets a copy of
    what stands under ``[*]``."""
    missing = indices.join(_indices(tree, depth), ["key", "parent", "step"], "left_anti")
    under = tree.where((F.size("path") > depth) & (F.get("path", F.lit(depth)) == ANY)).select("key", F.slice("path", 1, depth).alias("parent"), F.slice("path", F.lit(depth + 2), F.size("path")).alias("tail"), "element")
    copies = under.join(missing, ["key", "parent"]).select("key", F.concat("parent", F.array("step"), "tail").alias("path"), "element")
    return tree.unionByName(copies)


def _side_by_side(left: DataFrame, right: DataFrame, deepest: int) -> DataFrame:
    """(key, path, element, right): the rows of both trees.  An index that only one side lists meets
    the ``[*]`` of the other, so the other's is spelled out for it first, at every depth."""
    both = left.select("key", "path", "element", F.lit(False).alias("right")).unionByName(right.select("key", "path", "element", F.lit(True).alias("right")))
    for depth in range(deepest):
        step, parent = F.get("path", F.lit(depth)), F.slice("path", 1, depth).alias("parent")
        deeper = both.where(F.size("path") > depth)
        sides = deeper.where(is_index(step)).groupBy("key", parent, step.alias("step")).agg(F.bool_or("right").alias("in_right"), F.bool_or(~F.col("right")).alias("in_left"))
        missing = sides.where("in_left <> in_right").select("key", "parent", "step", F.col("in_left").alias("right"))
        under = deeper.where(step == ANY).select("key", parent, F.slice("path", F.lit(depth + 2), F.size("path")).alias("tail"), "element", "right")
        copies = dealt(under, "key", "parent", "right").join(dealt(missing, "key", "parent", "right"), ["key", "parent", "right"])
        both = both.unionByName(copies.select("key", F.concat("parent", F.array("step"), "tail").alias("path"), "element", "right"))
    return both


def merge(left: DataFrame, right: DataFrame, deepest: int) -> DataFrame:
    """Both trees in one, with the indices of each spelled out for the other."""
    return prune(_side_by_side(left, right, deepest).drop("right"))


def leq(left: DataFrame, right: DataFrame, deepest: int) -> DataFrame:
    """(key, leq): whether the left tree of each key adds nothing to the right one: no row of the
    merged tree is the left's alone."""
    merged = _judged(_side_by_side(left, right, deepest), F.bool_or("right").alias("right"))
    return merged.groupBy("key").agg((~F.bool_or(~F.col("gone") & ~F.col("right"))).alias("leq"))


def write_index(tree: DataFrame, new: DataFrame, path: list[str], strong: bool = False) -> DataFrame:
    """Elements of ``new(key, element)`` written at ``path``, minding its indices.

    An index that a tree does not list yet first gets what stands under ``[*]``.  A write through
    ``[*]`` goes to every listed index and to ``[*]`` itself, and is weak, however it was meant.
    """
    keys = new.select("key").distinct()
    for depth, step in enumerate(path):
        if step.startswith("[") and step != ANY and ANY not in path[:depth]:
            tree = spell_out(tree, keys.select("key", _literal(path[:depth]).alias("parent"), F.lit(step).alias("step")), depth).distinct()
    targets = keys.select("key", _literal([]).alias("parent"))
    for depth, step in enumerate(path):
        every = targets.select("key", "parent", F.lit(step).alias("step"))
        if step == ANY:
            every = every.unionByName(_indices(tree, depth).join(targets, ["key", "parent"], "left_semi"))
        targets = every.distinct().select("key", F.concat("parent", F.array("step")).alias("parent"))
    if strong and ANY not in path:
        return write_strong(tree, new, path)
    rows = new.join(targets, "key").select("key", F.col("parent").alias("path"), "element")
    return prune(tree.unionByName(rows).distinct())


def resolve_arguments(path: Column, constants: Column) -> Column:
    """``path`` with every step ``[<Argument(n)>]`` replaced by the index of the constant that the
    map ``constants`` (n to text) has for it, else by ``[*]``."""
    number = lambda step: F.regexp_extract(step, r"^\[<Argument\((\d+)\)>\]$", 1)
    found = lambda step: F.try_element_at(constants, number(step).try_cast("int"))
    return F.transform(path, lambda step: F.when(number(step) == "", step).otherwise(F.coalesce(F.concat(F.lit("["), found(step), F.lit("]")), F.lit(ANY))))


def propagate(tree: DataFrame, rules: DataFrame) -> DataFrame:
    """Elements moved by ``rules(key, input, output)``: a path under the input goes under the
    output with its remainder, and one above the input goes to the output itself."""
    joined = tree.join(rules, "key")
    size = F.least(F.size("path"), F.size("input"))
    fits = F.slice("path", F.lit(1), size) == F.slice("input", F.lit(1), size)
    return joined.where(fits).select("key", F.concat("output", rest(F.col("path"), F.size("input"))).alias("path"), "element").distinct()


def shape_with(tree: DataFrame, mold: DataFrame) -> DataFrame:
    """Paths cut to their longest prefix in ``mold(key, path)``; the root is always in it."""
    heads = tree.select("key", "path", "element", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", 1, n))).alias("head"))
    known = mold.select("key", F.col("path").alias("head")).distinct()
    root = tree.select("key").distinct().select("key", _literal([]).alias("head"))
    found = heads.join(known.unionByName(root).distinct(), ["key", "head"], "left_semi")
    best = found.groupBy("key", "path", "element").agg(F.max(F.struct(F.size("head").alias("n"), "head")).alias("x"))
    return best.select("key", F.col("x.head").alias("path"), "element").distinct()


def drop_invalid(tree: DataFrame, fields: DataFrame) -> DataFrame:
    """Paths cut before the first step that is no field of its owner.

    ``fields(owner, step)``; the owner of a step is the step before it, that of the first is
    ``key``.  An owner without fields is unknown and lets every step pass.
    """
    steps = tree.select("key", "path", "element", F.posexplode_outer("path").alias("i", "step"))
    owned = steps.withColumn("owner", F.when(F.col("i") > 0, F.get("path", F.col("i") - 1)).otherwise(F.col("key").cast("string")))
    known = fields.select("owner").distinct().withColumn("known", F.lit(True))
    right = fields.distinct().withColumn("valid", F.lit(True))
    judged = owned.join(known, "owner", "left").join(right, ["owner", "step"], "left")
    bad = F.min(F.when(F.col("known") & F.col("valid").isNull(), F.col("i")))
    cut = judged.groupBy("key", "path", "element").agg(bad.alias("bad"))
    return cut.select("key", F.when(F.col("bad").isNull(), F.col("path")).otherwise(F.slice("path", F.lit(1), F.coalesce("bad", F.lit(0)))).alias("path"), "element").distinct()
