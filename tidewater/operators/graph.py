"""Closures over call graphs and type hierarchies, as delta loops.

A loop keeps what it has seen apart from its frontier, joins only the frontier with the edges and
checkpoints every round, so a round costs what it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.joins import arranged, split_single
from tidewater.functions.rounds import MOST_ROUNDS, DidNotSettle, settled


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None, key: list[str] | None = None) -> DataFrame:
    """(*key, node, distance): least number of hops from the seeds (*key, node) over edges (a, b).

    Nodes come up in the order of distance, so a node is final when it is first seen.  The edges
    are computed once and not in every round.
    """
    key = [*(key or []), "node"]
    edges = settled(edges.select("a", "b"))
    frontier = settled(seeds.select(*key).distinct().withColumn("distance", F.lit(0)))
    seen = frontier
    for d in range(1, (most if most is not None else MOST_ROUNDS) + 1):
        step = frontier.join(edges, frontier["node"] == edges["a"]).select(*key[:-1], F.col("b").alias("node")).distinct()
        frontier = settled(step.join(seen.select(*key), key, "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    if most is None:
        raise DidNotSettle(f"still growing after {MOST_ROUNDS} rounds")
    return seen


def extends_closure(types: DataFrame) -> DataFrame:
    """(ancestor, type, depth): all strict descendants of every type but the root."""
    links = settled(types.where("super IS NOT NULL").select("type", "super"))
    level = settled(links.where("super <> 'Object'").select(F.col("super").alias("ancestor"), "type", F.lit(1).alias("depth")))
    out, depth = level, 1
    while True:
        depth += 1
        if depth > MOST_ROUNDS:
            raise DidNotSettle("the hierarchy has a cycle")
        down = links.select(F.col("super").alias("mid"), F.col("type").alias("low"))
        level = settled(level.join(down, level["type"] == down["mid"]).select("ancestor", F.col("low").alias("type"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def with_ancestors(facts: DataFrame, closure: DataFrame, col: str = "class") -> DataFrame:
    """``facts`` with ``ancestors``: those of ``col`` and itself."""
    above = closure.groupBy(F.col("type").alias("__type")).agg(F.collect_set("ancestor").alias("__above"))
    joined = facts.join(above, facts[col] == above["__type"], "left")
    return joined.withColumn("ancestors", F.array_union(F.array(col), F.coalesce("__above", F.array().cast("array<string>")))).drop("__type", "__above")


def _bases(decls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, name, ancestor) of ``decls(method_id, name, type)``, distinct: methods declared in one
    place, which meet each of their overrides only once, and the rest."""
    bases = decls.select(F.col("method_id").alias("base"), "name", F.col("type").alias("ancestor"))
    return split_single(bases, "base", ["name", "ancestor"])


def _below(decls: DataFrame, closure: DataFrame) -> DataFrame:
    """(name, ancestor, method), distinct: what is declared below each type.  A declaration has few
    types above it, but a type may have most declarations below, so the closure joins this side."""
    return decls.join(closure, "type").select("name", "ancestor", F.col("method_id").alias("method")).distinct()


def overrides(decls: DataFrame, closure: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(base, method): methods of the same name declared in a descendant; with ``only(base)``, of
    these bases alone."""
    decls = settled(decls.select("method_id", "name", "type"))
    low = _below(decls, closure)
    if only is not None:
        decls = decls.join(only.select(F.col("base").alias("method_id")), "method_id", "left_semi")
    once, more = (bases.join(low, ["name", "ancestor"]).select("base", "method") for bases in _bases(decls))
    return once.unionByName(more.distinct())


def override_counts(decls: DataFrame, closure: DataFrame) -> DataFrame:
    """(base, n): how many overrides a method has, if any.  Only those of methods declared in
    several places are made to be counted."""
    decls = settled(decls.select("method_id", "name", "type"))
    low = _below(decls, closure)
    once, more = _bases(decls)
    sizes = low.groupBy("name", "ancestor").agg(F.count(F.lit(1)).alias("n"))
    made = more.join(low, ["name", "ancestor"]).select("base", "method").distinct()
    return once.join(sizes, ["name", "ancestor"]).select("base", "n").unionByName(made.groupBy("base").agg(F.count(F.lit(1)).alias("n")))


def any_override(decls: DataFrame, closure: DataFrame, flag: str) -> DataFrame:
    """(base, ``flag``): whether the boolean holds for any override of a method, if it has one."""
    decls = settled(decls.select("method_id", "name", "type", flag))
    flags = decls.groupBy(F.col("method_id").alias("method")).agg(F.bool_or(flag).alias(flag))
    below = _below(decls, closure).join(flags, "method").groupBy("name", "ancestor").agg(F.bool_or(flag).alias(flag))
    bases = decls.select(F.col("method_id").alias("base"), "name", F.col("type").alias("ancestor"))
    return bases.join(below, ["name", "ancestor"]).groupBy("base").agg(F.bool_or(flag).alias(flag))


def overrides_below(calls: DataFrame, decls: DataFrame, closure: DataFrame) -> DataFrame:
    """(call, target) of virtual ``calls(call, base, receiver)``: overrides declared in the
    receiver's type or below it, a row for each such declaration."""
    decls = settled(decls.select("method_id", "name", "type"))
    own = decls.select(F.col("type").alias("receiver"), "type")
    reach = closure.select(F.col("ancestor").alias("receiver"), "type").unionByName(own).distinct()
    seen = decls.join(reach, "type").select(F.col("method_id").alias("method"), "receiver")
    low = _below(decls, closure)
    once, more = _bases(decls)
    # the receiver is part of the key, so a call only meets overrides that it keeps
    kept = low.join(seen, "method")
    once = once.join(low.select("name", "ancestor").distinct(), ["name", "ancestor"], "left_semi")
    direct = calls.join(once, "base").join(kept, ["name", "ancestor", "receiver"])
    made = more.join(low, ["name", "ancestor"]).select("base", "method").distinct().join(seen, "method")
    return direct.select("call", F.col("method").alias("target")).unionByName(calls.join(made, ["base", "receiver"]).select("call", F.col("method").alias("target")))


def class_intervals(types: DataFrame, closure: DataFrame) -> DataFrame:
    """(type, lo, hi): enter and exit numbers of a depth-first walk, siblings by name.

    hi = lo + 2 * size - 1, and a child starts 1 + twice the sizes of earlier siblings after its
    parent, so one window over siblings and a pass down the levels give all numbers.
    """
    below = closure.groupBy(F.col("ancestor").alias("type")).agg((F.count(F.lit(1)) + 1).alias("size"))
    total = types.agg(F.count(F.lit(1)).alias("total"))
    sized = types.join(below, "type", "left").crossJoin(F.broadcast(total))  # one row
    sized = sized.select("type", "super", F.when(F.col("super").isNull(), F.col("total")).otherwise(F.coalesce("size", F.lit(1))).alias("size"))
    earlier = Window.partitionBy("super").orderBy("type").rowsBetween(Window.unboundedPreceding, -1)
    offset = settled(sized.withColumn("offset", 1 + 2 * F.coalesce(F.sum("size").over(earlier), F.lit(0))))
    level = settled(offset.where("super IS NULL").select("type", F.lit(0).cast("long").alias("lo"), "size"))
    out = level
    for _ in range(MOST_ROUNDS):
        above = level.select(F.col("type").alias("super"), F.col("lo").alias("above"))
        level = settled(offset.join(above, "super").select("type", (F.col("above") + F.col("offset")).alias("lo"), "size"))
        if level.isEmpty():
            return out.select("type", "lo", (F.col("lo") + 2 * F.col("size") - 1).alias("hi"))
        out = out.unionByName(level)
    raise DidNotSettle("the hierarchy has a cycle")


def textual_index(sites: DataFrame) -> DataFrame:
    """``sites(caller, callee, pos)`` with ``idx``: how many calls of the callee stand before."""
    return sites.withColumn("idx", F.row_number().over(Window.partitionBy("caller", "callee").orderBy("pos")) - 1)


def nearest(edges: DataFrame, targets: DataFrame, most: int = 10) -> DataFrame:
    """(node, target, distance, exported): the nearest of ``targets(node, exported)`` that a node
    can reach; at a distance exported beats unexported, then the smallest id.

    A node carries one label.  A nearest target of a node is a nearest target of some successor
    one step closer, so the best label among these is the node's.
    """
    edges = settled(edges.select("a", "b"))
    label = F.struct((~F.col("exported")).alias("hidden"), F.col("node").alias("target"))
    frontier = settled(targets.groupBy("node").agg(F.min(label).alias("label")).withColumn("distance", F.lit(0)))
    seen = frontier
    for d in range(1, most + 1):
        step = frontier.join(edges, frontier["node"] == edges["b"]).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("label")).withColumnRenamed("at", "node")
        frontier = settled(step.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select("node", "label.target", "distance", (~F.col("label.hidden")).alias("exported"))


def shorter_ranges(spans: DataFrame) -> DataFrame:
    """``spans(line, s, e)`` that no overlapping shorter (then earlier) range of their line displaces."""
    other = spans.selectExpr("line AS line2", "s AS s2", "e AS e2")
    beaten = "line = line2 AND s2 <= e AND s <= e2 AND (e2 - s2 < e - s OR (e2 - s2 = e - s AND s2 < s))"
    return spans.join(other, F.expr(beaten), "left_anti")


#: Nodes up to which a set to be taken off the edges is broadcast.
FEW_NODES = 100_000


def _peeled(left: DataFrame) -> DataFrame:
    """Edges whose nodes have edges in and out, as long as some have not."""
    for _ in range(MOST_ROUNDS):
        ends = left.select(F.col("a").alias("node"), F.lit(True).alias("out")).unionByName(left.select(F.col("b").alias("node"), F.lit(False).alias("out")))
        bare = settled(ends.groupBy("node").agg(F.bool_and("out").alias("every"), F.bool_or("out").alias("any")).where("every = any").select("node"))
        n = bare.count()
        if n == 0:
            break
        bare = F.broadcast(bare) if n <= FEW_NODES else bare
        left = settled(left.join(bare, F.col("a") == F.col("node"), "left_anti").join(bare, F.col("b") == F.col("node"), "left_anti"))
    return left


def _least_to_reach(by_a: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches each node."""
    colour = settled(by_a.select(F.col("a").alias("node")).union(by_a.select("b")).distinct().withColumn("colour", F.col("node")))
    changed = colour
    for _ in range(MOST_ROUNDS):
        pushed = changed.join(by_a, F.col("node") == F.col("a")).groupBy(F.col("b").alias("to")).agg(F.min("colour").alias("new"))
        joined = colour.join(pushed, F.col("node") == F.col("to"), "left")
        colour2 = settled(joined.select("node", F.least("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") < F.col("colour")).alias("moved")))
        changed = colour2.where("moved").select("node", "colour")
        colour = colour2.select("node", "colour")
        if changed.isEmpty():
            return colour
    raise DidNotSettle("colours still spread")


def _reaching_back(by_b: DataFrame, colour: DataFrame) -> DataFrame:
    """(colour, node): nodes that reach the node of their colour through nodes of that colour."""
    back = grown = settled(colour.where("node = colour").select("colour", "node"))
    for _ in range(MOST_ROUNDS):
        step = grown.join(by_b, F.col("node") == F.col("b")).select("colour", F.col("a").alias("node")).distinct()
        grown = settled(step.join(colour, ["node", "colour"], "left_semi").join(back, ["colour", "node"], "left_anti").select("colour", "node"))
        if grown.isEmpty():
            return back
        back = back.unionByName(grown)
    raise DidNotSettle("components still grow")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each strongly connected component.

    Nodes without edges in or out of the rest are peeled off; in what is left, the smallest id
    that reaches a node colours it, and the nodes of a colour that reach back form a component.
    The edges are dealt once by each end, not in every round.
    """
    edges = settled(edges.select("a", "b"))
    nodes = settled(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    left, done = edges.where("a IS NOT NULL AND b IS NOT NULL"), None
    for _ in range(MOST_ROUNDS):
        left = _peeled(left)
        if left.isEmpty():
            break
        by_a, by_b = arranged(left, "a"), arranged(left, "b")
        found = settled(_reaching_back(by_b, _least_to_reach(by_a)).select("node", F.col("colour").alias("component")))
        done = found if done is None else done.unionByName(found)
        gone = found.select(F.col("node").alias("gone"))
        left = settled(by_a.join(gone, F.col("a") == F.col("gone"), "left_anti").join(gone, F.col("b") == F.col("gone"), "left_anti"))
        by_a.unpersist()
        by_b.unpersist()
    else:
        raise DidNotSettle("components are left")
    if done is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(done, "node", "left").withColumn("component", F.coalesce("component", "node"))


def cull_frames(frames: DataFrame) -> DataFrame:
    """``frames(method, kind, callee)`` that lead to a leaf (no callee) or to kept frames, as the
    greatest fixpoint of 'my callee still has a frame of my kind'.

    A key (method, kind) that has no frame takes the frames that call it with it; a key that loses
    its last frame so is the next round's.  A round joins only these keys.
    """
    frames = settled(frames.where("callee IS NULL OR kind IS NOT NULL"))  # no kind, no key to lead to
    by_callee = arranged(frames.where("callee IS NOT NULL"), "callee", "kind")
    has = settled(frames.groupBy("method", "kind").agg(F.count(F.lit(1)).alias("n")))
    called = by_callee.select(F.col("callee").alias("method"), "kind").distinct()
    dead = new = settled(called.join(has, ["method", "kind"], "left_anti"))
    lost = None
    for _ in range(MOST_ROUNDS):
        if new.isEmpty():
            break
        keys = new.select(F.col("method").alias("m2"), F.col("kind").alias("k2"))
        cut = settled(by_callee.join(keys, (F.col("callee") == F.col("m2")) & (F.col("kind") == F.col("k2")), "left_semi").groupBy("method", "kind").agg(F.count(F.lit(1)).alias("cut")))
        # of the keys that lose frames now, those that have lost all by now
        before = cut if lost is None else cut.unionByName(lost.join(cut.select("method", "kind"), ["method", "kind"], "left_semi"))
        sums = before.groupBy("method", "kind").agg(F.sum("cut").alias("cut"))
        lost = cut if lost is None else lost.unionByName(cut)
        new = settled(has.join(sums, ["method", "kind"]).where("cut = n").select("method", "kind"))
        dead = dead.unionByName(new)
    else:
        raise DidNotSettle("frames still go")
    gone = dead.select(F.col("method").alias("m2"), F.col("kind").alias("k2"))
    alive = frames.join(gone, (F.col("callee") == F.col("m2")) & (F.col("kind") == F.col("k2")), "left_anti")
    by_callee.unpersist()
    return alive.select(*frames.columns)
