"""Labelled flow within a method: composing edges through temporaries with label cancellation.

A label is a string: ``.f`` reads field f, ``+f`` stores into it, ``(s`` enters call site s and
``)s`` leaves it.  Composing puts the second edge's labels after the first's: a store followed by
a read of the same field cancels, of another field the flow is dead; ``.*`` reads any field.
Calls cancel with returns of their own site.  Field and call labels are kept as two stacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.rounds import DidNotSettle, settled

MOST_DEPTH = 5
MOST_EDGES = 100_000
MOST_ROUNDS = 60
DEAD = "dead"


def _push(stack: Column, label: Column, opening: str, closing: str) -> Column:
    """``stack`` after one more label, or [DEAD]."""
    top = F.try_element_at(stack, F.lit(-1))
    opened = F.coalesce(top.startswith(opening), F.lit(False))
    closes = label.startswith(closing)
    same = (F.substring(top, 2, 1 << 20) == F.substring(label, 2, 1 << 20)) | (F.substring(label, 2, 1 << 20) == "*") | (F.substring(top, 2, 1 << 20) == "*")
    shorter = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
    grown = F.concat(stack, F.array(label))
    return F.when(F.array_contains(stack, DEAD), stack).when(closes & opened, F.when(same, shorter).otherwise(F.array(F.lit(DEAD)))).otherwise(grown)


def compose_stack(first: Column, second: Column, opening: str, closing: str) -> Column:
    return F.aggregate(second, first, lambda s, label: _push(s, label, opening, closing))


def compose(left: DataFrame, right: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """Edges (method, src, dst, fields, calls) that follow ``left`` and then ``right``."""
    r = right.select("method", F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("fields").alias("f2"), F.col("calls").alias("c2"))
    joined = left.withColumnRenamed("dst", "mid").join(r, ["method", "mid"])
    out = joined.select("method", "src", F.col("to").alias("dst"), compose_stack(F.col("fields"), F.col("f2"), "+", ".").alias("fields"), compose_stack(F.col("calls"), F.col("c2"), "(", ")").alias("calls"))
    alive = ~F.array_contains("fields", DEAD) & ~F.array_contains("calls", DEAD) & (F.size("fields") <= depth)
    return out.where(alive).distinct()


def eliminate(edges: DataFrame, temps: DataFrame, depth: int = MOST_DEPTH, most_edges: int = MOST_EDGES) -> DataFrame:
    """Edges between nodes that are no temporaries (``temps(method, node)``), following all paths
    through them.  A method that grows past ``most_edges`` gives no edges at all, as it is defined.
    """
    temps = temps.distinct()
    outgoing = edges.join(temps.select("method", F.col("node").alias("src")), ["method", "src"], "left_semi")
    seen = frontier = settled(edges.join(temps.select("method", F.col("node").alias("src")), ["method", "src"], "left_anti").distinct())
    for _ in range(MOST_ROUNDS):
        open_ = frontier.join(temps.select("method", F.col("node").alias("dst")), ["method", "dst"], "left_semi").select("method", "src", "dst", "fields", "calls")
        fresh = compose(open_, outgoing, depth)
        frontier = settled(fresh.join(seen, ["method", "src", "dst", "fields", "calls"], "left_anti"))
        if frontier.isEmpty():
            closed = seen.join(temps.select("method", F.col("node").alias("dst")), ["method", "dst"], "left_anti")
            return closed.select("method", "src", "dst", "fields", "calls")
        seen = settled(seen.unionByName(frontier))
        large = seen.groupBy("method").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_edges).select("method")
        seen, frontier = (df.join(large, "method", "left_anti") for df in (seen, frontier))
    raise DidNotSettle("paths through temporaries still grow")
