"""Facts kept up to date from a stream of new call edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.functions.rounds import MOST_ROUNDS, DidNotSettle, settled

#: Batches after which a version holds everything again instead of what its batch changed.
WHOLE_EVERY = 20


def nearer(seen: DataFrame, edges: DataFrame, added: DataFrame, most: int | None = None) -> DataFrame:
    """(node, distance) of the nodes that ``added(a, b)`` brings nearer, where ``seen(node, distance)``
    holds over ``edges``.

    Only those nodes are followed further: the work is that of the change.
    """
    every = settled(edges.unionByName(added).distinct())
    frontier, changed, via = seen, None, added
    for _ in range(MOST_ROUNDS):
        step = frontier.join(via, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg((F.min("distance") + 1).alias("distance"))
        if most is not None:
            step = step.where(F.col("distance") <= most)
        before = seen if changed is None else seen.unionByName(changed)
        old = before.join(step.select("node"), "node", "left_semi").groupBy("node").agg(F.min("distance").alias("before"))
        frontier = settled(step.join(old, "node", "left").where("before IS NULL OR distance < before").select("node", "distance"))
        if frontier.isEmpty():
            return changed if changed is not None else frontier
        changed = settled((frontier if changed is None else changed.unionByName(frontier)).groupBy("node").agg(F.min("distance").alias("distance")))
        via = every
    raise DidNotSettle("distances still shrink")


def merge_reach(seen: DataFrame, edges: DataFrame, added: DataFrame, most: int | None = None) -> DataFrame:
    """Distances ``seen(node, distance)`` over ``edges`` after ``added(a, b)`` came in."""
    return seen.unionByName(nearer(seen, edges, added, most)).groupBy("node").agg(F.min("distance").alias("distance"))


def _versions(spark: SparkSession, path: str, schema, version: int) -> DataFrame:
    """Everything up to a version: the last whole one and the changes since."""
    whole = version - version % WHOLE_EVERY
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{path}/{v}") for v in range(whole, version + 1)])


def distances_at(spark: SparkSession, state_path: str, version: int) -> DataFrame:
    """(node, distance) after so many batches."""
    rows = _versions(spark, f"{state_path}/reach", "node long, distance int", version)
    return rows.groupBy("node").agg(F.min("distance").alias("distance"))


def follow_edges(spark: SparkSession, source: DataFrame, seeds: DataFrame, state_path: str, checkpoint: str, most: int | None = None) -> StreamingQuery:
    """Start a query that keeps distances and edges under ``state_path`` for a stream ``source(a, b)``.

    A batch writes version ``epoch + 1``: its new edges and the nodes that they bring nearer, and
    everything once in ``WHOLE_EVERY`` batches.  A batch that is run again after a failure overwrites
    its own version and reads those before, so each edge counts once.
    """
    schema = source.select("a", "b").schema
    seeds.select(F.col("node").cast("long").alias("node"), F.lit(0).alias("distance")).write.mode("overwrite").parquet(f"{state_path}/reach/0")
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{state_path}/edges/0")

    def batch(added: DataFrame, epoch: int) -> None:
        session, version = added.sparkSession, epoch + 1
        seen = distances_at(session, state_path, epoch)
        edges = _versions(session, f"{state_path}/edges", schema, epoch)
        added = settled(added.select("a", "b").distinct())
        changed = nearer(seen, edges, added, most)
        if version % WHOLE_EVERY == 0:
            added = edges.unionByName(added).distinct()
            changed = seen.unionByName(changed).groupBy("node").agg(F.min("distance").alias("distance"))
        changed.select(F.col("node").cast("long").alias("node"), F.col("distance").cast("int").alias("distance")).write.mode("overwrite").parquet(f"{state_path}/reach/{version}")
        added.write.mode("overwrite").parquet(f"{state_path}/edges/{version}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
