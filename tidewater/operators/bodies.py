"""Facts along ordered method bodies, by windows over (method, register)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_write(body: DataFrame, writes: list[str], reads: list[str]) -> DataFrame:
    """For every read (method_id, pos, reg, op) the op and position of the last write before it."""
    before = Window.partitionBy("method_id", "reg").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    written = F.when(F.col("op").isin(writes), F.struct("op", "pos"))
    seen = body.withColumn("w", F.last(written, ignorenulls=True).over(before))
    return seen.where(F.col("op").isin(reads)).select("method_id", "pos", "reg", "op", F.col("w.op").alias("last_op"), F.col("w.pos").alias("last_pos"))


def tainted_sinks(body: DataFrame, source: str, cleaner: str, sink: str) -> DataFrame:
    """Sinks whose register was last written by a source and not cleaned since."""
    return last_write(body, [source, cleaner], [sink]).where(F.col("last_op") == source).select("method_id", "pos", "reg", F.col("last_pos").alias("source_pos"))


def fold_states(body: DataFrame, ops: list[str]) -> DataFrame:
    """(method_id, reg, n_writes, final): writes of each register and the op of the last."""
    written = body.where(F.col("op").isin(ops))
    return written.groupBy("method_id", "reg").agg(F.count(F.lit(1)).alias("n_writes"), F.max_by("op", "pos").alias("final"))


def infer_sinks(body: DataFrame, writes: list[str], sink: str) -> DataFrame:
    """(method_id, reg): registers that reach a sink as they came in: nothing wrote them before."""
    return last_write(body, writes, [sink]).where("last_pos IS NULL").select("method_id", "reg").distinct()


def infer_generations(body: DataFrame, source: str, others: list[str], returns: str) -> DataFrame:
    """(method_id, reg): results that a source wrote last, which make their method a generation."""
    return last_write(body, [source, *others], [returns]).where(F.col("last_op") == source).select("method_id", "reg").distinct()
