"""How rows are dealt to tasks, and joins whose result is much larger than their sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks into which one side of a key is dealt, and tasks of the join.
BLOCKS, TASKS = 16, 64


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as the session has shuffle partitions.  Repeated keys
    and texts shrink so well in a shuffle that partitions merged by their bytes there (Spark's
    adaptive default) take many times that memory once they are sorted or hashed; a number that is
    asked for is not merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def arranged(df: DataFrame, *keys: str, distinct: bool = False) -> DataFrame:
    """``df`` dealt and sorted by ``keys`` and kept so: a loop that joins it by them every round moves
    only its other side.  Rows are made ``distinct`` where they are dealt to, without a further
    shuffle.  The caller lets it go with ``unpersist``."""
    rows = dealt(df, *keys)
    return (rows.distinct() if distinct else rows).sortWithinPartitions(*keys).persist()


def split_single(rows: DataFrame, key: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows(key, *values)``, distinct and without null values, in two: keys that have one row, and
    the rest.  Joined by ``values`` to distinct rows, a key of the first part meets each only once,
    so that only the rest needs a ``distinct`` on what the join makes."""
    place = F.struct(*values)
    known = rows.dropna(subset=values).groupBy(key).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    once = known.where("first = last").select(key, *[F.col(f"first.{v}") for v in values])
    several = known.where("first <> last").select(F.col(key).alias("__key"))
    more = rows.dropna(subset=values).join(several, rows[key].eqNullSafe(several["__key"]), "left_semi")
    return once, more.select(key, *values).distinct()


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], blocks: int = BLOCKS) -> DataFrame:
    """Equi-join for keys with many rows on both sides: the rows of ``left`` are dealt into blocks by
    ``by`` and those of ``right`` go to every block, so that no task makes all pairs of a key.  The
    number of tasks is fixed, as few bytes go in where many rows come out.  The merge join holds a
    block and gives it out once for each row of ``right``: a result that is written shrinks by such
    runs and by repeats of a short block, but not by repeats of all that a key has."""
    dealt = left.withColumn("__block", F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int"))
    copies = right.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = [*on, "__block"]
    return copies.repartition(TASKS, *key).join(dealt.repartition(TASKS, *key).hint("merge"), key).drop("__block")
