"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between Spark and its Python workers, unless the session says otherwise.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where it is unset, a temporary one serves a local
    session (tests); a cluster's executors would not see it, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and
    a lost executor costs a re-read instead of a recomputation.  Inside :func:`passing` the table
    goes with the block."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _passing:
        _passing[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, n: int, by: str) -> DataFrame:
    """``df`` written in ``n`` buckets by a column, as a table of the session: a join by that column
    shuffles the other side only.  Inside :func:`passing` the table goes with the block."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"tidewater_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    if _passing:
        _passing[-1] += [path, f"table {table}"]
    df.write.format("parquet").bucketBy(n, by).option("path", path).saveAsTable(table)
    return spark.table(table)


_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables materialized within the block are deleted at its end."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            if path.startswith("table "):
                spark.sql(f"DROP {path.replace('table', 'TABLE', 1)}")
            else:
                delete_path(spark, path)


@contextmanager
def lasting() -> Iterator[None]:
    """Tables materialized within the block outlive the :func:`passing` block around it."""
    _passing.append([])
    try:
        yield
    finally:
        _passing.pop()


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _release() -> None:
    """Give memory that a task has left back to the machine: workers wait idle for the next one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of bounded bytes; a worker frees its memory after
    its task."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH_SETTING) == _default_batch(spark):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(released, schema)


def _default_batch(spark: SparkSession) -> str:
    return spark._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(_BATCH_SETTING)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, so any store works."""
    target, files = _file_system(spark, path)
    files.delete(target, True)


def share_file(spark: SparkSession, name: str, content: bytes) -> str:
    """Put a small file into the shared folder and let Spark bring it to every executor; the name
    under which ``SparkFiles.get`` finds it there."""
    path = f"{shared_dir(spark)}/files/{name}"
    target, files = _file_system(spark, path)
    if not files.exists(target):
        fresh, _ = _file_system(spark, f"{path}-{uuid.uuid4().hex}")
        out = files.create(fresh)
        out.write(content)
        out.close()
        files.rename(fresh, target)
    spark.sparkContext.addFile(str(target.toString()))
    return name
