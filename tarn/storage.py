"""Where intermediate tables live, and how lineage is cut.

Tables go to the shared folder that the cluster names in ``spark.checkpoint.dir``, so a lost
executor never takes them along. Only where that setting is missing (tests, notebooks in local
mode) a folder of our own is made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Memory that a broadcast table may take on every executor, and how many times the bytes of its compressed files it takes there at most.
BROADCAST_MEMORY, EXPANSION = 128 << 20, 8
#: Whether Spark deletes an execution's shuffle files at its end; else they stay until the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}
_scratch: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, or a folder of our own in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="tarn-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and return a DataFrame that reads it.

    Unlike ``checkpoint()`` the files are columnar and compressed, later reads are pruned to the
    columns they use, and the table's size is known to the planner. What was shuffled for it is
    deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarn_path = path
    held = _scratch.get()
    if held is not None:
        held.append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialized within are deleted at its end, but for those that the function it gives has been called with.

    What is returned from it must not read the others any more; kept tables belong to the scratch around, if there is one.
    """
    outer, held = _scratch.get(), []
    token, kept = _scratch.set(held), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _scratch.reset(token)
        for table in held:
            if not any(table is k for k in kept):
                release(table)
            elif outer is not None:
                outer.append(table)


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_tarn_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def size_bytes(df: DataFrame) -> int:
    """Bytes of the files of a materialized table; what a broadcast decision is based on."""
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(df._tarn_path)
    fs = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    return fs.getContentSummary(target).getLength()


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A materialized table with a hint to broadcast it, if its measured files, grown as they do in memory, are small enough; else as it is."""
    return F.broadcast(df) if size_bytes(df) * EXPANSION <= BROADCAST_MEMORY else df
