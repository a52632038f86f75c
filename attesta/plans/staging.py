"""Intermediate tables in the folder that all executors share.

A written table cuts lineage like ``checkpoint()``, survives lost executors, is compressed and can be
pruned by column. The folder comes from ``spark.checkpoint.dir``; only a local session may go without it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that a task hands to Python at a time.
BATCH_BYTES = 4 << 20
#: Options of ``put`` for values of up to megabytes: row groups and pages are measured at every row, else first at the hundredth and then by the mean so far; a reader holds a row group.
LONG_VALUES = {"parquet.block.size": str(BATCH_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
_local: dict[str, str] = {}
_roots: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; on a local master without one, a temporary folder of this session."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local:
        folder = tempfile.mkdtemp(prefix="attesta-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local[sc.applicationId] = f"file://{folder}"
    return _local[sc.applicationId]


def bounded_batches(spark: SparkSession) -> None:
    """From now on rows go to Python some ``BATCH_BYTES`` at a time, unless the session has a limit of its own.

    Without one a batch is 10,000 rows, however long: for texts its buffers, in the JVM and in Python, are most of a task's memory.
    The setting stays, as it must hold when the result is written.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


class Staging:
    """The intermediate tables of one job: ``put`` writes one and reads it again, ``drop`` deletes it."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        _roots[self.root] = None

    def put(self, df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        """Writes a table; its shuffles' files go with the end of the write, as nothing will read them again."""
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(_CLEANUP, None)
        try:
            conf.set(_CLEANUP, "true")
            df.write.options(compression="zstd", **(options or {})).mode("errorifexists").parquet(path)
        finally:
            conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all that was staged inside it: for work whose result has been written by then."""
    before = set(_roots)
    try:
        yield
    finally:
        for root in [r for r in _roots if r not in before]:
            _delete(spark, root)
            del _roots[root]
