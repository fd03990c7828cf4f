"""Cutting lineage in loops, in a way that survives the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Tables up to this many (narrow) rows may be sent to every executor.
BROADCAST_ROWS = 300_000
# ... if their files, which are compressed, are no larger than this.
BROADCAST_BYTES = 8 << 20

# Spark's setting that files of shuffles go with the execution that made them; versions that lack it ignore it.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folders: dict[str, str] = {}
# Lists of paths that are being noted down, the innermost last.
_noting: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application inside the one named in ``spark.checkpoint.dir``.

    Where the setting is missing, as in tests, a temporary folder serves on a local
    master only; on a cluster a folder of one machine would be lost with it.
    """
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="coratia-stored-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        _own_folders[application] = f"{base.rstrip('/')}/coratia-{application}-{uuid.uuid4().hex[:8]}"
        atexit.register(drop_stored, spark)
    return _own_folders[application]


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nothing has been written to."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _noting:
        _noting[-1].append(path)
    return path


def drop_stored(spark: SparkSession) -> None:
    """Delete everything this application has stored; DataFrames read from it are invalid then."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    folder = _own_folders.pop(context.applicationId, None)
    if folder:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    for name in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class Scope:
    """The tables stored while it was open, which `release` deletes together.

    DataFrames read from them are invalid then; what is to outlive them must be written elsewhere first.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scope:
        _noting.append(self.paths)
        return self

    def __exit__(self, *_) -> None:
        _noting.pop()

    def release(self) -> None:
        _delete(self.spark, self.paths)
        self.paths.clear()


def written(spark: SparkSession, path: str) -> bool:
    """Whether a write to `path` has come to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


@dataclass(frozen=True)
class Stored:
    """Stored rows, how many there are, and how many bytes their files hold; without a size they count as long."""

    df: DataFrame
    rows: int
    size: int = BROADCAST_BYTES + 1

    @property
    def small(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.size <= BROADCAST_BYTES

    def sized(self) -> DataFrame:
        """The rows, marked for broadcast if they are few and short; else joins shuffle as usual."""
        return F.broadcast(self.df) if self.small else self.df

    def fits(self, other: DataFrame) -> DataFrame:
        """`other`, known to have no more rows than this table, treated the same way."""
        return F.broadcast(other) if self.small else other


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what runs inside go when it ends; else all steps' files stay until the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def store(df: DataFrame, name: str = "table") -> Stored:
    """Write the rows as compressed Parquet to the shared folder, counted on the way, and read them from there.

    Later plans read only the columns they need, push their filters down, and
    depend on no executor that may have been lost.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    counted = Observation()
    with freed_shuffles(spark):
        df.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    # The schema is known: reading it from the files would be one more job.
    stored = spark.read.schema(df.schema).parquet(path)
    return Stored(stored, counted.get["rows"], size)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Run `df` once and continue from its stored rows."""
    return store(df).df
