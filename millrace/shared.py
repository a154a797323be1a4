"""Tables written to the folder that driver and executors share, to cut lineage and to hold file formats."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, on one machine, below a temporary folder.  On a
    cluster it must be set: executors and driver share no other."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="millrace-"))
        root = f"file://{_own[0]}"
    # With its scheme, so that Spark and Python workers mean the same store.
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    made = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(made)
    return made


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the shared folders that were made in it; what is to stay must have been written elsewhere."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for folder in made:
            drop(spark, folder)


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: a lost executor costs no recomputation of its plan."""
    path = shared_folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, most: int) -> DataFrame:
    """``df``, after its session's Arrow batches were bounded to ``most`` rows, if they weren't smaller.  The setting
    stays: plans are made when they run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(df.sparkSession.conf.get(name, "0"))
    if not 0 < rows <= most:
        df.sparkSession.conf.set(name, str(most))
    return df
