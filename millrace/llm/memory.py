"""Keeps the memory of executors small: of the batches that pass between Spark and Python workers, and of the workers, which
live on from task to task and from operator to operator."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a batch: documents, or pairs of their sets, of some kilobytes each.
BATCH_ROWS = 512


def small_batches(df: DataFrame, most: int = BATCH_ROWS) -> DataFrame:
    """``df``, after its session's Arrow batches were bounded to ``most`` rows, if they weren't smaller.  The setting
    stays: plans are made when they run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(df.sparkSession.conf.get(name, "0"))
    if not 0 < rows <= most:
        df.sparkSession.conf.set(name, str(most))
    return df


def tidy(forget_encoders: bool = False) -> None:
    """Returns freed memory to the system; ``forget_encoders`` drops the word tables of tokenizers as well."""
    encoding = sys.modules.get("millrace.llm.encoding")
    if forget_encoders and encoding is not None:
        encoding.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
