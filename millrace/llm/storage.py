"""Files of the shared folder, written and read by Python workers, beside the tables of ``millrace.shared``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from millrace.shared import drop, scope, shared_folder, written

__all__ = ["drop", "frees_shuffles", "get", "is_mapped", "mapped", "put", "scope", "shared_folder", "written"]


@contextmanager
def frees_shuffles(spark: SparkSession) -> Iterator[None]:
    """A block whose actions leave no shuffle files behind; the session's setting is what it was when it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def put(path: str, data: bytes) -> None:
    """Writes a file of the shared folder from any executor; a repeated attempt replaces it whole."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0])
    draft = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(data)
    store.move(draft, name)


def get(path: str) -> bytes:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return f.read()


def is_mapped(path: str) -> bool:
    """Whether ``mapped`` can map files of this folder: it is mounted."""
    from pyarrow import fs

    return isinstance(fs.FileSystem.from_uri(path)[0], fs.LocalFileSystem)


def mapped(path: str):
    """A file's bytes as an array: memory-mapped where the shared folder is mounted, else read into memory."""
    import numpy as np
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(name, dtype=np.uint8, mode="r")
    return np.frombuffer(get(path), dtype=np.uint8)
