"""Chunk files of documents in the shared folder, and sets of hashes that chunks exchange by shard.

A chunk is read again by every pass that needs its texts, so texts are never shuffled, and what travels between passes
is one compressed set of hashes per chunk and shard, and one answer per hash.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.memory import small_batches, tidy
from millrace.llm.storage import put, shared_folder, written
from millrace.llm.wordhash import split_texts

#: Bytes of text and documents of a chunk; the hashes of a shard on average; shards and tasks of a pass at most.
CHUNK_BYTES, CHUNK_DOCS, SHARD, SHARDS, TASKS = 6 << 20, 1 << 12, 3_000_000, 1 << 23, 1 << 17


def stage(docs: DataFrame, id_col: str, text_col: str, name: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[str, DataFrame, int, int]:
    """Writes ``docs`` as chunk files and returns their folder, their list (``chunk`` number, ``file``), and how many
    shards and tasks a pass should have.  A chunk has its documents in id order, null ids first."""
    folder = shared_folder(docs.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 24
        tidy(forget_encoders=True)

        def save() -> pa.RecordBatch:
            nonlocal number
            held.sort(key=lambda x: (x[0] is not None, x[0] or 0))
            file, sink = f"{number}-{uuid.uuid4().hex}", io.BytesIO()
            table = pa.table({"id": pa.array([i for i, _ in held], pa.int64()), "text": pa.array([t for _, t in held], pa.binary())})
            with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            put(f"{folder}/{file}", sink.getvalue())
            number += 1
            return pa.RecordBatch.from_pydict({"chunk": pa.array([number - 1], pa.int64()), "file": [file], "size": pa.array([size], pa.int64())})

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), split_texts(b.column(1)), strict=True):
                if held and (size + len(t or b"") > chunk_bytes or len(held) == CHUNK_DOCS):
                    yield save()
                    held, size = [], 0
                held.append((i, t))
                size += len(t or b"")
        if held:
            yield save()
            held = []
        tidy()

    rows = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`")).mapInArrow(run, "chunk long, file string, size long")
    listed = written(rows, f"{name}-list")
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return folder, listed.select("chunk", "file"), int(min(SHARDS, max(1, size // 6 // SHARD))), int(min(max(1, n), TASKS))


def read(data: bytes) -> tuple[list, list]:
    """Ids and texts (bytes or None) of a chunk file."""
    table = pa.ipc.open_file(pa.BufferReader(data)).read_all()
    return table.column(0).to_pylist(), table.column(1).to_pylist()


def planes(values: np.ndarray) -> bytes:
    """The values' bytes of equal weight together, which the compressor can use."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: bytes, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, n).T).reshape(-1).view(dtype)


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, start and end of each run of an ascending array."""
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(values[a]), int(a), int(b)


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where each run of an ascending array starts."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
