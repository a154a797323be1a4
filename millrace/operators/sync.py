"""Synchronisation of a folder with the index: what changed is read, cut into chunks, embedded and put in as one segment.

A version of the index is a list of segments, of chunks (with embeddings), postings and rows of the registry; readers see
the one before until all of the new one is written.  A document that can't be read or has no text leaves what is known of
it as it is and is tried again; one bad file stops nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.commits import Conflict
from millrace.functions.tags import is_supported
from millrace.functions.vectors import document_id, point_id
from millrace.operators import lexical, providers, registry, segments
from millrace.operators.chunking import block_chunks
from millrace.schemas import RECORDS, REGISTRY
from millrace.shared import drop, small_batches
from millrace.sources import readers as R

#: Tasks that read files at most.
FILE_TASKS = 10_000
#: Files whose contents go to a task at once.
FILES_AT_ONCE = 256
#: Records, or characters of their texts, that a task hands on at once.
RECORDS_AT_ONCE, CHARS_AT_ONCE = 512, 4 << 20


def taken(readers: dict) -> Column:
    """Whether one of ``readers`` takes the file of a path.  What none takes is neither read nor, if it is known, deleted."""
    return F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(sorted(readers))


def listed(spark: SparkSession, folder: str | list[str], readers: dict | None = None) -> DataFrame:
    """Files below a folder (or of a list of them) that one of ``readers`` takes; of none, those of a supported kind."""
    wanted = is_supported("path") if readers is None else taken(readers)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(wanted)


def scan(spark: SparkSession, folder: str | list[str], readers: dict | None = None) -> DataFrame:
    """The listed files with path, document_id and file_hash."""
    files = listed(spark, folder, readers)
    return files.select("path", document_id("path").alias("document_id"), F.sha2("content", 256).alias("file_hash"))


def _records(readers: dict, content):
    """A function of Arrow batches of files that gives their records, with the reason (``error``) where there are none.  A
    file is held at a time, and records are handed on by some hundred, not file by file."""
    schema = to_arrow_schema(StructType.fromDDL(f"{RECORDS}, error string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for b in batches:
            for k, path in enumerate(b.column("path").to_pylist()):
                ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
                try:
                    if ext not in readers:
                        raise ValueError(f"no reader for .{ext} files")
                    rows = [r | {"error": None} for r in readers[ext](path, content(b, k))]
                except Exception as e:  # whatever a broken file makes a parser raise
                    rows = [R.record(path, 0, "") | {"error": f"{type(e).__name__}: {e}"[:500]}]
                held += rows
                size += sum(len(r["text"] or "") for r in rows)
                if len(held) >= RECORDS_AT_ONCE or size >= CHARS_AT_ONCE:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read_files(paths: DataFrame, readers: dict = R.READERS) -> DataFrame:
    """The records of files (path), which workers read, so that no content passes through a shuffle; ``error`` has the
    reason where a file can't be read or no reader takes it."""

    def content(b: pa.RecordBatch, k: int) -> bytes:
        from pyarrow import fs

        path = b.column("path")[k].as_py()
        if path.startswith("file:"):
            store, name = fs.LocalFileSystem(), f"/{path[5:].lstrip('/')}"
        else:  # paths come without escapes
            store, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
        with store.open_input_file(name) as f:
            return f.read()

    return paths.select("path").mapInArrow(_records(readers, content), f"{RECORDS}, error string")


def errors_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").groupBy(F.col("source").alias("path")).agg(F.min("error").alias("error"))


def parse(files: DataFrame, readers: dict = R.READERS) -> tuple[DataFrame, DataFrame]:
    """The records of files (path, content), and (path, error) of those that can't be read or that no reader takes: two
    reads of one lazy parse.  Who wants both and pays for each file reads them once by ``read_files``, written.

    A task holds a batch of contents whole, so batches of the session are bounded to ``FILES_AT_ONCE`` files."""
    small_batches(files, FILES_AT_ONCE)
    read = files.select("path", "content").mapInArrow(_records(readers, lambda b, k: b.column("content")[k].as_py() or b""), f"{RECORDS}, error string")
    return read.where("error is null").drop("error"), errors_of(read)


def chunked(records: DataFrame, embedder) -> DataFrame:
    """Chunks of records with document id, point id and embedding; a chunk whose embedding fails has the reason in
    ``embed_error``."""
    chunks = block_chunks(records).withColumn("document_id", document_id("source"))
    chunks = chunks.withColumn("point_id", point_id("document_id", "chunk_id"))
    return providers.embed(chunks, embedder)


def outcomes(changes: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """``changes`` with what came of them: status (indexed, updated, skipped, deleted, empty, failed), chunk_count,
    ocr_used and error."""
    per = chunks.groupBy("document_id").agg(
        F.count("*").alias("chunk_count"), F.coalesce(F.bool_or("ocr_used"), F.lit(False)).alias("ocr_used"), F.max("embed_error").alias("embed_error"),
        F.min_by(F.struct("file_type", "category", "document_type", "filename"), "chunk_index").alias("first"),
    )
    out = changes.join(per, "document_id", "left").join(errors, "path", "left")
    error = F.coalesce("error", "embed_error")
    status = F.when(F.col("change").isin("skipped", "deleted"), F.col("change")).when(error.isNotNull(), "failed").when(F.col("chunk_count").isNull(), "empty").otherwise(F.col("change"))
    return out.select(
        "path", "document_id", "file_hash", status.alias("status"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("ocr_used", F.lit(False)).alias("ocr_used"),
        error.alias("error"), "first.file_type", "first.category", "first.document_type", "first.filename",
    )


def totals(done: DataFrame) -> DataFrame:
    """One row: how many documents had each status, were recognised from pictures, or failed in recognition."""
    kinds = ["indexed", "updated", "skipped", "deleted", "failed", "empty"]
    new = F.col("status").isin("indexed", "updated")
    return done.agg(
        *(F.count_if(F.col("status") == k).alias(k) for k in kinds), F.count_if(new & F.col("ocr_used")).alias("ocr_processed"),
        F.count_if((F.col("status") == "failed") & F.contains(F.lower(F.coalesce("error", F.lit(""))), F.lit("ocr"))).alias("ocr_failed"),
    )


def registered(known: DataFrame, done: DataFrame, now) -> DataFrame:
    """The registry after a synchronisation; empty and failed documents keep the row that they had, if any."""
    new = done.where("status IN ('indexed', 'updated')")
    rows = new.select(
        "document_id", F.coalesce("filename", F.element_at(F.split("path", "/"), -1)).alias("filename"), "path", "file_hash", "file_type", "category", "document_type",
        F.lit("indexed").alias("status"), F.when(F.col("status") == "indexed", now).alias("created_at"), now.alias("updated_at"), F.col("ocr_used").cast("int").alias("ocr_used"),
        F.col("chunk_count").cast("int").alias("chunk_count"),
    )
    left = known.join(done.where("status = 'deleted'").select("path"), "path", "left_anti").select(*known.columns)
    return registry.merge(left, rows)


def load(spark: SparkSession, path: str) -> segments.View | None:
    """The index as of its last version; None before the first."""
    view = segments.Index(spark, path).view()
    return view if view.version else None


def registry_of(view: segments.View) -> DataFrame:
    return view.keyed("registry", "path", REGISTRY)


def recreate(spark: SparkSession, path: str) -> None:
    """Forgets all versions."""
    drop(spark, path)


def sync(spark: SparkSession, folder: str, path: str, embedder=None, readers: dict = R.READERS, force: bool = False, tries: int = 3) -> dict[str, int]:
    """Brings the index below ``path`` up to date with a folder and returns the counts of what was done.

    Only what changed is written, as a segment.  If another synchronisation changed the same documents meanwhile, this one
    starts again, at most ``tries`` times; then its ``Conflict`` is raised and nothing of it is kept."""
    for left in range(tries - 1, -1, -1):
        try:
            return _sync(spark, folder, path, embedder or providers.MockEmbedder(), readers, force)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be positive")


def follow(spark: SparkSession, folder: str, path: str, checkpoint: str, embedder=None, readers: dict = R.READERS, name: str = "files"):
    """Follows a folder as a stream up to what is there now: each batch of new files goes into the index once, also if the
    batch is run again, and documents whose files are gone go out of it.  The index is then that of a synchronisation.

    A file that was written anew under its old name isn't new to a stream: ``sync`` finds it.  ``name``: of the stream, by
    which the index remembers the last batch that is in it."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema(schema).load(folder)

    def merge(batch: DataFrame, number: int) -> None:
        take(spark, batch.select("path"), number, folder, path, embedder or providers.MockEmbedder(), readers, name)

    return files.select("path").writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def take(spark: SparkSession, paths: DataFrame, number: int, folder: str, path: str, embedder, readers: dict = R.READERS, name: str = "files") -> dict[str, int] | None:
    """Puts batch ``number`` of a stream of new files into the index; None if it is in it already."""
    index = segments.Index(spark, path)
    if index.mark(name) >= number:
        return None
    there = listed(spark, folder, readers).select("path")
    known = registry_of(index.view())
    few = [r[0] for r in paths.limit(segments.NAMED + 1).collect()]  # more are hashed among all that are there
    new = scan(spark, few, readers) if 0 < len(few) <= segments.NAMED else scan(spark, folder, readers).join(paths, "path", "left_semi")
    same = known.join(paths, "path", "left_anti").join(there, "path", "left_semi").select("path", "document_id", "file_hash")
    return _apply(spark, index, known, registry.compare(new.unionByName(same), known.where(taken(readers))), path, embedder, readers, (name, number))


def _sync(spark: SparkSession, folder: str, path: str, embedder, readers: dict, force: bool) -> dict[str, int]:
    index = segments.Index(spark, path)
    known = registry_of(index.view())
    return _apply(spark, index, known, registry.compare(scan(spark, folder, readers), known.where(taken(readers)), force=force), path, embedder, readers)


def _apply(spark: SparkSession, index: segments.Index, known: DataFrame, compared: DataFrame, path: str, embedder, readers: dict, mark: tuple[str, int] | None = None) -> dict[str, int]:
    draft = f"{path}/draft-{uuid.uuid4().hex}"
    step = lambda df, name: (df.write.parquet(f"{draft}/{name}"), spark.read.schema(df.schema).parquet(f"{draft}/{name}"))[1]
    try:
        # Each step is written once, so that no file is listed, read, recognised or embedded twice.
        changes = step(compared, "changes")
        wanted = changes.where("change IN ('indexed', 'updated')").select("path")
        n = wanted.count()
        parsed = step(read_files(wanted.repartition(max(1, min(n, FILE_TASKS)), "path"), readers), "records")
        chunks = step(chunked(parsed.where("error is null").drop("error"), embedder), "chunks")
        done = step(outcomes(changes, chunks, errors_of(parsed)), "done")
        good = done.where("status IN ('indexed', 'updated')")
        gone = done.where("status = 'deleted'").select("path", "document_id")
        counts = totals(done).first().asDict()
        if counts["indexed"] or counts["updated"] or counts["deleted"]:
            new = chunks.join(good.select("document_id"), "document_id", "left_semi").withColumn("doc", F.col("point_id"))
            touched = known.join(good.select("path"), "path", "left_semi")
            rows = registered(touched, done, F.current_timestamp()).withColumn("deleted", F.lit(False))
            rows = rows.unionByName(gone.withColumn("deleted", F.lit(True)), allowMissingColumns=True)
            index.change(new, gone.select("document_id"), lexical.searchable_text(new), {"registry": rows}, mark)
            tidy(index)
        return counts
    finally:
        drop(spark, draft)


def tidy(index: segments.Index) -> None:
    """Merges segments while there are runs to merge; a conflict leaves them to the writer that caused it."""
    chunks = index.view().chunks()
    try:
        while chunks is not None and index.merge(lexical.searchable_text(chunks), {"registry": "path"}):
            pass
    except Conflict:
        pass
