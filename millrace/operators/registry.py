"""The document registry as snapshots: what changed, what is gone, and the merged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.schemas import DEFAULTS, PAYLOAD


def scan(spark, folder: str) -> DataFrame:
    """Files below a folder that a reader takes, with hash and id, in the order of their paths."""
    from millrace.functions.tags import is_supported
    from millrace.functions.vectors import document_id

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(is_supported("path")).select("path", F.sha2("content", 256).alias("file_hash"), document_id("path").alias("document_id"), "length").orderBy("path")


def compare(current: DataFrame, known: DataFrame, scope: str | None = None, force: bool = False) -> DataFrame:
    """Rows (path, document_id, file_hash, change): indexed, updated, skipped or deleted.

    Only known paths below ``scope`` can be deleted, so that a part of a tree can be compared alone.
    """
    old = known.select("path", F.col("file_hash").alias("old_hash"), F.col("document_id").alias("old_id"))
    both = current.select("path", "document_id", "file_hash").join(old, "path", "full_outer")
    change = (
        F.when(F.col("old_id").isNull(), "indexed").when(F.col("document_id").isNull(), "deleted")
        .when((F.col("file_hash") == F.col("old_hash")) & F.lit(not force), "skipped").otherwise("updated")
    )
    out = both.select("path", F.coalesce("document_id", "old_id").alias("document_id"), F.coalesce("file_hash", "old_hash").alias("file_hash"), change.alias("change"))
    return out.where((F.col("change") != "deleted") | F.col("path").startswith(scope)) if scope else out


def summary(changes: DataFrame) -> DataFrame:
    """One row of counts of a synchronisation; ``error`` (optional) tells recognition failures."""
    error = F.lower(F.col("error")) if "error" in changes.columns else F.lit(None).cast("string")
    kinds = ["indexed", "updated", "skipped", "deleted", "empty", "failed"]
    counts = [F.count_if(F.col("change") == k).alias(k) for k in kinds]
    return changes.agg(F.count("*").alias("total"), *counts, F.count_if((F.col("change") == "failed") & F.contains(error, F.lit("ocr"))).alias("ocr_failed"))


def by_path(known: DataFrame, path) -> DataFrame:
    """The row of a path (or the rows of a column of paths, given as a table with ``path``)."""
    return known.where(F.col("path") == path) if isinstance(path, str) else known.join(path.select("path").distinct(), "path", "left_semi")


def by_id(known: DataFrame, document) -> DataFrame:
    """The row of a document id (or the rows of a table with ``document_id``)."""
    return known.where(F.col("document_id") == document) if isinstance(document, str) else known.join(document.select("document_id").distinct(), "document_id", "left_semi")


def listed(known: DataFrame) -> DataFrame:
    """The registry by file name, then by path."""
    return known.orderBy("filename", "path")


def without(known: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """The registry without the rows whose key is in ``gone``."""
    return known.join(gone.select(key).distinct(), key, "left_anti").select(*known.columns)


def payload(chunks: DataFrame, nulls: bool = False) -> DataFrame:
    """Chunks with the columns that a search gives back.  A column that is missing has its default; with ``nulls``, null
    values have it too."""
    out = []
    for name, default in DEFAULTS.items():
        kind = PAYLOAD.get(name, "string")
        value = F.expr(f"cast(array() as {kind})") if kind.startswith("array") else F.lit(default).cast(kind)
        if name in chunks.columns:
            value = F.coalesce(F.col(name), value) if nulls else F.col(name)
        out.append(value.alias(name))
    rest = [c for c in chunks.columns if c not in DEFAULTS]
    return chunks.select(*rest, *out)


def merge(known: DataFrame, rows: DataFrame, key: str = "path") -> DataFrame:
    """``known`` with ``rows`` put in: new keys are added, of known ones the columns that aren't null are replaced."""
    new = rows.select(*(F.col(c).alias(f"__{c}") for c in rows.columns))
    both = known.join(new, F.col(key) == F.col(f"__{key}"), "full_outer")
    return both.select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in rows.columns else F.col(c) for c in known.columns))


def replace_documents(chunks: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """``chunks`` without those of documents that are in ``new`` or ``gone``, and with the new ones."""
    stale = new.select("document_id").unionByName(gone.select("document_id")).distinct()
    return chunks.join(stale, "document_id", "left_anti").unionByName(new, allowMissingColumns=True)


def swap(df: DataFrame, path: str) -> None:
    """Writes a snapshot beside the old one and then points the name at it: readers see one or the other."""
    import uuid

    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/v-{version}")
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")


def load(spark, path: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/v-{version}")
