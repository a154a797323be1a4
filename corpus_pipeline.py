"""A training-data pipeline over ``documents``: cleaned, deduplicated by line and by document, decontaminated, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, with
``n_chars`` kept true.  Nulls: a document without text has no words and is rejected by the first stage.  Rows that
repeat an id and a text count once after the third stage.  Decisions join back by id and text, so documents whose ids
are null or repeated are documents of their own.  Empty tables give empty results; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontaminate import decontaminate
from millrace.llm.exprs import free_prefix, with_row_key
from millrace.llm.jaccard import jaccard_components
from millrace.llm.linededup import line_dedup
from millrace.llm.packing import pack
from millrace.llm.quality import quality_rules
from millrace.llm.storage import scope, shared_folder
from millrace.shipping import ship


def _as(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``like`` and the length of its text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*(f"`{c}`" for c in like.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, then documents that fail the base rules or lost too much."""
    judged = quality_rules(docs.select(F.struct(*docs.columns).alias("row"), "text")).where("kept")
    kept = judged.select(*(F.col("clean_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
    return _as(kept, docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of five documents and more stay in the last of them only."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = docs.select("doc_id", "text", (F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(None)).alias("row"))
    return _as(line_dedup(row).select("doc_id", "text", *(F.col("row")[c].alias(c) for c in rest)), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    own = f"{free_prefix(docs)}row"
    key = {"id": "doc_id", "h": "text_hash", "n": "text_bytes"}
    leads = jaccard_components(docs.select("doc_id", "text")).where("leads").select(F.struct(*(F.col(c).alias(k) for k, c in key.items())).alias(own)).distinct()
    row = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    return docs.withColumn(own, row).join(leads, own, "left_semi").dropDuplicates([own]).select(*(f"`{c}`" for c in docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by the benchmark go."""
    found = decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), with_key=True)
    own = f"{free_prefix(docs)}key"
    gone = found.where("contaminated").select(F.col("__key").alias(own)).distinct()
    return with_row_key(docs, "doc_id", "text", own).join(gone, own, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    packed = pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]
#: Packing needs the tokenizer, which SQL doesn't have; a test holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, f"pipeline-{name.replace(' ', '-').lower()}")
        with scope(spark):  # what a stage wrote on its way goes when its rows are written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
