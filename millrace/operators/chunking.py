"""Chunks: one per layout block, or packed from sections, paragraphs and sentences with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.tags import classify, extract_measurements, extract_tags

SIZE, OVERLAP, LEAST = 900, 150, 80


def _units(text: str, size: int, lossy: bool) -> Iterator[str]:
    """Pieces no longer than ``size`` where structure allows: sections, paragraphs, runs of sentences, hard cuts.  A run of
    more than ``size`` characters without white space is cut into several; ``lossy`` keeps its end only."""
    for section in map(str.strip, re.split(r"(?=\n#+ )", text)):
        if len(section) <= size:
            if section:
                yield section
            continue
        for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", section))):
            if len(paragraph) <= size:
                yield paragraph
                continue
            line = ""
            for sentence in filter(None, map(str.strip, re.split(r"(?<=[.?!;])\s+", paragraph))):
                if len(line) + len(sentence) + 1 <= size:
                    line = f"{line} {sentence}" if line else sentence
                    continue
                if line:
                    yield line
                line = sentence if len(sentence) <= size else ""
                if not line:
                    ends = r"(?:\s+|$)" if lossy else r"(?:\s+|$|(?=\S))"
                    yield from filter(None, (m.strip() for m in re.findall(rf".{{1,{size}}}{ends}", sentence, 0 if lossy else re.S)))
            if line:
                yield line


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, lossy: bool = False) -> list[str]:
    """Units packed into chunks of about ``size``; a chunk begins with the last units of the one before that fit into
    ``overlap``.  A chunk under ``least`` goes on into the next one; ``lossy`` leaves it out, and of very long words all
    but the end.  The last chunk goes only if it repeats the one before."""
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    out: list[str] = []
    held: list[str] = []
    length = 0
    for unit in _units(text, size, lossy):
        whole = "\n\n".join(held)
        if held and length + len(unit) + 1 > size and (lossy or len(whole) >= least):
            if len(whole) >= least:
                out.append(whole)
            room, k = overlap, len(held)
            while k and len(held[k - 1]) <= room:
                k -= 1
                room -= len(held[k])
            held = held[k:]
            length = sum(map(len, held)) + len(held)
        held.append(unit)
        length += len(unit) + 1
    whole = "\n\n".join(held).strip()
    if whole and (not out or whole != out[-1]):
        out.append(whole)
    return out


def semantic_chunks(docs: DataFrame, doc: str, text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, lossy: bool = False) -> DataFrame:
    """Rows (doc, chunk_index, chunk): a sequential fold per text, in Arrow batches and without a shuffle."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = b["t"].map(lambda t: split_text(t, size, overlap, least, lossy))
            rows = pd.DataFrame({"doc": b["doc"], "chunk": parts, "chunk_index": parts.map(lambda p: list(range(len(p))))})
            yield rows.explode(["chunk", "chunk_index"]).dropna(subset=["chunk"]).astype({"chunk_index": "int32"})[["doc", "chunk_index", "chunk"]]

    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("t")).mapInPandas(run, f"doc {kind}, chunk_index int, chunk string")


def block_chunks(records: DataFrame, blank: bool = False) -> DataFrame:
    """One chunk for each block of each record, with its context line, provenance, tags and measurements.

    The current heading is carried forward to the blocks below it; the chunk's id has the record's number, so that
    rows of one sheet don't share one.  A record without blocks is one by its text.  Blocks without text are left out,
    unless ``blank``.  Source and ``rec_idx`` must tell records apart, or their blocks mix.
    """
    blocks = records.select("*", F.posexplode_outer("blocks").alias("block_idx", "block"))
    body = F.when(F.col("block_idx").isNull(), F.col("text")).otherwise(F.col("block.text"))
    blocks = blocks.withColumn("body", body)
    told = F.length(F.trim("body")) > 0
    if not blank:
        blocks = blocks.where(told)
    at = Window.partitionBy("source", "rec_idx").orderBy("block_idx")
    head = F.last(F.when((F.col("block.type") == "heading") & told, F.col("body")), ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("section", F.coalesce(head, F.col("section"))).withColumn("class", classify("source"))
    page = F.when(F.col("page_number").isNotNull(), F.concat(F.lit(" | Page "), F.col("page_number").cast("string"))).otherwise("")
    headed = (F.col("block.type") != "heading") | F.col("block.type").isNull()
    section = F.when(F.col("section").isNotNull() & headed, F.concat(F.lit("Section: "), F.col("section"), F.lit("\n"))).otherwise("")
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    parent = F.concat_ws("_", F.lit("parent"), stem, F.concat(F.lit("r"), F.col("rec_idx")))
    return blocks.select(
        F.concat(F.lit("doc_"), stem, F.lit("_r"), F.col("rec_idx"), F.lit("_p"), F.col("page_number"), F.lit("_b"), F.coalesce("block_idx", F.lit(0))).alias("chunk_id"),
        (F.row_number().over(Window.partitionBy("source").orderBy("rec_idx", "block_idx")) - 1).cast("long").alias("chunk_index"),
        F.concat(F.lit("Source: ["), F.col("filename"), page, F.lit("]\n"), section, F.lit("Content:\n"), F.col("body")).alias("text"),
        "source", "filename", "location", "page_number", "section", "file_type", "content_type", F.col("class.category").alias("category"),
        F.col("class.document_type").alias("document_type"), F.col("class.revision").alias("revision"), "extraction_method", "ocr_used", "ocr_confidence",
        extract_tags("body").alias("tags"), extract_measurements("body").alias("measurements"),
        (F.coalesce("is_table", F.lit(False)) | F.coalesce(F.col("block.type") == "table", F.lit(False))).alias("is_table"),
        parent.alias("parent_id"), F.substring("text", 1, 3000).alias("parent_text"),
        F.concat(F.col("filename"), F.lit(", "), F.col("location")).alias("citation"), "requires_vision", "drawing_code",
    )
