"""Recognition of pictures behind a seam: engines, a factory, layout with repairs, readers of pages, a quality report.

An engine takes grey values and gives rows of text with boxes and confidences; engines that need a model are registered
by whoever has one.  The stand-in needs none.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import images, ocr
from millrace.functions.text import bound, is_heading
from millrace.operators import layout
from millrace.schemas import BLOCK
from millrace.sources.pdf import page_texts
from millrace.sources.readers import record

#: What an engine gives for a picture.
LAYOUT = f"text string, average_confidence double, blocks array<{BLOCK}>, line_count int"
LOW_QUALITY = 0.65


class Engine(Protocol):
    def available(self) -> bool: ...

    def layout(self, pixels: np.ndarray) -> list[dict]:
        """Lines in reading order: text, bbox (x1, y1, x2, y2) and confidence."""


class MockEngine:
    """Gives the same lines for every picture."""

    def __init__(self, text: str = "PT-101 reads 12.5 bar\nXV-301 is closed", confidence: float = 0.95):
        self.text, self.confidence = text, confidence

    def available(self) -> bool:
        return True

    def layout(self, pixels: np.ndarray) -> list[dict]:
        return [{"text": t, "bbox": [10.0, 10.0 + 25 * k, 250.0, 30.0 + 25 * k], "confidence": self.confidence} for k, t in enumerate(self.text.split("\n"))]


#: Engines by name, in the order in which "auto" tries them; "mock" is the last resort.
ENGINES: dict[str, Callable[[], Engine]] = {"mock": MockEngine}


def register(name: str, make: Callable[[], Engine]) -> None:
    """Adds an engine before the stand-in."""
    mock = ENGINES.pop("mock")
    ENGINES[name] = make
    ENGINES["mock"] = mock


def engine(name: str = "auto") -> Engine:
    """The engine of a name, or the first that is available."""
    if name != "auto":
        if name not in ENGINES:
            raise ValueError(f"no recognition engine {name!r}; there are {', '.join(ENGINES)}")
        return ENGINES[name]()
    return next(e for e in (make() for make in ENGINES.values()) if e.available())


def recognize(pages: DataFrame, make: Callable[[], Engine] = engine, pixels: str = "pixels", width: str = "width", tier: str = "tier") -> DataFrame:
    """``pages`` with ``layout``: pictures (grey bytes, row by row, and their width) are preprocessed by their tier and
    go through the engine in Arrow batches; an engine is made once a task.  A picture that fails has ``layout`` null and
    the reason in ``ocr_error``."""

    @F.pandas_udf(f"{LAYOUT}, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = make()
        for data, widths, tiers in batches:
            rows = []
            for d, w, t in zip(data, widths, tiers, strict=True):
                try:
                    lines = own.layout(images.preprocess(np.frombuffer(d, dtype=np.uint8).reshape(-1, int(w)), t))
                    blocks = [{"block_id": f"b{k}", "type": "paragraph", "text": x["text"], "bbox": [float(v) for v in x["bbox"]], "confidence": float(x["confidence"])} for k, x in enumerate(lines)]
                    mean = float(np.mean([b["confidence"] for b in blocks])) if blocks else 0.0
                    rows.append(("\n".join(b["text"] for b in blocks), round(mean, 4), blocks, len(blocks), None))
                except Exception as e:  # the engine's own failure, whatever it is
                    rows.append((None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            out = pd.DataFrame(rows, columns=["text", "average_confidence", "blocks", "line_count", "error"], dtype=object)
            yield out.astype({"average_confidence": "Float64", "line_count": "Int32"})

    out = pages.withColumn("__l", run(F.col(pixels), F.col(width), F.coalesce(F.col(tier), F.lit("light"))))
    found = F.struct(*(F.col(f"__l.{n}").alias(n) for n in ("text", "average_confidence", "blocks", "line_count")))
    return out.withColumn("layout", F.when(F.col("__l.error").isNull(), found)).withColumn("ocr_error", F.col("__l.error")).drop("__l")


def repaired(found: Column) -> Column:
    """A layout with its text and the text of each block repaired, blocks told apart as headings and paragraphs, blank
    ones left out, and ``changed``, the steps that changed the text."""
    whole = ocr.repair_log(found["text"], found["average_confidence"])

    def block(b: Column) -> Column:
        def told(text: Column) -> Column:
            return F.struct(b["block_id"].alias("block_id"), F.when(is_heading(text), "heading").otherwise("paragraph").alias("type"), text.alias("text"), b["bbox"].alias("bbox"), b["confidence"].alias("confidence"))

        return bound(F.trim(ocr.repair(b["text"], F.coalesce(b["confidence"], F.lit(1.0)))), told)

    blocks = F.filter(F.transform(found["blocks"], block), lambda b: b["text"] != "")
    return F.struct(whole["text"].alias("text"), found["average_confidence"].alias("average_confidence"), blocks.alias("blocks"), found["line_count"].alias("line_count"), whole["changed"].alias("changed"))


def boxes(found: Column) -> Column:
    """The boxes of a layout's blocks as ``layout.table`` takes them."""
    return F.transform(found["blocks"], lambda b: F.struct(b["bbox"][0].alias("x1"), b["bbox"][1].alias("y1"), b["bbox"][2].alias("x2"), b["bbox"][3].alias("y2"), b["text"].alias("text"), b["confidence"].alias("score")))


def quality_report(pages: DataFrame, found: str = "layout", threshold: float = LOW_QUALITY, most: int | None = None) -> DataFrame:
    """Rows (path, page_number, avg_confidence, line_count, is_low_quality, is_table_page, error) of recognised pages;
    ``most``: the first pages of each file only (a report).  A page that failed is of low quality."""
    pages = pages.where(F.col("page_number") <= most) if most else pages
    mean = F.round(F.coalesce(F.col(found)["average_confidence"], F.lit(0.0)), 4)
    table = F.coalesce(layout.table(boxes(F.col(found)))["is_table"], F.lit(False))
    return pages.select(
        "path", "page_number", mean.alias("avg_confidence"), F.coalesce(F.col(found)["line_count"], F.lit(0)).alias("line_count"), (mean < threshold).alias("is_low_quality"),
        table.alias("is_table_page"), (F.col("ocr_error") if "ocr_error" in pages.columns else F.lit(None).cast("string")).alias("error"),
    )


def _heading(line: str) -> bool:
    return len(line) < 80 and (line.isupper() or bool(re.match(r"\d+\.\d+\s+[A-Z]", line)))


def _blocks(lines: list[dict]) -> list[dict]:
    out = []
    for x in lines:
        if t := x["text"].strip():
            out.append({"block_id": f"b{len(out)}", "type": "heading" if _heading(t) else "paragraph", "text": t, "bbox": x["bbox"], "confidence": float(x["confidence"])})
    return out


def image_reader(make: Callable[[], Engine] = engine) -> Callable[[str, bytes], Iterator[dict]]:
    """A reader of pictures: one record with the engine's blocks; a picture without text has none.  PNG files are read
    here, others by an engine that has ``decode``."""

    def read(path: str, data: bytes) -> Iterator[dict]:
        own = make()
        pixels = own.decode(data) if hasattr(own, "decode") else images.read_png(data)
        lines = own.layout(images.preprocess(pixels, "light"))
        text = "\n".join(x["text"] for x in lines).strip()
        if text:
            mean = sum(x["confidence"] for x in lines) / len(lines)
            yield record(path, 0, text, location="Image", content_type="image", extraction_method="ocr", ocr_used=True, ocr_confidence=round(mean, 4), blocks=_blocks(lines))

    return read


def pdf_reader(make: Callable[[], Engine] = engine, render: Callable[[bytes, int, int], np.ndarray] | None = None, least: int = 50) -> Callable[[str, bytes], Iterator[dict]]:
    """A reader of PDF files: a record a page, of its native text where there is enough of it, else of what the engine
    reads from ``render(data, page number from 1, dpi)``; without a renderer, of what native text there is."""

    def read(path: str, data: bytes) -> Iterator[dict]:
        for k, text in enumerate(page_texts(data)):
            more = {"page_number": k + 1, "location": f"Page {k + 1}"}
            letters = sum(c.isalnum() for c in text)
            if render is not None and (len(text) < least or letters < least / 2):
                lines = make().layout(images.preprocess(render(data, k + 1, 200), "light"))
                if found := "\n".join(x["text"] for x in lines).strip():
                    mean = sum(x["confidence"] for x in lines) / len(lines)
                    yield record(path, k, found, content_type="scanned_document", extraction_method="ocr", ocr_used=True, ocr_confidence=round(mean, 4), blocks=_blocks(lines), **more)
            elif text:
                yield record(path, k, text, blocks=[{"block_id": "b0", "type": "paragraph", "text": text, "bbox": None, "confidence": None}], **more)

    return read


def describe(data: bytes | None, call: Callable[[str, str], str] | None, prompt: str = "Describe this picture for an engineer.") -> str:
    """What a vision model (a function of a prompt and a picture in base 64) says of a picture; "" where it fails."""
    if not data or call is None:
        return ""
    try:
        return call(prompt, base64.b64encode(data).decode()).strip()
    except Exception:  # the model's own failure
        return ""


def benchmark(pages: DataFrame) -> DataFrame:
    """The totals of recognised pages (layout, seconds)."""
    from millrace.operators.evaluate import ocr_benchmark

    table = F.coalesce(layout.table(boxes(F.col("layout")))["is_table"], F.lit(False))
    return ocr_benchmark(pages.select(F.coalesce(F.col("layout.average_confidence"), F.lit(0.0)).alias("confidence"), table.alias("is_table"), "seconds"))
