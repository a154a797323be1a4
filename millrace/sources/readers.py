"""Readers of files into the records table: office formats by their XML, drawings by name and strings, HTML, text.

Each reader takes (path, bytes) and yields record rows; files are spread over the cluster by the binaryFile source.
"""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schemas import RECORDS

_NAMES = [f.split()[0] for f in re.sub(r"<[^<>]*(<[^<>]*>[^<>]*)*>", "", RECORDS).split(", ")]


def record(path: str, k: int, text: str, **more) -> dict:
    row = dict.fromkeys(_NAMES)
    name = path.rsplit("/", 1)[-1]
    row |= {
        "source": path, "filename": name, "rec_idx": k, "page_number": 1, "location": "Document", "file_type": name.rsplit(".", 1)[-1].lower(), "content_type": "document",
        "text": text, "extraction_method": "native_text", "ocr_used": False, "is_table": False, "requires_vision": False,
    }
    return row | more


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node, name: str = "t") -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == name)


def read_docx(path: str, data: bytes) -> Iterator[dict]:
    """One record: paragraphs, then tables with their header put to each cell where the numbers agree."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    parts = [t for e in body if _local(e.tag) == "p" and (t := _texts(e).strip())]
    tables = [e for e in body if _local(e.tag) == "tbl"]
    for n, table in enumerate(tables, 1):
        head: list[str] = []
        rows = []
        for k, tr in enumerate(e for e in table if _local(e.tag) == "tr"):
            cells = [t for tc in tr if _local(tc.tag) == "tc" and (t := _texts(tc).strip())]
            if not cells:
                continue
            if k == 0:
                head = cells
                rows.append("Header: " + " | ".join(cells))
            elif len(head) == len(cells):
                rows.append(f"Row {k}: " + ", ".join(f"{h}: {c}" for h, c in zip(head, cells, strict=True)))
            else:
                rows.append(f"Row {k}: " + " | ".join(cells))
        if rows:
            parts.append(f"[Table {n}]\n" + "\n".join(rows))
    if parts:
        yield record(path, 0, "\n\n".join(parts))


def read_xlsx(path: str, data: bytes) -> Iterator[dict]:
    """A record per row that has values: the first of a sheet names the columns of the others."""
    name = path.rsplit("/", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        there = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in there:
            shared = [_texts(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), next(v for k, v in s.attrib.items() if _local(k) == "id")) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
        k = 0
        for title, rid in sheets:
            target = targets[rid].lstrip("/")
            sheet = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            head: list[str] = []
            for n, row in enumerate((r for r in sheet.iter() if _local(r.tag) == "row"), 1):
                n, values = int(row.get("r") or n), []
                for c in row:
                    v = next((x.text for x in c if _local(x.tag) == "v"), None)
                    value = _texts(c) if c.get("t") == "inlineStr" else shared[int(v)] if c.get("t") == "s" and v is not None else v
                    if value is not None and str(value).strip():
                        values.append(str(value).strip())
                if not values:
                    continue
                if not head:
                    head, at, label, body = values, n, "Schema Headers", " | ".join(values)
                else:
                    at, label = n, f"Row {n}"
                    body = " | ".join(f"{h}: {v}" for h, v in zip(head, values, strict=True)) if len(head) == len(values) else " | ".join(values)
                yield record(path, k, f"[Dataset: {name} | Sheet: {title} | {label}]\n{body}", location=f"Sheet {title}, Row {at}", section=f"Sheet {title}", is_table=True)
                k += 1


def read_pptx(path: str, data: bytes) -> Iterator[dict]:
    """A record per slide, with its notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        there = set(z.namelist())
        slides = sorted((int(m[1]), n) for n in there if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for k, (number, name) in enumerate(slides):
            text = "\n".join(t for p in ElementTree.fromstring(z.read(name)).iter() if _local(p.tag) == "p" and (t := _texts(p).strip()))
            notes = f"ppt/notesSlides/notesSlide{number}.xml"
            if notes in there and (t := "\n".join(t for p in ElementTree.fromstring(z.read(notes)).iter() if _local(p.tag) == "p" and (t := _texts(p).strip()))):
                text += f"\n[Notes]\n{t}"
            if text.strip():
                yield record(path, k, text, page_number=number, location=f"Slide {number}")


#: Fixed parts of folder and file names that tell a drawing's discipline.
DISCIPLINES = [("PID", "P&ID", "Piping and instrumentation"), ("Instrumentation", "Instr", "Instrumentation and control"), ("Control_Panel", "ICP", "Control panels and wiring"), ("Network", None, "Network architecture")]


def read_drawing(path: str, data: bytes) -> Iterator[dict]:
    """One record of what name, folder and the strings of the first 64 KiB tell; the picture itself needs a model."""
    name, folder = path.rsplit("/", 1)[-1], path.rsplit("/", 2)[-2] if path.count("/") > 1 else ""
    code = m[1] if (m := re.search(r"([A-Z]\d{4,5}-\d+)", name)) else "CAD-DWG"
    discipline = next((d for f, n, d in DISCIPLINES if f in folder or n and n in name), "General")
    strings = [s.decode("latin1").strip() for s in re.findall(rb"[\x20-\x7E]{4,}", data[:65536])]
    tags = sorted({s for s in strings if re.search(r"\b[A-Z]{2,4}-\d{2,4}\b", s)})
    title = re.sub(r"(?i)\.(dwg|dxf)$", "", re.sub(r"^[A-Za-z0-9\s,-]+ - ", "", name))
    text = f"Drawing: {name}\nCode: {code}\nDiscipline: {discipline}\nTitle: {title}\n" + (f"Tags: {', '.join(tags)}" if tags else "Tags: to be read from the picture")
    yield record(path, 0, text, location=f"CAD Drawing {code}", content_type="cad_drawing", extraction_method="cad_metadata", section=folder, requires_vision=True, drawing_code=code)


def read_html(path: str, data: bytes) -> Iterator[dict]:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", data.decode("utf-8", "replace"))
    if text := re.sub(r"\s+", " ", html.unescape(text)).strip():
        yield record(path, 0, text)


def read_text(path: str, data: bytes) -> Iterator[dict]:
    if text := data.decode("utf-8", "replace").strip():
        yield record(path, 0, text)


def read_csv(path: str, data: bytes) -> Iterator[dict]:
    """A record of the headers, and one a row that has a value, as of a sheet."""
    rows = list(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))))
    rows = [(n, [c.strip() for c in r]) for n, r in enumerate(rows, 1) if any(c.strip() for c in r)]
    if not rows:
        return
    name, headers, k = path.rsplit("/", 1)[-1], rows[0][1], 0
    yield record(path, k, f"[Dataset: {name} | Schema Headers]\n{' | '.join(h for h in headers if h)}", is_table=True)
    for n, row in rows[1:]:
        k += 1
        cells = [f"{(headers[c] if c < len(headers) else '') or f'Column {c + 1}'}: {v}" for c, v in enumerate(row) if v]
        yield record(path, k, f"[Dataset: {name} | Row {n}]\n{' | '.join(cells)}", location=f"Row {n}", is_table=True)


READERS: dict[str, Callable[[str, bytes], Iterator[dict]]] = {
    "docx": read_docx, "xlsx": read_xlsx, "pptx": read_pptx, "dwg": read_drawing, "dxf": read_drawing, "html": read_html, "htm": read_html, "txt": read_text, "md": read_text, "csv": read_csv,
}


def read_files(spark: SparkSession, folder: str, readers: dict = READERS) -> tuple[DataFrame, DataFrame]:
    """The records of all files below a folder, and (path, error) of those that can't be read: one bad file stops nothing.

    PDF and image readers need a recognition provider and are added to ``readers`` by whoever has one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))).where(F.col("ext").isin(list(readers)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data, ext in zip(b["path"], b["content"], b["ext"], strict=True):
                try:
                    rows += [r | {"error": None} for r in readers[ext](path, data)]
                except Exception as e:  # whatever a broken file makes a parser raise
                    rows.append(record(path, 0, "") | {"error": f"{type(e).__name__}: {e}"[:500]})
            if rows:
                yield pd.DataFrame(rows, columns=[*_NAMES, "error"])

    read = files.select("path", "content", "ext").mapInPandas(run, f"{RECORDS}, error string")
    return read.where("error is null").drop("error"), read.where("error is not null").select(F.col("source").alias("path"), "error")


def first_rows(manifest: DataFrame, order: str) -> DataFrame:
    """The first row of each file name."""
    return manifest.groupBy("filename").agg(F.min_by(F.struct(*manifest.columns), order).alias("__r")).select("__r.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest (CSV with a header): the first row of each file name."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"').withColumn("__n", F.monotonically_increasing_id())
    return first_rows(rows, "__n").drop("__n")


#: How a drawing is worked on where its manifest doesn't say.
PROCESSING, MODE = "render_to_image_then_vision_ocr", "multimodal"


def with_manifest(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Records, with what a manifest (filename, recommended_processing, retrieval_mode; a row a name) says of drawings put
    to their texts.  Spark chooses how the two are joined."""
    told = manifest.select("filename", F.col("recommended_processing").alias("__p"), F.col("retrieval_mode").alias("__m"))
    line = F.concat(F.lit("\nProcessing: "), F.coalesce("__p", F.lit(PROCESSING)), F.lit("\nRetrieval: "), F.coalesce("__m", F.lit(MODE)))
    drawn = F.when(F.col("content_type") == "cad_drawing", F.concat("text", line)).otherwise(F.col("text"))
    return records.join(told, "filename", "left").withColumn("text", drawn).select(*records.columns)


def read_questions(spark: SparkSession, path: str, default: list[tuple] | None = None) -> DataFrame:
    """Questions (question, expected_keywords, category) of a JSON file; where there is none, ``default`` is written there
    first."""
    import json

    from millrace.schemas import EVAL_QUESTIONS

    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if default is not None and not store.exists(where):
        rows = [dict(zip(("question", "expected_keywords", "category"), q, strict=True)) for q in default]
        out = store.create(where)
        out.write(bytearray(json.dumps(rows, indent=2).encode()))
        out.close()
    return spark.read.schema(EVAL_QUESTIONS).json(path, multiLine=True)
