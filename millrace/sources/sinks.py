"""Sinks: the graph, evaluation results, questions and answers, audit lines, and office reports by their XML.

Tables are written by Spark; reports are small, of at most `ROWS` rows, and made on the driver."""

from __future__ import annotations

import html
import io
import os
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schemas import EDGES

#: Rows of a report at most: more are an error, not a cut.
ROWS = 100_000
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_OFFICE = "http://schemas.openxmlformats.org"
_RELATIONS = f"{_OFFICE}/officeDocument/2006/relationships"


def save_graph(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst", "relation", "source", "seq").write.mode("overwrite").parquet(path)


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    """The edges that were saved; none if there is nothing yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(EDGES).parquet(path) if there else spark.createDataFrame([], EDGES)


def graphml(edges: list) -> str:
    """Edges (src, dst, relation, source) as GraphML, for other tools."""
    nodes = sorted({n for e in edges for n in (e["src"], e["dst"])})
    q = html.escape
    rows = [f'<node id="{q(n)}"/>' for n in nodes]
    rows += [f'<edge source="{q(e["src"])}" target="{q(e["dst"])}"><data key="relation">{q(e["relation"])}</data><data key="source">{q(e["source"] or "")}</data></edge>' for e in edges]
    keys = "".join(f'<key id="{k}" for="edge" attr.name="{k}" attr.type="string"/>' for k in ("relation", "source"))
    return f'{_XML}<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">{"".join(rows)}</graph></graphml>'


def read_graphml(text: str) -> list[dict]:
    """The edges of a GraphML text; data keys may be declared under other ids."""
    root = ElementTree.fromstring(text)
    name = lambda tag: tag.rsplit("}", 1)[-1]
    keys = {e.get("id"): e.get("attr.name") for e in root.iter() if name(e.tag) == "key"}
    out = []
    for k, e in enumerate(x for x in root.iter() if name(x.tag) == "edge"):
        data = {keys.get(d.get("key"), d.get("key")): d.text or "" for d in e}
        out.append({"src": e.get("source"), "dst": e.get("target"), "relation": data.get("relation", "RELATED_TO"), "source": data.get("source"), "seq": k})
    return out


def save_results(totals: DataFrame, results: DataFrame, path: str) -> None:
    """Evaluation results: the totals and a row a question, as JSON lines."""
    totals.coalesce(1).write.mode("overwrite").json(f"{path}/aggregate")
    results.write.mode("overwrite").json(f"{path}/per_question")


def append_pairs(pairs: DataFrame, path: str) -> None:
    """Questions and answers behind those that are there, as JSON lines."""
    pairs.write.mode("append").json(path)


def audit_line(time, component, operation, target, local, details):
    """An event as one line of text."""
    kind = F.when(local, "LOCAL").otherwise("EXTERNAL")
    return F.concat_ws(" | ", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), kind, component, operation, F.coalesce(target, F.lit("")), F.coalesce(details, F.lit("")))


def append_audit(events: DataFrame, path: str) -> None:
    events.select(audit_line(F.col("timestamp"), F.col("component"), F.col("operation"), F.col("target"), F.col("is_local"), F.col("details")).alias("value")).write.mode("append").text(path)


def _package(files: dict[str, str], main: str, kind: str, parts: dict[str, str]) -> bytes:
    """A zip of XML files with the content types and the link to the main one."""
    types = "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, t in parts.items())
    head = {
        "[Content_Types].xml": f'{_XML}<Types xmlns="{_OFFICE}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
        "_rels/.rels": f'{_XML}<Relationships xmlns="{_OFFICE}/package/2006/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/{kind}" Target="{main}"/></Relationships>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (head | files).items():
            z.writestr(name, text)
    return out.getvalue()


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _clean(value) -> str:
    """Text for XML: without the control characters that it can't hold."""
    return html.escape(_CONTROL.sub("", str(value)))


def excel(rows: DataFrame | list[dict], sheet: str = "Report") -> bytes:
    """A workbook of one sheet: a header and the rows.  Numbers stay numbers, nulls are empty."""
    if isinstance(rows, DataFrame):
        held = rows.limit(ROWS + 1).collect()
        if len(held) > ROWS:
            raise ValueError(f"a report has at most {ROWS} rows; write a table instead")
        names, values = rows.columns, [list(r) for r in held]
    else:
        names = list(dict.fromkeys(k for r in rows for k in r))
        values = [[r.get(n) for n in names] for r in rows]

    def cell(i: int, j: int, v) -> str:
        at = f"{_letters(j)}{i}"
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{_clean(v)}</t></is></c>'

    body = "".join(f'<row r="{i}">{"".join(cell(i, j, v) for j, v in enumerate(r))}</row>' for i, r in enumerate([names, *values], 1))
    ns = f"{_OFFICE}/spreadsheetml/2006/main"
    files = {
        "xl/workbook.xml": f'{_XML}<workbook xmlns="{ns}" xmlns:r="{_RELATIONS}"><sheets><sheet name="{_clean(sheet)[:31]}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{_XML}<Relationships xmlns="{_OFFICE}/package/2006/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{_XML}<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>',
    }
    base = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    return _package(files, "xl/workbook.xml", "officeDocument", {"xl/workbook.xml": f"{base}.sheet.main+xml", "xl/worksheets/sheet1.xml": f"{base}.worksheet+xml"})


def word(title: str, text: str) -> bytes:
    """A document of a title and paragraphs (a line each)."""
    ns = f"{_OFFICE}/wordprocessingml/2006/main"
    line = lambda t, bold="": f'<w:p><w:r>{bold}<w:t xml:space="preserve">{_clean(t)}</w:t></w:r></w:p>'
    body = line(title, '<w:rPr><w:b/><w:sz w:val="32"/></w:rPr>') + "".join(map(line, text.split("\n")))
    files = {"word/document.xml": f'{_XML}<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>'}
    return _package(files, "word/document.xml", "officeDocument", {"word/document.xml": "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"})


def slides(pages: list[dict]) -> bytes:
    """A deck: a slide for each (title, content)."""
    a, p = f"{_OFFICE}/drawingml/2006/main", f"{_OFFICE}/presentationml/2006/main"
    base = "application/vnd.openxmlformats-officedocument.presentationml"

    def shape(k: int, text: str, y: int) -> str:
        lines = "".join(f"<a:p><a:r><a:t>{_clean(t)}</a:t></a:r></a:p>" for t in text.split("\n"))
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{k}" name="Text {k}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="457200" y="{y}"/><a:ext cx="8229600" cy="1143000"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr/>{lines}</p:txBody></p:sp>'

    group = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
    ids = "".join(f'<p:sldId id="{256 + k}" r:id="rId{k}"/>' for k in range(1, len(pages) + 1))
    links = "".join(f'<Relationship Id="rId{k}" Type="{_RELATIONS}/slide" Target="slides/slide{k}.xml"/>' for k in range(1, len(pages) + 1))
    files = {
        "ppt/presentation.xml": f'{_XML}<p:presentation xmlns:a="{a}" xmlns:r="{_RELATIONS}" xmlns:p="{p}"><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'{_XML}<Relationships xmlns="{_OFFICE}/package/2006/relationships">{links}</Relationships>',
    }
    for k, page in enumerate(pages, 1):
        body = shape(2, page.get("title", ""), 274638) + shape(3, page.get("content", ""), 1600200)
        files[f"ppt/slides/slide{k}.xml"] = f'{_XML}<p:sld xmlns:a="{a}" xmlns:p="{p}"><p:cSld><p:spTree>{group}{body}</p:spTree></p:cSld></p:sld>'
    parts = {"ppt/presentation.xml": f"{base}.presentation.main+xml"} | {f"ppt/slides/slide{k}.xml": f"{base}.slide+xml" for k in range(1, len(pages) + 1)}
    return _package(files, "ppt/presentation.xml", "officeDocument", parts)


def put_report(data: bytes, folder: str, name: str) -> str:
    """Writes a report below a folder; names with a path of their own are refused."""
    if os.path.basename(name) != name or name in ("", ".", ".."):
        raise ValueError(f"{name!r} is no file name")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path
