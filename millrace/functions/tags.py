"""Equipment tags, measurements, revisions and document classes as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import col

#: Fixed patterns of tags, in the order in which they are read; the fourth ignores case and is upper-cased.
TAG_PATTERNS = [
    r"\b[A-Z]{1,5}-\d{1,5}[A-Z]?\b",
    r"\bR\d+S\d+\b",
    r"\b[A-Z]{2,4}\d{2,4}[A-Z]?\b",
    r"(?i)\b(?:24\s*VDC|120\s*VAC|230\s*VAC|480\s*VAC|4-20\s*mA)\b",
    r"\b(?:P&ID|SCADA|MAH|SOP|FAT|ICP|BOM|PLC|RTU)\b",
]
SIGNALS = 3
#: Fixed words that look like tags and are none.
NO_TAGS = ["PAGE", "SHEET", "DOC", "PDF", "ITEM", "REV", "NOTE", "DATE"]
#: Fixed units, and the spelling of those that aren't lower case.
UNITS = "bar|barg|psig|kpa|mpa|psi|°C|°F|deg C|deg F|mm/s|m/s|rpm|hz|v|kv|ma|a|kw|mw|m3/h|tph|kg/h|lpm"
SPELLED = {"deg c": "°C", "deg f": "°F", "°c": "°C", "°f": "°F", "kpa": "kPa", "mpa": "MPa", "mw": "MW", "kw": "kW", "kv": "kV", "hz": "Hz"}
MEASUREMENT = rf"(?i)\b(\d+(?:\.\d+)?)\s*({UNITS})\b"
#: Fixed patterns of tags in questions, and of what else makes a question one for exact words.
QUERY_TAG = r"\b([A-Z]{1,5}-\d{1,5}[A-Z]?|[A-Z]{2,4}\d{2,4}[A-Z]?)\b"
EXACT = r"\b(?:[A-Z0-9]{2,6}-[A-Z0-9]{2,6}|ERR[_-]?[A-Z0-9]+|0x[0-9A-Fa-f]+|E-\d{2,4})\b"
#: Fixed terms of document types in the order of precedence, and their categories.
TYPES = [
    ("pid", "engineering", ["p&id", "p_and_i", "pid", "legend"]),
    ("inspection", "compliance", ["inspection", "checklist", "accident", "investigation", "audit"]),
    ("instrumentation", "engineering", ["instrument", "instrumentation", "mounting", "transmitter", "sensor"]),
    ("control_panel", "engineering", ["control_panel", "control-panel", "panel", "icp", "wiring", "power distribution"]),
    ("network", "engineering", ["network", "architecture", "topology"]),
    ("scada", "engineering", ["scada", "hmi", "plc"]),
    ("standard", "standards", ["standard", "manual", "specification", "sop"]),
    ("template", "templates", ["template", "form", "inventory"]),
]
#: Fixed pattern of revisions.
REVISION = r"(?i)\b(?:Rev|Revision)[\s.:_-]*([0-9]+(?:\.[0-9]+)?|[A-Z])\b"


def any_of(text: Column, terms: list[str]) -> Column:
    out = F.contains(text, F.lit(terms[0]))
    for t in terms[1:]:
        out = out | F.contains(text, F.lit(t))
    return out


def extract_tags(text: Column | str) -> Column:
    """Distinct tags of a text, sorted, as written (signals upper-cased)."""
    found = []
    for k, p in enumerate(TAG_PATTERNS):
        hits = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(p), F.lit(0))
        found.append(F.transform(hits, F.upper) if k == SIGNALS else hits)
    every = F.array_distinct(F.flatten(F.array(*found)))
    return F.array_sort(F.filter(every, lambda t: ~F.upper(t).isin(NO_TAGS)))


def extract_measurements(text: Column | str) -> Column:
    """Distinct "value unit" of a text, sorted, with units in their usual spelling."""
    t = F.coalesce(col(text), F.lit(""))
    values, units = (F.regexp_extract_all(t, F.lit(MEASUREMENT), F.lit(k)) for k in (1, 2))
    spelled = F.create_map(*[F.lit(x) for kv in SPELLED.items() for x in kv])
    joined = F.zip_with(values, units, lambda v, u: F.concat(v, F.lit(" "), F.coalesce(F.try_element_at(spelled, F.lower(u)), F.lower(u))))
    return F.array_sort(F.array_distinct(joined))


def extract_revision(text: Column | str, filename: Column | str | None = None) -> Column:
    """Superseded, Draft, "Rev x" or Active, from the name and the opening of the text."""
    name = F.coalesce(col(filename), F.lit("")) if filename is not None else F.lit("")
    t = F.concat(name, F.lit(" "), F.substring(F.coalesce(col(text), F.lit("")), 1, 1500))
    code = F.regexp_extract(t, REVISION, 1)
    return (
        F.when(t.rlike(r"(?i)\b(superseded|obsolete|withdrawn)\b"), "Superseded")
        .when(t.rlike(r"(?i)\b(draft|preliminary|unapproved)\b"), "Draft")
        .when(code != "", F.concat(F.lit("Rev "), F.upper(code)))
        .otherwise("Active")
    )


def classify(path: Column | str) -> Column:
    """file_type, content_type, category, document_type and revision of a path; P&IDs are told by the whole path."""
    p = F.lower(col(path))
    name = F.element_at(F.split(p, "/"), -1)
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    kind, category = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (t, c, terms) in enumerate(TYPES):
        hit = any_of(p if k == 0 else name, terms)
        kind = F.coalesce(kind, F.when(hit, t))
        category = F.coalesce(category, F.when(hit, c))
    content = F.when(ext.isin("png", "jpg", "jpeg", "webp"), "image").when(F.contains(name, F.lit("scan")), "scanned_document").otherwise("document")
    return F.struct(
        ext.alias("file_type"), content.alias("content_type"), F.coalesce(category, F.lit("general")).alias("category"),
        F.coalesce(kind, F.lit("general")).alias("document_type"), extract_revision(F.lit(""), F.element_at(F.split(col(path), "/"), -1)).alias("revision"),
    )


def file_kind(path: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(col(path), r"\.([^./]*)$", 1))
    return F.when(ext.isin("pdf", "docx", "xlsx"), ext).when(ext.isin("png", "jpg", "jpeg", "webp"), "image").otherwise("unknown")


def is_supported(path: Column | str) -> Column:
    """Files that a reader takes; decks and drawings too."""
    return F.lower(F.regexp_extract(col(path), r"\.([^./]*)$", 1)).isin("pdf", "docx", "xlsx", "pptx", "dwg", "dxf", "png", "jpg", "jpeg", "webp", "html", "htm", "txt", "csv")


def query_tags(question: Column | str, codes: list[str] = ()) -> Column:
    """Equipment tags of a question: at least four characters, not a unit's code."""
    hits = F.regexp_extract_all(F.upper(F.coalesce(col(question), F.lit(""))), F.lit(QUERY_TAG), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(hits, lambda t: (F.length(t) >= 4) & ~t.isin(list(codes) or ["-"]))))


def asks_exactly(question: Column | str, codes: list[str] = ()) -> Column:
    """Whether a question names a tag or a code, so that exact words weigh more than meaning."""
    return (F.size(query_tags(question, codes)) > 0) | F.coalesce(F.trim(col(question)).rlike(EXACT), F.lit(False))


#: Fixed words of questions about audits.
ASKS_AUDIT = ["audit", "report", "incident", "accident", "mah", "inspection", "safety"]
#: Fixed multipliers of documents by parts of their names or places, in the order of precedence: parts, multiplier, and the
#: multiplier where the question asks for audits.  Callers add their own folders.
AUTHORITY = [
    (["safety_audit", "incident", "audit", "annual_safety"], 1.35, 1.65),
    (["sop", "standard", "design_basis"], 1.25, 1.25),
    (["pid", "p&id", "schematic"], 1.15, 1.15),
    (["template", "blank", "fat_sat_checklist"], 0.65, 0.65),
]
#: Fixed multipliers by revision.
LIFE = [(["superseded", "obsolete", "withdrawn"], 0.40), (["draft", "preliminary"], 0.75), (["rev"], 1.05)]


def authority(filename: Column, location: Column, question: Column, revision: Column, table: list = AUTHORITY) -> Column:
    """A multiplier for a chunk: by the kind of its document (first that applies), then by its revision."""
    where, rev = F.lower(F.concat_ws(" ", F.coalesce(filename, F.lit("")), F.coalesce(location, F.lit("")))), F.lower(F.coalesce(revision, F.lit("")))
    asked, base, life = any_of(F.lower(question), ASKS_AUDIT), F.lit(1.0), F.lit(1.0)
    for parts, plain, audits in reversed(table):
        base = F.when(any_of(where, parts), F.when(asked, float(audits)).otherwise(float(plain))).otherwise(base)
    for parts, factor in reversed(LIFE):
        life = F.when(any_of(rev, parts), factor).otherwise(life)
    return F.round(base * life, 4)


#: Fixed words of questions that ask for a figure, and units that count as one in the evidence.
NUMERIC = ["pressure", "temperature", "temp", "limit", "stroke", "closing time", "thickness", "sulfur", "ppm", "bar", "°c", "celsius", "kv", "vdc", "flow", "set point"]
EVIDENCE = r"(?i)\b(\d+(?:\.\d+)?)\s*(?:bar\(g\)|%|(?:bar|°c|c|ppm|seconds|sec|s|mm|m3/h|vdc|vac|kpa)\b)"


def asks_for_figure(question: Column | str) -> Column:
    return any_of(F.lower(col(question)), NUMERIC)


def figures(text: Column | str) -> Column:
    """Measured values in a piece of evidence."""
    return F.size(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(EVIDENCE), F.lit(1)))


def is_visual(requires_vision: Column, content_type: Column, file_type: Column, ocr_used: Column) -> Column:
    kinds = content_type.isin("cad_drawing", "scanned_document", "image") | file_type.isin("dwg", "dxf", "png", "jpg", "jpeg", "webp")
    return F.coalesce(requires_vision, F.lit(False)) | F.coalesce(kinds, F.lit(False)) | F.coalesce(ocr_used, F.lit(False))
