"""Evidence for answers: dossiers, contexts with sources, grounding, confidence, visual hand-off, the search contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.tags import asks_for_figure, figures, is_visual


def confidence(top: Column) -> Column:
    return F.when(top >= 0.75, "HIGH").when(top >= 0.50, "MEDIUM").otherwise("LOW")


def names(tag: Column, tags: Column, text: Column) -> Column:
    """Whether a chunk names a tag: among its tags, or as a part of its text, whatever the case."""
    listed = F.array_contains(F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.upper), F.upper(tag))
    return F.coalesce(listed | F.contains(F.upper(text), F.upper(tag)), F.lit(False))


def dossiers(tags: DataFrame, known: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per tag: the known dossier with the files of all its hits beside those that it refers to, else what the
    hits that name the tag say (files, and the first two snippets), else nothing (``origin``: known, mined, none).

    ``hits`` has (tag, place, filename, text, tags): what was retrieved for each tag.  Snippets are cut to the first two
    by rank before they are gathered."""
    rows = hits.withColumn("tag", F.upper(F.trim("tag"))).withColumn("named", names(F.col("tag"), F.col("tags"), F.col("text")))
    rows = rows.withColumn("nth", F.sum(F.col("named").cast("int")).over(Window.partitionBy("tag").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    files = rows.select("tag", "filename", "named").groupBy("tag").agg(F.array_sort(F.collect_set("filename")).alias("all_files"), F.array_sort(F.collect_set(F.when(F.col("named"), F.col("filename")))).alias("found_in"))
    notes = rows.where("named AND nth <= 2").groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.substring("text", 1, 250).alias("s")))), lambda x: x["s"]).alias("notes"))
    out = tags.withColumn("tag", F.upper(F.trim("tag"))).join(known, "tag", "left").join(files, "tag", "left").join(notes, "tag", "left")
    is_known = F.col("service").isNotNull()
    empty = F.array().cast("array<string>")
    own = F.coalesce(F.col("referenced_documents"), empty) if "referenced_documents" in known.columns else empty
    documents = F.when(is_known, F.array_sort(F.array_union(own, F.coalesce("all_files", empty)))).otherwise(F.coalesce("found_in", empty))
    return out.withColumn("documents", documents).withColumn("origin", F.when(is_known, "known").when(F.size(F.coalesce("notes", empty)) > 0, "mined").otherwise("none"))


#: Lines of a dossier: label and column, in order; those without a value are left out.
DOSSIER = [("Equipment type", "equipment_type"), ("Service", "service"), ("Normal operating", "normal_operating_range"), ("Trip / limit", "trip_limit"), ("Failsafe action", "failsafe_action"), ("Audit status", "statutory_audit_finding")]


def dossier_box(dossier: DataFrame) -> Column:
    """A dossier as text: a head, a line for each value, its documents; null for a tag of which nothing is known."""
    column = lambda n: F.col(n) if n in dossier.columns else F.lit(None).cast("string")
    lines = [F.when(column(c).isNotNull(), F.concat(F.lit(f"{label}: "), column(c))) for label, c in DOSSIER]
    head = F.concat(F.lit("ASSET "), F.col("tag"), F.coalesce(F.concat(F.lit(" ("), column("unit"), F.lit(")")), F.lit("")))
    return F.when(F.col("origin") != "none", F.concat_ws("\n", head, *lines, F.concat(F.lit("Documents: "), F.array_join("documents", ", ")), F.array_join(F.col("notes"), "\n")))


def references(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Of hits (tag, place, filename, page_number, document_type, score, text, tags; by choice qid) those that name their
    tag: document, page, category, score and an excerpt of 300 characters, marked where it is cut."""
    cut = F.when(F.length("text") > 300, F.concat(F.substring("text", 1, 300), F.lit("..."))).otherwise(F.col("text"))
    rows = hits.where(names(F.col("tag"), F.col("tags"), F.col("text")))
    rows = rows.where(F.col("place") <= k) if k else rows
    return rows.select(*(c for c in ("qid", "doc") if c in hits.columns), "tag", "place", F.col("filename").alias("document"), F.col("page_number").alias("page"), F.col("document_type").alias("category"), "score", cut.alias("excerpt"))


def grounding(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question: whether it asks for a figure, figures in its hits, and whether it is grounded."""
    n = hits.groupBy("qid").agg(F.sum(figures("text")).alias("n"))
    out = questions.join(n, "qid", "left").select("qid", asks_for_figure("text").alias("numeric"), F.coalesce("n", F.lit(0)).cast("long").alias("n_figures"))
    return out.withColumn("grounded", ~F.col("numeric") | (F.col("n_figures") > 0))


def sources(hits: DataFrame) -> DataFrame:
    """Hits with the text to cite: the parent's at its first appearance for a question, the chunk's own afterwards."""
    first = F.row_number().over(Window.partitionBy("qid", "parent_id").orderBy("place")) == 1
    whole = first & (F.length("parent_text") > 0) & (F.length("parent_id") > 0)
    return hits.withColumn("cited", F.trim(F.when(whole, F.col("parent_text")).otherwise(F.col("text")))).withColumn("whole_section", whole)


#: Lines of an evidence block behind its head: label, column and what stands for a missing value.
BLOCK = [
    ("Document", "filename", "Unknown"), ("Page", "page_number", "1"), ("Location", "location", "Unknown"), ("Section", "section", ""), ("Category", "category", "general"),
    ("Document type", "document_type", "general"), ("Extraction", "extraction_method", "native_text"), ("Tags", "tags", ""), ("Relevance", "score", "0.0"),
]


def evidence_block(hits: DataFrame) -> Column:
    """A hit as a numbered block of text: a line for each value that it has, and the text to cite."""
    lines = []
    for label, name, default in BLOCK:
        if name in hits.columns:
            c = F.array_join(F.col(name), ", ") if hits.schema[name].dataType.typeName() == "array" else F.col(name).cast("string")
            value = F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
            lines.append(F.when(value != "", F.concat(F.lit(f"{label}: "), value)))
    return F.concat_ws("\n", F.concat(F.lit("[E"), F.col("place"), F.lit("]")), *lines, F.col("cited"), F.lit(""))


def context(hits: DataFrame, limit: int = 6000) -> DataFrame:
    """Per question the context (evidence blocks in order, cut at ``limit``), its sources and the confidence."""
    item = F.struct("place", "filename", "page_number", "score", "doc")
    rows = sources(hits)
    out = rows.withColumn("block", evidence_block(rows)).groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("place", "block"))).alias("b"), F.sort_array(F.collect_list(item)).alias("sources"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("top")
    )
    text = F.array_join(F.transform("b", lambda x: x["block"]), "\n")
    text = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n[cut]"))).otherwise(text)
    return out.select("qid", text.alias("context"), "sources", confidence(F.col("top")).alias("confidence"))


def contract(questions: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """One row per question: found, confidence, context, sources and counts; without hits a reason."""
    out = questions.select("qid").join(context(hits), "qid", "left")
    n = F.coalesce(F.size("sources"), F.lit(0))
    found = F.col("sources").isNotNull()
    return out.select(
        "qid", found.alias("found"), F.coalesce("confidence", F.lit("LOW")).alias("confidence"), "context", "sources",
        F.struct(F.lit(2 * k).alias("candidates"), n.alias("final")).alias("stats"), F.when(~found, "no evidence").alias("reason"),
    )


def visual(hits: DataFrame) -> DataFrame:
    return hits.where(is_visual(F.col("requires_vision"), F.col("content_type"), F.col("file_type"), F.col("ocr_used")))


def corroborating(hits: DataFrame) -> DataFrame:
    """Per question the other documents that have hits beside the first's, sorted."""
    first = F.first("filename").over(Window.partitionBy("qid").orderBy("place"))
    rows = hits.select("qid", "place", "filename", first.alias("first")).where("filename <> first")
    return rows.groupBy("qid").agg(F.array_sort(F.collect_set("filename")).alias("others"))


def evidence_answer(hits: DataFrame) -> DataFrame:
    """The answer without a model: the first document and page, the opening of its text, the documents that agree."""
    first = F.min_by(F.struct("filename", "page_number", F.substring(F.trim("text"), 1, 1200).alias("text")), "place")
    top = confidence(F.max(F.when(F.col("place") == 1, F.col("score")))).alias("confidence")
    best = hits.groupBy("qid").agg(first.alias("f"), top, F.collect_set("filename").alias("names"))
    others = F.array_sort(F.array_except("names", F.array("f.filename")))  # as ``corroborating`` has them, from one pass over the hits
    out = best.withColumn("others", F.when((F.size(others) > 0) & F.col("f.filename").isNotNull(), others))
    more = F.when(F.col("others").isNotNull(), F.concat(F.lit("Also in: "), F.array_join("others", ", ")))
    text = F.concat_ws("\n", F.concat(F.lit("From "), F.col("f.filename"), F.lit(", page "), F.col("f.page_number")), F.col("f.text"), more)
    return out.select("qid", text.alias("answer"), F.coalesce("others", F.array().cast("array<string>")).alias("others"), "confidence")
