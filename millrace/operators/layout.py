"""Layout of recognised pages: lines and tables out of boxes, as sequential folds in array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.ocr import clean_cell
from millrace.functions.text import bound


def _middle(values: Column) -> Column:
    """The upper median."""
    s = F.array_sort(values)
    return F.get(s, (F.size(s) / 2).cast("int"))


def _rows(boxes: Column, tolerance: Column, running_mean: bool) -> Column:
    """Boxes (x1, y1, x2, y2, text, score) in rows: each box joins the current row if its centre is within
    ``tolerance`` of the row's, which moves with every box (to the mean of all, or half way to the new one)."""
    by_y = F.array_sort(F.transform(boxes, lambda b: F.struct(((b["y1"] + b["y2"]) / 2).alias("cy"), b["x1"].alias("x1"), b["text"].alias("text"))))
    cell = "struct<x1:double,text:string>"
    start = F.expr(f"named_struct('rows', cast(array() as array<array<{cell}>>), 'row', cast(array() as array<{cell}>), 'cy', cast(null as double), 'sum', 0D)")

    def step(a: Column, b: Column) -> Column:
        item = F.array(F.struct(b["x1"].cast("double").alias("x1"), b["text"].alias("text")))
        joins = a["cy"].isNull() | (F.abs(b["cy"] - a["cy"]) <= tolerance)
        n = F.size(a["row"])
        moved = (a["sum"] + b["cy"]) / (n + 1) if running_mean else F.coalesce((a["cy"] + b["cy"]) / 2, b["cy"])
        return F.when(
            joins, F.struct(a["rows"].alias("rows"), F.concat(a["row"], item).alias("row"), moved.cast("double").alias("cy"), (a["sum"] + b["cy"]).cast("double").alias("sum"))
        ).otherwise(F.struct(F.concat(a["rows"], F.array(a["row"])).alias("rows"), item.alias("row"), b["cy"].cast("double").alias("cy"), b["cy"].cast("double").alias("sum")))

    done = F.aggregate(by_y, start, step, lambda a: F.filter(F.concat(a["rows"], F.array(a["row"])), lambda r: F.size(r) > 0))
    return F.transform(done, lambda r: F.array_sort(r))


def lines(boxes: Column, least: float = 0.65) -> Column:
    """The text of a page: confident boxes in rows, cells of a row left to right with " | " between."""

    def joined(good: Column) -> Column:
        tolerance = F.greatest(_middle(F.transform(good, lambda b: F.abs(b["y2"] - b["y1"]))) * 0.4, F.lit(10.0))
        text = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: c["text"]), " | ")), "\n")
        return bound(tolerance, lambda t: text(_rows(good, t, True)))

    return bound(F.filter(boxes, lambda b: (b["score"] >= least) & (F.trim(b["text"]) != "")), joined)


def table(boxes: Column, min_columns: int = 2, min_rows: int = 2) -> Column:
    """is_table, rows of repaired cells, csv_text, num_rows, num_cols; a table has two rows of two cells at least."""
    tolerance = F.greatest(F.coalesce(_middle(F.transform(boxes, lambda b: b["y2"] - b["y1"])), F.lit(20.0)) * 0.5, F.lit(8.0))
    rows = bound(tolerance, lambda t: F.transform(_rows(boxes, t, False), lambda r: F.transform(r, lambda c: clean_cell(c["text"]))))

    def described(rows: Column) -> Column:
        is_table = (F.size(rows) >= min_rows) & (F.size(F.filter(rows, lambda r: F.size(r) >= min_columns)) >= min_rows)
        kept = F.when(is_table, rows).otherwise(F.array().cast("array<array<string>>"))
        csv = F.array_join(F.transform(kept, lambda r: F.array_join(F.transform(r, lambda c: F.trim(c)), " | ")), "\n")
        return F.struct(is_table.alias("is_table"), kept.alias("rows"), csv.alias("csv_text"), F.size(kept).alias("num_rows"), F.coalesce(F.array_max(F.transform(kept, lambda r: F.size(r))), F.lit(0)).alias("num_cols"))

    return bound(rows, described)
