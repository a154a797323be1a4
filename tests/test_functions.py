"""Expressions against values worked out by hand, and against Python."""

import uuid

from pyspark.sql import functions as F

from millrace.functions import ocr, tags, text, vectors


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()) or "x int")
    return df.select(column.alias("r")).first()["r"]


def test_tokens_keep_one_hyphen(spark):
    assert one(spark, text.tokens("t"), t="PT-101 a-b-c Ünit 3.5") == ["pt-101", "a-b", "c", "nit", "3", "5"]
    assert one(spark, text.tokens("t"), t=None) == []


def test_tags(spark):
    assert one(spark, tags.extract_tags("t"), t="PT-101 at 24 vdc, R0S03 and PLC01; SCADA REV PAGE-1 ISO9001") == ["24 VDC", "ISO9001", "PAGE-1", "PLC01", "PT-101", "R0S03", "SCADA"]
    assert one(spark, tags.extract_measurements("t"), t="5 bar, 5 BAR and 3.2 kpa") == ["3.2 kPa", "5 bar"]
    assert one(spark, tags.extract_revision("t", "n"), t="x", n="plan Rev b.pdf") == "Rev B"
    assert one(spark, tags.extract_revision("t"), t="This is OBSOLETE Rev 2") == "Superseded"
    assert one(spark, tags.extract_revision("t"), t="plain") == "Active"


def test_repairs(spark):
    assert one(spark, ocr.fix_tags("t"), t="PT lOl and XV-3O1a end") == "PT-101 and XV-301A end"
    assert one(spark, ocr.fix_tags("t"), t="PT-101") == "PT-101"
    assert one(spark, ocr.fix_numbers("t"), t="at 1O.25 bar") == "at 10.25 bar"
    assert one(spark, ocr.normalize_units("t"), t="5 BAR ( g ) 3 kpa 40 ° c") == "5 bar(g) 3 kPa 40 °C"
    assert one(spark, ocr.fix_dates("t"), t="on l2/O3/2024, 1O-01-99") == "on l2/O3/2024, 10-01-99"
    assert one(spark, ocr.mark_doubtful("t", F.col("c")), t="at 5 bar", c=0.5) == "at 5 bar [UNVERIFIED]"
    assert one(spark, ocr.clean_cell("t"), t="24 VOC on XV 3|O") == "24 VDC on XV-310"


def test_predicates(spark):
    assert one(spark, text.is_conversational("t"), t=" Hello, there! ") and not one(spark, text.is_conversational("t"), t="explain the blowdown valve logic")
    assert one(spark, text.is_followup("t"), t="and the other one") and not one(spark, text.is_followup("t", True), t="show all recent pressure trends for PT-101 on Monday")
    assert one(spark, text.is_insufficient("t"), t=None) and one(spark, text.is_insufficient("t"), t="-" * 80)
    assert one(spark, F.to_json(text.json_reply("t")), t='Sure:\n```json\n{"a": 1}\n```') == '{"a":1}'
    assert one(spark, tags.figures("t"), t="at 5 % and 3 bar(g), 7 apples") == 2


def test_ids(spark):
    assert one(spark, vectors.point_id("a", "b"), a="doc", b="chunk é") == str(uuid.uuid5(vectors.POINTS, "doc:chunk é"))
    v = one(spark, vectors.mock_embedding("t", 64), t="x")
    assert len(v) == 64 and v[:32] == v[32:] and abs(sum(x * x for x in v) - 1) < 1e-4
    assert one(spark, vectors.quantize(F.array(F.lit(-1.0), F.lit(0.0), F.lit(9.0)), F.lit(-1.0), F.lit(1.0))) == [-128, -1, 127]


def test_routes(spark):
    none = F.lit(None).cast("struct<width:double,height:double,mean:double,std:double,dynamic_range:double,dark_ratio:double,laplacian_var:double>")
    r = one(spark, ocr.route(F.col("t"), F.col("n"), none), t="w" * 60, n="x.png")
    assert (r["page_type"], r["skip_ocr"], r["dpi"]) == ("digital_clean", True, 150)
    assert one(spark, ocr.route(F.col("t"), F.col("n"), none), t="", n="unit_pid.png")["tier"] == "light"


def test_repairs_compute_a_text_once(spark):
    """A step names the text before it several times; each of them was computed again for every name."""
    from millrace.operators import layout, recognition

    def searches(c) -> int:
        plan = spark.createDataFrame([("a",)], "t string").select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("regexp_extract_all(")

    assert searches(ocr.repair(F.col("t"), F.lit(0.9))) == 3
    found = F.from_json("t", recognition.LAYOUT)
    assert searches(recognition.repaired(found)["blocks"]) == 3
    boxes = F.from_json("t", "array<struct<x1:double,y1:double,x2:double,y2:double,text:string,score:double>>")
    assert searches(layout.table(boxes)) == 1


def test_guards_leave_no_match_out(spark):
    """What is looked at before a rule is a part of every match of it, in any case and with any white space."""
    import re

    units = ["BAR ( g )", "Bar", "KPA", "mPa", "PSIA", "psiG", "° C", "DEG c", "Degree C", "M3/H", "NM3/h", "l/MIN", "VDC", "vAC", "4 - 20 MA", "Rpm", "MM/s", "PPM (v)", "ppm(W)", "PPM", "WT %"]
    for text, part, (pattern, unit) in zip(units, ocr.UNIT_PARTS, ocr.UNITS, strict=True):
        assert re.fullmatch(f"(?i){pattern}", text) and part in text.lower(), text
    for cell, pattern in zip(["24 v0C", "12o vac", "23O VAC", "4 - 2o MA", "BAR (G)"], [p for p, _ in ocr.CELL_RULES], strict=True):
        assert re.fullmatch(f"(?i){pattern}", cell) and re.search(ocr.CELL_PARTS, cell), cell
    for prefix in ocr.PREFIXES.split("|"):
        assert all(re.match(ocr.TAG_AHEAD, prefix + sep + body) for sep in ("", "-", " ") for body in ("lO", "1234I"))
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([*units, None, "", "xpsiadeg c PT lO 24V0C|FV-|l"])], "k int, t string")
    plain = F.col("t")
    for pattern, unit in ocr.UNITS:
        plain = F.regexp_replace(plain, f"(?i){pattern}", unit)
    assert all(r["a"] == r["b"] for r in rows.select(ocr.normalize_units("t").alias("a"), plain.alias("b")).collect())
    assert rows.select(ocr.clean_cell("t").alias("c")).collect()[-1]["c"] == "xpsiadeg c PT-10 24 VDC|FV-11"


def test_substitute_keeps_marks(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(["a1b22", "1", "", None, "x\x01y1z", "11\x01", "\x01"])], "k int, t string")
    got = rows.orderBy("k").select(text.substitute(F.col("t"), "[0-9]", lambda m: F.concat(F.lit("<"), m, F.lit(">"))).alias("r")).collect()
    assert [r["r"] for r in got] == ["a<1>b<2><2>", "<1>", "", None, "x\x01y<1>z", "<1><1>\x01", "\x01"]
