"""Query expansion from small tables: units with synonyms and a context, and spoken phrases with their codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.tags import query_tags

#: A starter table of plant units: code, name, synonyms, context.  Callers bring their own in the same shape.
UNITS = [
    ("CDU", "Crude Distillation Unit", ["crude tower", "topping unit"], "Separates crude oil into cuts at about atmospheric pressure."),
    ("VDU", "Vacuum Distillation Unit", ["vacuum column", "vacuum tower"], "Distils the heavy residue under vacuum."),
    ("HCU", "Hydrocracker Unit", ["hydrocracking"], "Cracks heavy oils under hydrogen pressure."),
    ("FCC", "Fluid Catalytic Cracker", ["cat cracker", "regenerator"], "Cracks gas oil on a moving catalyst."),
    ("SRU", "Sulphur Recovery Unit", ["claus plant"], "Turns acid gas into elemental sulphur."),
    ("ESD", "Emergency Shutdown", ["trip system"], "Brings the plant to a safe state when a limit is passed."),
    ("PSV", "Pressure Safety Valve", ["relief valve"], "Opens at its set pressure to protect a vessel."),
    ("BDV", "Blowdown Valve", ["depressuring valve"], "Empties a section to the flare."),
    ("PT", "Pressure Transmitter", ["pressure sensor"], "Sends a measured pressure to the control system."),
    ("BS-VI", "Bharat Stage VI", ["ultra low sulphur"], "A fuel standard with ten parts per million of sulphur at most."),
]
#: Other spellings of codes.
ALIASES = {"BS6": "BS-VI", "BSVI": "BS-VI"}
#: Fixed phrases and their codes, in order.
PHRASES = [
    ("blowdown valve", "BDV"), ("blow down valve", "BDV"), ("depressurizing valve", "BDV"), ("pressure safety valve", "PSV"), ("relief valve", "PSV"),
    ("safety relief valve", "PSV"), ("emergency isolation valve", "XV"), ("emergency shutdown valve", "XV"), ("isolation valve", "XV"),
    ("motor operated valve", "MOV"), ("motorized valve", "MOV"), ("pressure transmitter", "PT"), ("pressure sensor", "PT"), ("pressure gauge", "PT"),
    ("temperature transmitter", "TT"), ("temperature sensor", "TT"), ("flow transmitter", "FT"), ("flow meter", "FT"), ("level transmitter", "LT"),
    ("level gauge", "LT"), ("emergency shutdown", "ESD"), ("emergency depressurization", "EDS"), ("rapid depressuring", "EDS"),
]


def table(spark: SparkSession, rows=UNITS) -> DataFrame:
    return spark.createDataFrame(rows, "code string, full_name string, synonyms array<string>, context string")


def expand(questions: DataFrame, units: DataFrame, text: str = "text", codes: list[str] | None = None) -> DataFrame:
    """Questions with ``dense_text`` (the first two definitions behind the question) and ``boosts`` (names, synonyms
    and tags, sorted).  Words meet the units by an equi-join on their code; ``codes`` are those that are no tags (the
    starter table's, if none are given)."""
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    words = questions.select("qid", F.posexplode(F.regexp_extract_all(F.upper(F.col(text)), F.lit(r"\b([A-Z0-9_\-./]+)\b"), F.lit(1))).alias("at", "word"))
    words = words.withColumn("code", F.coalesce(F.try_element_at(alias, F.col("word")), F.col("word")))
    meant = words.join(units, "code")
    found = meant.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("at", F.concat("code", F.lit(" ("), "full_name", F.lit("): "), "context").alias("d")))).alias("defs"),
        F.flatten(F.collect_list(F.concat(F.array("full_name"), "synonyms"))).alias("names"),
    )
    out = questions.join(found, "qid", "left")
    boosts = F.array_sort(F.array_distinct(F.concat(F.coalesce("names", F.array().cast("array<string>")), query_tags(F.col(text), [u[0] for u in UNITS] if codes is None else codes))))
    defs = F.array_join(F.transform(F.slice("defs", 1, 2), lambda x: x["d"]), " ")
    dense = F.when(F.col("defs").isNotNull(), F.concat(F.trim(F.col(text)), F.lit(" | Context: "), defs)).otherwise(F.trim(F.col(text)))
    return out.select(*questions.columns, dense.alias("dense_text"), boosts.alias("boosts"))


def expand_acronyms(text: Column, units: list[tuple] = UNITS, phrases: list[tuple[str, str]] = PHRASES) -> Column:
    """The question with codes of spoken phrases and names of codes behind it, sorted.  ``units`` (code, name, ...) and
    ``phrases`` (in lower case, code) are the caller's; they stand in the expression, so they are lists of some hundred."""
    low, up = F.lower(text), F.upper(text)
    spoken = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")) for p, c in phrases]) if phrases else F.array().cast("array<struct<p:string,c:string>>")
    codes = F.transform(F.filter(spoken, lambda x: F.contains(low, x["p"]) & ~F.contains(up, x["c"])), lambda x: x["c"])
    words = F.regexp_extract_all(up, F.lit(r"\b([A-Z0-9_-]+)\b"), F.lit(1))
    units = F.array(*[F.struct(F.lit(u[0]).alias("k"), F.lit(u[1]).alias("n")) for u in units]) if units else F.array().cast("array<struct<k:string,n:string>>")
    names = F.transform(F.filter(units, lambda u: F.array_contains(words, u["k"]) & ~F.contains(low, F.lower(u["n"]))), lambda u: u["n"])
    more = F.array_sort(F.array_distinct(F.concat(codes, names)))
    return F.when(F.size(more) > 0, F.concat(F.trim(text), F.lit(" ("), F.array_join(more, " "), F.lit(")"))).otherwise(F.trim(text))
