"""Command line: python -m millrace COMMAND ... (see --help)."""

from __future__ import annotations

import argparse
import json
import sys
import time

from millrace.operators.fusion import THRESHOLD
from millrace.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description="Indexes documents and answers questions about them.")
    p.add_argument("--index", default="millrace-index", help="folder of the index")
    p.add_argument("--master", help="Spark master")
    p.add_argument("--threshold", type=float, default=THRESHOLD, help="least score of a hit")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("sync", "brings the index up to date with a folder"), ("benchmark", "recognises the pages of a folder and reports their quality")):
        sub.add_parser(name, help=text).add_argument("folder")
    sub.choices["sync"].add_argument("--force", action="store_true", help="reads unchanged files again")
    ask = sub.add_parser("ask", help="answers a question")
    ask.add_argument("question")
    ask.add_argument("-k", type=int, default=4)
    sub.add_parser("chat", help="answers questions from standard input, a line each")
    sub.add_parser("eval", help="evaluates retrieval").add_argument("questions", nargs="?", help="JSON file of questions")
    sub.add_parser("ocr", help="reads a file and shows its text").add_argument("file")
    sub.add_parser("tag", help="what the documents say of a tag").add_argument("tag")
    sub.add_parser("agent", help="works on a task").add_argument("task")
    sub.add_parser("list", help="the indexed documents")
    sub.add_parser("check", help="what works")
    return p


def main(arguments: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(arguments)
    from millrace.engine import QUESTIONS, Engine
    from millrace.shipping import ship
    from millrace.sources.readers import read_questions

    spark = spark or session("millrace", a.master or "local[*]", **{"spark.ui.showConsoleProgress": "false"})
    ship(spark)
    engine = Engine(spark, a.index, threshold=a.threshold)
    show = lambda x: print(json.dumps(x, indent=2, default=str, ensure_ascii=False))
    if a.command == "sync":
        show(engine.sync(a.folder, a.force))
    elif a.command == "ask":
        for event in engine.answer_stream(a.question, a.k):
            if event["type"] == "token":
                print(event["text"], end="")
        print(f"\n[{event['confidence']}] {', '.join(s['filename'] for s in event['sources'])}")
    elif a.command == "chat":
        history: list[tuple[str, str]] = []
        for line in sys.stdin:
            found = engine.answer(line.strip(), history=history[-6:])
            history.append((line.strip(), found["answer"]))
            print(found["answer"], f"[{found['confidence']}]", sep="\n")
    elif a.command == "eval":
        show(engine.evaluate(read_questions(spark, a.questions, QUESTIONS) if a.questions else None))
    elif a.command == "ocr":
        show(engine.inspect_scanned_document(a.file))
    elif a.command == "tag":
        show(engine.lookup_equipment_tag(a.tag))
    elif a.command == "agent":
        for event in engine.run(a.task):
            show(event)
    elif a.command == "list":
        show(engine.list_registered_documents())
    elif a.command == "check":
        show(engine.health())
    elif a.command == "benchmark":
        from pyspark.sql import functions as F

        from millrace.operators import evaluate, sync

        began = time.time()
        records = sync.read_files(sync.scan(spark, a.folder).select("path"), engine.readers()).where("error is null AND ocr_used").cache()
        n = records.count()
        seconds = (time.time() - began) / max(1, n)
        pages = records.select(F.coalesce("ocr_confidence", F.lit(0.0)).alias("confidence"), F.coalesce("is_table", F.lit(False)).alias("is_table"), F.lit(seconds).alias("seconds"))
        show(evaluate.ocr_benchmark(pages).first().asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
