"""One object for an index and what works on it: synchronise, retrieve, search, answer, look tags up, evaluate, report.

Models are put in: ``embedder``, ``rerank`` (see ``rerank.reranker``), ``ocr`` (a maker of recognition engines), ``render``
(pages of PDF files as pictures), ``call`` (a language model, a function of a prompt).  What is left out has a stand-in or
is left out of the work."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.tags import extract_tags
from millrace.functions.text import cache_key, is_conversational, is_followup
from millrace.operators import agent, evaluate, evidence, fusion, memory, ontology, providers, recognition, registry, sync
from millrace.operators.audit import AuditLog
from millrace.operators.segments import View
from millrace.schemas import EVAL_QUESTIONS, REGISTRY, TURNS
from millrace.shared import scope
from millrace.sources import readers, sinks

K = 4
#: Answers that are held, and question vectors.
ANSWERS, VECTORS = 5000, 128
NOTHING = "The local documents hold nothing on this."
GREETING = "I answer questions from the documents that are indexed here."
#: Questions for an evaluation where a folder brings none.
QUESTIONS = [
    ("What is the trip limit of PT-101?", ["PT-101", "trip", "bar"], "instruments"),
    ("How long may XV-301 take to close?", ["XV-301", "closing", "seconds"], "instruments"),
    ("What did the last safety audit find?", ["audit", "finding"], "audits"),
    ("How is the unit shut down in an emergency?", ["emergency", "shutdown"], "procedures"),
    ("Which standards apply?", ["standard"], "standards"),
]


class Cache:
    """The last ``most`` values; ``touch``: a value that is read counts as new."""

    def __init__(self, most: int, touch: bool = True):
        self.most, self.touch, self.held = most, touch, OrderedDict()

    def get(self, key):
        if key in self.held and self.touch:
            self.held.move_to_end(key)
        return self.held.get(key)

    def put(self, key, value) -> None:
        self.held[key] = value
        while len(self.held) > self.most:
            self.held.popitem(last=False)


#: Tools in the form in which language models take them.
TOOLS = [
    {"type": "function", "function": {"name": name, "description": text, "parameters": {"type": "object", "properties": properties, "required": required}}}
    for name, text, properties, required in (
        ("search_internal_knowledge", "Finds passages of the indexed documents for a question.", {"query": {"type": "string"}, "top_k": {"type": "integer"}, "document_type": {"type": "string"}}, ["query"]),
        ("lookup_equipment_tag", "What the documents say of an equipment tag.", {"tag": {"type": "string"}}, ["tag"]),
        ("inspect_scanned_document", "Reads a picture or a scanned page and lists its tags.", {"file_path": {"type": "string"}, "page_number": {"type": "integer"}}, ["file_path"]),
        ("list_registered_documents", "The documents that are indexed.", {}, []),
        ("get_airgap_status", "Whether anything left this site.", {}, []),
    )
]


class Engine:
    def __init__(self, spark: SparkSession, path: str, embedder=None, rerank=None, ocr: Callable = recognition.engine, render: Callable | None = None, call: Callable[[str], str] | None = None, stream: Callable[[str], Iterator[str]] | None = None, dossiers: DataFrame | None = None, threshold: float = fusion.THRESHOLD):
        self.spark, self.path, self.rerank, self.ocr, self.render, self.call, self.stream = spark, path.rstrip("/"), rerank, ocr, render, call, stream
        self.embedder, self.known, self.threshold = embedder or providers.MockEmbedder(), dossiers, threshold
        self.answers, self.vectors = Cache(ANSWERS), Cache(VECTORS, touch=False)
        self.log = AuditLog(spark, f"{self.path}/audit")

    # Index.

    def readers(self) -> dict:
        """Readers by extension: of pictures other than PNG if the recognition engine decodes them."""
        kinds = ("png", "jpg", "jpeg", "webp") if hasattr(self.ocr(), "decode") else ("png",)
        return readers.READERS | {"pdf": recognition.pdf_reader(self.ocr, self.render), **dict.fromkeys(kinds, recognition.image_reader(self.ocr))}

    def sync(self, folder: str, force: bool = False) -> dict[str, int]:
        """Brings the index up to date with a folder; answers that are held are forgotten."""
        self.audit("ingestion", "sync", folder)
        self.answers = Cache(ANSWERS)
        return sync.sync(self.spark, folder, f"{self.path}/index", self.embedder, self.readers(), force)

    def recreate(self) -> None:
        sync.recreate(self.spark, f"{self.path}/index")

    def index(self) -> View | None:
        """The index as of its last version; None before the first."""
        return sync.load(self.spark, f"{self.path}/index")

    def tables(self) -> dict[str, DataFrame] | None:
        """The registry and the chunks; None before the first version."""
        view = self.index()
        return {"registry": sync.registry_of(view), "chunks": view.chunks()} if view else None

    def documents(self) -> DataFrame:
        """The registry by file name."""
        found = self.tables()
        return registry.listed(found["registry"] if found else self.spark.createDataFrame([], REGISTRY))

    # Retrieval.

    def questions(self, texts: list[str]) -> DataFrame:
        """Stated questions as a table: number, text, what each side searches for, and the vector."""
        asked = self.spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
        asked = fusion.prepare(asked, ontology.table(self.spark))
        return providers.embed(asked, self.embedder, "dense_query").withColumnRenamed("embedding", "vector").drop("embed_error")

    def retrieve(self, texts: list[str], k: int = K, threshold: float | None = None, criteria: dict | None = None) -> DataFrame:
        """The hits of several questions: qid, place, score and the chunk's columns."""
        view = self.index()
        chunks = view.chunks() if view else None
        if chunks is None:
            raise LookupError("there is no index yet; synchronise a folder first")
        return fusion.retrieve(view, chunks, chunks.drop("embedding"), self.questions(texts), k, self.threshold if threshold is None else threshold, criteria, score=self.rerank)

    def search(self, question: str, k: int = K, criteria: dict | None = None) -> dict:
        """The search contract of one question."""
        self.audit("retrieval", "search", question)
        if not question.strip():
            return {"found": False, "confidence": "LOW", "context": None, "sources": [], "reason": "no question"}
        hits = self.retrieve([question], k, criteria=criteria)
        asked = self.spark.createDataFrame([(0,)], "qid long")
        return evidence.contract(asked, hits, k).first().asDict(recursive=True)

    # Answers.

    def answer(self, question: str, k: int = K, history: list[tuple[str, str]] | None = None) -> dict:
        """Text, sources and confidence: by the model, else from the evidence itself."""
        for event in self._answer(question, k, history, self.call and (lambda prompt: iter([self.call(prompt)]))):
            if event["type"] == "done":
                return event["answered"]
        raise AssertionError

    def answer_stream(self, question: str, k: int = K, history: list[tuple[str, str]] | None = None) -> Iterator[dict]:
        """The answer piece by piece as the model (``stream``, else ``call``) gives it, then its sources and confidence.  If
        the model fails before its first piece, the evidence answers; after it, an ``error`` event ends what there is."""
        for event in self._answer(question, k, history, self.stream or (self.call and (lambda prompt: agent.pieces(self.call(prompt))))):
            yield {"type": "done", **event["answered"]} if event["type"] == "done" else event

    def _answer(self, question: str, k: int, history: list[tuple[str, str]] | None, model: Callable[[str], Iterator[str]] | None) -> Iterator[dict]:
        def whole(answered: dict) -> Iterator[dict]:
            for piece in agent.pieces(answered["answer"]):
                yield {"type": "token", "text": piece}
            yield {"type": "done", "answered": answered}

        key = self._value(cache_key(F.lit(question)))
        if not history and (held := self.answers.get(key)):
            yield from whole(held)
            return
        if not question.strip() or self._value(is_conversational(F.lit(question))):
            yield from whole({"answer": GREETING, "sources": [], "confidence": "HIGH"})
            return
        asked = self.condensed(question, history or [])
        with scope(self.spark):  # what the search writes on its way goes
            hits = self.retrieve([asked], k).withColumn("cited", F.col("text"))
            found = evidence.contract(self.spark.createDataFrame([(0,)], "qid long"), hits, k).first().asDict(recursive=True)
            plain = evidence.evidence_answer(hits).first() if found["found"] and model is None else None
        if not found["found"]:
            yield from whole({"answer": NOTHING, "sources": [], "confidence": "LOW"})
            return
        pieces, failed = [], None
        if model is not None:
            try:
                for piece in model(f"Answer from this evidence only and cite it as [E1], [E2] ...\n\n{found['context']}\n\nQuestion: {asked}"):
                    pieces.append(piece)
                    yield {"type": "token", "text": piece}
            except Exception as e:  # the model's own failure
                failed = e
        if failed is not None and pieces:
            yield {"type": "error", "text": f"{type(failed).__name__}: {failed}"[:200]}
        if not pieces:
            if plain is None:
                with scope(self.spark):
                    plain = evidence.evidence_answer(self.retrieve([asked], k).withColumn("cited", F.col("text"))).first()
            pieces = [plain["answer"]]
            for piece in agent.pieces(plain["answer"]):
                yield {"type": "token", "text": piece}
        elif found["confidence"] == "LOW":
            pieces.append("\n\nThe evidence for this is weak; check it against the documents.")
            yield {"type": "token", "text": pieces[-1]}
        answered = {"answer": "".join(pieces), "sources": found["sources"], "confidence": found["confidence"]}
        if not history and failed is None:
            self.answers.put(key, answered)
        yield {"type": "done", "answered": answered}

    def condensed(self, question: str, history: list[tuple[str, str]]) -> str:
        """A question that follows up on earlier ones, rewritten by the model to stand for itself."""
        if not history or self.call is None or not self._value(is_followup(F.lit(question), earlier=len(history))):
            return question
        turns = self.spark.createDataFrame([(0, n, q, a, []) for n, (q, a) in enumerate(history)], TURNS)
        told = memory.summary(turns.select("conv_id", "turn", F.lit("user").alias("role"), F.concat_ws("\n", "question", "answer").alias("text"))).first()["summary"]
        try:
            rewritten = self.call(f"Rewrite the last question so that it can be understood alone.\n{told}\nLast question: {question}")
        except Exception:  # the model's own failure
            return question
        return self._value(memory.condensed(F.lit(question), F.lit(rewritten)))

    def _value(self, expression):
        return self.spark.range(1).select(expression.alias("v")).first()["v"]

    # Tools.

    def search_internal_knowledge(self, query: str, top_k: int = 5, document_type: str | None = None) -> str:
        found = self.search(query, top_k, {"document_type": document_type} if document_type else None)
        return found["context"] if found["found"] else NOTHING

    def lookup_equipment_tag(self, tag: str) -> dict:
        """A tag's dossier, and the places that name it."""
        clean = tag.strip().upper()
        self.audit("tools", "lookup_equipment_tag", clean)
        hits = self.retrieve([clean], 5).withColumn("tag", F.lit(clean))
        known = self.known if self.known is not None else self.spark.createDataFrame([], "tag string, service string")
        dossier = evidence.dossiers(self.spark.createDataFrame([(clean,)], "tag string"), known, hits)
        boxed = dossier.withColumn("box", evidence.dossier_box(dossier)).first().asDict(recursive=True)
        places = [r.asDict() for r in evidence.references(hits).orderBy("place").collect()]
        return {"tag": clean, "dossier": boxed if boxed["origin"] != "none" else None, "matches_found": len(places), "references": places}

    def inspect_scanned_document(self, file_path: str, page_number: int | None = None) -> dict:
        """What the readers find in a file, or on one of its pages, and its tags."""
        self.audit("tools", "inspect_scanned_document", file_path)
        files = self.spark.read.format("binaryFile").load(file_path).select("path", "content")
        records, errors = sync.parse(files, self.readers())
        records = records.where(F.col("page_number") == page_number) if page_number else records
        rows = records.orderBy("rec_idx").select("text", "extraction_method").collect()
        if not rows:
            bad = errors.first()
            return {"success": False, "error": bad["error"] if bad else "nothing was read"}
        text = "\n".join(r["text"] for r in rows)
        return {"success": True, "file_name": file_path.rsplit("/", 1)[-1], "method": rows[0]["extraction_method"], "character_count": len(text), "detected_industrial_tags": self._value(extract_tags(F.lit(text))), "extracted_text": text}

    def list_registered_documents(self) -> list[dict]:
        return [r.asDict() for r in self.documents().select("document_id", "filename", "document_type", "chunk_count", "ocr_used", "updated_at").collect()]

    def get_airgap_status(self) -> dict:
        return memory.audit_totals(self.audit_table()).first().asDict()

    def tool(self, name: str, **arguments):
        """Calls a tool of ``TOOLS`` by its name."""
        if name not in {t["function"]["name"] for t in TOOLS}:
            raise ValueError(f"no tool {name!r}")
        return getattr(self, name)(**arguments)

    def run(self, task: str, out: str | None = None) -> Iterator[dict]:
        """An agent's events on a task; ``out``: the folder of its reports."""

        def report(make):
            return lambda p: sinks.put_report(make(p), out or f"{self.path}/reports", p.get("filename", "report"))

        tools = {
            "create_excel": report(lambda p: sinks.excel(p.get("data", []))), "create_word": report(lambda p: sinks.word(p.get("title", ""), p.get("content", ""))),
            "create_ppt": report(lambda p: sinks.slides(p.get("slides", []))),
        }
        find = lambda q: [r.asDict() for r in self.retrieve([q]).orderBy("place").select("filename", "page_number", "text", "score").collect()]
        yield from agent.Agent(find, agent.Planner(self.call), tools=tools).events(task)

    # Audit, evaluation, data for training.

    def audit(self, component: str, operation: str, target: str, local: bool = True) -> None:
        """Writes an event to the log of the index; it stays when this object goes."""
        self.log.record(component, operation, target, local)

    def audit_table(self) -> DataFrame:
        """What was done with this index, as ``schemas.AUDIT`` with ids."""
        return self.log.table()

    def evaluate(self, questions: DataFrame | None = None, k: int = 5, save: str | None = None) -> dict:
        """Totals of retrieval for questions with expected keywords (the engine's own, if none are given)."""
        rows = (questions or self.spark.createDataFrame(QUESTIONS, EVAL_QUESTIONS)).where("question <> ''").collect()  # stated questions
        began = time.time()
        hits = self.retrieve([r["question"] for r in rows], k).select("qid", "place", "text", "tags", "filename").cache()
        n = hits.count()
        latency = 1000 * (time.time() - began) / max(1, len(rows))
        asked = self.spark.createDataFrame([(i, r["expected_keywords"], r["category"]) for i, r in enumerate(rows)], "qid long, expected_keywords array<string>, category string")
        judged = hits.join(asked, "qid").withColumn("relevant", evaluate.holds_keyword(F.col("text"), F.col("tags"), F.col("expected_keywords")))
        results = evaluate.per_question(judged, asked).withColumn("latency_ms", F.lit(latency))
        totals = evaluate.totals(results)
        if save:
            sinks.save_results(totals, results, save)
        out = totals.first().asDict() | {"chunks": n}
        hits.unpersist()
        return out

    def synthetic_questions(self, n: int, make: Callable[[str], dict], path: str, seed: int = 0) -> int:
        """Appends up to ``n`` questions and answers that ``make`` (a model) writes from a sample of chunks."""
        t = self.tables()
        pairs = evaluate.synthetic_pairs(evaluate.sample(t["chunks"], n, seed), make)
        written = pairs.cache()
        count = written.count()
        if count:
            sinks.append_pairs(written, path)
        written.unpersist()
        return count

    def health(self) -> dict[str, str]:
        """What works: the index, the embedder, recognition, the model."""

        def tried(f) -> str:
            try:
                return str(f())
            except Exception as e:
                return f"failed: {type(e).__name__}: {e}"[:200]

        state = self.tables()
        return {
            "index": tried(lambda: f"{state['registry'].count()} documents, {state['chunks'].count()} chunks") if state else "none yet",
            "embedder": tried(lambda: f"{len(providers.embed(self.spark.createDataFrame([('probe',)], 'text string'), self.embedder).first()['embedding'])} dimensions"),
            "recognition": tried(lambda: type(self.ocr()).__name__), "model": "given" if self.call else "none; answers come from the evidence",
        }
