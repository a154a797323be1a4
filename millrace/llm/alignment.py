"""Alignment of two tokenizers over a corpus, as relations: tokens, their ends, the ends that both have, and links.

Both tokenizers cut a text in places that their rules and pieces fix whatever stands around, such as a word's space.
What lies between two such places, a stretch, has the same tokens wherever it stands, so the relations are made of the
distinct stretches with the number of times that they occur, counted in chunk files before anything is shuffled: tokens
are exploded with their places, windowed sums of lengths give their ends, equal ends of both sides meet, running counts of the ends
that both have number the groups.  Each end of either side closes one link: the range between it and the end before it
lies in one token of each.  A chunk's documents, kept as the numbers of their stretches, then meet the sums of those.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import chunks as C
from millrace.llm.encoding import WIDE_SPACE
from millrace.llm.memory import tidy
from millrace.llm.storage import drop, frees_shuffles, get, put, scope, shared_folder, written

#: Marks that may begin a stretch after one of these letters, if no piece has them there.
MARKS, LETTERS = ".,;:!?", "A-Za-zÀ-ÖØ-öø-ɏ"
#: White space that isn't a space or a line feed; stretches that are encoded together.
_RARE, TOGETHER = re.compile(f"[\t\v\f\r{WIDE_SPACE}]"), 512
#: Bytes of text of a chunk: the larger, the fewer rows for stretches that many chunks have.
CHUNK_BYTES = 12 << 20
#: Pairs of ids that may be broadcast, of 33 bytes each.
PAIRS = 1 << 20
_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class ByteLevel:
    """A tokenizers file whose tokens are byte-level: every token stands for the bytes of the text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes[k] = bytes(self.alphabet[c] for c in token) if all(c in self.alphabet for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model; it puts a space before each text, so it gets what follows the space of the first word."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.pieces = [self.model.id_to_piece(k) for k in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(self.pieces)]
        self.before = self.model.encode("a")

    def encode(self, texts: list[str]) -> list[list[int]]:
        out, n = self.model.encode([f"a{t}" for t in texts], num_threads=1), len(self.before)
        if any(ids[:n] != self.before for ids in out):
            raise ValueError("a piece of the model reaches over the start of a stretch")
        return [ids[n:] for ids in out]


def cuts(pieces: list[str]) -> str:
    """The pattern of a stretch: white space and what follows it.  A tokenizer of words cuts before white space that follows
    anything else, and between letters and marks; this model does unless a piece has them inside, as some have a carriage
    return at their ends: what follows one of those stays with it."""
    pieces = [p.replace("▁", " ") for p in pieces]
    every = f"\t\n\v\f\r {WIDE_SPACE}"
    inside = "".join(c for c in every if any(re.search(f"[^{every}]{c}", p) for p in pieces))
    space = "".join(c for c in every if c not in inside)
    if " " in inside or "\n" in inside or inside and any(re.search(f"[{inside}][{space}]", p) for p in pieces):
        raise ValueError("the model has pieces that reach over white space")
    marks = "".join(m for m in MARKS if not any(re.search(f"[{LETTERS}]{re.escape(m)}", p) for p in pieces))
    word = f"[{space}]*+[{LETTERS}]++(?=[{marks}])|" if marks else ""
    on = f"(?:(?<=[{inside}])[{space}]++[^{space}]*+)*+" if inside else ""
    return f"{word}[{space}]*+[^{space}]++{on}|[{space}]++"


_models: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def _both(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    if (a_path, b_path) not in _models:
        _models[a_path, b_path] = ByteLevel(a_path), Pieces(b_path)
    return _models[a_path, b_path]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ranges, given by their starts and sizes, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _span_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums of spans of values, given by their sizes, that follow each other."""
    upto, ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)]), np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def _stretches(cut: re.Pattern, texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different stretches of a chunk's texts, how many each text has, and their numbers, text after text.  A word is
    what stands between two spaces, of a text where each of those begins a stretch; it is cut once, however often it stands
    there, and one of letters and digits alone is a stretch."""
    plain, odd, cut_odd, large = [], [], [], pa.large_string()
    for k, t in enumerate(texts):
        if t:
            u = t.decode()
            if "  " in u or "\n " in u or u[0].isspace() or _RARE.search(u):
                odd.append(k)
                cut_odd.append(pa.array(cut.findall(f" {u}"), large))
            else:
                plain.append(k)
    split = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_binary()).cast(large), " ")
    words = split.flatten().dictionary_encode()
    alone = pc.utf8_is_alnum(words.dictionary)
    single = pc.binary_join_element_wise(pa.scalar("", large), words.dictionary.filter(alone), pa.scalar(" ", large))
    several = [cut.findall(f" {w}") for w in words.dictionary.filter(pc.invert(alone)).to_pylist()]
    # The stretches of words, then those of odd texts, get numbers; a word's are a range of them.
    known = pa.concat_arrays([single, pa.array([u for w in several for u in w], large), *cut_odd]).dictionary_encode()
    numbers, alone, code = known.indices.to_numpy(), alone.to_numpy(zero_copy_only=False), words.indices.to_numpy()
    sizes = np.ones(len(alone), dtype=np.int64)
    sizes[~alone] = [len(w) for w in several]
    starts = np.empty(len(alone), dtype=np.int64)
    starts[alone] = np.arange(len(single))
    starts[~alone] = len(single) + np.cumsum(sizes[~alone]) - sizes[~alone]
    n, of_odd = np.zeros(len(texts), dtype=np.int64), sum(map(len, cut_odd))
    n[plain], n[odd] = _span_sums(sizes[code], pc.list_value_length(split).to_numpy()), [len(x) for x in cut_odd]
    at, out = np.cumsum(n) - n, np.empty(n.sum(), dtype=np.int32)
    out[_ranges(at[plain], n[plain])] = numbers[_ranges(starts[code], sizes[code])]
    out[_ranges(at[odd], n[odd])] = numbers[len(numbers) - of_odd :]
    return known.dictionary, n, out


def _save(path: str, ids: list, n: np.ndarray, numbers: np.ndarray) -> None:
    """A chunk's documents as a file: ids, how many stretches each has, and the numbers of those."""
    sink, row = io.BytesIO(), {"id": pa.array([ids], pa.large_list(pa.int64())), "n": pa.array([n]), "numbers": pa.array([C.planes(numbers)], pa.large_binary())}
    table = pa.table(row)
    with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    put(path, sink.getvalue())


def _saved(path: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    ids, n, numbers = (c[0] for c in pa.ipc.open_file(pa.BufferReader(get(path))).read_all().columns)
    n = n.values.to_numpy()
    return ids.values, n, C.unplanes(numbers.as_py(), "i4", int(n.sum()))


def _found(folder: str, pattern: str, saved: str):
    """The different stretches of each chunk file by number, with how often they stand there, a chunk without any as one row
    without a stretch.  What its documents have of them is saved by the chunk's number; the texts aren't needed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile(pattern)
        for batch in batches:
            for chunk, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, texts = C.read(get(f"{folder}/{file}"))
                different, n, numbers = _stretches(cut, texts)
                _save(f"{saved}/{chunk}", ids, n, numbers)
                rows = max(1, len(different))
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array(np.full(rows, chunk)), "k": pa.array(np.arange(rows, dtype=np.int32)),
                    "u": different.cast(pa.string()) if len(different) else pa.array([None], pa.string()), "n": pa.array(np.bincount(numbers, minlength=rows)),
                })
        tidy()

    return run


def _spoilt(saved: str):
    """From chunks and the numbers of their bad stretches, how often each stretch stands in documents that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, bad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, n, numbers = _saved(f"{saved}/{chunk}")
                spoilt = _span_sums(np.isin(numbers, bad), n) > 0
                counts = np.bincount(numbers[np.repeat(spoilt, n)])
                k = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(k), chunk)), "k": pa.array(k.astype(np.int32)), "lost": pa.array(counts[k])})

    return run


def _documents(saved: str, digest: bool):
    """The rows of a chunk's documents from what is known of its stretches."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, n, numbers = _saved(f"{saved}/{key[0].as_py()}")
        groups = rows.column("groups")
        at = np.empty(len(rows), dtype=np.int64)
        at[rows.column("k").to_numpy()] = np.arange(len(rows))
        at = at[numbers]
        whole = (n > 0) & (_span_sums(groups.is_null().to_numpy()[at], n) == 0)
        count = lambda x, mark: pc.count_substring(x, mark).fill_null(0).to_numpy().astype(np.int64)
        n_groups, commas, of_a = count(groups, "|"), count(groups, ","), count(pc.replace_substring_regex(groups, r"\|[^;]*", ""), ",")
        a, b = of_a + n_groups, commas - of_a + n_groups
        # Each end closes a link, and those of both sides close one together.
        sums = {"n_a": a, "n_b": b, "n_groups": n_groups, "n_links": a + b - n_groups} | {c: rows.column(c).fill_null(0).to_numpy() for c in _SUMS[4:]}
        groups, told, end = groups.to_pylist(), [], 0
        for size, good in zip(n.tolist(), whole.tolist(), strict=True):
            joined = ";".join([groups[u] for u in at[end : end + size].tolist()]) if good else ""
            told.append(hashlib.sha256(joined.encode()).hexdigest() if digest and good else joined)
            end += size
        return pa.table({"id": ids, **{c: pa.array(np.where(whole, _span_sums(sums[c][at], n), 0)) for c in _SUMS}, "groups": pa.array(told, pa.string())})

    return run


def _together(side: ByteLevel | Pieces, sizes: np.ndarray, texts: list[str], fill: list[bool]) -> tuple[np.ndarray, np.ndarray] | None:
    """The tokens of stretches, encoded as one text, and how many each has; None if a side doesn't give them back."""
    parts = [p for t, f in zip(texts, fill, strict=True) for p in ((" a", t) if f else (t,))]
    whole = "".join(parts)
    ids = np.array(side.encode([whole])[0], dtype=np.int32)
    if b"".join(map(side.bytes.__getitem__, ids.tolist())) != whole.encode():
        return None
    ends, bounds = np.cumsum(sizes[ids]), np.cumsum([len(p.encode()) for p in parts])
    at = np.searchsorted(ends, bounds)
    if not np.array_equal(ends[at], bounds):
        raise ValueError("a token reaches over the start of a stretch")
    counts = np.diff(at + 1, prepend=0)
    own = np.array([x for f in fill for x in ((False, True) if f else (True,))])
    return ids[np.repeat(own, counts)], counts[own]


def _tokens(side: ByteLevel | Pieces, sizes: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """The tokens of stretches one after the other, how many each has, and whether they give its bytes back."""
    ids, counts, good = [np.zeros(0, np.int32)], [], []
    for k in range(0, len(texts), TOGETHER):
        part = texts[k : k + TOGETHER]
        found = None if any(t[-1].isspace() for t in part) else _together(side, sizes, part, [not t[0].isspace() for t in part])
        if found is not None:
            ids.append(found[0])
            counts += found[1].tolist()
            good += [True] * len(part)
            continue
        for t, x in zip(part, side.encode(part), strict=True):
            ids.append(np.array(x, dtype=np.int32))
            counts.append(len(x))
            good.append(b"".join(map(side.bytes.__getitem__, x)) == t.encode())
    return np.concatenate(ids), np.array(counts, dtype=np.int64), good


def _encode(a_path: str, b_path: str):
    """Stretches with a number, whether both sides' bytes are the stretch's, and the tokens of both sides, A's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _both(a_path, b_path)
        sizes = [np.array([len(x) for x in side.bytes], dtype=np.int32) for side in (a, b)]
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(0).to_pylist()
            (a_ids, a_n, a_good), (b_ids, b_n, b_good) = (_tokens(side, n, texts) for side, n in zip((a, b), sizes, strict=True))
            good = [x and y for x, y in zip(a_good, b_good, strict=True)]
            a_ids, b_ids = a_ids[np.repeat(good, a_n)], b_ids[np.repeat(good, b_n)]
            a_n, b_n = np.where(good, a_n, 0), np.where(good, b_n, 0)
            of_b = np.repeat(np.tile([False, True], len(texts)), np.stack([a_n, b_n], axis=1).reshape(-1))
            ids, size = np.zeros(len(of_b), dtype=np.int32), np.zeros(len(of_b), dtype=np.int32)
            ids[~of_b], ids[of_b], size[~of_b], size[of_b] = a_ids, b_ids, sizes[0][a_ids], sizes[1][b_ids]
            offsets = np.concatenate([[0], np.cumsum(a_n + b_n)])
            tokens = pa.StructArray.from_arrays([pa.array(of_b), pa.array(ids), pa.array(size)], ["b", "id", "size"])
            numbers = pa.array(np.arange(number, number + len(texts)))
            number += len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), numbers, pa.array(good, pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens)], ["u", "times", "unit", "good", "tokens"])
        tidy()

    return run


def _links(units: DataFrame) -> DataFrame:
    """Each unit with its ``groups`` written out and its links (a, b) as an array.  All steps keep the rows of a unit where
    one exchange has put them."""
    tokens = units.where("good").select("unit", "times", F.posexplode("tokens").alias("pos", "t")).select("unit", "times", "pos", "t.*").repartition("unit")
    upto = Window.partitionBy("unit", "b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = tokens.withColumn("end", F.sum("size").over(upto))
    # The equi-join of both sides on unit and end: ends are distinct on each side, so a grouping does it in place.
    met = ends.groupBy("unit", "end").agg(F.max("times").alias("times"), F.max(F.expr("if(b, null, id)")).alias("a"), F.max(F.expr("if(b, id, null)")).alias("b"))
    # Backwards, the last token seen is the one that the range before an end lies in, and common ends number the groups.
    back = Window.partitionBy("unit").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    rows = met.select(
        "unit", "times", "end", "a", "b", F.last("a", ignorenulls=True).over(back).alias("of_a"), F.last("b", ignorenulls=True).over(back).alias("of_b"),
        F.sum(F.expr("if(a is not null AND b is not null, 1, 0)")).over(back).alias("g"),
    )
    ids = lambda c: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("end", F.col(c).alias("id"))))), lambda x: x["id"].cast("string")))
    groups = rows.groupBy("unit", "g").agg(
        F.max("times").alias("times"), F.max("end").alias("end"), F.concat(ids("a"), F.lit("|"), ids("b")).alias("text"),
        F.collect_list(F.struct(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).alias("links"),
    )
    return groups.groupBy("unit").agg(
        F.max("times").alias("times"),
        F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("end", "text"))), lambda x: x["text"])).alias("groups"), F.flatten(F.collect_list("links")).alias("links"),
    )


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row per row of ``docs``, and the pairs of ids that are linked.

    Documents: id, ``n_a, n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose pair has the highest count
    of its B id, ties included), ``count_sum`` (of the links' pair counts) and ``groups``, written ``a1,a2|b1;a3|b2``, or
    the SHA-256 of that (``digest``).  Pairs: ``a, b, n_times, best``; n_times is how many links of the corpus hold the pair.

    ``a_path``: a byte-level tokenizers file; ``b_path``: a sentencepiece model with byte fallback.  Both read the text
    with a space before it (the model adds its own).  A null or empty text, and one that either side doesn't give back
    byte by byte, has no tokens: zeros, and groups ''.  Ids are whole numbers; null ids stay null; repeated rows each
    count and each have a row.  Empty tables give empty results; columns other than the two named are ignored.  Ties of
    pair counts are all best.  A text of any length is taken whole; one without spaces is one stretch, whose tokens one
    task sorts.  A model whose pieces reach over spaces raises.
    """
    spark, pattern = docs.sparkSession, cuts(_both(a_path, b_path)[1].pieces)
    told_at, pairs_at, saved = (shared_folder(spark, f"alignment-{n}") for n in ("told", "pairs", "documents"))
    with frees_shuffles(spark):
        folder, listed, _, tasks = C.stage(docs, id_col, text_col, "alignment-chunks", CHUNK_BYTES)
        found = listed.repartition(tasks, "chunk").mapInArrow(_found(folder, pattern, saved), "chunk long, k int, u string, n long")
        found = written(found, "alignment-stretches")
        drop(spark, folder)
        with scope(spark):  # tokens and links go when the sums of stretches are written
            counted = found.where("u is not null").groupBy("u").agg(F.sum("n").alias("times"))
            units = counted.mapInArrow(_encode(a_path, b_path), "u string, times long, unit long, good boolean, tokens array<struct<b:boolean,id:int,size:int>>")
            units = written(units, "alignment-tokens")
            bad = units.where("not good").select("u")
            if not bad.isEmpty():  # stretches count in the documents that are given back whole only
                held = found.join(bad, "u", "left_semi").groupBy("chunk").agg(F.collect_list("k").alias("bad"))  # of one chunk each
                lost = held.mapInArrow(_spoilt(saved), "chunk long, k int, lost long").join(found, ["chunk", "k"]).groupBy("u").agg(F.sum("lost").alias("lost"))
                units = units.join(lost, "u", "left").withColumn("times", F.col("times") - F.coalesce("lost", F.lit(0))).drop("lost")
            aligned = written(_links(units), "alignment-links")
            linked = aligned.where("times > 0").select("times", F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("times").alias("n_times"))
            pairs = linked.withColumn("best", F.col("n_times") == F.max("n_times").over(Window.partitionBy("b")))
            pairs.write.parquet(pairs_at)
            pairs = spark.read.schema(pairs.schema).parquet(pairs_at)
            small = pairs.count() <= PAIRS
            of_links = aligned.select("unit", F.explode("links").alias("l")).select("unit", "l.*").join(F.broadcast(pairs) if small else pairs, ["a", "b"])
            sums = of_links.groupBy("unit").agg(F.count_if("best").alias("n_best"), F.sum("n_times").alias("count_sum"))
            told = units.where("good").select("unit", "u").join(aligned.select("unit", "groups"), "unit").join(sums, "unit", "left").drop("unit")
            told.write.parquet(told_at)
            told = spark.read.schema(told.schema).parquet(told_at)
    each = found.select("chunk", "k", "u").join(told, "u", "left").drop("u")
    # As many tasks as there are chunks, so that what one reads doesn't grow with the corpus.
    rows = each.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(_documents(saved, digest), f"id long, {', '.join(f'{c} long' for c in _SUMS)}, groups string")
    return rows, pairs


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, _ = align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.select(F.col("id").alias("doc_id"), *_SUMS, F.col("groups").alias("groups_sha256"))
