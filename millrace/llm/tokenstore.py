"""A content-addressed store of token ids.

Files of a store, all Parquet below one folder:

``draft``      (kind "chunk") ``key`` (BLAKE2b-128 of the payload), ``n`` ids, ``payload`` (little-endian ids of ``width`` bytes);
               a chunk is there once, however many documents hold it.
``manifest``   (kind "document") one row per document in ascending id order: id, ``part`` (file order) and ``local`` (ids
               before it in the part), ``n_tokens``, ``hashes`` and ``sizes`` of its chunks in order (the recipe),
               ``root`` (Merkle root over its chunk hashes).  (kind "part") one row per part: ``n_tokens``, ``docs`` and
               ``root`` (Merkle root over its documents' roots, in order).
``parts``      one row per part: ``part``, ``n_tokens``, ``docs``, ``first`` (ids before the part), ``root``.
``store``      one row: ``root`` (Merkle root over the parts' roots), ``docs``, ``n_tokens``.

A rolling hash over the last ids decides where chunks end, so a passage yields the same chunks wherever it stands.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.encoding import encoder
from millrace.llm.memory import small_batches, tidy
from millrace.llm.storage import shared_folder
from millrace.llm.wordhash import mix

#: Ids that the rolling hash sees; a chunk ends where MASK bits of it are 0; least and most ids of a chunk.
ROLL, MASK, LEAST, MOST = 12, (1 << 9) - 1, 128, 2048
#: Chunks whose payload a task remembers having sent.
REMEMBER = 100_000
MANIFEST = "id {}, n_tokens long, hashes array<binary>, sizes array<int>, part int, local long, docs long, root binary, kind string"
PARTS = "part int, n_tokens long, docs long, root binary, first long"
#: Ids that are cut together; rows of an Arrow batch, most of which are hashes.
GROUP, BATCH_ROWS = 1 << 20, 2048


def marks(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash would end a chunk, in a stream of ids; the first ROLL - 1 places of a text depend on what
    stands before it, and lie where no chunk may end."""
    g = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))[ids] if ids.max(initial=0) < 1 << 16 else mix(ids.astype(np.uint64) + np.uint64(1))
    roll = np.zeros(len(ids), dtype=np.uint64)
    for k in range(min(ROLL, len(ids))):
        roll[k:] += g[: len(ids) - k] * np.uint64((2 * k + 1) << k)
    return np.flatnonzero((roll >> np.uint64(23)) & np.uint64(MASK) == 0) + 1


def chunk_ends(n: int, places: list[int]) -> list[int]:
    """Ends of the chunks of a document of ``n`` ids, given the marks inside it."""
    ends, last = [], 0
    for m in [*places, n]:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST or m == n and m > last:
            ends.append(m)
            last = m
    return ends


class Merkle:
    """A Merkle tree that grows by leaves in order and keeps one hash a level; an odd one goes up alone."""

    def __init__(self):
        self.levels: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.levels and self.levels[-1][0] == level:
            leaf, level = blake2b(self.levels.pop()[1] + leaf, digest_size=16).digest(), level + 1
        self.levels.append((level, leaf))

    def root(self) -> bytes:
        """The root of what was added; no leaves: 16 zero bytes."""
        if not self.levels:
            return bytes(16)
        root = self.levels[-1][1]
        for _, left in reversed(self.levels[:-1]):
            root = blake2b(left + root, digest_size=16).digest()
        return root


def merkle(leaves: list[bytes]) -> bytes:
    """The Merkle root of hashes in order."""
    if len(leaves) == 1:
        return leaves[0]
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def _power(bits: int) -> np.ndarray:
    """x**(2**k) modulo the CRC-32 polynomial, for k below ``bits``, in the reflected order that CRC-32 uses."""
    out = np.zeros(bits, dtype=np.uint32)
    p = np.array([1 << 30], dtype=np.uint32)
    for k in range(bits):
        out[k] = p[0]
        p = _times(p, p)
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC-32 polynomial."""
    out, b = np.zeros(max(len(a), len(b)), dtype=np.uint32), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1) == 1, b, np.uint32(0))
        b = np.where(b & np.uint32(1) == 1, (b >> np.uint32(1)) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
    return out


def crc32_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 adds (by XOR) to that of a whole in which ``n_bytes`` bytes follow the part."""
    out, rest, table = crc.astype(np.uint32), n_bytes.astype(np.uint64) * np.uint64(8), _power(44)
    for k in range(44):
        at = np.flatnonzero((rest >> np.uint64(k)) & np.uint64(1) == 1)
        if len(at):
            out[at] = _times(np.repeat(table[k : k + 1], len(at)), out[at])
    return out


def write_store(
    docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes ``docs`` (null text: empty; each text's ids and then ``end_id``) and writes the store's files.

    Repeated rows and null ids are documents of their own; null ids come first; of equal ids the shorter come first.  An
    empty table makes empty files.  Texts of any length are encoded whole; extra columns are ignored.  Texts are encoded
    once; only distinct chunks of a task are shuffled, by hash, and hashes for the recipes.  A task holds one group of
    texts (`GROUP` ids), the word tables of its encoder and the addresses of its chunks (16 bytes each).
    """
    kind_of = docs.select(F.col(f"`{id_col}`")).schema.fields[0].dataType.simpleString()
    schema = f"kind string, key binary, id {kind_of}, n_tokens long, row long, hashes array<binary>, sizes array<int>, n int, width int, payload binary"
    names = ["kind", "key", "id", "n_tokens", "row", "hashes", "sizes", "n", "width", "payload"]

    def take(docs_of: deque, row: Iterator[int], group: list[bytes], rows: list[tuple], sent: set[bytes], kind: np.dtype) -> None:
        """Cuts the documents of ``group`` into chunks; adds the chunks that weren't sent, and the recipes."""
        ids = np.frombuffer(b"".join(group), dtype="<u4")
        data, at = memoryview(ids.astype(kind).tobytes()), marks(ids)
        edges = np.cumsum([0, *(len(g) // 4 for g in group)])
        first = np.searchsorted(at, edges, side="right").tolist()
        at, edges, width = at.tolist(), edges.tolist(), kind.itemsize
        for a, b, i, j in zip(edges, edges[1:], first, first[1:], strict=False):
            doc, hashes, sizes, last = docs_of.popleft(), [], [], 0
            for e in chunk_ends(b - a, [m - a for m in at[i:j]]):
                payload = data[width * (a + last) : width * (a + e)]
                h = blake2b(payload, digest_size=16).digest()
                hashes.append(h)
                sizes.append(e - last)
                if h not in sent:
                    if len(sent) >= REMEMBER:
                        sent.clear()
                    sent.add(h)
                    rows.append(("chunk", h, None, None, None, None, None, e - last, width, bytes(payload)))
                last = e
            k = next(row)
            rows.append(("recipe", blake2b(k.to_bytes(8, "little"), digest_size=16).digest(), doc, b - a, k, hashes, sizes, None, None, None))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, sent = encoder(tokenizer, kind), set()
        end = np.array([end_id], dtype="<u4").tobytes()
        row = count(TaskContext.get().partitionId() << 33)
        docs_of, rows, group, size, of = deque(), [], [], 0, None

        def texts() -> Iterator[str | None]:
            """The texts of all batches; those that are encoded together may come from several."""
            nonlocal of
            for batch in batches:
                of = batch.schema.field(0).type
                docs_of.extend(batch.column(0).to_pylist())
                for t in batch.column(1):
                    yield t.as_py()

        def out() -> pa.RecordBatch:
            types = [pa.string(), pa.binary(), of, pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for raw in code.encode_all(texts()):
            group.append(raw + end)
            size += len(raw) // 4 + 1
            if size >= GROUP:
                take(docs_of, row, group, rows, sent, np.dtype(code.width))
                yield out()
                rows, group, size = [], [], 0
        if group:
            take(docs_of, row, group, rows, sent, np.dtype(code.width))
            yield out()
        tidy()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first of each chunk, and all recipes; what has one address is in one partition."""
        tidy(forget_encoders=True)
        seen: set[bytes] = set()
        for b in batches:
            keep = []
            for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keep.append(k == "recipe" or h not in seen)
                if k == "chunk":
                    seen.add(h)
            yield b.filter(pa.array(keep))
        tidy()

    rows = small_batches(docs, BATCH_ROWS).select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(cut, schema).repartition("key").mapInArrow(once, schema)
    rows.write.partitionBy("kind").option("compression", "lz4").parquet(f"{folder}/draft")
    spark = docs.sparkSession
    draft = spark.read.schema(schema.replace("kind string, ", "") + ", kind string").parquet(f"{folder}/draft")
    recipes = draft.where("kind = 'recipe'").select("id", "n_tokens", "row", "hashes", "sizes")
    # By row number last, so that rows of one id lie in several parts.
    ordered = recipes.repartitionByRange("id", "n_tokens", "row").sortWithinPartitions("id", "n_tokens", "row").drop("row")
    manifest = MANIFEST.format(kind_of)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(forget_encoders=True)
        part, local, docs, tree, of = TaskContext.get().partitionId(), 0, 0, Merkle(), None
        names = ["id", "n_tokens", "hashes", "sizes", "part", "local", "docs", "root", "kind"]
        for b in batches:
            of = b.schema.types
            n = np.asarray(b.column(1), dtype=np.int64)
            before = local + np.cumsum(n) - n
            local, docs = local + int(n.sum()), docs + len(n)
            roots = [merkle(h) for h in b.column(2).to_pylist()]
            for root in roots:
                tree.add(root)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array([1] * len(n), pa.int64()), pa.array(roots, pa.binary()), pa.array(["document"] * len(n))], names)
        if docs:
            whole = [pa.array([x], t) for x, t in zip((None, local, None, None), of, strict=True)]
            yield pa.RecordBatch.from_arrays([*whole, pa.array([part], pa.int32()), pa.array([None], pa.int64()), pa.array([docs], pa.int64()), pa.array([tree.root()], pa.binary()), pa.array(["part"])], names)

    ordered.mapInArrow(number, manifest).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/manifest")
    # One row a part, of which there are as many as tasks: the only thing that a single task puts in one order.
    parts = spark.read.schema(manifest).parquet(f"{folder}/manifest").where("kind = 'part'").select("part", "n_tokens", "docs", "root")

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = 0
        for b in batches:
            n = np.asarray(b.column(1), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first + np.cumsum(n) - n, pa.int64())], [*b.schema.names, "first"])
            first += int(n.sum())

    parts.coalesce(1).sortWithinPartitions("part").mapInArrow(top, PARTS).write.parquet(f"{folder}/parts")
    _store(spark, folder).write.parquet(f"{folder}/store")


def _store(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the root over the parts in order, with the sums of their documents and ids."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, n, docs = Merkle(), 0, 0
        for b in batches:
            for root in b.column(3).to_pylist():
                tree.add(root)
            n, docs = n + sum(b.column(1).to_pylist()), docs + sum(b.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([tree.root()], pa.binary()), pa.array([docs], pa.int64()), pa.array([n], pa.int64())], ["root", "docs", "n_tokens"])

    return spark.read.schema(PARTS).parquet(f"{folder}/parts").coalesce(1).sortWithinPartitions("part").mapInArrow(top, "root binary, docs long, n_tokens long")


def check_manifest(spark: SparkSession, folder: str) -> None:
    """Puts the tree together again from the manifest and raises ``ValueError`` where it differs from what is stored.

    The documents' roots of a part come in order to one task, which keeps one hash a level; a part is what one task
    wrote.  The parts' roots, one row for each task of the writer, come to one task.
    """
    roots = spark.read.schema("root binary, local long, n_tokens long, part int, kind string").parquet(f"{folder}/manifest").where("kind = 'document'")
    ordered = roots.select("part", "local", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "local", "n_tokens")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(forget_encoders=True)
        at, tree, docs, tokens = None, Merkle(), 0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([tokens], pa.int64()), pa.array([docs], pa.int64()), pa.array([tree.root()], pa.binary())], ["part", "found_tokens", "found_docs", "found"])
        for b in batches:
            for part, local, n, root in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != at:
                    if at is not None:
                        yield row()
                    at, tree, docs, tokens = part, Merkle(), 0, 0
                if local != tokens:
                    raise ValueError(f"a document of part {part} is missing or repeated at {local}")
                tree.add(root)
                docs, tokens = docs + 1, tokens + n
        if at is not None:
            yield row()

    found = ordered.mapInArrow(again, "part int, found_tokens long, found_docs long, found binary")
    parts = spark.read.schema(PARTS).parquet(f"{folder}/parts")
    wrong = parts.join(found, "part", "full").where("NOT (found <=> root AND found_tokens <=> n_tokens AND found_docs <=> docs)").limit(3).collect()
    if wrong:
        raise ValueError(f"parts of the manifest are damaged: {sorted(r['part'] for r in wrong)}")
    stored = spark.read.schema("root binary, docs long, n_tokens long").parquet(f"{folder}/store").collect()
    if stored != _store(spark, folder).collect():
        raise ValueError("the store's root is not that of its parts")


def _tables(spark: SparkSession, folder: str, id_type: str) -> tuple[DataFrame, DataFrame]:
    chunks = spark.read.schema("key binary, n int, width int, payload binary, kind string").parquet(f"{folder}/draft").where("kind = 'chunk'")
    chunks = chunks.select(F.col("key").alias("hash"), "n", "width", "payload")
    parts = spark.read.schema(PARTS).parquet(f"{folder}/parts").select("part", "first")
    # One row of 12 bytes for each task of the writer: Spark's own threshold decides whether they are broadcast.
    manifest = spark.read.schema(MANIFEST.format(id_type)).parquet(f"{folder}/manifest").where("kind = 'document'").join(parts, "part")
    return chunks, manifest.withColumn("start", F.col("first") + F.col("local"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads payloads: each must have its address and its size; gives the CRC-32 of its ids as 32 bits each."""
    from zlib import crc32

    tidy(forget_encoders=True)
    for b in batches:
        crc = []
        for h, n, width, payload in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3), strict=True):
            payload = payload.as_buffer()
            ids = np.frombuffer(payload, dtype=f"<u{width}")
            if blake2b(payload, digest_size=16).digest() != h or len(ids) != n:
                raise ValueError(f"chunk {h.hex()} is damaged")
            crc.append(crc32(ids.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crc, pa.int64())], ["hash", "n", "crc"])


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads recipes: each must have its Merkle root; gives a row for each chunk with the ids that follow it."""
    tidy(forget_encoders=True)
    for b in batches:
        start, hashes, sizes, roots = (c.to_pylist() for c in b.columns)
        rows, h, n, after = [], [], [], []
        for s, hs, ns, root in zip(start, hashes, sizes, roots, strict=True):
            if merkle(hs) != root:
                raise ValueError(f"the recipe at {s} is damaged")
            left = np.cumsum(ns[::-1])[::-1] - ns
            rows += [s] * len(hs)
            h += hs
            n += ns
            after += left.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(h, pa.binary()), pa.array(n, pa.int32()), pa.array(after, pa.int64())], ["start", "hash", "size", "after"])


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tidy(forget_encoders=True)
    for b in batches:
        start, size, n, after, crc = b.columns
        x = crc32_shift(np.asarray(crc).astype(np.uint32), 4 * np.asarray(after))
        yield pa.RecordBatch.from_arrays([start, n.cast(pa.int64()), pa.array(x.astype(np.int64))], ["start", "n", "x"])


def read_digests(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """One row per document, from the files: id, ``start, n_tokens, ids_crc32`` of the reconstructed ids.

    Every payload is read and held against its address, every recipe against its Merkle root, the documents' roots
    against their part's and the parts' against the store's; the CRC-32 of a document is put together from those of its
    chunks, so that payloads don't travel (``read_ids`` puts the ids themselves together).
    """
    check_manifest(spark, folder)
    chunks, manifest = _tables(spark, folder, id_type)
    read = chunks.mapInArrow(_checked, "hash binary, n int, crc long")
    uses = manifest.select("start", "hashes", "sizes", "root").mapInArrow(_recipes, "start long, hash binary, size int, after long")
    joined = uses.join(read, "hash", "left").select("start", "size", "n", "after", "crc")
    whole = joined.mapInArrow(_shifted, "start long, n long, x long").groupBy("start").agg(F.sum("n").alias("n_read"), F.bit_xor("x").alias("ids_crc32"))
    out = manifest.select("id", "start", "n_tokens").join(whole, "start")
    wrong = F.raise_error(F.concat(F.lit("chunks are missing at "), F.col("start")))
    return out.select("id", "start", F.when(F.col("n_read") == F.col("n_tokens"), F.col("n_tokens")).otherwise(wrong).alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """One row per document, from the files: id, ``start`` and ``ids`` (array), put together from its chunks."""
    chunks, manifest = _tables(spark, folder, id_type)
    uses = manifest.select("id", "start", F.posexplode("hashes").alias("k", "hash")).join(chunks, "hash")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.concatenate([np.frombuffer(p["payload"], dtype=f"<u{p['width']}") for p in ps]).astype(np.int64) for ps in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64()))], ["id", "start", "ids"])

    grouped = uses.groupBy("id", "start").agg(F.sort_array(F.collect_list(F.struct("k", "width", "payload"))).alias("parts"))
    return grouped.mapInArrow(whole, f"id {manifest.schema['id'].dataType.simpleString()}, start long, ids array<long>")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, folder).withColumnRenamed("id", "doc_id")
