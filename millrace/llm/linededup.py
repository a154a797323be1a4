"""Line dedup: documents probe a sharded minimal perfect hash of frequent lines instead of joining lines.

Lines are counted by 128-bit hash in a shuffle of hashes alone.  Those of several documents go into shards, one file each
in the shared folder, with their counts, which tasks map into memory and probe for all lines of a batch at once; a line's
fingerprint and count decide.  Lines of one document never go, and their hashes would only make the index large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import mph
from millrace.llm.exprs import free_prefix
from millrace.llm.memory import small_batches, tidy
from millrace.llm.storage import is_mapped, mapped, put, shared_folder, written
from millrace.llm.wordhash import split_texts

#: Keys of a shard on average; some 24 bytes a key.
SHARD = 1_000_000
SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes | None, least: int) -> tuple[list[bytes], list[int], bytes]:
    """The lines, which of them have a key of at least ``least`` code points, and the keys' 16-byte hashes in a row."""
    from xxhash import xxh3_128_digest

    lines, at, hashes = (text or b"").split(b"\n"), [], []
    for k, line in enumerate(lines):
        if len(line) >= least:
            key = line.strip(SPACE).lower()
            if len(key) >= least and (len(key) >= 4 * least or len(key.decode(errors="replace")) >= least):
                at.append(k)
                hashes.append(xxh3_128_digest(key))
    return lines, at, b"".join(hashes)


def _halves(hashes: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(hashes, dtype=">u8").reshape(-1, 2).astype(np.uint64)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text less its repeated lines, and ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  Keys of at least ``min_chars``
    code points that at least ``min_docs`` distinct ids hold lose all their lines except in the largest id holding
    them.  Ids are whole numbers; documents whose id is null count as one document with the smallest id, and rows with
    one id as one document; texts of any length are whole.  A null or empty text is one empty line, and comes back as ''.  Other columns stay, save
    that ``n_lines`` and ``n_dropped`` are replaced.  Empty tables give empty results.
    """
    spark = docs.sparkSession
    docs = small_batches(docs).drop("n_lines", "n_dropped")
    own_id = f"{free_prefix(docs)}id"

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(forget_encoders=True)
        for b in batches:
            ids, parts = b.column(0), []
            for text in split_texts(b.column(1)):
                found = line_keys(text, min_chars)[2]
                parts.append(b"".join({found[i : i + 16] for i in range(0, len(found), 16)}))
            hi, lo = _halves(b"".join(parts))
            rows = np.repeat(np.arange(len(parts)), [len(p) // 16 for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), ids.take(pa.array(rows))], ["hi", "lo", "id"])

    lines = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`")).mapInArrow(hashes, "hi long, lo long, id long")
    repeated = lines.distinct().groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(f"n > 1 OR {min_docs} < 2")
    repeated = written(repeated, "lines")
    shards, folder = -(-repeated.count() // SHARD), shared_folder(spark, "line-shards")

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        hi, lo = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("hi", "lo"))
        k = int(rows["shard"].iloc[0])
        put(f"{folder}/{k}.mph", mph.build(hi, lo, rows["n"].to_numpy(), rows["last"].to_numpy(np.int64)))
        return pd.DataFrame({"shard": [k]})

    built = set()
    if shards:
        by = F.pmod(F.shiftrightunsigned("hi", 8), F.lit(shards)).cast("int").alias("shard")
        built = {r[0] for r in repeated.withColumn("shard", by).groupBy("shard").applyInPandas(shard, "shard int").collect()}  # a number a shard

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, mph.Table] = {}
        local = is_mapped(folder)
        for b in batches:
            names = b.schema.names
            ids, texts = b.column(names.index(own_id)), split_texts(b.column(names.index(text_col)))
            found = [line_keys(t, min_chars) for t in texts]
            hi, lo = _halves(b"".join(f[2] for f in found))
            own = np.repeat(np.array(ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), dtype=np.int64), [len(f[1]) for f in found])
            gone = np.zeros(len(hi), dtype=bool)
            if shards:
                of = ((hi >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)
                for k in np.unique(of).tolist():
                    if k in built:
                        if k not in tables:
                            if not local:  # where files can't be mapped, one is held at a time
                                tables.clear()
                            tables[k] = mph.Table(mapped(f"{folder}/{k}.mph"))
                        at = np.flatnonzero(of == k)
                        place = tables[k].find(hi[at], lo[at])
                        known = np.flatnonzero(place >= 0)
                        known = known[tables[k].counts[place[known]] >= min_docs]
                        gone[at[known]] = tables[k].numbers[place[known]] != own[at[known]]
            out, n_dropped, first = [], [], 0
            for lines, at, _ in found:
                flags = gone[first : first + len(at)]
                first += len(at)
                if flags.any():
                    dropped = {k for k, f in zip(at, flags.tolist(), strict=True) if f}
                    lines_left = [x for k, x in enumerate(lines) if k not in dropped]
                else:
                    lines_left = lines
                out.append(b"\n".join(lines_left))
                n_dropped.append(len(lines) - len(lines_left))
            columns = {n: c for n, c in zip(names, b.columns, strict=True) if n != own_id}
            columns[text_col] = pa.array(out, pa.binary()).cast(pa.string())
            columns |= {"n_lines": pa.array([len(f[0]) for f in found], pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)
        tidy()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_lines long, n_dropped long"
    return docs.withColumn(own_id, F.col(f"`{id_col}`").cast("long")).mapInArrow(drop, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, k, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT doc_id, k, line, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
