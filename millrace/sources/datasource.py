"""``spark.read.format("millrace_documents").load(folder)``: the records of documents as a Spark data source.

Files are listed without being read.  Small ones share a partition up to a number of bytes; the pages of a large PDF are
dealt out over several.  Filters on extension and path leave files out before anything is opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from millrace.schemas import RECORDS
from millrace.sources import pdf, readers

NAME = "millrace_documents"
#: Bytes of a partition, and of a PDF's share of one; options ``partitionBytes`` and ``pageBytes``.
PARTITION_BYTES, PAGE_BYTES = 32 << 20, 32 << 20
#: Columns that a file has before it is read.
_KNOWN = ("path", "extension", "length")
_SCHEMA = f"path string, extension string, length long, error string, {RECORDS}"


@dataclass
class Files(InputPartition):
    """Files (path, length) and which share of each to read: number and how many."""

    files: list[tuple[str, int, int, int]]

    def __init__(self, files):
        super().__init__(None)
        self.files = files


def _store(folder: str):
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), f"/{folder[5:].lstrip('/')}", "file:"
    if "://" not in folder:
        return fs.LocalFileSystem(), folder, "file:"
    store, name = fs.FileSystem.from_uri(folder)
    return store, name, folder[: len(folder) - len(name)] if folder.endswith(name) else ""


def _extension(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.size, self.page_size = int(options.get("partitionBytes", PARTITION_BYTES)), int(options.get("pageBytes", PAGE_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes what can be told of a file that isn't read; Spark applies the rest."""
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains"}
        for f in filters:
            if type(f) in kinds and f.attribute[0] in _KNOWN and len(f.attribute) == 1 and f.value is not None:
                self.tests.append((f.attribute[0], kinds[type(f)], f.value))
            else:
                yield f

    def _wanted(self, path: str, length: int) -> bool:
        known = {"path": path, "extension": _extension(path), "length": length}
        test = {"is": lambda a, b: a == b, "in": lambda a, b: a in b, "starts": lambda a, b: a.startswith(b), "ends": lambda a, b: a.endswith(b), "contains": lambda a, b: b in a}
        return known["extension"] in _READERS and all(test[how](known[name], value) for name, how, value in self.tests)

    def listed(self) -> list[tuple[str, int]]:
        """Paths and lengths of the files to read, in order."""
        from pyarrow import fs

        store, name, scheme = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(name, recursive=True)) if store.get_file_info(name).type == fs.FileType.Directory else [store.get_file_info(name)]
        files = [(f"{scheme}{f.path}", f.size) for f in found if f.type == fs.FileType.File]
        return sorted((p, n) for p, n in files if self._wanted(p, n))

    def partitions(self) -> list[Files]:
        out, held, size = [], [], 0
        for path, n in self.listed():
            shares = -(-n // self.page_size) if _extension(path) == "pdf" else 1
            if shares > 1:
                out += [Files([(path, n, k, shares)]) for k in range(shares)]
                continue
            if held and size + n > self.size:
                out.append(Files(held))
                held, size = [], 0
            held.append((path, n, 0, 1))
            size += n
        return [*out, *([Files(held)] if held else [])] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, length, share, shares in partition.files:
            store, name, _ = _store(path)
            ext, first = _extension(path), (path, _extension(path), length)
            try:
                with store.open_input_file(name) as f:
                    data = f.read()
                rows = _pages(path, data, share, shares) if ext == "pdf" else _READERS[ext](path, data)
                for r in rows:
                    yield (*first, None, *(r[c] for c in readers._NAMES))
            except Exception as e:  # whatever a broken file makes a parser raise
                if share == 0:
                    r = readers.record(path, 0, "")
                    yield (*first, f"{type(e).__name__}: {e}"[:500], *(r[c] for c in readers._NAMES))


def _pages(path: str, data: bytes, share: int = 0, shares: int = 1) -> Iterator[dict]:
    """The pages of a share of a PDF: every ``shares``-th one."""
    for k, text in enumerate(pdf.page_texts(data)):
        if k % shares == share and text:
            yield readers.record(path, k, text, page_number=k + 1, location=f"Page {k + 1}")


_READERS = readers.READERS | {"pdf": _pages}


class Documents(DataSource):
    """Records of the files below ``path``: those of ``schemas.RECORDS``, and path, extension, length and error of the
    file.  A file that can't be read has one row with its error."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Documents)
