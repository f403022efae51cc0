"""Page files as a Python data source (A4, A5): ``spark.read.format(...)`` over folders of documents whose pages a parser yields.

The files under a folder are listed once, sorted, and packed into groups of about ``group_bytes``, a partition each.  A task opens one file
after the other and sends pages on as the parser yields them, in Arrow batches of bounded rows and bytes: what it holds is one batch and what the
parser holds, not a file or a group.  A file that cannot be opened or parsed is a row with its error (an *event*), after the pages that
it gave before; the other files are not touched by it.

The parser gets an open binary file and yields the pages' texts.  Files are opened by path on the executors (a local or mounted
folder); for a store that only Spark reaches, ``read_pages`` takes Spark's own file reader instead, one file of a task at a time (that reader leaves
out files without a byte).
"""

from __future__ import annotations

import fnmatch
import io
import os
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GROUP_BYTES = 64 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
DDL = "path string, doc_id string, domain string, page_num int, text string, error string"
_SCHEMA = pa.schema([("path", pa.string()), ("doc_id", pa.string()), ("domain", pa.string()), ("page_num", pa.int32()), ("text", pa.string()), ("error", pa.string())])
Parser = Callable[[io.BufferedIOBase], Iterable[str]]


def form_feed_pages(file: io.BufferedIOBase, step: int = 1 << 20) -> Iterator[str]:
    """Pages of UTF-8 text between form feeds, read piece by piece."""
    held = b""
    while piece := file.read(step):
        *whole, held = (held + piece).split(b"\f")
        for page in whole:
            yield page.decode("utf-8")
    yield held.decode("utf-8")


def line_pages(file: io.BufferedIOBase) -> Iterator[str]:
    """A page a line."""
    for line in io.TextIOWrapper(file, "utf-8", newline="\n"):
        yield line.removesuffix("\n")


def local_path(path: str) -> str | None:
    """The path in the file system, or None if only Spark reaches it."""
    url = urlparse(path)
    return unquote(url.path) if url.scheme == "file" else path if not url.scheme else None


def groups(root: str, pattern: str, size: int) -> list[list[str]]:
    """The files under ``root``, sorted, in groups of about ``size`` bytes; a larger file is a group of its own."""
    found = sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in fnmatch.filter(names, pattern))
    out, total = [], 0
    for path in found:
        n = os.path.getsize(path)
        if not out or total + n > size:
            out.append([])
            total = 0
        out[-1].append(path)
        total += n
    return out


def pages_of(path: str, opened: Callable[[], io.BufferedIOBase], parse: Parser) -> Iterator[tuple]:
    """Rows of one file: its pages from 1 on, then an event if it broke."""
    parts = path.split("/")
    own = (path, parts[-1], parts[-2] if len(parts) > 1 else None)
    n = 0
    try:
        with opened() as file:
            for n, text in enumerate(parse(file), 1):
                if not isinstance(text, str):
                    raise TypeError(f"a page is {type(text).__name__}, not text")
                yield (*own, n, text, None)
    except Exception as e:  # whatever a parser does to a broken file
        yield (*own, None, None, f"{type(e).__name__}: {e}"[:1000])


def batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4] or "") + 200
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _SCHEMA)], schema=_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _SCHEMA)], schema=_SCHEMA)


class FileGroup(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(len(paths))
        self.paths = paths


class PageReader(DataSourceReader):
    def __init__(self, options: dict, parse: Parser):
        self.root, self.pattern, self.size, self.parse = options["path"], options.get("pattern", "*.pdf"), int(options.get("groupbytes", GROUP_BYTES)), parse

    def partitions(self) -> list[InputPartition]:
        return [FileGroup(x) for x in groups(self.root, self.pattern, self.size)] or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            yield from batches(pages_of(path, lambda: open(path, "rb"), self.parse))  # noqa: B023


def page_source(name: str, parser: Parser) -> type[DataSource]:
    """A data source class: ``spark.dataSource.register(page_source("reports", parse))``, then ``spark.read.format("reports").option("pattern", "*.pdf").load(folder)``."""

    class PageFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return DDL

        def reader(self, schema) -> DataSourceReader:
            return PageReader({k.lower(): v for k, v in self.options.items()}, parser)

    return PageFiles


def read_pages(spark: SparkSession, root: str, parse: Parser = form_feed_pages, pattern: str = "*.pdf", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A4, A5: (path, doc_id: file name, domain: folder, page_num, text, error): one row a page, and one for each broken file."""
    folder = local_path(root)
    if folder is not None:
        source = page_source(f"page_files_{getattr(parse, '__name__', 'of')}_{id(parse)}", parse)
        spark.dataSource.register(source)
        return spark.read.format(source.name()).option("pattern", pattern).option("groupBytes", group_bytes).load(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path", "content")

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from batches(pages_of(path, lambda: io.BytesIO(content.as_buffer()), parse))  # noqa: B023

    return files.mapInArrow(run, DDL)


def without_events(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, events): the pages, and (path, error) of the broken files."""
    return pages.where("error is null").drop("error"), pages.where("error is not null").select("path", "error")
