"""Python data sources: JSON-lines logs that grow while they are read, and PDF pages in ranges.

    register(spark)
    spark.readStream.format("skarn_lines").load("hdfs://.../logs")
    spark.read.format("skarn_pages").option("range", 50).load("s3://.../papers")
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from skarn.operators import layout

#: Bytes of a log that one task reads; bytes looked at together for the last line end.
SPLIT, TAIL = 64 << 20, 1 << 16


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path in its store, size) of the files below path, or of path itself."""
    store, root = _store(path)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith(("_", ".")))


@dataclass
class Span(InputPartition):
    """Bytes of a file: lines that begin from start on and before stop; first is where reading of the file began."""

    file: str
    first: int
    start: int
    stop: int


class _Lines:
    """What batch and stream share: where whole lines end, how spans are planned, and how one is read."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def ends(self) -> dict[str, int]:
        """Of each file, the place behind its last line end. What comes behind is a line that is still being written."""
        store, _ = _store(self.path)
        return {name: self._end(store, name, size) for name, size in _files(self.path, self.suffix)}

    @staticmethod
    def _end(store: fs.FileSystem, name: str, size: int) -> int:
        with store.open_input_file(name) as f:
            hi = size
            while hi:
                lo = max(0, hi - TAIL)
                f.seek(lo)
                if (at := f.read(hi - lo).rfind(b"\n")) >= 0:
                    return lo + at + 1
                hi = lo
        return 0

    def spans(self, start: dict[str, int], stop: dict[str, int]) -> list[Span]:
        out = []
        for name, end in sorted(stop.items()):
            first = start.get(name, 0)
            out += [Span(name, first, at, min(at + SPLIT, end)) for at in range(first, end, SPLIT)]
        return out

    def rows(self, span: Span) -> Iterator[tuple]:
        store, _ = _store(self.path)
        with store.open_input_file(span.file) as raw:
            at = span.start
            raw.seek(max(span.first, at - 1))
            buffered = _Reader(raw)
            if at > span.first and buffered.read_byte() != b"\n":  # this line began in the span before
                at += len(buffered.line())
            while at < span.stop:
                line = buffered.line()
                if not line.endswith(b"\n"):
                    break
                yield (span.file, at, line.rstrip(b"\r\n").decode("utf-8", "replace"))
                at += len(line)


class _Reader:
    """Lines of a stream, read TAIL bytes at a time."""

    def __init__(self, raw):
        self.raw, self.held, self.at = raw, b"", 0

    def read_byte(self) -> bytes:
        if self.at >= len(self.held):
            self.held, self.at = self.raw.read(TAIL), 0
        self.at += 1
        return self.held[self.at - 1 : self.at]

    def line(self) -> bytes:
        parts = []
        while True:
            if self.at >= len(self.held):
                self.held, self.at = self.raw.read(TAIL), 0
                if not self.held:
                    return b"".join(parts)
            end = self.held.find(b"\n", self.at)
            parts.append(self.held[self.at : end + 1 if end >= 0 else len(self.held)])
            self.at = end + 1 if end >= 0 else len(self.held)
            if end >= 0:
                return b"".join(parts)


class _LinesBatch(DataSourceReader):
    def __init__(self, lines: _Lines):
        self.lines = lines

    def partitions(self) -> list[Span]:
        return self.lines.spans({}, self.lines.ends())

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.lines.rows(partition)


class _LinesStream(DataSourceStreamReader):
    """The position that a query commits is the number of bytes taken from each file, so nothing is lost or read twice."""

    def __init__(self, lines: _Lines):
        self.lines = lines

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.lines.ends()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.lines.spans(start, end)

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.lines.rows(partition)


class Lines(DataSource):
    """Whole lines of the files below a path, with file and place in bytes; options: path, suffix (.jsonl)."""

    @classmethod
    def name(cls) -> str:
        return "skarn_lines"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def _lines(self) -> _Lines:
        return _Lines(self.options["path"], self.options.get("suffix", ".jsonl"))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _LinesBatch(self._lines())

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _LinesStream(self._lines())


# --- pages -----------------------------------------------------------------------------------


def open_pdf(data: bytes):
    """Pages of a PDF as functions: count, size(k), items(k). The reader is an optional package."""
    import fitz

    pdf = fitz.open(stream=data, filetype="pdf")

    class Pages:
        count = pdf.page_count

        @staticmethod
        def size(k: int) -> tuple[float, float]:
            box = pdf[k].cropbox
            return box.width, box.height

        @staticmethod
        def items(k: int) -> Iterator[tuple[str, float, float, float, float, str | None]]:
            for block in pdf[k].get_text("dict")["blocks"]:
                for line in block.get("lines", ()):
                    yield ("line", *line["bbox"], "".join(s["text"] for s in line["spans"]))
            for x0, y0, x1, y1, word, *_ in pdf[k].get_text("words"):
                yield ("word", x0, y0, x1, y1, word)
            for drawing in pdf[k].get_drawings():
                yield ("rule", *drawing["rect"], None)

    return Pages


@dataclass
class PageRange(InputPartition):
    file: str
    first: int
    stop: int


class _PagesReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, size: int, opener: str):
        self.path, self.suffix, self.size, self.opener = path, suffix, size, opener

    def _open(self, name: str):
        module, _, function = self.opener.partition(":")
        store, _ = _store(self.path)
        with store.open_input_stream(name) as f:
            return getattr(importlib.import_module(module), function)(f.read())

    def partitions(self) -> list[PageRange]:
        """A range of pages a task, so that one long file is read by many."""
        return [PageRange(name, k, min(k + self.size, n)) for name, _ in _files(self.path, self.suffix) for n in [self._open(name).count] for k in range(0, n, self.size)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        pages = self._open(partition.file)
        for k in range(partition.first, partition.stop):
            width, height = pages.size(k)
            for n, (kind, x0, y0, x1, y1, text) in enumerate(pages.items(k)):
                yield (partition.file, k + 1, n, kind, float(x0), float(y0), float(x1), float(y1), float(width), float(height), text)


class Pages(DataSource):
    """Lines, words and rules of pages with their boxes; options: path, suffix (.pdf), range (pages a task), opener (module:function)."""

    @classmethod
    def name(cls) -> str:
        return "skarn_pages"

    def schema(self) -> str:
        return "doc_id string, page int, n int, kind string, x0 double, y0 double, x1 double, y1 double, width double, height double, text string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        o = self.options
        return _PagesReader(o["path"], o.get("suffix", ".pdf"), int(o.get("range", 50)), o.get("opener", "skarn.sources.readers:open_pdf"))


def register(spark: SparkSession) -> None:
    for source in (Lines, Pages):
        spark.dataSource.register(source)


def page_documents(items: DataFrame) -> DataFrame:
    """Rows of skarn_pages to documents: text in reading order a page, and three-rule tables, whole over pages."""
    by, box = ["doc_id", "page"], ["x0", "x1", "top", "bottom"]
    of = lambda kind: items.where(F.col("kind") == kind)
    lines = of("line").drop("kind")
    captions = lines.where(F.col("text").rlike(layout.CAPTION)).select(*by, F.col("n").alias("caption_id"), "x0", "x1", F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    words = of("word").select(*by, "x0", "x1", F.col("y0").alias("top"), F.col("y1").alias("y"), F.col("text").alias("word"))
    tables = layout.rule_tables(of("rule"), captions, words, by=by)
    edges = layout.placed_words(tables, words, by).groupBy(*by, "caption_id", "col").agg(F.min("x0").alias("left"), F.max("x1").alias("right"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("col", c))), lambda x: x[c])
    edges = edges.groupBy(*by, "caption_id").agg(ordered("left").alias("lefts"), ordered("right").alias("rights"))
    cells = layout.rule_cells(tables, words, by).groupBy(*by, "caption_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col").alias("at"), "text"))).alias("cells"), F.max("row").alias("last"))
    shape = cells.join(edges, [*by, "caption_id"])
    at = lambda r, c: F.coalesce(F.filter(F.map_entries("cells"), lambda e: (e["key"]["row"] == r) & (e["key"]["col"] == c))[0]["value"], F.lit(""))
    rows = F.transform(F.sequence(F.lit(0), F.col("last").cast("int")), lambda r: F.transform(F.sequence(F.lit(0), F.size("lefts") - 1), lambda c: at(r, c)))
    height = items.groupBy(*by).agg(F.max("height").alias("height"))
    whole = tables.join(shape, [*by, "caption_id"]).join(height, by).select(*by, F.col("caption_id").alias("n"), *box, "height", "lefts", "rights", F.to_json(rows).alias("rows"))
    return layout.documents(lines.select(*by, "n", "x0", "y0", "x1", "y1", "width", "text"), whole)


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """file, offset and the fields of each line; a line that is no JSON has nulls and invalid = true."""
    r = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    names = T.StructType.fromDDL(schema).names
    return lines.withColumn("r", r).select("file", "offset", *(F.col(f"r.{c}").alias(c) for c in names), F.col("r._corrupt").isNotNull().alias("invalid"))


def append_lines(path: str, rows: list[dict]) -> None:
    """Appends to a local log. Rows are made to text before the file is opened; a line that a crash left torn is ended first."""
    text = "".join(json.dumps(r, ensure_ascii=False, allow_nan=False) + "\n" for r in rows)
    with open(path, "ab+") as f:
        if f.seek(0, 2):
            f.seek(-1, 2)
            text = text if f.read(1) == b"\n" else "\n" + text
        f.write(text.encode())
