"""Sources and sinks over files: uploaded documents, request logs and model streams, each with an explicit schema."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections import deque
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from pathlib import PurePosixPath
from urllib.parse import parse_qsl, urlparse
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.operators.telemetry import latest

SUFFIXES = (".txt", ".md", ".docx", ".pdf")
DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("block_index", T.IntegerType()),
        T.StructField("block_type", T.StringType()),
        T.StructField("paragraph_index", T.IntegerType()),
        T.StructField("table_index", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("total_pages", T.IntegerType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/skarn"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def parse_text(data: bytes) -> list[dict]:
    """The whole file as one document, its line ends kept; a byte order mark goes, blank files and bad bytes are errors."""
    text = data.decode("utf-8-sig")
    if not text.strip():
        raise ValueError("the file is blank")
    return [{"text": text, "line_start": 1, "line_end": len(text.splitlines())}]


def _words(node) -> str:
    return "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else x.text or "" for x in node.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))


def parse_docx(data: bytes) -> list[dict]:
    """Paragraphs and top-level tables in body order, numbered from 1; texts and cells trimmed, cells joined by tabs and rows by line feeds.

    Blank blocks keep their numbers but give no row.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out, counts = [], {"paragraph": 0, "table": 0}
    cell_text = lambda cell: "\n".join(_words(p) for p in cell.findall(f"{_W}p")).strip()
    for k, node in enumerate((n for n in body if n.tag in (f"{_W}p", f"{_W}tbl")), 1):
        kind = "paragraph" if node.tag == f"{_W}p" else "table"
        counts[kind] += 1
        if kind == "paragraph":
            text = _words(node).strip()
        else:
            text = "\n".join("\t".join(map(cell_text, row.findall(f"{_W}tc"))) for row in node.findall(f"{_W}tr"))
        if text.strip():
            out.append({"text": text, "block_index": k, "block_type": kind, f"{kind}_index": counts[kind]})
    if not out:
        raise ValueError("the document is blank")
    return out


def parse_pdf(data: bytes) -> list[dict]:
    """Text of each page that has any, if the optional reader is installed."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    try:
        import fitz
    except ImportError as e:
        raise ValueError("reading PDF files needs the optional package pymupdf") from e
    with fitz.open(stream=data, filetype="pdf") as pdf:
        if pdf.needs_pass:
            raise ValueError("the PDF file is encrypted")
        pages = [(k, page.get_text()) for k, page in enumerate(pdf)]
    out = [{"text": t, "page": k, "page_number": k + 1, "total_pages": len(pages)} for k, t in pages if t.strip()]
    if not out:
        raise ValueError("all pages are blank")
    return out


PARSERS = {".txt": parse_text, ".md": parse_text, ".docx": parse_docx, ".pdf": parse_pdf}


def parse_file(name: str, data: bytes) -> list[dict]:
    suffix = PurePosixPath(name).suffix.lower()
    if suffix not in PARSERS:
        raise ValueError(f"unknown file type {suffix or name!r}")
    return PARSERS[suffix](data)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content, doc_id, task_id, suffix): whole files, named by the hashes of their bytes and of name and bytes."""
    name = F.regexp_extract("path", r"[^/]*$", 0)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", "length", name.alias("name"))
    task = F.sha2(F.concat(F.encode("name", "utf-8"), F.lit(b"\x00"), F.col("content")), 256)
    return raw.withColumn("doc_id", F.sha2("content", 256)).withColumn("task_id", task).withColumn("suffix", F.lower(F.regexp_extract("name", r"\.[^.]+$", 0)))


def import_tasks(files: DataFrame) -> DataFrame:
    """Each (name, bytes) once, the first by path."""
    first = files.groupBy("task_id").agg(F.min("path").alias("path"))
    return files.join(first, ["task_id", "path"], "left_semi")


def load(files: DataFrame, max_bytes: int = 20 << 20) -> DataFrame:
    """(task_id, status, error, documents): errors are data, so one bad file never ends a batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for f in pdf.itertuples():
                try:
                    if f.length > max_bytes:
                        raise ValueError("the file is too large")
                    common = {"doc_id": f.doc_id, "source": f.path, "source_file": f.name, "file_type": f.suffix.lstrip(".")}
                    docs = [{**{c: None for c in DOCUMENT.names}, **common, **d} for d in parse_file(f.name, bytes(f.content))]
                    rows.append((f.task_id, "success", None, docs))
                except Exception as e:  # noqa: BLE001 - the error is the row
                    rows.append((f.task_id, "failed", str(e) or type(e).__name__, []))
            yield pd.DataFrame(rows, columns=["task_id", "status", "error", "documents"])

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("task_id", "status", "error")] + [T.StructField("documents", T.ArrayType(DOCUMENT))])
    return files.select("task_id", "path", "name", "suffix", "doc_id", "length", "content").mapInPandas(run, schema)


def documents(loaded: DataFrame) -> DataFrame:
    return loaded.where("status = 'success'").select(F.explode("documents").alias("d")).select("d.*")


def sound_originals(stored: DataFrame) -> DataFrame:
    """(doc_id, name, copies) of stored files (folder, name, content) whose bytes still have the hash that names their folder; the first by name."""
    sound = stored.where(F.col("folder") == F.sha2("content", 256))
    return sound.groupBy(F.col("folder").alias("doc_id")).agg(F.min("name").alias("name"), F.count("*").alias("copies"))


def library_originals(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, copies) of stored originals under <path>/<64 hex digits>/<name>, verified."""
    files = scan_files(spark, path).withColumn("folder", F.regexp_extract("path", r"/([0-9a-f]{64})/[^/]+$", 1))
    return sound_originals(files.where(F.col("suffix").isin(*SUFFIXES)))


_built: dict[tuple, object] = {}


def built_once(spark: SparkSession, path: str, what: str, make: Callable[[str], object]):
    """What make(root) builds of a table, once a session and again when the table's files change; its folder goes with the session."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = files.getFileSystem(spark._jsc.hadoopConfiguration())
    state = tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in system.listStatus(files)))
    name = (spark.sparkContext.applicationId, path, what, state)
    if name not in _built:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/built-{uuid.uuid4().hex}")
        _built[name] = make(str(folder))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return _built[name]


# --- logs ------------------------------------------------------------------------------------

REQUEST = "schema_version int, request_id string, session_id string, timestamp string, status string, retrieval struct<status: string, score_model: string, score_revision: string, documents: array<struct<rank: int, text: string, score: double>>, top1_score: double>, timing struct<retrieval_seconds: double, generation_seconds: double, response_seconds: double>, tokens struct<input: long, output: long, total: long, source: string>, cache struct<hit: boolean, mode: string, similarity: double>"


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(last snapshot of each request, one row with the number of invalid lines). Files are ordered by name, lines by place."""
    lines = spark.read.text(path, lineSep="\n").where(F.col("value").rlike(r"\S")).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    parsed = lines.withColumn("r", F.from_json("value", REQUEST))
    valid = (F.col("r.schema_version") == 1) & F.col("r.request_id").isNotNull() & F.col("r.retrieval.status").isNotNull() & F.col("r.retrieval.score_model").isNotNull() & F.col("r.retrieval.score_revision").isNotNull()
    valid = F.coalesce(valid, F.lit(False))
    rows = parsed.where(valid).select("r.*", "file", "block", "line")
    return latest(rows, "request_id", ["file", "block", "line"]).drop("file", "block", "line"), parsed.agg(F.count_if(~valid).alias("invalid_lines"))


def append_requests(rows: DataFrame, path: str) -> None:
    """Appends snapshots as JSON lines, partitioned by the day of their timestamp."""
    rows.withColumn("day", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("day").json(path)


def fold_stream(lines: list[str]) -> dict:
    """A model's NDJSON stream: the text so far, whether it ended properly, and usage; text before an error is kept."""
    import json

    text, done, usage, error = "", None, {}, None
    for line in lines:
        if not line.strip():
            continue
        try:
            row = json.loads(line)
            text += row["message"]["content"]
            if row.get("done") is True:
                done, usage = row.get("done_reason"), {k: row.get(k) for k in ("prompt_eval_count", "eval_count")}
                break
        except (ValueError, KeyError, TypeError) as e:
            error = f"bad stream line: {e}"
            break
    if done is None and error is None:
        error = "the stream ended early"
    return {"text": text, "done_reason": done, "usage": usage, "error": error}


# The class names of the search site's result pages.
RESULT, LINK, SNIPPET, NO_RESULTS, CHALLENGES = "result", "result__a", "result__snippet", "no-results", ("challenge-form", "anomaly-modal")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style"}


class TagTree(HTMLParser):
    """The tags of a page as a tree: each node its tag, attributes, children and texts in order. Tags left open end with their parent."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = {"tag": "", "attrs": {}, "parts": []}
        self._open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "parts": []}
        self._open[-1]["parts"].append(node)
        if tag not in _VOID:
            self._open.append(node)

    def handle_startendtag(self, tag, attrs):
        self._open[-1]["parts"].append({"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "parts": []})

    def handle_endtag(self, tag):
        depth = max((k for k, n in enumerate(self._open) if k and n["tag"] == tag), default=0)
        if depth:
            del self._open[depth:]

    def handle_data(self, data):
        self._open[-1]["parts"].append(data)


def nodes(tree: dict, holds: Callable[[dict], bool], within: bool = True):
    """Nodes below tree for which holds is true, in order; with within also those inside another such node."""
    waiting = deque(p for p in tree["parts"] if isinstance(p, dict))
    while waiting:
        node = waiting.popleft()
        found = holds(node)
        if found:
            yield node
        if within or not found:
            waiting.extendleft(p for p in reversed(node["parts"]) if isinstance(p, dict))


def node_text(tree: dict) -> str:
    out, waiting = [], [tree]
    while waiting:
        part = waiting.pop()
        if isinstance(part, str):
            out.append(part)
        elif part["tag"] not in _SILENT:
            waiting.extend(reversed(part["parts"]))
    return re.sub(r"\s+", " ", " ".join(out)).strip()


def marked(node: dict, *names: str) -> bool:
    return bool({*node["attrs"].get("class", "").split(), node["attrs"].get("id", "")}.intersection(names))


def web_results(html: str, most: int = 5) -> list[dict]:
    """(title, snippet, url) of a result page: links with a host, redirects unwrapped. A page that is no result page is an error."""
    tree = TagTree(html).root
    if next(nodes(tree, lambda n: marked(n, *CHALLENGES)), None):
        raise ValueError("the search site asks for a verification")
    first = lambda block, name: next(nodes(block, lambda n: marked(n, name)), None)
    out = []
    for block in nodes(tree, lambda n: marked(n, RESULT), within=False):
        link, snippet = first(block, LINK), first(block, SNIPPET)
        url = target(link["attrs"].get("href", "")) if link else None
        if url:
            out.append({"title": node_text(link), "snippet": node_text(snippet) if snippet else "", "url": url})
    if not out and not next(nodes(tree, lambda n: marked(n, NO_RESULTS)), None):
        raise ValueError("the response is not a result page")
    return out[:most]


def target(href: str) -> str | None:
    """Where a link leads, past the site's redirect; None where that is no web address with a host."""
    url = dict(parse_qsl(urlparse(href).query)).get("uddg", href)
    parts = urlparse(url)
    return url if parts.scheme in ("http", "https") and parts.hostname else None


PAGE = "title string, links array<struct<href: string, text: string>>, text string"


#: An ampersand that no reference with a semicolon begins with, such as one cut at a title's end.
_UNENDED = re.compile(r"&(?!(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")


def parsed_pages(pages: DataFrame, ended: bool = False) -> DataFrame:
    """pages (html, any others) with title, links and visible text of each page, by its tag tree, instead of html.

    As browsers do, old names of entities count without their semicolon, too; with ended they stay as they are written.
    """

    def run(batches):
        for b in batches:
            found = []
            for html in b.column("html").to_pylist():
                html = html or ""
                tree = TagTree(_UNENDED.sub("&amp;", html) if ended else html).root
                title = next(nodes(tree, lambda n: n["tag"] == "title"), None)
                links = [{"href": n["attrs"]["href"], "text": node_text(n)} for n in nodes(tree, lambda n: n["tag"] == "a" and "href" in n["attrs"])]
                body = next(nodes(tree, lambda n: n["tag"] == "body"), tree)
                found.append({"title": node_text(title) if title else None, "links": links, "text": node_text(body)})
            extra = pa.RecordBatch.from_pylist(found, kinds)
            rest = b.drop_columns(["html"])
            yield pa.RecordBatch.from_arrays([*rest.columns, *extra.columns], [*rest.schema.names, *extra.schema.names])

    link = pa.struct([("href", pa.string()), ("text", pa.string())])
    kinds = pa.schema([("title", pa.string()), ("links", pa.list_(link)), ("text", pa.string())])
    pages = pages.drop("title", "links", "text")
    return pages.mapInArrow(run, T.StructType([*(f for f in pages.schema if f.name != "html"), *T.StructType.fromDDL(PAGE)]))


def html_text(html: str) -> str:
    """Visible text of a page: without head, scripts and styles, entities decoded."""
    body = re.sub(r"(?is)<(script|style|head)\b.*?</\1>", " ", html)
    return re.sub(r"\s+", " ", unescape(re.sub(r"(?s)<[^>]+>", " ", body))).strip()
