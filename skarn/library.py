"""A library of documents: import, index, status, search, delete. Everything is kept in one folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.config import Settings
from skarn.functions.models import Encoder, HashEncoder, encoded
from skarn.functions.text import expanded, is_placeholder, stripped_request, tokens
from skarn.operators import aliases, evidence, index, ivf, retrieve, segments
from skarn.operators.chunking import chunks
from skarn.sources import files
from skarn.tables import Table

CHUNK = "chunk_id string, doc_id string, source_file string, file_type string, block_type string, page_number int, paragraph_index int, table_index int, line_start int, line_end int, chunk_index int, start_index int, end_index int, text string, embedding array<float>"
ORIGINAL = "doc_id string, source_file string, content binary"
#: The columns that chunks of one piece of a document share.
PARENT = ["doc_id", "source_file", "file_type", "block_type", "page_number", "paragraph_index", "table_index"]
#: The fingerprint of the chunks, the version of their table that it is of, and whether a write has begun since.
PRINT = "low string, middle string, high string, n long, version long, begun boolean"
MANIFEST = "doc_id string, source_file string, status string, error string, expected long, complete boolean"


def _stamp(state: dict) -> str:
    return "|".join(str(state[c]) for c in ("low", "middle", "high", "n"))


class Library:
    """Chunks with vectors and a manifest of imports. The encoder's name and revision are checked whenever it is opened."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), make_encoder: Callable[[], Encoder] = HashEncoder):
        encoder = make_encoder()
        self.spark, self.settings, self._make = spark, settings, make_encoder
        self._encoder, self._root = encoder, root
        self.chunks = Table(spark, f"{root}/chunks", CHUNK, {"model": encoder.name, "revision": encoder.revision, "width": encoder.width, "space": "cosine"})
        self.manifest = Table(spark, f"{root}/manifest", MANIFEST)
        self.originals = Table(spark, f"{root}/originals", ORIGINAL)
        self.vectors = Table(spark, f"{root}/vectors", "root string")
        self.prints = Table(spark, f"{root}/prints", PRINT)
        self.words = segments.Segments(spark, f"{root}/lexical", "chunk_id")

    # --- import --------------------------------------------------------------------------------

    def load(self, path: str, retry_failed: bool = False) -> DataFrame:
        """Imports files below path: parse, chunk, encode what is new, append, audit. Returns the manifest rows of this load.

        Files already complete are left alone, and failed ones too unless they are to be tried again.
        """
        raw = files.scan_files(self.spark, path)
        held = self.manifest.read()
        done = held.where("complete" if retry_failed else "complete or status = 'failed'").select("doc_id")
        tasks = files.import_tasks(raw.join(done, "doc_id", "left_anti"))
        loaded = files.load(tasks, self.settings.max_file_mb << 20).join(tasks.select("task_id", "doc_id", F.col("name").alias("source_file")), "task_id")
        s = self.settings
        parent = F.sha2(F.concat_ws("\x00", "doc_id", F.coalesce(F.col("page_number").cast("string"), F.lit("")), F.coalesce(F.col("block_index").cast("string"), F.lit("")), "text"), 256)
        cut = chunks(files.documents(loaded), s.chunk_strategy, s.chunk_size, s.chunk_overlap, parent).dropDuplicates(["chunk_id"])
        # Only what the store lacks is encoded.
        new = cut.join(self.chunks.read().select("chunk_id"), "chunk_id", "left_anti").withColumn("embedding", encoded(F.col("text"), self._make))
        expected = cut.groupBy("doc_id").agg(F.count("*").alias("expected"))
        rows = loaded.join(expected, "doc_id", "left").select("doc_id", "source_file", "status", "error", F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.lit(False).alias("complete")).dropDuplicates(["doc_id"])
        # Kept before the chunks change what is new; a load that stops here is found incomplete and resumed.
        self.manifest.rewrite(held.join(rows.select("doc_id"), "doc_id", "left_anti").unionByName(rows))
        good = tasks.join(loaded.where("status = 'success'").select("task_id"), "task_id", "left_semi")
        kept = good.select("doc_id", F.col("name").alias("source_file"), "content")
        self.originals.append(kept.join(self.originals.read().select("doc_id", "source_file"), ["doc_id", "source_file"], "left_anti"))
        new = new.persist()  # encoded once, for the store and both indexes
        before = self.fingerprint()
        after = index.combined(before, self._print_of(new))
        self._note(before, begun=True)
        if self._covered(before):  # else the next search brings the index up to date
            self.words.add(index.bags(new, normalize=True), _stamp(after))
        if vectors := self.vector_index():
            vectors.add(new)
        self.chunks.append(new)
        self._note(after)
        new.unpersist()
        return self.audit().join(tasks.select("doc_id").distinct(), "doc_id", "left_semi")

    def audit(self) -> DataFrame:
        """Marks documents whose chunks are all there as complete."""
        n = self.chunks.read().groupBy("doc_id").agg(F.count("*").alias("n"))
        m = self.manifest.read().join(n, "doc_id", "left")
        self.manifest.rewrite(m.withColumn("complete", (F.col("status") == "success") & (F.coalesce("n", F.lit(0)) == F.col("expected"))))
        return self.manifest.read()

    def delete(self, doc_id: str) -> int:
        """Removes a document's chunks, then its stored original and manifest row; the number of chunks that went."""
        gone, before = self.list_chunks(doc_id), self.fingerprint()
        after = index.combined(before, lost := self._print_of(gone), -1)
        removed = lost["n"]
        self._note(before, begun=True)
        if self._covered(before):
            self.words.delete(index.bags(gone, normalize=True), _stamp(after))
        if vectors := self.vector_index():
            vectors.delete(gone)
        self.chunks.rewrite(self.chunks.read().where(F.col("doc_id") != doc_id))
        self._note(after)
        self.originals.rewrite(self.originals.read().where(F.col("doc_id") != doc_id))
        self.manifest.rewrite(self.manifest.read().where(F.col("doc_id") != doc_id))
        return removed

    # --- scans ---------------------------------------------------------------------------------

    def list_chunks(self, doc_id: str | None = None) -> DataFrame:
        rows = self.chunks.read()
        return rows if doc_id is None else rows.where(F.col("doc_id") == doc_id)

    def count(self) -> int:
        return self.chunks.read().count()

    def stored(self, question: str | None = None) -> DataFrame:
        """(doc_id, name, copies) of stored originals whose bytes still have the hash that names them; of those a question may name, if one is given."""
        held = self.originals.read()
        if question is not None:
            held = held.where(aliases.may_name(question, F.col("source_file")))
        return files.sound_originals(held.select(F.col("doc_id").alias("folder"), F.col("source_file").alias("name"), "content"))

    def original(self, doc_id: str) -> tuple[str, list[dict]]:
        """Name and parsed pieces of a stored original; its bytes are verified. One file, of at most max_file_mb."""
        if not re.fullmatch("[0-9a-f]{64}", doc_id):
            raise ValueError("a document's id has 64 hex digits")
        held = self.originals.read().where((F.col("doc_id") == doc_id) & (F.sha2("content", 256) == doc_id))
        first = held.orderBy("source_file").limit(1).collect()
        if not first:
            raise ValueError("no sound original with that id is stored")
        return first[0]["source_file"], files.parse_file(first[0]["source_file"], bytes(first[0]["content"]))

    def _print_of(self, rows: DataFrame) -> dict:
        return index.corpus_fingerprint(rows.select(F.sha2("chunk_id", 256).alias("h"))).first().asDict()

    def _note(self, state: dict, begun: bool = False) -> None:
        row = (state["low"], state["middle"], state["high"], state["n"], self.chunks.version, begun)
        self.prints.rewrite(self.spark.createDataFrame([row], PRINT).coalesce(1))

    def _covered(self, state: dict) -> bool:
        """Whether the lexical index is that of the chunks in this state."""
        stamp = self.words.stamp()
        return stamp == _stamp(state) or stamp is None and not state["n"]

    def fingerprint(self) -> dict:
        """The multiset hash of the chunks. Loads and deletes add to it and subtract from it, so no chunk is read.

        It is counted again only where it can't be trusted: a write began and didn't end, or the table was rewritten by others.
        """
        held = self.prints.read().first()
        if held is None or held["begun"] or held["version"] != self.chunks.version:
            self._note(index.combined(self._print_of(self.chunks.read()), {"low": "", "middle": "", "high": "", "n": 0}))
            held = self.prints.read().first()
        return {c: held[c] for c in ("low", "middle", "high", "n")}

    def scope(self) -> str:
        """What an answer depends on beside its question: the chunks, the encoder and the settings."""
        return "|".join(map(str, [_stamp(self.fingerprint()), self._encoder.name, self._encoder.revision, self.settings]))

    def status(self) -> DataFrame:
        """(doc_id, chunks, expected, complete, status) of every document known."""
        m = self.manifest.read().where("status = 'success'")
        n = self.chunks.read().groupBy("doc_id").agg(F.count("*").alias("chunks"))
        return index.library_status(n, self.stored().select("doc_id"), m.select("doc_id", "expected", F.lit(True).alias("complete"), F.lit(True).alias("readable")))

    def resolve(self, prefix: str) -> str:
        """The one document whose id starts with prefix (8 hex digits or more)."""
        found = self.manifest.read().where(F.col("doc_id").startswith(prefix)).select("doc_id").distinct().limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{prefix} names {'no' if not found else 'more than one'} document")
        return found[0][0]

    def health(self) -> dict:
        """Whether both tables can be read, and what they hold."""
        return {"chunks": self.count(), "documents": self.manifest.read().count(), "model": self._encoder.name, "version": self.chunks.version}

    # --- search --------------------------------------------------------------------------------

    def _question(self, question: str, k: int) -> DataFrame:
        if type(k) is not int or k <= 0:
            raise ValueError("k must be a positive integer")
        q = self.spark.createDataFrame([(0, question)], "query_id long, question string")
        return q.select("query_id", expanded(stripped_request(F.col("question"))).alias("question"))

    def lexicon(self) -> segments.Live:
        """The lexical index of the chunks as they are now. Loads add segments and deletes tombstones; what was missed is made up for here."""
        state = _stamp(self.fingerprint())
        if self.words.stamp() != state:
            self.words.sync(index.bags(self.chunks.read(), normalize=True), state)
        return self.words.live()

    def _lexical(self, question: str, k: int, doc_id: str | None) -> DataFrame:
        words = self.lexicon()
        scores = words.scores(words.asked(self._question(question, k).withColumnRenamed("question", "text"), normalize=True))
        if doc_id is not None:  # statistics cover the corpus, candidates one document
            scores = scores.join(self.list_chunks(doc_id).select("chunk_id"), "chunk_id", "left_semi")
        return scores

    def _similar(self, question: str, k: int, doc_id: str | None) -> DataFrame:
        """At least the k most similar chunks: of one document by all of its vectors, of the library by its index, if it has one."""
        v = self._encoder.encode([self._question(question, k).first()["question"]])[0]
        q = self.spark.createDataFrame([(0, v)], "query_id long, query array<float>")
        if doc_id is None and (index := self.vector_index()):
            return index.nearest(q, k).drop("rank")
        return retrieve.nearest(self.list_chunks(doc_id), q, k, "chunk_id")

    def bm25(self, question: str, k: int = 5, doc_id: str | None = None) -> DataFrame:
        return retrieve.top(self._lexical(question, k, doc_id), k, "query_id", F.desc("score"), F.col("chunk_id"))

    def vector(self, question: str, k: int = 5, doc_id: str | None = None) -> DataFrame:
        return retrieve.top(self._similar(question, k, doc_id), k, "query_id", F.desc("score"), F.col("chunk_id"))

    def index_vectors(self, cells: int | None = None) -> ivf.VectorIndex:
        """Builds the vector index anew; searches of the whole library then read the cells near a question alone, and loads add to it."""
        root = f"{self._root}/vectors-{uuid.uuid4().hex}"
        ivf.build(self.chunks.read(), root, "chunk_id", cells)
        self.vectors.rewrite(self.spark.createDataFrame([(root,)], "root string"))
        return self.vector_index()

    def vector_index(self) -> ivf.VectorIndex | None:
        held = self.vectors.read().collect()
        return ivf.VectorIndex(self.spark, held[0]["root"], "chunk_id", "string") if held else None

    def hybrid(self, question: str, k: int = 5, doc_id: str | None = None, rerank: bool = False) -> DataFrame:
        """Both branches, fused, without image placeholders; reranked by the stand-in if asked. Columns of the chunk and score, rank.

        Where placeholders leave too few of the candidates, twice and four times as many of both branches are fused.
        """
        n = max(self.settings.candidates, k)
        texts = self.chunks.read().drop("embedding").where(~is_placeholder(F.col("text")))
        fused = retrieve.hybrid(self._lexical(question, 4 * n, doc_id), self._similar(question, 4 * n, doc_id), texts, n, n if rerank else k, rrf_k=self.settings.rrf_k)
        best = fused.join(texts, "chunk_id")
        if not rerank:
            return best
        q = F.broadcast(self._question(question, k).select(tokens(F.col("question"), True).alias("q")))
        scored = best.withColumnRenamed("rank", "fused").join(q).withColumn("score", retrieve.overlap_score(F.col("q"), tokens(F.col("text"), True))).drop("q")
        return retrieve.top(scored, k, "query_id", F.desc("score"), F.col("fused"))

    def expanded(self, found: DataFrame, question: str) -> tuple[list[dict], bool]:
        """The rows of found with their texts joined by the neighbours that touch them, scored again, and whether that changed any."""
        ids = [r[0] for r in found.select("doc_id").distinct().collect()]
        near = evidence.stitched(self.chunks.read().where(F.col("doc_id").isin(ids)).drop("embedding"), PARENT)
        q = F.broadcast(self._question(question, 1).select(tokens(F.col("question"), True).alias("q")))
        both = found.select("chunk_id", "score", "rank").join(near, "chunk_id").join(q)
        both = both.withColumn("again", retrieve.overlap_score(F.col("q"), tokens(F.col("text"), True))).drop("q")
        rows = [r.asDict() for r in both.orderBy("rank").collect()]
        changed = any(r["own_text"] != r["text"] for r in rows)
        for r in rows:
            r["score"] = r.pop("again") if changed else r["score"]
        return rows, changed
