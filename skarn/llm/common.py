"""Shared pieces: the shared folder, byte-level word tables and 64-bit hashes in numpy.

Everything here works on whole texts as UTF-8 bytes; a null text counts as empty.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes hashed at a time; keeps the working arrays of a task at some 30 MB.
BLOCK = 1 << 18
BATCH_BYTES = 2 << 20

_rng = np.random.default_rng(20240601)
#: One random 64-bit value for each byte, and an odd base for the polynomial hash.
BYTE_HASH = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
SHINGLE_WEIGHTS = _rng.integers(1, 1 << 63, 8, dtype=np.int64).astype(U64) * U64(2) + U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Tab, line feed, vertical tab, form feed, carriage return and space part words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/skarn"


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    What a result still reads stays until the driver ends and goes then; other tables can be dropped sooner.
    """

    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        files, path = self._files()
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _files(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def write(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(self._CLEANUP, "false")
        self.spark.conf.set(self._CLEANUP, "true")  # the shuffle files behind the table go with the job that wrote it
        try:
            df.write.mode("overwrite").parquet(path := f"{self.root}/{name}")
        finally:
            self.spark.conf.set(self._CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Frees tables that nothing reads any more."""
        for name in names:
            files, path = self._files(name)
            files.delete(path, True)


def spare(docs: DataFrame, name: str) -> str:
    """A column name like `name` that docs does not use."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Lets the session hand whole texts to Python 2 MB at a time, where it would take more: two workers an executor then stay within a few hundred MB."""
    if int(re.sub(r"\D", "", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(step: Callable) -> Callable:
    """A step over Arrow batches behind which the worker gives back what it has freed; else it keeps, while it waits and in
    every later task, what its largest task took."""

    @wraps(step)
    def run(batches, *args, **kwargs):
        try:
            yield from step(batches, *args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return run


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def binary_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array and the n + 1 offsets of its values, without copying."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    kind = np.int64 if pa.types.is_large_binary(arr.type) else np.int32
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about size bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(29)
    h *= U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(BLOCK, n)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"]


def word_spans(data: np.ndarray, offsets: np.ndarray, part: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes that do not part words, within one text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~part[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending, non-overlapping spans."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = powers(hi - lo)
        prefix = np.zeros(hi - lo + 1, U64)
        np.cumsum(BYTE_HASH[data[lo:hi]] * up, out=prefix[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(U64))
        i = j
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    k, n = min(k, len(words)), len(words) - min(k, len(words)) + 1
    out = np.full(n, k, U64)
    for j in range(k):
        out += words[j : j + n] * SHINGLE_WEIGHTS[j]
        out ^= out >> U64(31)
    return mix(out)


def packer():
    return zstandard.ZstdCompressor(level=1)


@lean
def compressed(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns keep and the bytes of column text, compressed, as column z."""
    z = packer()
    for b in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
        texts = [z.compress(x) for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(texts, pa.binary())], [*keep, "z"])


def packed_texts(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of rows, and their bytes of text compressed before they travel, as z; about 0.4 of their bytes."""
    kinds = T.StructType([*(rows.schema[c] for c in keep), T.StructField("z", T.BinaryType())])
    return rows.select(*keep, "text").mapInArrow(lambda it: compressed(it, keep), kinds)


def salted_join(rows: DataFrame, side: DataFrame, keys: list[str], total: int, least: int = 256, salts: int = 64) -> DataFrame:
    """rows joined with side on keys; side holds each key once, and as c how many of the rows have it.

    Rows of keys with more than one in 4096 of all rows (total) are dealt over `salts` tasks and the key's row of side goes to
    each; there are fewer than 4096 such keys, so that broadcasting them is safe.
    """
    most, hot, salt = max(least, total // 4096), "is hot", "salt of rows"
    keyed = rows.join(F.broadcast(side.where(F.col("c") > most).select(*keys, F.lit(True).alias(hot))), keys, "left")
    dealt = F.when(F.col(hot), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(0)
    keyed = keyed.withColumn(salt, dealt).drop(hot)
    every = F.when(F.col("c") > most, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return keyed.join(side.withColumn(salt, F.explode(every)), [*keys, salt]).drop(salt)
