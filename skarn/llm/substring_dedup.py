"""Exact substring dedup: a depth-limited radix sort of suffixes, by most significant digits.

Finds every byte covered by a string of `depth` bytes that also starts elsewhere in the
table, the same document included. Suffixes are ordered only as far as they must be, each
pass by one digit; a suffix that is alone with its digits leaves, and those still together
at full depth are exactly the repeated windows:

1. Digit one is the DIGIT-byte string at a suffix's anchor: the least-hashed DIGIT-byte
   string inside its first `depth` bytes. Equal windows have equal anchors at equal offsets,
   so neighbouring suffixes that share an anchor (a run) move as one row.
2. Digit two is the whole run: runs equal in all their bytes repeat in all their windows.
3. Runs that share digit one but not digit two are cut by their anchor's offset into strips
   of STRIP suffixes, one representative for each distinct run. Equal strips repeat in all
   their windows; a strip leaves if the bytes that all its windows hold are found nowhere else.
4. What is left of the strips gives a digit of full depth for each window.

A departure from the plain sort by position: there, pass one would move a row for each byte of the corpus, some 30 times its
size; with digits taken at anchors a row stands for some 40 suffixes, and the groups at full depth are the same.

Digits are compared by 64-bit hashes, always within one bucket of the digit before, so by 128 bits: two different
windows among 2**40 are taken for equal with a chance below 2**-48. Rows are aggregated before they are shuffled, no bucket
is gathered in a task and the rows of frequent digits are dealt over many tasks, so a string that a third of all rows
hold costs no more than others.

Texts are written once, compressed and numbered; the number tells rows apart, whatever their ids and texts.

Defined results: null or empty texts have 0 bytes and nothing removed; texts shorter than
`depth` keep all bytes; rows that repeat a doc_id are separate texts; a null doc_id is kept;
extra columns stay in `row`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.llm.common import BYTE_HASH, U64, Scratch, binary_buffer, doc_blocks, lean, mix, packer, salted_join, small_batches, text_bytes

DEPTH = 200
DIGIT = 32
#: A run has at most depth - DIGIT + 1 suffixes, in strips of so many.
STRIP = 43
#: Suffixes of one text that are worked on together.
_CHUNK = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15
_POSITION = U64((1 << 24) - 1)


def _digit_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all DIGIT-byte strings, by doubling."""
    h, power = BYTE_HASH[data], _MULTIPLIER
    step = 1
    while step < DIGIT:
        h = h[:-step] * U64(power) + h[step:]
        power = power * power % (1 << 64)
        step *= 2
    return mix(h)


def runs(data: np.ndarray, offsets: np.ndarray, depth: int):
    """(text, first suffix, number of suffixes, offset of the anchor in the first, digit one) of each run."""
    n = len(data) - depth + 1
    if n <= 0:
        return None
    digits = _digit_hashes(data)
    key = (digits & ~_POSITION) | np.arange(len(digits), dtype=U64)
    width, span = 1, depth - DIGIT + 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    anchor = (key[:n] & _POSITION).astype(np.int64)
    ok = np.zeros(n + 1, np.int8)
    last = np.minimum(offsets[1:] - depth + 1, n)
    has = last > offsets[:-1]
    np.add.at(ok, offsets[:-1][has], 1)
    np.add.at(ok, last[has], -1)
    at = np.flatnonzero(np.cumsum(ok[:n], dtype=np.int8) > 0)
    if not len(at):
        return None
    a = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
    firsts = np.flatnonzero(new)
    start = at[firsts]
    count = np.diff(np.append(firsts, len(at)))
    text = np.searchsorted(offsets, start, "right") - 1
    return text, start, count, a[firsts] - start, digits[a[firsts]]


def _chunks(data: np.ndarray, offsets: np.ndarray, depth: int):
    """Pieces of the buffer as (first text, bytes, offsets, shift): short texts together, long ones in overlapping parts."""
    for i, j in doc_blocks(offsets, _CHUNK):
        lo, hi = int(offsets[i]), int(offsets[j])
        for at in range(lo, max(lo + 1, hi - depth + 1), _CHUNK) if j == i + 1 else [lo]:
            end = min(hi, at + _CHUNK + depth - 1) if j == i + 1 else hi
            yield i, data[at:end], (offsets[i : j + 1] - lo if j > i + 1 else np.array([0, end - at])), at - lo


def _pack(at: np.ndarray, offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First suffix, offset of its anchor and number of suffixes of a run, as one number."""
    return at.astype(np.int64) << 20 | offset.astype(np.int64) << 10 | count.astype(np.int64)


def _unpacked(p: int) -> tuple[int, int, int]:
    return p >> 20, p >> 10 & 1023, p & 1023


def _texts(batches):
    """A few texts at a time: the batch's other columns, and the texts' bytes as one binary array."""
    unpack = zstandard.ZstdDecompressor().decompress
    for b in _slices(batches):
        yield b, pa.array([unpack(z) for z in b.column("z").to_pylist()], pa.binary())


@lean
def _anchors(batches, depth: int):
    hashed = xxhash.xxh3_64_intdigest
    for b, texts in _texts(batches):
        data, offsets = binary_buffer(texts)
        ids = b.column("id").to_numpy()
        for first, part, cuts, shift in _chunks(data, offsets, depth):
            if (found := runs(part, cuts, depth)) is None:
                continue
            text, start, count, anchor, digit = found
            view = memoryview(part)
            whole = np.fromiter((hashed(view[s : s + c + depth - 1]) for s, c in zip(start.tolist(), count.tolist())), U64, len(start))
            whole = mix(whole + (anchor * 512 + count).astype(U64))
            packed = _pack(start - cuts[text] + shift, anchor, count)
            columns = [digit.view(np.int64), whole.view(np.int64), ids[first + text], packed]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["g", "s", "id", "p"])


@lean
def _segments(batches, depth: int):
    """(g, s, p, bytes): the bytes under all windows of each run asked for."""
    unpack = zstandard.ZstdDecompressor().decompress
    for b in _slices(batches):
        rows: list[tuple] = []
        for i in range(b.num_rows):
            text = unpack(b.column("z")[i].as_py())
            for r in b.column("asked")[i].as_py():
                at, _, n = _unpacked(r["p"])
                rows.append((r["g"], r["s"], r["p"], text[at : at + n + depth - 1]))
            if rows and (len(rows) >= 1 << 14 or i == b.num_rows - 1):
                columns, rows = list(zip(*rows)), []
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["g", "s", "p", "bytes"])


@lean
def _strips(batches, depth: int):
    """(g, s, q, core, strip): digits of the strips of each run."""
    hashed = xxhash.xxh3_64_intdigest
    for b in _slices(batches):
        rows: list[tuple] = []
        for g, s, p, seg in zip(*(b.column(c).to_pylist() for c in ("g", "s", "p", "bytes"))):
            _, o, n = _unpacked(p)
            view = memoryview(seg)
            for q in range((o - n + 1) // STRIP, o // STRIP + 1):
                lo, hi = o - min(STRIP * q + STRIP - 1, o), o - max(STRIP * q, o - n + 1)
                core = o - STRIP * q
                rows.append((g, s, q, hashed(view[core : core + depth - STRIP + 1]), hashed(view[lo : hi + depth], hi - lo)))
        columns = list(zip(*rows)) or [[]] * 5
        whole = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32()))]
        hashes = [pa.array(np.array(c, U64).view(np.int64)) for c in columns[3:]]
        yield pa.RecordBatch.from_arrays([*whole, *hashes], ["g", "s", "q", "core", "strip"])


@lean
def _windows(batches, depth: int):
    """(g, s, k, w): a digit of full depth for window k of a run, of the strips asked for."""
    hashed = xxhash.xxh3_64_intdigest
    for b in _slices(batches, 4096):
        out: list[list] = [[], [], [], []]
        for g, s, p, seg, strips in zip(*(b.column(c).to_pylist() for c in ("g", "s", "p", "bytes", "qs"))):
            _, o, n = _unpacked(p)
            view = memoryview(seg)
            ks = [k for q in strips for k in range(o - min(STRIP * q + STRIP - 1, o), o - max(STRIP * q, o - n + 1) + 1)]
            out[0].append(np.full(len(ks), g))
            out[1].append(np.full(len(ks), s))
            out[2].append(np.array(ks, np.int32))
            out[3].append(np.fromiter((hashed(view[k : k + depth], o - k) for k in ks), U64, len(ks)))
        if out[0]:
            g, s, k, w = (np.concatenate(x) for x in out)
            for i in range(0, len(g), 1 << 16):
                cut = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (g, s, k, w.view(np.int64))], ["g", "s", "k", "w"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans: sorted, overlapping or touching ones joined."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _slices(batches, rows: int = 1024):
    """Batches of at most so many rows, so that what a task holds as Python objects stays small."""
    for b in batches:
        yield from (b.slice(i, rows) for i in range(0, b.num_rows, rows))


@lean
def _packed(batches):
    """The texts compressed, and numbered within the task that reads them; the table that is written holds the numbers."""
    z, at = packer(), TaskContext.get().partitionId() << 40
    for b in _slices(batches):
        texts = [z.compress(x) for x in b.column("text").to_pylist()]
        ids = pa.array(np.arange(at, at + b.num_rows))
        at += b.num_rows
        yield pa.RecordBatch.from_arrays([ids, b.column("row"), pa.array(texts, pa.binary())], ["id", "row", "z"])


def packed_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, row: the other columns, z: the compressed text) of each row, as a written table."""
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(None).cast("long").alias("doc_id")]
    rows = docs.select(F.struct(*columns).alias("row"), text_bytes().alias("text"))
    kinds = [T.StructField("id", T.LongType()), rows.schema["row"], T.StructField("z", T.BinaryType())]
    return scratch.write(rows.mapInArrow(_packed, T.StructType(kinds)), "texts")


def repeated_spans(texts: DataFrame, scratch: Scratch, depth: int = DEPTH) -> DataFrame:
    """(id, at, n): runs of n suffixes from byte at, all of whose windows repeat. texts: id, z."""
    anchors = texts.select("id", "z").mapInArrow(partial(_anchors, depth=depth), "g long, s long, id long, p long")
    anchors = scratch.write(anchors, "anchors")
    total = anchors.count()
    together = anchors.groupBy("g").agg(F.count("*").alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi")).where("c > 1")
    together = together.select("g", "c", (F.col("lo") == F.col("hi")).alias("same"))
    alive = scratch.write(salted_join(anchors, together, ["g"], total).drop("c"), "alive")
    scratch.drop("anchors")
    spans = F.array(F.struct(F.shiftright("p", 20).alias("at"), F.col("p").bitwiseAND(1023).alias("n")))
    whole = alive.where("same").select("id", F.explode(spans).alias("x"))

    opened = alive.where("not same").drop("same")
    kinds = opened.groupBy("g", "s").agg(F.count("*").alias("c"), F.min(F.struct("id", "p")).alias("r"))
    kinds = scratch.write(kinds, "kinds")
    asked = kinds.groupBy(F.col("r.id").alias("id")).agg(F.collect_list(F.struct("g", "s", "r.p")).alias("asked"))
    bytes_of = texts.select("id", "z").join(asked, "id").select("z", "asked")
    segments = bytes_of.mapInArrow(partial(_segments, depth=depth), "g long, s long, p long, bytes binary")
    segments = scratch.write(segments, "segments")
    strips = segments.mapInArrow(partial(_strips, depth=depth), "g long, s long, q int, core long, strip long")
    equal = strips.groupBy("g", "q", "strip").agg(F.count("*").alias("c"), F.min("s").alias("one"), F.min("core").alias("core"))
    # A strip meets others than its equals if its core has more than one kind of strip.
    mixed = equal.groupBy("g", "q", "core").agg(F.count("*").alias("c")).where("c > 1")
    several = 4 * segments.count()
    same = salted_join(strips.select("g", "s", "q", "strip"), equal.where("c > 1").select("g", "q", "strip", "c"), ["g", "q", "strip"], several)
    same = same.groupBy("g", "s").agg(F.collect_list("q").alias("whole"))
    to_open = salted_join(equal.select("g", "q", "core", "one"), mixed, ["g", "q", "core"], several)
    qs = to_open.groupBy("g", F.col("one").alias("s")).agg(F.collect_list("q").alias("qs"))
    windows = segments.join(qs, ["g", "s"]).mapInArrow(partial(_windows, depth=depth), "g long, s long, k int, w long")
    windows = scratch.write(windows, "windows")
    met = windows.groupBy("g", "w").agg(F.count("*").alias("c")).where("c > 1")
    hits = salted_join(windows, met, ["g", "w"], windows.count()).groupBy("g", "s").agg(F.collect_list("k").alias("ks"))
    marks = kinds.select("g", "s", "c").join(hits, ["g", "s"], "left").join(same, ["g", "s"], "left")
    marks = scratch.write(marks.where("c > 1 or ks is not null or whole is not null"), "marks")
    scratch.drop("windows", "segments", "kinds")
    first, offset, n = F.shiftright("p", 20), F.shiftright("p", 10).bitwiseAND(1023), F.col("p").bitwiseAND(1023)
    none, one_long = F.array().cast("array<int>"), F.lit(1).cast("long").alias("n")
    one = F.transform(F.coalesce("ks", none), lambda k: F.struct((first + k).alias("at"), one_long))
    low = lambda q: offset - F.least(q * STRIP + STRIP - 1, offset)
    high = lambda q: offset - F.greatest(q * STRIP, offset - n + 1)
    strip = lambda q: F.struct((first + low(q)).alias("at"), (high(q) - low(q) + 1).alias("n"))
    many = F.transform(F.coalesce("whole", none), strip)
    partly = salted_join(opened, marks, ["g", "s"], total)
    partly = partly.select("id", F.explode(F.when(F.col("c") > 1, spans).otherwise(F.concat(one, many))).alias("x"))
    return whole.union(partly).select("id", "x.at", "x.n")


@lean
def _cut(batches, depth: int, digest: bool):
    unpack = zstandard.ZstdDecompressor().decompress
    for b in _slices(batches):
        rows: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans")}
        for z, found in zip(b.column("z").to_pylist(), b.column("found").to_pylist()):
            data = unpack(z)
            spans = merged([(r["at"], r["at"] + r["n"] + depth - 1) for r in found or ()])
            rows["n_bytes"].append(len(data))
            rows["n_removed"].append(sum(hi - lo for lo, hi in spans))
            rows["n_spans"].append(len(spans))
            rows["spans"].append([{"start": lo, "stop": hi} for lo, hi in spans])
            edges = [0, *(x for span in spans for x in span), len(data)]
            if digest:
                h = hashlib.sha256()
                for lo, hi in zip(edges[::2], edges[1::2]):
                    h.update(data[lo:hi])
                rows["kept_sha256"].append(h.hexdigest())
                rows["kept_text"].append(None)
            else:
                rows["kept_sha256"].append(None)
                rows["kept_text"].append(kept_characters(data, edges))
        places = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [places]
        yield pa.RecordBatch.from_arrays([b.column("row"), *map(pa.array, rows.values(), kinds)], ["row", *rows])


def kept_characters(data: bytes, edges: list[int]) -> str:
    """What is left between the removed spans; a character that a span covers in part stays whole."""
    out = []
    for lo, hi in zip(edges[::2], edges[1::2]):
        while 0 < lo < len(data) and data[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi += 1
        out.append(data[lo:hi])
    return b"".join(out).decode("utf-8", "replace")


def substring_dedup(docs: DataFrame, depth: int = DEPTH, digest: bool = False) -> DataFrame:
    """Per row of docs: row (its other columns), n_bytes, n_removed, n_spans, kept_sha256 (if digest) or kept_text, spans (in bytes)."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "substrings")
    texts = packed_rows(docs, scratch)
    spans = repeated_spans(texts, scratch, depth).groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    numbers = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    kept = [T.StructField(c, T.StringType()) for c in ("kept_sha256", "kept_text")]
    schema = T.StructType([texts.schema["row"], *numbers, *kept, T.StructField("spans", T.ArrayType(span))])
    found = texts.join(spans, "id", "left").select("row", "z", "found")
    return found.mapInArrow(partial(_cut, depth=depth, digest=digest), schema)
