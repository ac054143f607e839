"""Improbable-feature digests: rare byte windows of a text in chained Bloom filters, compared by their shared bits.

Every window of 32 bytes has an entropy. How often each entropy occurs is counted over all windows of all documents; the
fewer, the rarer, and equally rare ones go by entropy. Of every 32 neighbouring windows the rarest, the leftmost of equals, gets
a vote; windows with 8 votes are the text's features. Texts below 256 bytes have windows of 8 bytes with 2 votes of 8 as
well, and one below 8 bytes is its own feature; so every text but an empty one has a feature. Each distinct feature sets
HASHES bits of a filter of BITS; after FILL features the next filter begins.

Two digests are as alike as the filters of the shorter one (by number of filters, then of bits) find their best match in the
other, on average. Filters share at random about k1 k2 / BITS bits; the share of what lies between that and the lesser k, less
the part below NOISE of it, is their likeness. Equal digests have likeness 1, and an empty one has 0 with any but another.

All windows of a batch are ranked at once: an entropy follows from how often the byte that comes and the byte that goes occur in a
window, which takes 31 comparisons of shifted byte arrays. Long texts go through in pieces of BLOCK windows.

A document's next one, by falling id, comes from a range-partitioned sort of the texts, compressed: within a partition it is the
following row, and at the end of one the first row of the next, which travel apart (two rows a partition). Texts move once.

Defined results: null texts are empty; an empty text has an empty fingerprint; null ids come last; documents with one id go by a hash
of their text; repeated rows are documents of their own; a single document is its own next; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.llm.common import BYTE_HASH, Scratch, binary_buffer, mix, packed_texts, packer, powers, small_batches, spare, text_bytes

BITS, HASHES, FILL, NOISE = 2048, 5, 160, 0.2
LEVELS = 1024
#: Windows ranked at a time, so that the byte arrays stay in a core's cache; bytes of texts taken at a time.
BLOCK, GROUP_BYTES = 1 << 17, 2 << 20
_FAR = 1 << 62


@dataclass(frozen=True)
class Scale:
    """Windows of `window` bytes, of which those with `votes` are taken, for texts of fewer than `below` bytes."""

    window: int
    votes: int
    below: int

    @cached_property
    def gain(self) -> np.ndarray:
        """What the c-th equal byte of a window adds to the sum of c log2 c, in whole numbers."""
        c = np.arange(self.window + 1, dtype=float)
        f = np.round(c * np.log2(np.maximum(c, 1)) * (1 << 20)).astype(np.int64)
        return np.append(0, np.diff(f))


SCALES = [Scale(32, 8, 1 << 62), Scale(8, 2, 256)]


def levels(data: np.ndarray, scale: Scale) -> np.ndarray:
    """The entropy level (0 to LEVELS - 1) of the window that starts at each byte, of those that fit."""
    n, w = len(data), scale.window
    if n < w:
        return np.zeros(0, np.int64)
    before, after = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for d in range(1, w):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same  # equal bytes up to window - 1 places back, and itself
        after[:-d] += same
    change = scale.gain[before]
    change[w:] -= scale.gain[after[: n - w]]
    top = int(scale.gain.sum())
    return (top - np.cumsum(change)[w - 1 :]) * (LEVELS - 1) // top


def inside(offsets: np.ndarray, lo: int, hi: int, window: int) -> np.ndarray:
    """Whether the window from each byte lo to hi - 1 ends in the text in which it starts."""
    out = np.ones(hi - lo, bool)
    ends = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi + window, "left")]
    for d in range(1, window):  # places from which a window would pass the end
        at = ends - d
        out[at[(at >= lo) & (at < hi)] - lo] = False
    return out


def histogram(data: np.ndarray, offsets: np.ndarray, scale: Scale) -> np.ndarray:
    """Windows of each level."""
    out, last = np.zeros(LEVELS, np.int64), len(data) - scale.window + 1
    for lo in range(0, last, BLOCK):
        hi = min(lo + BLOCK, last)
        found = levels(data[lo : hi + scale.window - 1], scale)[inside(offsets, lo, hi, scale.window)]
        out += np.bincount(found, minlength=LEVELS)
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """The place of each level from the rarest; a level that does not occur is rarer than any."""
    out = np.empty(LEVELS, np.int64)
    out[np.argsort(counts, kind="stable")] = np.arange(LEVELS)
    return out


def _least(key: np.ndarray, window: int) -> np.ndarray:
    """For each place the least key of the `window` places (a power of two) from it on."""
    step = 1
    while step < window:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    return key


def selected(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the windows that get enough votes, in order; a text shorter than a window has none."""
    texts, hashes, w = [], [], scale.window
    last = len(data) - w + 1
    for lo in range(0, last, BLOCK):
        hi = min(lo + BLOCK, last)
        # Windows of this piece can be voted for from w - 1 places before to as many after.
        a, b = max(lo - w + 1, 0), min(hi + w - 1, last)
        key = rank[levels(data[a : b + w - 1], scale)] << 32 | np.arange(b - a)
        key[~inside(offsets, a, b, w)] = _FAR
        # What straddles two texts keeps their windows w - 1 places apart, so no vote sees both.
        edge = np.full(w - 1, _FAR)
        least = _least(np.concatenate([edge, key, edge]), w)
        votes = np.bincount(least[least < _FAR] & 0xFFFFFFFF, minlength=b - a)
        at = a + np.flatnonzero(votes >= scale.votes)
        at = at[(at >= lo) & (at < hi)]
        if len(at):
            texts.append(np.searchsorted(offsets[1:], at, "right"))
            hashes.append(_hashes(data, at, at + w))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(texts), np.concatenate(hashes)


def features(texts: list[bytes], ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the features of all scales, by text, scale and place; a text below the least window is its own."""
    found = []
    for scale, rank in zip(SCALES, ranks):
        own = np.array([k for k, t in enumerate(texts) if len(t) < scale.below], np.int64)
        text, hashes = selected(*joined([texts[k] for k in own]), rank, scale)
        found.append((own[text], hashes))
    short = [k for k, t in enumerate(texts) if 0 < len(t) < SCALES[-1].window]
    found += [(np.array([k]), _hashes(np.frombuffer(texts[k], np.uint8), np.array([0]), np.array([len(texts[k])]))) for k in short]
    text, hashes = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(text, kind="stable")
    return text[order], hashes[order]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of the texts."""
    return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending starts near each other."""
    lo, hi = int(starts[0]), int(ends[-1])
    up, down = powers(hi - lo)
    prefix = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum(BYTE_HASH[data[lo:hi]] * up, out=prefix[1:])
    s, e = starts - lo, ends - lo
    return mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64))


def filters(hashes: np.ndarray) -> bytes:
    """Chained filters of a text's features in order; a feature that was there before adds nothing."""
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    if not len(hashes):
        return b""
    chain = np.zeros((-(-len(hashes) // FILL), BITS), bool)
    width = np.uint64(BITS.bit_length() - 1)
    for k in range(HASHES):
        chain[np.arange(len(hashes)) // FILL, ((hashes >> (width * np.uint64(k))) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(chain, axis=1).tobytes()


def digests(texts: list[bytes], ranks: list[np.ndarray]) -> list[bytes]:
    """The chained filters of each text."""
    text, hashes = features(texts, ranks)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    return [filters(hashes[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1; by each filter of the shorter digest its best match in the other."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    size = BITS // 8
    one, two = ([int.from_bytes(x[k : k + size]) for k in range(0, len(x), size)] for x in (a, b))
    counts = [[x.bit_count() for x in chain] for chain in (one, two)]
    if (len(one), sum(counts[0]), a) > (len(two), sum(counts[1]), b):
        one, two, counts = two, one, counts[::-1]
    total = 0.0
    for x, kx in zip(one, counts[0]):
        best = 0.0
        for y, ky in zip(two, counts[1]):
            chance, most = kx * ky / BITS, min(kx, ky)
            floor = chance + NOISE * (most - chance)
            shared = (x & y).bit_count()
            if shared > floor:  # then most > floor, as most >= shared
                best = max(best, (shared - floor) / (most - floor))
        total += best
    return total / len(one)


# --- over tables ---------------------------------------------------------------------------------


def _counted(batches):
    counts = np.zeros((len(SCALES), LEVELS), np.int64)
    for b in batches:
        column = b.column("text")
        for k, scale in enumerate(SCALES):
            short = column if scale.below > 1 << 32 else column.filter(pc.less(pc.binary_length(column), scale.below))
            counts[k] += histogram(*binary_buffer(short), scale)
    scale, level = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(scale.astype(np.int32)), pa.array(level.astype(np.int32)), pa.array(counts[scale, level])], ["scale", "level", "n"])


def rarities(docs: DataFrame) -> list[np.ndarray]:
    """The ranks of each scale's levels, by all windows of all texts."""
    small_batches(docs.sparkSession)
    parts = docs.select(text_bytes().alias("text")).mapInArrow(_counted, "scale int, level int, n long")
    counts = np.zeros((len(SCALES), LEVELS), np.int64)
    for scale, level, n in parts.groupBy("scale", "level").agg(F.sum("n")).collect():  # at most LEVELS rows a scale
        counts[scale, level] = n
    return [rarity(c) for c in counts]


def shown(digest: bytes) -> str:
    return base64.b64encode(digest).decode()


def _marked(batches, ranks, given: str):
    for b in batches:
        texts, out = b.column(given).to_pylist(), []
        for group in _groups(texts, len):
            out += map(shown, digests(group, ranks.value))
        yield b.drop_columns([given]).append_column("fingerprint", pa.array(out, pa.string()))


def _groups(items, size):
    """Lists of items of about GROUP_BYTES."""
    group, held = [], 0
    for x in items:
        group.append(x)
        held += size(x)
        if held >= GROUP_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def fingerprints(docs: DataFrame, ranks: list[np.ndarray]) -> DataFrame:
    """docs with the column fingerprint (one of that name is replaced); compare two by likeness() of their decoded bytes."""
    small_batches(docs.sparkSession)
    docs = docs.drop("fingerprint")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    given = spare(docs, "bytes of text")
    schema = T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())])
    return docs.withColumn(given, text_bytes()).mapInArrow(partial(_marked, ranks=shared, given=given), schema)


#: What is known of a document beside its next one: (doc_id, text, digest).
_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compared(pairs: list[tuple], ranks: list[np.ndarray]) -> list[dict]:
    """Result rows of ((doc_id, text, digest), (text, digest) of the next)."""
    texts = [raw.decode("utf-8", "replace") for (_, raw, _), _ in pairs]
    changed = [edited(t, raw.decode("utf-8", "replace")).encode() for t, (_, (raw, _)) in zip(texts, pairs)]
    out = []
    for text, new, mark, ((doc_id, _, own), (_, next_mark)) in zip(texts, changed, digests(changed, ranks), pairs):
        values = [doc_id, len(text), hashlib.sha256(new).hexdigest(), shown(own), shown(mark), likeness(own, mark), likeness(own, next_mark)]
        out.append(dict(zip(_NAMES, values)))
    return out


def _digested(batches, ranks, schema: pa.Schema):
    """A sorted partition to its results, but for the last row's, which goes on as tail; the first row goes on as head too."""
    unpack, z = zstandard.ZstdDecompressor(), packer()
    last, part = None, 0

    def end(kind: str, row: tuple) -> dict:
        return {"kind": kind, "part": part, "doc_id": row[0], "z": z.compress(row[1]), "digest": row[2]}

    for b in batches:
        part = b.column("part")[0].as_py() if b.num_rows else part
        rows = ((i, unpack.decompress(x)) for i, x in zip(b.column("doc_id").to_pylist(), b.column("z").to_pylist()))
        for group in _groups(rows, lambda r: len(r[1])):
            group = [(i, raw, mark) for (i, raw), mark in zip(group, digests([raw for _, raw in group], ranks.value))]
            out = [] if last else [end("head", group[0])]
            both = [last, *group] if last else group
            last = both[-1]
            out += ({"kind": "row"} | r for r in _compared([(a, c[1:]) for a, c in zip(both, both[1:])], ranks.value))
            yield pa.RecordBatch.from_pylist(out, schema)
    if last:
        yield pa.RecordBatch.from_pylist([end("tail", last)], schema)


def _joined_ends(batches, ranks, schema: pa.Schema):
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        for r in b.to_pylist():
            pair = ((r["doc_id"], unpack.decompress(r["z"]), r["digest"]), (unpack.decompress(r["next_z"]), r["next_digest"]))
            yield pa.RecordBatch.from_pylist(_compared([pair], ranks.value), schema)


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(rarities(docs))
    scratch = Scratch(spark, "fingerprints")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    dealt = packed_texts(rows, ["doc_id", "tie"]).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = T.StructType.fromDDL(f"kind string, part int, {_ROW}, z binary, digest binary")
    dealt = dealt.select("doc_id", "z", F.spark_partition_id().alias("part"))
    made = scratch.write(dealt.mapInArrow(partial(_digested, ranks=ranks, schema=to_arrow_schema(kind)), kind), "rows")
    heads, tails = (made.where(F.col("kind") == k) for k in ("head", "tail"))
    parts = sorted(r[0] for r in heads.select("part").collect())  # one a partition
    follow = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part int, next_part int")
    heads = heads.select(F.col("part").alias("next_part"), F.col("z").alias("next_z"), F.col("digest").alias("next_digest"))
    ends = tails.select("part", "doc_id", "z", "digest").join(F.broadcast(follow), "part").join(heads, "next_part")
    kind = T.StructType.fromDDL(_ROW)
    ends = ends.mapInArrow(partial(_joined_ends, ranks=ranks, schema=to_arrow_schema(kind)), kind)
    return made.where("kind = 'row'").select(_NAMES).union(ends)
