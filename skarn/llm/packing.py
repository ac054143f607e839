"""Best-fit packing of tokenised documents into sequences of at most `size` tokens.

Each document's ids and a closing id 0; a longer one is cut into pieces of `size` tokens,
the first of which may be shorter. Pieces are dealt at random into groups of about GROUP and
each group is packed by bounded-space online best fit, piece by piece as they arrive: at most OPEN bins
are open; a bitset keyed by free space finds the fullest bin that still takes a piece; if none does and OPEN
bins are open, the fullest closes. Memory does not grow with a group but for its rows. The price of packing online: on
sf0.1 4992 sequences, where the tokens would fill 4935.1; unbounded bins need 4990, and pieces sorted beforehand 4936.

Defined results: null and empty texts are one token; repeated rows and null ids are packed as
they come; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import Scratch, lean, small_batches

GROUP, OPEN = 32768, 32


@lru_cache(2)
def _encoder(path: str):
    """(a faster encoder of the byte-level BPE, its special tokens' strings)."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    specials = [t["content"] for t in model.get("added_tokens", ())]
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in specials}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), specials


@lru_cache(2)
def _exact(path: str):
    """The named encoder, for texts with a special token's string; a worker that meets none does not hold it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(texts: list[str | None], path: str) -> list[list[int]]:
    fast, specials = _encoder(path)
    return [_exact(path).encode(t, add_special_tokens=False).ids if any(s in t for s in specials) else fast.encode_ordinary(t) for t in (t or "" for t in texts)]


def cut_points(n: int, size: int) -> list[int]:
    """Starts of the pieces of n tokens: the first takes what is left over."""
    first = n % size or size
    return [0, *range(first, n, size)] if n > size else [0]


@lean
def _pieces(batches, path: str, size: int, end: int):
    for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
        rows: list[tuple] = []
        for k, ids in enumerate(token_ids(b.column("text").to_pylist(), path)):
            ids = np.array([*ids, end], "<u4")
            starts = cut_points(len(ids), size)
            rows += [(k, p, s, e - s, zlib.crc32(ids[s:e].tobytes())) for p, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
        columns = list(zip(*rows)) or [[]] * 5
        ids, piece = b.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32())
        numbers = [pa.array(c, pa.int64()) for c in columns[2:]]
        yield pa.RecordBatch.from_arrays([ids, piece, *numbers], ["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(lengths: list[int], size: int, open_bins: int = OPEN) -> tuple[list[int], list[int]]:
    """The bin and the place in it of each length, in order of arrival."""
    bits, free, count, made = 0, {}, 0, 0
    bins, places = [], []
    for n in lengths:
        if fits := bits >> n:
            room = n + (fits & -fits).bit_length() - 1
            chosen = free[room].pop()
            if not free[room]:
                bits &= ~(1 << room)
        else:
            if count == open_bins:  # the fullest closes
                least = (bits & -bits).bit_length() - 1
                free[least].pop()
                if not free[least]:
                    bits &= ~(1 << least)
                count -= 1
            room, chosen, made, count = size, made, made + 1, count + 1
        bins.append(chosen)
        places.append(size - room)
        if room - n:
            free.setdefault(room - n, []).append(chosen)
            bits |= 1 << (room - n)
        else:
            count -= 1
    return bins, places


def _packed(table: pa.Table, size: int) -> pa.Table:
    table = table.sort_by("at")  # the order of arrival, also where a lost task runs again
    bins, places = best_fit(table["length"].to_pylist(), size)
    group = table["part"][0].as_py()
    sequences = pa.array([(group << 32) + b for b in bins], pa.int64())
    return table.drop_columns(["part", "at"]).append_column("sequence_id", sequences).append_column("offset", pa.array(places, pa.int64()))


def best_fit_packing(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "packing")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = scratch.write(texts.mapInArrow(partial(_pieces, path=tokenizer, size=size, end=end), schema), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    dealt = pieces.withColumn("at", F.monotonically_increasing_id()).withColumn("at", F.xxhash64("at")).withColumn("part", F.pmod("at", F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(lambda t: _packed(t, size), f"{schema}, sequence_id long, offset long")
