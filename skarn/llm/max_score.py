"""Exact top-k inner product search by MaxScore over integer vectors.

Components become floor(256 * x). A dimension is a term and its postings are the shard's column. A posting adds
at least the term's low bound and at most its high bound, the products of the query's component with the least and greatest
of the column; what it adds above the low bound is its contribution, never more than high - low.

A shard is read in steps of STEP vectors. Before each one, the query's terms are split by the k-th best score so far:
the terms with the least bounds, as many as together cannot lift a vector from all low bounds to that score, are not essential.
The postings of the essential terms are traversed in full. A vector whose part plus the bounds of the other terms is below
the k-th score is dropped; the others probe the remaining terms a few at a time, widest first, while they compete. As the bar
rises, fewer terms stay essential. The best k of each shard are merged.

Shards and blocks of queries have a fixed size. The blocks are read in groups of about GROUP_BYTES, and each group is
broadcast to the shards, which never move; so memory is bounded, and only k rows of a query and shard travel. Sums of any size
take the same way: in doubles while they are exact there, else in Python's whole numbers.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; a shorter vector counts
as padded with zeros; sums beyond 64 bits are ranked by their true values and shown as the largest or smallest long; ties go
to the smaller id; rows with a null id take no part; rows that repeat an id are separate candidates, but never for their own
id; of query rows that repeat an id, the greatest vector asks; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skarn.llm.common import Scratch

SHARD, QUERIES, STEP, PROBED = 8192, 2048, 1024, 8
GROUP_BYTES = 32 << 20
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_COLUMNS = ["ids", "width", "vectors", "exact"]


def _pack(table: pa.Table) -> pa.Table:
    ids = table["vec_id"].to_numpy()
    rows = table["q"].to_pylist()
    width = max(map(len, rows))
    wide = max((abs(x) for r in rows for x in r), default=0)
    m = np.zeros((len(rows), width), "<f8" if wide < 1 << 26 else object)
    for k, r in enumerate(rows):
        m[k, : len(r)] = r
    order = np.argsort(ids, kind="stable")
    packed = m[order].astype("<i4").tobytes() if m.dtype != object else b""
    exact = None if m.dtype != object else [",".join(map(str, m[k].tolist())) for k in order]
    values = {
        "block": table["block"].slice(0, 1),
        "width": pa.array([width], pa.int32()),
        "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
        "vectors": pa.array([packed], pa.binary()),
        "exact": pa.array([exact], pa.list_(pa.string())),
    }
    return pa.table(values)


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids, width = np.frombuffer(row["ids"], "<i8"), row["width"]
    if row["exact"] is None:
        return ids, np.frombuffer(row["vectors"], "<i4").reshape(len(ids), width).astype(np.float64)
    whole = [[int(x) for x in r.split(",")] if r else [] for r in row["exact"]]
    return ids, np.array(whole, object).reshape(len(ids), width)


def _alike(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of one width; of whole numbers where doubles would not hold every sum exactly."""
    width = max(queries.shape[1], vectors.shape[1], 1)
    both = [np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (queries, vectors)]
    if all(m.dtype != object for m in both):
        most = np.abs(both[0]).sum(1).max(initial=0) * np.abs(both[1]).max(initial=0)
        if 2 * most < 2**53:
            return both[0], both[1]
    return tuple(np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape) for m in both)


def _kth(scores: np.ndarray, k: int):
    """The k-th greatest."""
    return sorted(scores, reverse=True)[k - 1] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]


def essential(width: np.ndarray, room) -> int:
    """How many terms, of widths in falling order, are essential: the rest together add less than room."""
    rest = np.cumsum(width[::-1])
    return len(width) - int(np.searchsorted(rest, room, "left"))


def top_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """(query row, vector row, score) of the k best vectors of a shard for each query; ids ascend."""
    queries, vectors = _alike(queries, vectors)
    if not len(vectors):
        return
    postings = np.ascontiguousarray(vectors.T)
    least, most = postings.min(1, initial=0), postings.max(1, initial=0)
    for q, query in enumerate(queries):
        one, two = query * least, query * most
        low, high = np.minimum(one, two), np.maximum(one, two)
        terms = np.argsort(low - high, kind="stable")
        width, floor = (high - low)[terms], low.sum()
        # What the terms from each place on can still add, and the sum of their low bounds.
        above = np.append(np.cumsum(high[terms][::-1])[::-1], 0)
        best, scores = np.zeros(0, np.int64), np.zeros(0, queries.dtype)
        for lo in range(0, len(ids), STEP):
            hi = min(lo + STEP, len(ids))
            bar = _kth(scores, k) if len(scores) >= k else None
            split = len(terms) if bar is None else essential(width, bar - floor)
            alive = lo + np.flatnonzero(ids[lo:hi] != query_ids[q])
            if not split:
                continue
            part = (query[terms[:split]] @ postings[terms[:split], lo:hi])[alive - lo]
            # Ids ascend, so a vector that only ties with the bar comes behind those that set it.
            while split < len(terms) and len(alive):
                keep = part + above[split] > bar
                alive, part = alive[keep], part[keep]
                probe = terms[split : split + PROBED]
                part = part + query[probe] @ postings[np.ix_(probe, alive)]
                split += len(probe)
            best, scores = np.concatenate([best, alive]), np.concatenate([scores, part])
            if len(best) > k:
                order = np.lexsort((best, -scores))[:k] if scores.dtype != object else sorted(range(len(best)), key=lambda i: (-scores[i], best[i]))[:k]
                best, scores = best[order], scores[order]
        yield from ((q, int(v), int(s)) for v, s in zip(best, scores))


def _search(batches, k: int):
    for b in batches:
        for row in b.to_pylist():
            qids, queries = _matrix({c: row[f"q_{c}"] for c in _COLUMNS})
            ids, vectors = _matrix(row)
            if found := list(top_k(qids, queries, ids, vectors, k)):
                q, v, s = zip(*found)
                # The true sum as bytes that sort like it, and the sum as far as a long holds it.
                order = pa.array([(x + (1 << 255)).to_bytes(32, "big") for x in s], pa.binary())
                shown = pa.array([min(max(x, _LEAST), _MOST) for x in s], pa.int64())
                columns = [pa.array(qids[list(q)]), pa.array(ids[list(v)]), shown, order]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "order"])


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each finite vector."""
    bad = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return table.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors dealt at random to blocks of about size, one row a block."""
    n = max(1, -(-vectors.count() // size))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    return dealt.groupBy("block").applyInArrow(_pack, "block long, width int, ids binary, vectors binary, exact array<string>")


def max_score(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, but for its own id."""
    scratch = Scratch(candidates.sparkSession, "maxscore")
    shards = scratch.write(_blocks(scratch.write(integer_vectors(candidates), "vectors"), SHARD), "shards")
    one_each = integer_vectors(queries).groupBy("vec_id").agg(F.max("q").alias("q"))
    asked = scratch.write(_blocks(scratch.write(one_each, "asked"), QUERIES), "blocks")
    scratch.drop("vectors", "asked")
    held = F.length("ids") + F.length("vectors") + F.coalesce(F.aggregate("exact", F.lit(0), lambda n, x: n + F.length(x)), F.lit(0))
    size = asked.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]
    groups, schema = max(1, -(-size // GROUP_BYTES)), "query_id long, vec_id long, score long, order binary"
    best = None
    for g in range(groups):
        block = asked.where(F.pmod("block", F.lit(groups)) == g).select(*(F.col(c).alias(f"q_{c}") for c in _COLUMNS))
        part = shards.crossJoin(F.broadcast(block)).mapInArrow(partial(_search, k=k), schema)
        best = part if best is None else best.union(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("order"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
