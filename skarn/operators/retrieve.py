"""Lexical, vector and hybrid retrieval: candidates, fusion and reranking."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60
#: Questions that meet the vectors in one pass.
QUESTIONS = 4096
#: Scores of one matrix product.
PRODUCT = 1 << 21


def top(df: DataFrame, k: int, by: str | None, *order: Column) -> DataFrame:
    """The first k rows (of each `by`) with their rank; with no `by` one TakeOrdered limits before ranking."""
    if by is None:
        df = df.orderBy(*order).limit(k)
        return df.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def _units(column: pa.Array, rows: int, width: int) -> np.ndarray:
    """The vectors of a batch, each divided by its length."""
    flat = column.flatten()
    if len(flat) != rows * width or column.null_count or flat.null_count:
        raise ValueError("a vector is missing, has nulls, or is not as wide as the questions")
    vectors = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, width)
    length = np.sqrt((vectors * vectors).sum(1))
    if not (length > 0).all():
        raise ValueError("a vector has no length")
    return vectors / length[:, None]


def _cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.round(np.clip(query @ vectors.T, -1, 1), 9)


def _scored(batches, key: str, asked):
    ids, query, _ = asked.value
    for b in batches:
        if not b.num_rows or not len(ids):
            continue
        step = max(1, PRODUCT // 8 // len(ids))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            score = _cosines(query, _units(part.column("embedding"), part.num_rows, query.shape[1]))
            # A vector's scores stand together, so its key is repeated in place.
            columns = [pa.array(np.tile(ids, part.num_rows)), part.column(key).take(pa.array(np.repeat(np.arange(part.num_rows), len(ids)))), pa.array(score.T.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", key, "score"])


def _blocks(queries: DataFrame, by: str | None = None):
    """Blocks of about QUESTIONS questions, sent to every task: (ids, vectors of length one, group of each)."""
    spark = queries.sparkSession
    group = F.lit(None) if by is None else F.col(by)
    queries = queries if by is None else queries.where(F.col(by).isNotNull())
    blocks = max(1, -(-queries.count() // QUESTIONS))
    for n in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).select(F.col("query_id").cast("long"), "query", group.alias("group")).collect()
        matrix = np.array([r[1] for r in part], np.float64).reshape(len(part), -1 if part else 0)
        length = np.sqrt((matrix * matrix).sum(1))
        if not (length > 0).all():
            raise ValueError("a vector has no length")
        if part or not n:
            yield len(part), spark.sparkContext.broadcast((np.array([r[0] for r in part], np.int64), matrix / length[:, None], [r[2] for r in part]))


def vector_scores(vectors: DataFrame, queries: DataFrame, key: str = "vec_id") -> DataFrame:
    """(query_id, key, score): cosine of every vector with every vector of a stated query set (query_id, query), to nine digits.

    Matrix products of at most PRODUCT scores; the questions go to every task in blocks of QUESTIONS, each a pass over the vectors.
    """
    out, kind = None, vectors.schema[key].dataType.simpleString()
    for count, asked in _blocks(queries):
        found = (vectors if count else vectors.limit(0)).select(key, "embedding").mapInArrow(partial(_scored, key=key, asked=asked), f"query_id long, {key} {kind}, score double")
        out = found if out is None else out.union(found)
    return out


def _best(q: np.ndarray, score: np.ndarray, row: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Which of the candidates (question, score, row of keys) are among the k best of their question; equal scores go by key."""
    order = np.lexsort((keys[row], -score, q))
    first = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[place < k]


def _nearest(batches, key: str, asked, k: int, by: str | None):
    ids, query, groups = asked.value
    of: dict = {}
    for n, g in enumerate(groups):
        of.setdefault(g, []).append(n)
    # The best so far of each question, and the least score that can still be among them.
    q, score, held, kind = np.zeros(0, np.int64), np.zeros(0), None, None
    least = np.full(len(ids), -np.inf)
    for b in batches:
        if not b.num_rows or not len(ids):
            continue
        vectors = _units(b.column("embedding"), b.num_rows, query.shape[1])
        keys, kind = b.column(key).to_numpy(zero_copy_only=False), b.schema.field(key).type
        labels = [None] * b.num_rows if by is None else b.column(by).to_pylist()
        rows_of: dict = {}
        for n, g in enumerate(labels):
            rows_of.setdefault(g, []).append(n)
        for g, rows in rows_of.items():
            asks = np.array(of.get(g, ()), np.int64)
            rows = np.array(rows)
            for at in range(0, len(rows) if len(asks) else 0, step := max(1, PRODUCT // max(len(asks), 1))):
                some = rows[at : at + step]
                found = _cosines(query[asks], vectors[some])
                bound = least[asks]
                if len(some) > k:
                    bound = np.maximum(bound, np.partition(found, len(some) - k, axis=1)[:, len(some) - k])
                a, r = np.nonzero(found >= bound[:, None])
                every = keys[some] if held is None else np.concatenate([held, keys[some]])
                q, score = np.r_[q, asks[a]], np.r_[score, found[a, r]]
                row = np.r_[np.arange(len(every) - len(some)), len(every) - len(some) + r]
                best = _best(q, score, row, every, k)
                q, score, held = q[best], score[best], every[row[best]]
                times = np.bincount(q, minlength=len(ids))
                last = np.cumsum(times)[times >= k] - 1  # the k-th of each question that has as many
                least[times >= k] = score[last]
    if len(q):
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(held, kind), pa.array(score)], ["query_id", key, "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", by: str | None = None) -> DataFrame:
    """(query_id, key, score): for each question (query_id, query) at least its k best vectors by cosine; ties go to the smaller key.

    With by only vectors with the question's value of that column, not null, are looked at. Every such vector meets the question, in
    matrix products of at most PRODUCT scores, and each task gives on only its best k. The questions go to every task in
    blocks of QUESTIONS, each a pass over the vectors.
    """
    out, kind = None, vectors.schema[key].dataType.simpleString()
    vectors = vectors.select(key, "embedding") if by is None else vectors.where(F.col(by).isNotNull()).select(key, "embedding", by)
    for count, asked in _blocks(queries, by):
        found = (vectors if count else vectors.limit(0)).mapInArrow(partial(_nearest, key=key, asked=asked, k=k, by=by), f"query_id long, {key} {kind}, score double")
        out = found if out is None else out.union(found)
    return out


def rrf(branches: list[DataFrame], key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """(query_id, key, score): sum of 1 / (k + rank) over branches (query_id, key, rank); a branch counts a key's first rank only."""
    firsts = [b.groupBy("query_id", key).agg(F.min("rank").alias("rank")) for b in branches]
    both = firsts[0]
    for b in firsts[1:]:
        both = both.unionByName(b)
    return both.groupBy("query_id", key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def hybrid(bm25: DataFrame, vector: DataFrame, keep: Column | DataFrame | None, candidates: int = 20, k: int = 5, key: str = "chunk_id", rrf_k: int = RRF_K) -> DataFrame:
    """Both branches cut to their candidates, fused, filtered and ranked. keep: a condition on the key, or a table of keys.

    Where the filter leaves a query fewer than `candidates`, twice as many of both branches are fused, and twice that; a
    query takes the first fusion that is enough, or from which the filter took nothing. One pass ranks the largest cut.
    """
    sizes = [candidates] if keep is None else [candidates, 2 * candidates, 4 * candidates]
    lists = [top(b, sizes[-1], "query_id", F.desc("score"), F.col(key)).select("query_id", key, "rank") for b in (bm25, vector)]
    both = lists[0].unionByName(lists[1])
    share = 1 / (rrf_k + F.col("rank"))
    fused = both.groupBy("query_id", key).agg(*(F.sum(F.when(F.col("rank") <= n, share)).alias(f"s{n}") for n in sizes))
    if keep is None:
        found = fused.withColumnRenamed(f"s{candidates}", "score")
    else:
        w = W.partitionBy("query_id")
        if isinstance(keep, DataFrame):
            marked = fused.join(keep.select(key, F.lit(True).alias("keep")), key, "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
        else:
            marked = fused.withColumn("keep", F.coalesce(keep, F.lit(False)))
        score = F.col(f"s{sizes[-1]}")
        for n in sizes[-2::-1]:
            s = F.col(f"s{n}")
            good, fetched = F.count_if(s.isNotNull() & F.col("keep")).over(w), F.count(s).over(w)
            score = F.when((good >= candidates) | (good == fetched), s).otherwise(score)
        found = marked.withColumn("score", score).where(F.col("keep") & F.col("score").isNotNull())
    found = found.withColumn("score", F.round("score", 12))
    return top(found.select("query_id", key, "score"), k, "query_id", F.desc("score"), F.col(key))


def mode(best: Column, threshold: float = 0.1) -> Column:
    """empty, low or grounded, by the best reranked score of a request."""
    return F.when(best.isNull(), "empty").when(best < threshold, "low").otherwise("grounded")


def overlap_score(question_tokens: Column, passage_tokens: Column) -> Column:
    """A reranker's deterministic stand-in: the sigmoid of twice the shared share of distinct question tokens minus one."""
    asked = F.array_distinct(question_tokens)
    share = F.size(F.array_intersect(asked, passage_tokens)) / F.greatest(F.size(asked), F.lit(1))
    return 1 / (1 + F.exp(-(2 * share - 1)))
