"""Centroid clustering: single-precision products with proven error bounds, exact integers where they leave a doubt.

Components become floor(1024 * x) as whole numbers. The squared distance of x to centroid c is |x|^2 plus
s(c) = |c|^2 - 2 x.c, so only s is compared. x.c comes from one single-precision matrix product a batch. Whatever the order of
its sums, a product of width d is off by at most g(d + 2) |x| |c| with g(n) = n u / (1 - n u), u = 2^-24, rounding of the factors
included; |c|^2 is exact before it becomes a double. So each s(c) lies in an interval of known ends. A centroid whose
interval begins beyond the least end cannot be nearest; where one is left it is nearest, else those that are left
are compared by exact whole numbers, and of equal ones the lowest number wins. Products that overflow leave all in doubt.

Vectors are read once and written as blocks of ids and components; a round is one pass over the blocks, in which
each task adds up its vectors by centroid and gives on k sums. Sums travel as 32-bit limbs, so they are exact at any size and Spark adds
them up; k centroids go back with the next round's tasks. No vector is shuffled.

Defined results: vectors with another width, or a null or non-finite component, are left out; a null id counts as an empty
text in the hash; rows that repeat an id are vectors of their own, those with equal hashes going by their components; with
fewer vectors than k there are as many centroids; extra columns are ignored; distances and inertias beyond 64 bits are shown
as the largest long; without vectors the result is empty.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import Scratch

ROWS = 4096
SCALE = 1024.0
#: Up to this size of components every squared distance of up to 64 components fits 64 bits.
SMALL = 1 << 27
_MOST = (1 << 63) - 1
_BASE = 1 << 32


# --- blocks of vectors ---------------------------------------------------------------------------


def _pack(batches, width: int):
    """Batches of (vec_id, embedding) to rows of ids and components: 32-bit where they fit, else their decimals."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            part = b.slice(k, ROWS)
            x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            with np.errstate(over="ignore"):
                q = np.floor(x * SCALE)
            if np.abs(q).max(initial=0) < 1 << 31:
                small, wide = q.astype("<i4").tobytes(), None
            else:  # 1024 x may be beyond doubles, so by whole numbers
                small, wide = None, " ".join(str(int(a) * 1024 if abs(a) >= 2.0**53 else int(np.floor(a * SCALE))) for a in x.ravel())
            ids = pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([small], pa.binary()), pa.array([wide], pa.string())], ["ids", "small", "wide"])


def _matrix(small: bytes | None, wide: str | None, width: int) -> np.ndarray:
    """Components of a block; Python's whole numbers where 64 bits might not hold what is made of them."""
    if small is not None:
        m = np.frombuffer(small, "<i4").reshape(-1, width).astype(np.int64)
        return m if np.abs(m).max(initial=0) < SMALL and width <= 64 else m.astype(object)
    return np.array([int(a) for a in wide.split(" ")], object).reshape(-1, width)


# --- nearest centroid ----------------------------------------------------------------------------


def _gamma(n: int) -> float:
    u = 2.0**-24
    return n * u / (1 - n * u)


def shortlist(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Which centroids (columns) may be nearest to each row: none that is left out can be."""
    width = x.shape[1]
    if any(np.abs(m).max(initial=0) >= 1 << 120 for m in (x, np.array(centroids, object))):
        return np.ones((len(x), len(centroids)), bool)
    with np.errstate(over="ignore", invalid="ignore"):
        a, c = x.astype(np.float32), np.array(centroids, object).astype(np.float32)
        dot = (a @ c.T).astype(np.float64)
        a, c = x.astype(np.float64), np.array(centroids, object).astype(np.float64)
        # Doubles round up to a relative 2^-40 here, far more than they need.
        up = 1 + 2.0**-40
        length = np.sqrt((a * a).sum(1)) * up
        square = np.array([float(sum(v * v for v in row)) for row in centroids])
        reach = np.sqrt(square) * up
        score = square[None, :] - 2 * dot
        error = 2 * _gamma(width + 2) * length[:, None] * reach[None, :]
        error = (error + 2.0**-48 * (square[None, :] + 2 * np.abs(dot))) * up
        low, high = score - error, score + error
        doubt = ~np.isfinite(low) | ~np.isfinite(high)
        least = np.where(doubt, np.inf, high).min(1)
        return doubt | (low <= least[:, None])


def exact(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid (or to one each), by whole numbers."""
    d = x - centroid
    return (d * d).sum(1)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of each row's nearest centroid, its squared distance, and how many rows needed exact comparison."""
    small = x.dtype != object and all(abs(v) < SMALL for row in centroids for v in row)
    x = x if small else x.astype(object)
    c = np.array(centroids, np.int64 if small else object)
    may = shortlist(x, centroids)
    cluster = may.argmax(1)
    doubtful = np.flatnonzero(may.sum(1) > 1)
    distance = exact(x, c[cluster])
    for k in range(len(centroids)):  # ascending, so that the lowest of equals stays
        rows = doubtful[may[doubtful, k] & (cluster[doubtful] != k)]
        if len(rows):
            d = exact(x[rows], c[k])
            nearer = d < distance[rows]
            distance[rows[nearer]], cluster[rows[nearer]] = d[nearer], k
    return cluster, distance, len(doubtful)


# --- rounds --------------------------------------------------------------------------------------


def limbs(v: int) -> list[int]:
    """Of base 2^32, the lowest first; all but the last are not negative, and the last has the sign."""
    out = []
    while not -(1 << 31) <= v < 1 << 31:
        out.append(v % _BASE)
        v >>= 32
    return [*out, v]


def _sums(batches, centroids: list[list[int]], width: int):
    """(cluster, dim, limb, value): sums of a task's vectors by nearest centroid; dim -1 is their number."""
    k = len(centroids)
    sums, counts = [[0] * width for _ in range(k)], [0] * k
    for b in batches:
        for small, wide in zip(b.column("small").to_pylist(), b.column("wide").to_pylist()):
            x = _matrix(small, wide, width)
            cluster, _, _ = nearest(x, centroids)
            for c in range(k):
                own = x[cluster == c]
                if len(own):  # a block's sums fit 64 bits: 4096 rows below 2^27
                    sums[c] = [a + int(v) for a, v in zip(sums[c], own.sum(0))]
                    counts[c] += len(own)
    rows = [(c, d, n, v) for c in range(k) if counts[c] for d, s in [*enumerate(sums[c]), (-1, counts[c])] for n, v in enumerate(limbs(s)) if v or not n]
    columns = [list(x) for x in zip(*rows)] or [[]] * 4
    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in columns[:3]), pa.array(columns[3], pa.int64())], ["cluster", "dim", "limb", "value"])


def moved(blocks: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """One round: the floored means of the vectors nearest to each centroid; one without vectors stays."""
    parts = blocks.select("small", "wide").mapInArrow(partial(_sums, centroids=centroids, width=width), "cluster int, dim int, limb int, value long")
    sums: dict = {}
    for c, d, n, v in parts.groupBy("cluster", "dim", "limb").agg(F.sum("value")).collect():  # k x (width + 1) x limbs rows
        sums[c, d] = sums.get((c, d), 0) + (v << (32 * n))
    return [[sums[c, d] // sums[c, -1] for d in range(width)] if (c, -1) in sums else row for c, row in enumerate(centroids)]


def _assigned(batches, centroids: list[list[int]], width: int):
    for b in batches:
        for ids, small, wide in zip(*(b.column(c).to_pylist() for c in ("ids", "small", "wide"))):
            cluster, distance, _ = nearest(_matrix(small, wide, width), centroids)
            columns = [pa.array(ids, pa.int64()), pa.array(cluster.astype(np.int32)), pa.array([min(int(d), _MOST) for d in distance], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])


def seeds(kept: DataFrame, k: int) -> list[list[int]]:
    """The k vectors with the least hashes of their ids."""
    mark = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(mark.alias("mark"), "embedding").orderBy("mark", "embedding").limit(k).collect()
    return [[int(v) * 1024 if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in map(float, r["embedding"])] for r in rows]


def cluster_vectors(vectors: DataFrame, k: int = 8, width: int = 64, rounds: int = 10) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    kept = vectors.where((F.size("embedding") == width) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    scratch = Scratch(spark, "centroids")
    blocks = scratch.write(kept.mapInArrow(partial(_pack, width=width), "ids array<long>, small binary, wide string"), "blocks")
    centroids = seeds(kept, k)
    for _ in range(rounds if centroids else 0):
        moves = moved(blocks, centroids, width)
        if moves == centroids:  # every further round would give the same
            break
        centroids = moves
    held = scratch.write(blocks.mapInArrow(partial(_assigned, centroids=centroids, width=width), "vec_id long, cluster int, distance long"), "assigned") if centroids else spark.createDataFrame([], "vec_id long, cluster int, distance long")
    sums = {r[0]: int(r[1]) for r in held.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(c, min(sums.get(c, 0), _MOST), min(sum(sums.values()), _MOST), shas[c]) for c in range(len(shas))]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return held.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
