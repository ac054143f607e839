"""An inverted-file index over vectors: cells of a k-means partition as folders, residuals in a byte a component.

The centroids are fitted by Spark's KMeans on a bounded sample (SAMPLE vectors a cell); every vector is then put into its
SPILL nearest cells: as what is left of it beside the centroid, rounded to bytes, and in the first as it came too. A search
finds each question's nearest cells, reads the bytes of these cells alone (other folders are pruned from the scan), keeps `shortlist`
rows a question by the rounded scores, and scores those exactly. How many cells that takes depends on the vectors: after a build,
DRILLS of them ask for their TEN nearest by exact search, and the fewest cells that hold RECALL of those are what later
searches look into. New vectors go to the cells that there are; deleted keys lie in a table of their own until the index is
built again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.text import cosine
from skarn.operators.retrieve import QUESTIONS, nearest, top
from skarn.sources.files import built_once

#: Cells at most, so that centroids fit every task; sampled vectors a cell; cells that a vector is put into.
CELLS, SAMPLE, SPILL = 4096, 256, 2
#: Questions that measure recall after a build, what they ask for, and the recall to reach.
DRILLS, TEN, RECALL = 200, 10, 0.98


def _unit(column: pa.Array, n: int) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    length = np.sqrt((rows * rows).sum(1))
    if column.null_count or not (length > 0).all():
        raise ValueError("a vector is missing or has no length")
    return rows / length[:, None]


def _placed(batches, centroids):
    """Each row once a cell, with the bytes of its residual and their scale, and its first cell as home."""
    c = centroids.value
    half = (c * c).sum(1) / 2
    for b in batches:
        if not b.num_rows:
            continue
        rows = _unit(b.column("embedding"), b.num_rows)
        near = np.argsort(half - rows @ c.T, axis=1, kind="stable")[:, :SPILL].astype(np.int32)
        for k in range(near.shape[1]):
            rest = rows - c[near[:, k]]
            scale = np.abs(rest).max(1, initial=0) / 127
            code = np.round(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            out = b if not k else b.set_column(1, "embedding", pa.nulls(b.num_rows, b.schema.field("embedding").type))
            out = out.append_column("code", pa.array([x.tobytes() for x in code], pa.binary())).append_column("scale", pa.array(scale))
            yield out.append_column("home", pa.array(near[:, 0])).append_column("cell", pa.array(near[:, k]))


def _probed(unit: np.ndarray, centroids: np.ndarray, probes: int) -> dict:
    """Cell by cell which questions look into it, and the product of each with its centroid."""
    score = unit @ centroids.T
    near = np.argsort((centroids * centroids).sum(1) / 2 - score, axis=1, kind="stable")[:, :probes]
    cells, asking = near.ravel(), np.repeat(np.arange(len(unit), dtype=np.int32), near.shape[1])
    order = np.argsort(cells, kind="stable")
    cells, asking = cells[order], asking[order]
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
    parts = np.split(asking, first[1:]) if len(cells) else []
    return {int(cells[a]): (who, score[who, cells[a]].astype(np.float32)) for a, who in zip(first, parts)}


def _rough(batches, key: str, asked, shortlist: int):
    """(query_id, home, key, rough): of each batch the best rows of each question that looks into their cells."""
    every, units, by_cell = asked.value
    for b in batches:
        cells = b.column("cell").to_numpy()
        for cell in np.unique(cells):
            if cell not in by_cell:
                continue
            who, base = by_cell[cell]
            ids, query = every[who], units[who]
            rows = np.flatnonzero(cells == cell)
            code = np.frombuffer(b"".join(b.column("code").take(pa.array(rows)).to_pylist()), np.int8).reshape(len(rows), -1)
            score = base[:, None] + query @ (code.astype(np.float32).T * b.column("scale").to_numpy()[rows].astype(np.float32))
            best = np.argsort(-score, axis=1, kind="stable")[:, :shortlist]
            columns = [pa.array(np.repeat(ids, best.shape[1])), b.column("home").take(pa.array(rows[best.ravel()])), b.column(key).take(pa.array(rows[best.ravel()])), pa.array(np.take_along_axis(score, best, 1).ravel().astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "home", key, "rough"])


@dataclass(frozen=True)
class VectorIndex:
    """An index that was built below root. key: what names a vector."""

    spark: SparkSession
    root: str
    key: str
    kind: str

    def _centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.root}/centroids").orderBy("cell").collect()  # at most CELLS
        return np.array([r["centre"] for r in rows])

    def probes(self) -> int:
        return self.spark.read.parquet(f"{self.root}/probes").first()[0]

    def calibrate(self) -> None:
        """Measures how many cells a question has to look into, by exact search for some of the vectors."""
        rows, centroids = self.rows().where("embedding is not null"), self._centroids()
        some = rows.orderBy(F.xxhash64(self.key)).limit(DRILLS).select("embedding").collect()
        drills = self.spark.createDataFrame([(k, list(r[0])) for k, r in enumerate(some)], "query_id long, query array<double>")
        true = top(nearest(rows, drills, TEN, self.key), TEN, "query_id", F.desc("score"), F.col(self.key))
        cells = self.rows().select(self.key, "cell").join(F.broadcast(true.select("query_id", self.key)), self.key)
        held: dict = {}
        for r in cells.collect():  # DRILLS * TEN * SPILL rows
            held.setdefault((r["query_id"], r[self.key]), []).append(r["cell"])
        unit = np.array([r[0] for r in some], float).reshape(len(some), -1)
        unit /= np.sqrt((unit * unit).sum(1))[:, None]
        order = np.argsort((centroids * centroids).sum(1) / 2 - unit @ centroids.T, axis=1, kind="stable")
        place = np.argsort(order, axis=1)  # of each cell among those of a question
        needed = sorted(min(place[q, c] for c in own) + 1 for (q, _), own in held.items())
        probes = int(needed[math.ceil(RECALL * len(needed)) - 1]) if needed else 1
        self.spark.createDataFrame([(probes,)], "probes int").write.mode("overwrite").parquet(f"{self.root}/probes")

    def add(self, vectors: DataFrame) -> None:
        """Puts further vectors (key, embedding) into the cells. A cell of very many rows is written by several tasks."""
        vectors = vectors.select(self.key, "embedding")
        shared = self.spark.sparkContext.broadcast(self._centroids())
        width = vectors.schema["embedding"].dataType.simpleString()
        placed = vectors.mapInArrow(partial(_placed, centroids=shared), f"{self.key} {self.kind}, embedding {width}, code binary, scale double, home int, cell int")
        placed.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.root}/cells")

    def delete(self, keys: DataFrame) -> None:
        keys.select(self.key).write.mode("append").parquet(f"{self.root}/deleted")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/cells")

    def _deleted(self) -> DataFrame | None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/deleted")
        return self.spark.read.parquet(str(place)) if place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place) else None

    def candidates(self, queries: DataFrame, probes: int | None = None, shortlist: int = 80) -> DataFrame:
        """(query_id, home, key, query): the rows that are worth an exact score. Questions go to the tasks in blocks of QUESTIONS."""
        spark, centroids = self.spark, self._centroids()
        probes = probes or self.probes()
        kind = queries.schema["query_id"].dataType.simpleString()
        blocks, out = max(1, -(-queries.count() // QUESTIONS)), None
        for n in range(blocks):
            part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).select("query_id", "query")
            rows = part.collect()
            unit = np.array([r["query"] for r in rows], np.float64).reshape(len(rows), -1 if rows else centroids.shape[-1])
            length = np.sqrt((unit * unit).sum(1))
            if not (length > 0).all():
                raise ValueError("a vector is missing or has no length")
            unit /= length[:, None]
            by_cell = _probed(unit, centroids, probes)
            # Each question's vector goes to the tasks once; its cells hold its number alone.
            asked = np.array([r["query_id"] for r in rows]), unit.astype(np.float32), by_cell
            held = self.rows().where(F.col("cell").isin(list(by_cell))).select(self.key, "code", "scale", "home", "cell")
            rough = held.mapInArrow(partial(_rough, key=self.key, asked=spark.sparkContext.broadcast(asked), shortlist=shortlist), f"query_id {kind}, home int, {self.key} {self.kind}, rough double")
            rough = rough.groupBy("query_id", "home", self.key).agg(F.max("rough").alias("rough"))
            best = top(rough, shortlist, "query_id", F.desc("rough"), F.col(self.key)).drop("rank", "rough").join(F.broadcast(part), "query_id")
            out = best if out is None else out.union(best)
        gone = self._deleted()
        return out if gone is None else out.join(gone, self.key, "left_anti")

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None, shortlist: int | None = None) -> DataFrame:
        """(query_id, key, score, rank): for each question (query_id, query) its k best vectors by cosine, of those in the cells that it looks into."""
        found = self.candidates(queries, probes, shortlist or max(8 * k, 80))
        kept = self.rows().where("embedding is not null").select(F.col("cell").alias("home"), self.key, "embedding")
        scored = kept.join(found, ["home", self.key]).select("query_id", self.key, F.round(cosine(F.col("embedding"), F.col("query")), 9).alias("score"))
        scored = scored.dropDuplicates(["query_id", self.key])  # an addition may have run twice
        return top(scored, k, "query_id", F.desc("score"), F.col(self.key))


def build(vectors: DataFrame, root: str, key: str = "vec_id", cells: int | None = None, seed: int = 7) -> VectorIndex:
    """Writes the index of vectors (key, embedding) below root. There are twice as many cells as the square root of their number."""
    spark = vectors.sparkSession
    vectors = vectors.select(key, "embedding")
    total = vectors.count()
    cells = cells or min(CELLS, max(1, round(2 * math.sqrt(total))))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = vectors.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double") / length)).alias("features"))
    share = min(1.0, cells * SAMPLE / max(total, 1))
    sample = unit if share == 1 else unit.sample(share, seed)
    centres = KMeans(k=cells, seed=seed, maxIter=10, initMode="random").fit(sample).clusterCenters() if total else []
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{root}/centroids")
    index = VectorIndex(spark, root, key, vectors.schema[key].dataType.simpleString())
    index.add(vectors)
    index.calibrate()
    return index


def index_of(spark: SparkSession, path: str, key: str = "vec_id") -> VectorIndex:
    """The index over a Parquet table of vectors, built once a session and again when the table's files change."""
    return built_once(spark, path, f"vectors {key}", lambda root: build(spark.read.parquet(path), root, key))
