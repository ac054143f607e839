"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed 3- to 5-byte strings a lower-cased text holds (each once, however
often). On labelled text, r is the log ratio of a feature's smoothed document frequencies
among toxic and other texts; logistic regression is fitted to the features times r. Only
the FEATURES whose frequencies differ most for their standard error take part.

The fit uses at most SAMPLE labelled rows of each label, those whose ids have the least
hashes, and at most SAMPLE_BYTES of their texts (documented bounds); every text is scored whole, from its own bytes alone.

Defined results: null and empty texts score as texts without features; a table without labels
of both kinds scores 0 everywhere; a null id is scored too; a document with more
than one label counts as toxic if one says so; repeated rows and extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.llm.common import lean, small_batches, spare, text_bytes
from skarn.llm.ngrams import ORDERS, distinct_features, logistic
from skarn.llm.samples import sample_texts

BITS, FEATURES, SAMPLE = 20, 10_000, 2000
#: Bytes of sampled texts of a label.
SAMPLE_BYTES = 32 << 20
THRESHOLD = 0.3


@dataclass
class Model:
    weights: np.ndarray | None
    bias: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.weights is None:
            return out
        for first, n, text, feature in distinct_features(texts, ORDERS, BITS, self.weights != 0):
            margin = np.bincount(text, weights=self.weights[feature], minlength=n) + self.bias
            out[first : first + n] = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return out


def fit(texts: list[bytes], labels: np.ndarray, share: float) -> Model:
    """share: of toxic rows among all labelled rows; corrects the bias for the sample's own share."""
    if not len(labels) or labels.min() == labels.max():
        return Model(None)
    counts = np.zeros((2, 1 << BITS), np.float32)
    for i in range(0, len(texts), 64):
        for first, _, text, feature in distinct_features(pa.array(texts[i : i + 64], pa.binary()), ORDERS, BITS):
            toxic = labels[i + first + text] == 1
            for k in (0, 1):
                counts[k] += np.bincount(feature[toxic == k], minlength=1 << BITS)
    totals = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    rates = (counts + 1) / (totals[:, None] + 2)
    ratio = np.log(rates[1] / rates[0])
    error = np.sqrt(rates[0] * (1 - rates[0]) / totals[0] + rates[1] * (1 - rates[1]) / totals[1])
    strength = np.abs(rates[1] - rates[0]) / error
    strength[counts.sum(0) < 3] = 0
    chosen = np.argsort(-strength, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[strength[chosen] > 0])
    column = np.full(1 << BITS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    rows, columns = [], []
    for i in range(0, len(texts), 64):
        for first, _, text, feature in distinct_features(pa.array(texts[i : i + 64], pa.binary()), ORDERS, BITS, column >= 0):
            rows.append((text + i + first).astype(np.int32))
            columns.append(column[feature])
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    w, bias = logistic(rows, columns, ratio[chosen][columns], labels[:, None].astype(float), len(chosen), 1e-4, 150, 0.03)
    weights = np.zeros(1 << BITS)
    weights[chosen] = w[:, 0] * ratio[chosen]
    sampled = totals[1] / totals.sum()
    shift = np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)) if 0 < share < 1 else 0.0
    return Model(weights, float(bias[0] + shift))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on documents that have a label; docs holds only those that may be learned from."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # Only ids travel until the sample is known; texts are then read for those rows alone.
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(marks, "doc_id")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return Model(None)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [r for k in (0, 1) for r in known.where(F.col("toxic") == k).orderBy(*order).limit(sample).collect()]
    kind = T.StructField("toxic", T.IntegerType())
    rows = sample_texts(docs, kind, [tuple(r) for r in ids], ["doc_id"], SAMPLE_BYTES)
    return fit([t for *_, t in rows], np.array([k for _, k, _ in rows]), totals[1] / (totals[0] + totals[1]))


@lean
def _score(batches, model, given: str):
    for b in batches:
        scores = model.value.scores(b.column(given))
        yield b.drop_columns([given]).append_column("score", pa.array(scores)).append_column("predicted", pa.array((scores >= THRESHOLD).astype(np.int32)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with columns score (0 to 1) and predicted (1 if score >= 0.3); any columns of those names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    given = spare(docs, "bytes of text")
    return docs.withColumn(given, text_bytes()).mapInArrow(partial(_score, model=shared, given=given), schema)
