"""Language ID by error-correcting output codes.

Each language has a codeword; each bit has a binary logistic classifier over the relative
frequencies of hashed 2- to 4-byte strings of a lower-cased text. Decoding takes the
codeword with the least loss, each bit's loss weighted by how well that bit's classifier did in
training; a text whose two best codewords lie within MARGIN of each other is ambiguous.

The fit uses at most SAMPLE rows of each language, those whose ids have the least hashes, and of their
texts at most SAMPLE_BYTES (documented bounds); every language of a row with an id is learned, and every text is read
whole. N-grams end with their text, so a score depends on the text alone.

Defined results: a null text or one without a letter is `und` with score 0; without
learned languages all are; a null id is kept; repeated rows and extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.llm.common import small_batches, spare, text_bytes
from skarn.llm.ngrams import blocks, hashed, logistic
from skarn.llm.samples import sample_texts

BITS, SAMPLE, MARGIN = 15, 300, 0.1
#: Bytes of sampled texts; each language may use an even share.
SAMPLE_BYTES = 64 << 20
ORDERS = (2, 3, 4)
SCALE = 30.0
#: The feature of no n-gram, and the units of a weight.
BLANK, ONE = 1 << BITS, 1 << 20


def codewords(n: int) -> np.ndarray:
    """n codewords of 0 and 1: all distinct splits for up to 5 languages, else random ones of 10 log2 n bits."""
    if n <= 1:
        return np.zeros((n, 1), np.int8)
    if n <= 5:
        return np.array([[(k >> (n - 1 - i) & 1) if i else 0 for k in range(1, 1 << (n - 1))] for i in range(n)], np.int8)
    rng = np.random.default_rng(n)

    def nearest(c: np.ndarray) -> int:
        signs = (2 * c - 1).astype(np.float32)
        alike = signs @ signs.T
        np.fill_diagonal(alike, -c.shape[1])
        return int(c.shape[1] - alike.max()) // 2

    best = max((rng.integers(0, 2, (n, int(np.ceil(10 * np.log2(n))))) for _ in range(50)), key=nearest)
    return best[:, (best.min(0) != best.max(0))].astype(np.int8)


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The feature of the n-gram from each byte; BLANK where it would reach into the next text."""
    h = hashed(data, order, BITS)
    at = offsets[1:, None] - np.arange(1, order)
    at = at[(at >= offsets[:-1, None]) & (at < len(h))]
    h[at] = BLANK
    return h


def gram_counts(offsets: np.ndarray) -> np.ndarray:
    """How many n-grams each text has."""
    return sum(np.maximum(np.diff(offsets) - order + 1, 0) for order in ORDERS)


def frequencies(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """For each text the sum over its n-grams of weights[feature], divided by their number.

    weights are whole numbers, so that a sum does not depend on where a batch or block begins.
    """
    weights = np.vstack([weights, np.zeros((1, weights.shape[1]), weights.dtype)])
    out = np.zeros((len(texts), weights.shape[1]))
    for first, data, offsets in blocks(texts):
        total = np.zeros((len(offsets) - 1, weights.shape[1]), np.int64)
        for order in ORDERS:
            h = grams(data, offsets, order)
            for lo in range(0, len(h), 1 << 16):
                part = weights[h[lo : lo + (1 << 16)]]
                a, b = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, lo + len(part), "left")
                cuts = np.maximum(offsets[a:b] - lo, 0)
                total[a:b] += np.add.reduceat(part, cuts, axis=0, dtype=np.int64)
        n = np.maximum(gram_counts(offsets), 1)
        out[first : first + len(n)] = total / n[:, None] / ONE
    return out


def whole(weights: np.ndarray) -> np.ndarray:
    """Weights in whole units of 1 / ONE."""
    return np.rint(np.clip(weights, -1000, 1000) * ONE).astype(np.int32)


@dataclass
class Model:
    names: list[str] = field(default_factory=list)
    codes: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    trust: np.ndarray | None = None

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Names, scores from 0 to 1, and whether a text is ambiguous."""
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        margin = np.clip(frequencies(texts, self.weights) + self.bias, -30, 30)
        one, zero = (self.trust * np.log1p(np.exp(-margin * s)) for s in (1.0, -1.0))
        loss = np.stack([np.where(c, one, zero).sum(1) for c in self.codes.astype(bool)], 1) / self.trust.sum()
        chance = np.exp(loss.min(1, keepdims=True) - loss)
        chance /= chance.sum(1, keepdims=True)
        ordered = np.sort(loss, 1)
        close = ordered[:, 1] - ordered[:, 0] < MARGIN if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return [self.names[k] for k in loss.argmin(1)], chance.max(1), close


def fit(texts: list[bytes], langs: list[str]) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model()
    codes = codewords(len(names))
    rows, columns, values = [], [], []
    for i in range(0, len(texts), 64):
        for first, data, offsets in blocks(pa.array(texts[i : i + 64], pa.binary())):
            keys = []
            for order in ORDERS:
                h = grams(data, offsets, order)
                at = np.flatnonzero(h != BLANK)
                keys.append((np.searchsorted(offsets, at, "right") - 1).astype(np.int64) << BITS | h[at])
            pairs, count = np.unique(np.concatenate(keys), return_counts=True)
            text = pairs >> BITS
            rows.append((text + i + first).astype(np.int32))
            columns.append((pairs & ((1 << BITS) - 1)).astype(np.int32))
            values.append((count * SCALE / np.maximum(gram_counts(offsets), 1)[text]).astype(np.float32))
    rows, columns, values = (np.concatenate(x) for x in (rows, columns, values))
    place = {x: i for i, x in enumerate(names)}
    targets = codes[[place[x] for x in langs]].astype(float)
    w, bias = logistic(rows, columns, values, targets, 1 << BITS, 1e-5, 60, 0.05)
    weights = whole(w * SCALE)
    margins = frequencies(pa.array(texts, pa.binary()), weights) + bias
    right = ((margins > 0) == (targets > 0.5)).mean(0)
    return Model(names, codes, weights, bias, np.log((right + 0.01) / (1.01 - right)).clip(0.01))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on docs' text and lang; docs holds only rows that may be learned from."""
    known = docs.where("lang is not null and doc_id is not null").withColumn("lang", F.col("lang").cast("string"))
    ids = known.select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("h"))
    # Of a language with n ids, the sample lies among those whose hash is in the first 4 * sample / n of all hashes:
    # some 4 * sample of them, fewer than the sample with no chance worth naming. Only these are ranked.
    sizes = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.05).alias("n"))
    near = F.col("h") / 2.0**64 + 0.5 < 4.0 * sample / F.col("n")
    ids = ids.join(F.broadcast(sizes), "lang").where(near).select("lang", "doc_id", "h").distinct()
    ids = ids.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("at") <= sample)
    ids = sorted(tuple(r) for r in ids.select("lang", "at", "doc_id").distinct().collect())
    if not ids:
        return Model()
    share = SAMPLE_BYTES // len({lang for lang, *_ in ids})
    rows = sample_texts(known, T.StructField("lang", T.StringType()), [(i, lang) for lang, _, i in ids], ["doc_id", "lang"], share)
    return fit([t for *_, t in rows], [lang for _, lang, _ in rows])


def _identify(batches, model, given: list[str]):
    for b in batches:
        names, scores, close = model.value.predict(b.column(given[0]))
        letters = b.column(given[1]).to_pylist()
        names = [n if ok else "und" for n, ok in zip(names, letters)]
        scores = np.where(np.array(letters, bool), scores, 0.0)
        out = b.drop_columns(given)
        for name, values in (("lang_pred", pa.array(names, pa.string())), ("score", pa.array(scores, pa.float64())), ("ambiguous", pa.array(close & np.array(letters, bool), pa.bool_()))):
            out = out.append_column(name, values)
        yield out


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs with columns lang_pred, score and ambiguous; any columns of those names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    given = [spare(docs, "bytes of text"), spare(docs, "has letters")]
    rows = docs.withColumn(given[0], text_bytes()).withColumn(given[1], letters)
    return rows.mapInArrow(partial(_identify, model=shared, given=given), schema)
