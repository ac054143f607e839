"""Hashed character n-grams of whole texts, and linear classifiers over them, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from skarn.llm.common import binary_buffer, doc_blocks
from skarn.llm.decontaminate import squeezed

ORDERS = (3, 4, 5)
#: Entries of the sparse rows that a step of the fit works on at a time.
_PART = 1 << 19


def hashed(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The feature of the n-gram that starts at each byte but the last order - 1."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    code = data[:n].astype(np.uint32) + np.uint32(order * 0x51ED27)
    for j in range(1, order):
        code *= np.uint32(0x01000193)
        code ^= data[j : j + n]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - bits)).view(np.int32)


def blocks(texts: pa.Array):
    """(first text, bytes, offsets): squeezed texts with a space on either side, a few at a time."""
    raw, cuts = binary_buffer(texts)
    for i, j in doc_blocks(cuts):
        data, offsets, _ = squeezed(raw[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i])
        n = j - i
        out = np.full(len(data) + 2 * n, 32, np.uint8)
        text = np.repeat(np.arange(n), np.diff(offsets))
        out[np.arange(len(data)) + 2 * text + 1] = data
        yield i, out, offsets + 2 * np.arange(n + 1)


def distinct_features(texts: pa.Array, orders: tuple[int, ...], bits: int, wanted: np.ndarray | None = None):
    """(text, feature) pairs, each once; of the features wanted only."""
    for first, data, offsets in blocks(texts):
        n, keys = len(offsets) - 1, []
        for order in orders:
            h = hashed(data, order, bits)
            at = np.flatnonzero(wanted[h]) if wanted is not None else np.arange(len(h))
            text = np.searchsorted(offsets, at, "right") - 1
            inside = at + order <= offsets[text + 1]
            keys.append(text[inside].astype(np.int64) << bits | h[at[inside]])
        pairs = np.unique(np.concatenate(keys)) if keys and n else np.zeros(0, np.int64)
        yield first, n, pairs >> bits, (pairs & ((1 << bits) - 1)).astype(np.int32)


def logistic(text: np.ndarray, column: np.ndarray, value: np.ndarray, targets: np.ndarray, width: int, l2: float, steps: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights [width, outputs] and biases of logistic regressions on sparse rows, by Adam on all rows.

    targets holds 0 or 1 for each row and output. The same input gives the same model.
    """
    rows, outputs = targets.shape
    text, column, value = text.astype(np.int32), column.astype(np.int32), value.astype(np.float32)
    parts = [slice(i, i + _PART) for i in range(0, len(text), _PART)]
    w, bias = np.zeros((width, outputs)), np.log((targets.mean(0) + 1e-3) / (1 - targets.mean(0) + 1e-3))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(bias), np.zeros_like(bias)]
    for step in range(1, steps + 1):
        margins = np.tile(bias, (rows, 1))
        for k in range(outputs):
            for p in parts:
                margins[:, k] += np.bincount(text[p], weights=value[p] * w[column[p], k], minlength=rows)
        error = (1 / (1 + np.exp(-np.clip(margins, -40, 40))) - targets) / rows
        gradient = l2 * w
        for k in range(outputs):
            for p in parts:
                gradient[:, k] += np.bincount(column[p], weights=value[p] * error[text[p], k], minlength=width)
        for x, g, m, v in ((w, gradient, moments[0], moments[1]), (bias, error.sum(0), moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, bias
