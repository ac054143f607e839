"""Toxicity scores and language decoding recomputed gram by gram, in plain loops."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from skarn.llm import decontaminate, language_id, toxicity
from skarn.llm.ngrams import hashed


def squeeze(t):
    return b" " + decontaminate.squeezed(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tobytes() + b" "


def grams(t, orders, bits):
    """The features of a text's grams, repeats included."""
    data = squeeze(t)
    return [int(hashed(np.frombuffer(data[k : k + n], np.uint8), n, bits)[0]) for n in orders for k in range(len(data) - n + 1)]


def texts_of(seed, n):
    r = random.Random(seed)
    nice, rude = ["kind", "words", "help", "you", "the"], ["vile", "scum", "you", "the"]
    labels = [k % 3 == 0 for k in range(n)]
    return [" ".join(r.choices(rude if bad else nice, k=r.randrange(1, 7))).encode() for bad in labels], np.array(labels, int)


def test_toxicity_equals_a_plain_fit():
    texts, labels = texts_of(1, 60)
    share = 0.1
    model = toxicity.fit(texts, labels, share)
    sets = [set(grams(t, toxicity.ORDERS, toxicity.BITS)) for t in texts]
    totals = [int((labels == k).sum()) for k in (0, 1)]
    held = [{}, {}]
    for s, k in zip(sets, labels):
        for g in s:
            held[k][g] = held[k].get(g, 0) + 1
    ratio, strength = {}, {}
    for g in set(held[0]) | set(held[1]):
        counts = [held[k].get(g, 0) for k in (0, 1)]
        rates = [(counts[k] + 1) / (totals[k] + 2) for k in (0, 1)]
        ratio[g] = math.log(rates[1] / rates[0])
        error = math.sqrt(sum(rates[k] * (1 - rates[k]) / totals[k] for k in (0, 1)))
        strength[g] = abs(rates[1] - rates[0]) / error if sum(counts) >= 3 else 0
    # Fewer features than the model may have: all that tell the labels apart are in it.
    chosen = sorted(g for g in strength if strength[g] > 1e-6)
    assert len(chosen) < toxicity.FEATURES and set(np.flatnonzero(model.weights)) <= {g for g in strength if strength[g] > 0}
    x = np.array([[ratio[g] if g in s else 0.0 for g in chosen] for s in sets])
    w, bias = np.zeros(len(chosen)), math.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))
    m, v, mb, vb = np.zeros(len(chosen)), np.zeros(len(chosen)), 0.0, 0.0
    for step in range(1, 151):
        error = (1 / (1 + np.exp(-(x @ w + bias))) - labels) / len(labels)
        g, gb = x.T @ error + 1e-4 * w, error.sum()
        m, v, mb, vb = m + 0.1 * (g - m), v + 0.01 * (g * g - v), mb + 0.1 * (gb - mb), vb + 0.01 * (gb * gb - vb)
        w = w - 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= 0.03 * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    sampled = totals[1] / sum(totals)
    bias += math.log(share / (1 - share)) - math.log(sampled / (1 - sampled))
    for t in [*texts, b"", b"you vile kind", b"zzz"]:
        s = set(grams(t, toxicity.ORDERS, toxicity.BITS))
        margin = bias + sum(wk * ratio[g] for wk, g in zip(w, chosen) if g in s)
        assert model.scores(pa.array([t], pa.binary()))[0] == pytest.approx(1 / (1 + math.exp(-margin)), abs=2e-3)


@pytest.mark.parametrize("languages", [1, 2, 4, 7])
def test_languages_are_decoded_by_the_nearest_codeword(languages):
    r = random.Random(languages)
    alphabets = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "abef"][:languages]
    made = lambda letters: "".join(r.choice(letters + " ") for _ in range(40)).encode()
    names = [f"l{k}" for k in range(languages) for _ in range(12)]
    model = language_id.fit([made(alphabets[int(n[1:])]) for n in names], names)
    texts = [made(a) for a in alphabets for _ in range(4)] + [b"", b"a", b"ae im qu", made("abcdefghijkl")]
    got, scores, close = model.predict(pa.array(texts, pa.binary()))
    # Codewords differ from one another, and no bit is the same for all languages.
    codes = [tuple(int(b) for b in c) for c in model.codes]
    assert len(set(codes)) == languages and (languages == 1 or all(len(set(bit)) == 2 for bit in zip(*codes)))
    for n, t in enumerate(texts):
        found = grams(t, language_id.ORDERS, language_id.BITS)
        margins = []
        for bit in range(len(codes[0])):
            total = sum(int(model.weights[g][bit]) for g in found) / max(len(found), 1) / language_id.ONE
            margins.append(min(max(total + float(model.bias[bit]), -30), 30))
        # A bit's loss is that of its classifier for the codeword's bit, weighted by how far the bit is trusted.
        loss = [sum(float(q) * math.log1p(math.exp(-m if c else m)) for q, m, c in zip(model.trust, margins, code)) / float(sum(model.trust)) for code in codes]
        best = min(range(languages), key=lambda k: loss[k])
        order = sorted(loss)
        assert languages > 1 and order[1] - order[0] < 1e-9 or got[n] == model.names[best]
        assert scores[n] == pytest.approx(1 / sum(math.exp(loss[best] - x) for x in loss), abs=1e-6)
        if languages > 1 and abs(order[1] - order[0] - language_id.MARGIN) > 1e-6:
            assert close[n] == (order[1] - order[0] < language_id.MARGIN)
    assert [got[k] for k in range(4 * languages)] == [f"l{k}" for k in range(languages) for _ in range(4)] or languages == 7
