"""LM scoring by subword lattice likelihood: all segmentations of a text, weighted by unigram scores.

A word is a space and its lower-cased bytes; a text is its words and one end. Every piece
of an existing vocabulary that matches somewhere is an edge of the word's lattice; single
bytes match everywhere. A forward recursion in log space sums over all paths, so a text's
score is its marginal log10 probability. The weights of pieces are the vocabulary's own scores: those of a unigram
model are log weights; a merge model, such as the only sentencepiece file at hand, holds ranks, which become
1 / (100 + rank), as the frequencies of ranked pieces fall. From there ROUNDS of expectation maximisation, each a pass over a table of
them, fit the weights to all distinct learned words, of whatever length: each counts once, as the words that only pieces can spell are new
ones. Beside them each word that was learned is one more edge, over the
whole word and weighted by how often it was met: a token's probability is K c / N for that edge and 1 - K for all paths over
pieces, with K = N / (N + V'), V' being the number of distinct learned words; the end likewise.
So probabilities of all tokens sum to 1 at most, and known words cost what their counts say. No word is cut: a long one takes
the same recursion with a window of as many places as the longest piece has bytes.

Beside it stands the base: add-one unigrams of whole words. Their counts cover the corpus:
words with a share above 1 / 2**17 are broadcast (there are no more than 2**17 of them); all other words travel once, as packets for ranges of word hashes with
each text's count inside, so that the task that counts a word also hands each batch of texts its
shares, which meet again as one row a batch and bucket. No word's packets hold more than 2**-17 of all learned tokens.

Defined results: null and empty texts are one end; null ids count as an empty text for the split; repeated
rows each count and are scored; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import LOWER, U64, Scratch, binary_buffer, crc_mod, lean, powers, small_batches, span_hashes, text_bytes, word_spans
from skarn.llm.common import BYTE_HASH as _BYTE

HOT_BITS = 16
#: How often the weights of pieces are fitted, what share stays with the weights before, and how many words a task of a round has.
ROUNDS, _KEPT, _FITTED = 5, 0.02, 1 << 16
PAIRS_A_BUCKET = 2_000_000
#: Words that one step of the recursion works on.
_ROWS = 1 << 14
#: Longer words are read by a window, so many at a time and so many places at a time.
_WHOLE, _LONG, _PLACES = 64, 64, 128
#: Places of longer words that a fit holds at a time; a word of more stands alone.
_HELD = 1 << 20


@dataclass
class Vocabulary:
    """Pieces as byte strings in a hash table of as many layers as its fullest place needs, their log weights (natural), and the end's."""

    hashes: np.ndarray
    slots: np.ndarray
    longest: int
    weights: np.ndarray
    end: float

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, or the last number, whose weight is minus infinity."""
        flat = h.ravel()
        at = (flat * U64(0x9E3779B97F4A7C15) >> U64(44)).astype(np.int64)
        out = np.full(len(flat), len(self.hashes), np.int32)
        some = np.flatnonzero(self.slots[0][at] >= 0)  # a place that the first layer leaves free has no piece in the others
        at, flat = at[some], flat[some]
        for slot in self.slots:
            k = slot[at]
            hit = (k >= 0) & (self.hashes[k] == flat)
            out[some[hit]] = k[hit]
        return out.reshape(h.shape)


def _spell(piece: bytes) -> int:
    """The un-mixed polynomial hash of a piece."""
    up, _ = powers(len(piece))
    return int((_BYTE[np.frombuffer(piece, np.uint8)] * up).sum(dtype=U64))


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces of a sentencepiece model. Scores of a unigram model are log weights; those of a merge model are ranks and become 1 / (rank + 100)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).trainer_spec
    scores: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:]:
                scores[piece] = model.get_score(i)
    ranks = kind.model_type == kind.BPE
    weight = {p: 1 / (100 - s) if ranks else float(np.exp(s)) for p, s in scores.items()}
    least = min(weight.values(), default=1.0)
    for b in range(256):
        weight.setdefault(bytes([b]), least)
    hashes = np.array([_spell(p) for p in weight], U64)
    slots, rest = [], np.arange(len(hashes))
    at = (hashes * U64(0x9E3779B97F4A7C15) >> U64(44)).astype(np.int64)
    while len(rest):  # a layer takes the first piece of each place, the next one those that are left
        _, first = np.unique(at[rest], return_index=True)
        layer = np.full(1 << 20, -1, np.int32)
        layer[at[rest[first]]] = rest[first]
        slots.append(layer)
        rest = np.delete(rest, first)
    total = sum(weight.values()) * 1.1
    return Vocabulary(hashes, np.array(slots), max(map(len, weight)), np.append(np.log(np.array([*weight.values()]) / total), -np.inf), float(np.log(0.1 / 1.1)))


class Words:
    """The distinct words of a batch: token by token which word it is, of which text."""

    def __init__(self, texts: pa.Array):
        data, offsets = binary_buffer(texts)
        self.data, self.n = LOWER[data], len(offsets) - 1
        starts, ends = word_spans(self.data, offsets)
        self.hashes, first, self.word = np.unique(span_hashes(self.data, starts, ends), return_index=True, return_inverse=True)
        self.starts, self.lengths = starts[first], (ends - starts)[first]
        self.text = np.searchsorted(offsets, starts, "right") - 1
        self.tokens = np.bincount(self.text, minlength=self.n) + 1


def _piece_ids(text: np.ndarray, ends: np.ndarray, widest: int, vocab: Vocabulary) -> np.ndarray:
    """ids[row, end, length] of the pieces that end at the given places of each row of bytes, up to widest long."""
    up, down = powers(text.shape[1] + 1)
    prefix = np.zeros((len(text), text.shape[1] + 1), U64)
    np.cumsum(_BYTE[text] * up[: text.shape[1]], axis=1, out=prefix[:, 1:])
    ids = np.full((len(text), len(ends), widest + 1), len(vocab.hashes), np.int32)
    for n in range(1, widest + 1):
        some = ends[ends >= n]
        ids[:, len(ends) - len(some) :, n] = vocab.ids((prefix[:, some] - prefix[:, some - n]) * down[some - n])
    return ids


def _summed(terms: np.ndarray) -> np.ndarray:
    """Log of the sum of each row's weights."""
    top = terms.max(1)
    return top + np.log(np.exp(terms - top[:, None]).sum(1))


def _lattices(words: Words, chosen: np.ndarray, vocab: Vocabulary):
    """(word, ids[row, end, length]) of rows of equal length: the bytes of words behind a space."""
    lo, length = words.starts[chosen] - 1, words.lengths[chosen] + 1
    order = np.argsort(length, kind="stable")
    for m in np.unique(length):
        rows = order[np.searchsorted(length[order], m, "left") : np.searchsorted(length[order], m, "right")]
        for i in range(0, len(rows), step := max(1, _ROWS * 8 // int(m))):
            part = rows[i : i + step]
            text = words.data[np.maximum(lo[part][:, None] + np.arange(m), 0)]
            text[:, 0] = 32
            yield chosen[part], _piece_ids(text, np.arange(m + 1), min(int(m), vocab.longest), vocab)


def _forward(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log of the weight of all paths from the start to each place."""
    rows, places, widest = ids.shape
    alpha = np.full((rows, places), -np.inf)
    alpha[:, 0] = 0
    for j in range(1, places):
        n = np.arange(1, min(j, widest - 1) + 1)
        alpha[:, j] = _summed(alpha[:, j - n] + weights[ids[:, j, n]])
    return alpha


def _flow(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """shares[row, end, length]: how often a row's paths take each piece, as expected. The share at a place flows back to those that its paths come from."""
    rows, places, widest = ids.shape
    alpha, flow, shares = _forward(ids, weights), np.zeros((rows, places)), np.zeros(ids.shape)
    flow[:, -1] = 1
    for j in range(places - 1, 0, -1):
        n = np.arange(1, min(j, widest - 1) + 1)
        shares[:, j, n] = flow[:, j, None] * np.exp(alpha[:, j - n] + weights[ids[:, j, n]] - alpha[:, j, None])
        flow[:, j - n] += shares[:, j, n]
    return shares


def _times(words: Words, vocab: Vocabulary) -> np.ndarray:
    """How often each piece is used, as expected over all segmentations of each distinct word."""
    times = np.zeros(len(vocab.weights))
    for _, ids in _lattices(words, np.flatnonzero(words.lengths < _WHOLE), vocab):
        times += np.bincount(ids.ravel(), weights=_flow(ids, vocab.weights).ravel(), minlength=len(times))
    long = np.flatnonzero(words.lengths >= _WHOLE)
    long = long[np.argsort(-words.lengths[long], kind="stable")]
    while len(long):
        step = int(np.clip(_HELD // (words.lengths[long[0]] + 1), 1, _LONG))
        times += _long_times(words, long[:step], vocab)
        long = long[step:]
    return times


def _long_times(words: Words, chosen: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The same for words of any length; longest first. The places' shares and logs are held, the pieces of a block alone."""
    lo, length, widest = words.starts[chosen] - 1, words.lengths[chosen] + 1, vocab.longest
    back, times = np.arange(1, widest + 1), np.zeros(len(vocab.weights))
    blocks = range(0, int(length.max()), _PLACES)
    alpha = np.full((len(chosen), widest + len(blocks) * _PLACES + 1), -np.inf)
    alpha[:, widest] = 0
    for at in blocks:
        ids = _block_ids(words, lo, at, vocab)
        for b in range(_PLACES):
            end = widest + at + b + 1
            alpha[:, end] = _summed(alpha[:, end - back] + vocab.weights[ids[:, b, back]])
    flow = np.zeros_like(alpha)
    flow[np.arange(len(chosen)), widest + length] = 1
    for at in reversed(blocks):
        ids = _block_ids(words, lo, at, vocab)
        shares = np.zeros(ids.shape)
        for b in reversed(range(_PLACES)):
            end = widest + at + b + 1
            shares[:, b, back] = flow[:, end, None] * np.exp(alpha[:, end - back] + vocab.weights[ids[:, b, back]] - alpha[:, end, None])
            flow[:, end - back] += shares[:, b, back]
        times += np.bincount(ids.ravel(), weights=shares.ravel(), minlength=len(times))
    return times


def _refitted(vocab: Vocabulary, times: np.ndarray, first: np.ndarray) -> Vocabulary:
    """The vocabulary with weights by how often pieces are used; a share stays with the first ones."""
    learned = times[:-1] / times[:-1].sum() / 1.1
    return replace(vocab, weights=np.append(np.log((1 - _KEPT) * learned + _KEPT * np.exp(first[:-1])), -np.inf))


def fitted(vocab: Vocabulary, texts: list[bytes]) -> Vocabulary:
    """The vocabulary with weights that fit these words, each a text of its own."""
    words = Words(pa.array(texts, pa.binary()))
    first = vocab.weights
    for _ in range(ROUNDS if len(words.hashes) else 0):
        vocab = _refitted(vocab, _times(words, vocab), first)
    return vocab


@lean
def _expected(batches, vocab):
    """(piece, n): how often the words of a task use each piece."""
    vocab = vocab.value
    times = np.zeros(len(vocab.weights))
    for b in batches:
        times += _times(Words(b.column("word")), vocab)
    used = np.flatnonzero(times)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(times[used])], ["piece", "n"])


def fitted_to(vocab: Vocabulary, words: DataFrame) -> Vocabulary:
    """The same for a table of distinct words (word), of which no task or driver holds more than its part."""
    first = vocab.weights
    for _ in range(ROUNDS):
        sent = words.sparkSession.sparkContext.broadcast(vocab)
        used = words.select("word").mapInArrow(partial(_expected, vocab=sent), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        if not len(used):
            break
        vocab = _refitted(vocab, np.bincount(used.piece.to_numpy(), weights=used.n.to_numpy(), minlength=len(first)), first)
        sent.destroy()
    return vocab


def _block_ids(words: Words, lo: np.ndarray, at: int, vocab: Vocabulary) -> np.ndarray:
    """ids[row, place, length] of the pieces that end at _PLACES places behind place `at` of words that begin at lo, with a space there."""
    place = np.arange(at - vocab.longest, at + _PLACES)
    text = words.data[np.clip(lo[:, None] + place, 0, len(words.data) - 1)]
    text[:, place == 0] = 32
    return _piece_ids(text, np.arange(vocab.longest + 1, vocab.longest + _PLACES + 1), vocab.longest, vocab)


def _rolled(words: Words, chosen: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Log probability of words of any length; longest first. Only the places that a piece can reach back to are held."""
    lo, length, widest = words.starts[chosen] - 1, words.lengths[chosen] + 1, vocab.longest
    out = np.zeros(len(chosen))
    back = np.arange(1, widest + 1)
    # Column widest is the place that the block starts from; those before it are the places behind.
    alpha = np.full((len(chosen), widest + _PLACES + 1), -np.inf)
    alpha[:, widest] = 0
    for at in range(0, int(length.max()), _PLACES):
        live = int((length > at).sum())
        ids = _block_ids(words, lo[:live], at, vocab)
        for b in range(_PLACES):
            end = widest + 1 + b
            alpha[:live, end] = _summed(alpha[:live, end - back] + vocab.weights[ids[:, b, back]])
        done = np.flatnonzero((length[:live] > at) & (length[:live] <= at + _PLACES))
        out[done] = alpha[done, widest + length[done] - at]
        alpha[:, : widest + 1] = alpha[:, _PLACES:]
    return out


def word_scores(words: Words, vocab: Vocabulary) -> np.ndarray:
    """Log probability (natural) of each distinct word."""
    out = np.zeros(len(words.hashes))
    for owner, ids in _lattices(words, np.flatnonzero(words.lengths < _WHOLE), vocab):
        out[owner] = _forward(ids, vocab.weights)[:, -1]
    long = np.flatnonzero(words.lengths >= _WHOLE)
    long = long[np.argsort(-words.lengths[long], kind="stable")]
    for i in range(0, len(long), _LONG):
        out[long[i : i + _LONG]] = _rolled(words, long[i : i + _LONG], vocab)
    return out


@lean
def _gather(batches):
    """(word, n): the words of each batch with their counts; a null word has the number of texts, which is that of ends."""
    for b in batches:
        words = Words(b.column("text"))
        times = np.bincount(words.word, minlength=len(words.hashes))
        offsets = np.r_[0, np.cumsum(words.lengths)]
        data = words.data[np.repeat(words.starts - offsets[:-1], words.lengths) + np.arange(offsets[-1])]
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(times), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([spelled.cast(pa.binary()), pa.array(times.astype(np.int64))], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([words.n], pa.int64())], ["word", "n"])


def _pass(texts: DataFrame, bits: int, scratch: Scratch):
    """Hot words with their counts, tokens and texts learned from, how many distinct words there are, and a table of them all (word)."""
    counted = scratch.write(texts.select("text").mapInArrow(_gather, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    words = counted.where("word is not null")
    total = counted.agg(F.sum("n"), F.sum(F.expr("if(word is null, n, 0)")), F.count("word")).first()
    tokens, ends, kinds = (int(x or 0) for x in total)
    hot = words.where(F.col("n") >= tokens / (2 << bits)).toArrow()
    data, offsets = binary_buffer(hot["word"].cast(pa.binary()))
    hashes, times = span_hashes(data, offsets[:-1], offsets[1:]), hot["n"].to_numpy().astype(np.float64)
    order = np.argsort(hashes)
    # Files of so many words each, which Spark deals over all cores.
    every = scratch.write(words.select("word").repartition(max(1, -(-kinds // _FITTED))), "words")
    scratch.drop("counts")
    return hashes[order], times[order], tokens, ends, kinds, every


def _mixed(counts: np.ndarray, pieces: np.ndarray, tokens: int, kinds: int) -> np.ndarray:
    """log10 of the probability of tokens learned so many times, whose paths over pieces have these log weights."""
    with np.errstate(divide="ignore"):
        whole = np.log(counts) - np.log(tokens + max(kinds, 1))
    return np.logaddexp(whole, pieces + np.log(max(kinds, 1)) - np.log(tokens + max(kinds, 1))) / np.log(10)


@lean
def _score(batches, vocab, hot, buckets: int, tokens: int, ends: int, kinds: int):
    """A row for each text (bucket -1), and packets of its other words for each bucket."""
    vocab, (hot_words, hot_counts) = vocab.value, hot.value
    base_row = TaskContext.get().partitionId() << 36
    z, end = zstandard.ZstdCompressor(level=1), _mixed(np.array([ends]), np.array([vocab.end]), tokens, kinds)[0]
    for b in batches:
        words, held = Words(b.column("text")), b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        per_word = word_scores(words, vocab)
        at = np.minimum(np.searchsorted(hot_words, words.hashes), max(len(hot_words) - 1, 0))
        is_hot = hot_words[at] == words.hashes if len(hot_words) else np.zeros(len(words.hashes), bool)
        times = np.where(is_hot, hot_counts[at], 0) if len(hot_words) else np.zeros(len(words.hashes))
        mine = is_hot[words.word]
        known = np.bincount(words.text[mine], weights=times[words.word[mine]] > 0, minlength=words.n)
        base = np.bincount(words.text[mine], weights=np.log10(times[words.word[mine]] + 1), minlength=words.n)
        mixed = _mixed(times, per_word, tokens, kinds)
        score = np.bincount(words.text[mine], weights=mixed[words.word[mine]], minlength=words.n) + end
        rows = base_row + np.arange(words.n)
        base_row += words.n
        empty = pa.nulls(words.n, pa.binary())
        facts = [pa.array(np.full(words.n, -1, np.int32)), pa.array(rows), b.column("doc_id"), b.column("held_out")]
        numbers = [pa.array(words.tokens.astype(np.int64)), *(pa.array(np.asarray(x, np.float64)) for x in (known, base, score))]
        yield pa.RecordBatch.from_arrays([*facts, *numbers, empty], _COLUMNS)
        pairs, count = np.unique(words.word[~mine].astype(np.int64) * words.n + words.text[~mine], return_counts=True)
        word, text = pairs // max(words.n, 1), pairs % max(words.n, 1)
        bucket = (words.hashes[word] >> U64(32)) * U64(buckets) >> U64(32)
        out = []
        # Words and so buckets ascend; only the buckets that the batch has words of are visited.
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
            own, inverse = np.unique(word[lo:hi], return_inverse=True)
            arrays = (
                np.array([len(own), hi - lo, words.n], "<i8"),
                words.hashes[own],
                per_word[own].astype("<f8"),
                np.bincount(inverse).astype("<u4"),
                text[lo:hi].astype("<u4"),
                count[lo:hi].astype("<u4"),
                np.packbits(~held),
            )
            out.append((int(bucket[lo]), int(rows[0]), z.compress(b"".join(a.tobytes() for a in arrays))))
        if out:
            ks, firsts, packets = zip(*out)
            n = len(out)
            types = [pa.int64(), pa.bool_(), pa.int64(), *[pa.float64()] * 3]
            given = [pa.array(ks, pa.int32()), pa.array(firsts, pa.int64()), *(pa.nulls(n, k) for k in types)]
            yield pa.RecordBatch.from_arrays([*given, pa.array(packets, pa.binary())], _COLUMNS)


_COLUMNS = ["bucket", "row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "packet"]


def _count(table: pa.Table, tokens: int, kinds: int) -> pa.Table:
    """Counts the words of a bucket in learned texts, and gives each batch of texts its share of base and score: (row, distinct, shares)."""
    z, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor().decompress
    hashes, pieces, texts, times, learned = [], [], [], [], []
    for packet in table["packet"].to_pylist():
        data = unpack(packet)
        n, pairs, size = np.frombuffer(data, "<i8", 3).tolist()
        own, paths = np.frombuffer(data, "<u8", n, 24), np.frombuffer(data, "<f8", n, 24 + 8 * n)
        at = 24 + 16 * n
        each, text, count = (np.frombuffer(data, "<u4", k, at + 4 * s) for k, s in ((n, 0), (pairs, n), (pairs, n + pairs)))
        flags = np.unpackbits(np.frombuffer(data, np.uint8, -1, at + 4 * (n + 2 * pairs)), count=size).astype(bool)
        hashes.append(np.repeat(own, each))
        pieces.append(np.repeat(paths, each))
        texts.append(text)
        times.append(count)
        learned.append(flags[text])
    distinct, word = np.unique(np.concatenate(hashes), return_inverse=True)
    told = np.concatenate(learned)
    counts = np.bincount(word[told], weights=np.concatenate(times)[told], minlength=len(distinct))
    shares, at = [], 0
    for text, count, paths in zip(texts, times, pieces):
        c = counts[word[at : at + len(text)]]
        at += len(text)
        own, inverse = np.unique(text, return_inverse=True)
        known, base = np.bincount(inverse, weights=count * (c > 0)), np.bincount(inverse, weights=count * np.log10(c + 1))
        score = np.bincount(inverse, weights=count * _mixed(c, paths, tokens, kinds))
        shares.append(z.compress(own.astype("<u4").tobytes() + known.astype("<u4").tobytes() + base.astype("<f8").tobytes() + score.astype("<f8").tobytes()))
    number = np.zeros(len(shares), np.int64)
    number[0] = (counts > 0).sum()
    return pa.table({"row": table["row"], "distinct": pa.array(number), "shares": pa.array(shares, pa.binary())})


def _sum(table: pa.Table) -> pa.Table:
    """(row, more, added, gained): what all buckets together give each text of one batch."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts, known, base, score = [], [], [], []
    for share in table["shares"].to_pylist():
        data = unpack(share)
        n = len(data) // 24
        texts.append(np.frombuffer(data, "<u4", n))
        known.append(np.frombuffer(data, "<u4", n, 4 * n))
        base.append(np.frombuffer(data, "<f8", n, 8 * n))
        score.append(np.frombuffer(data, "<f8", n, 16 * n))
    own, inverse = np.unique(np.concatenate(texts), return_inverse=True)
    known, base, score = (np.bincount(inverse, weights=np.concatenate(x)).astype(np.float64) for x in (known, base, score))
    return pa.table({"row": pa.array(table["row"][0].as_py() + own.astype(np.int64)), "more": pa.array(known), "added": pa.array(base), "gained": pa.array(score)})


def lattice_scores(docs: DataFrame, vocabulary: str, modulus: int = 7, remainder: int = 2, hot_bits: int = HOT_BITS) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch, share = Scratch(spark, "lattice"), spark.sparkContext.broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", modulus) == remainder).alias("held_out"), text_bytes().alias("text"))
    hot, times, tokens, ends, kinds, words = _pass(texts.where("not held_out"), hot_bits, scratch)
    vocab = fitted_to(load_vocabulary(vocabulary), words)
    scratch.drop("words")
    rest = max(1, int(tokens - times.sum()))
    buckets = max(1, -(-rest // PAIRS_A_BUCKET))
    schema = "bucket int, row long, doc_id long, held_out boolean, n_tokens long, known double, base double, score double, packet binary"
    score = partial(_score, vocab=share(vocab), hot=share((hot, times)), buckets=buckets, tokens=tokens, ends=ends, kinds=kinds)
    both = scratch.write(texts.mapInArrow(score, schema), "scored")
    counted = both.where("bucket >= 0").select("bucket", "row", "packet").groupBy("bucket").applyInArrow(lambda t: _count(t, tokens, kinds), "row long, distinct long, shares binary")
    counted = scratch.write(counted, "counted")
    distinct = int(counted.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]) + int((times > 0).sum()) + (1 if ends else 0)
    end_known, end_base = float(ends > 0), float(np.log10(ends + 1))
    parts = counted.select("row", "shares").groupBy("row").applyInArrow(_sum, "row long, more double, added double, gained double")
    rows = both.where("bucket = -1").drop("bucket", "packet").join(parts, "row", "left")
    known = (F.col("known") + F.coalesce("more", F.lit(0.0)) + end_known).cast("long")
    base = F.col("base") + F.coalesce("added", F.lit(0.0)) + end_base - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))
    return rows.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("gained", F.lit(0.0))).alias("score"))
