"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are lower-cased (A-Z) and every run of white space becomes one space. A CGK
random walk reads a text from a start: step j emits the byte under the cursor and moves
on by a random bit that depends on j and that byte. Walks of two strings that differ by
few edits fall into step again soon, so edit distance becomes Hamming distance. Each of
REPETITIONS walks keeps SAMPLED of its coordinates as one key. Walks start at every byte of texts and items
alike, so scripts without spaces are read as others are. A walk from a place of the text whose key equals that of an
item's walk is a vote for the item at that offset; votes are counted in bins of offsets as wide as the edits may shift them.

The parameters follow from max_edits e: a walk of s steps meets no edit with a chance of about (1 - e) (1 - e / 2)^(s - 1),
so s is the most steps that leave a chance of CLEAN, and an item of n bytes with a share e of edits
expects REPETITIONS * n * CLEAN votes. Item-sized windows with at least 1 / SLACK of those, or all but SPREAD times
their square root, are candidates. The slack is for edits that lie evenly, so that 0.99 of the items with as many
random edits as max_edits allows are found (tests measure it against brute force); fewer edits leave many times the votes.
Candidates whose pieces of 64 bytes need more edits than the item may have are dropped, and the edit
distance to the best substring around the window decides: at most max_edits of the item's length.

Items of up to SHORT bytes expect too few votes. They are compared with every place of every text by bit vectors, many
windows at a time, after an exact bound on shared 4-byte strings: no such item is ever missed. A longer item has
a walk from each byte but its last few, so it always has keys.

The items are a stated query set: they go to every task in blocks of at most ITEM_BYTES,
so a larger benchmark costs more passes and not more memory. No document is shuffled.

Defined results: null or empty texts and items match nothing; an item of so few bytes that max_edits of
them is less than one edit matches as an exact copy only; a null id is carried; items that repeat an id with another text
are items of their own, those that repeat the text too are one; repeated documents each get their result; extra columns stay.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import LOWER, SPACE, U64, binary_buffer, doc_blocks, lean, small_batches, spare, text_bytes

REPETITIONS, SAMPLED, CLEAN, SLACK, SPREAD = 2, 0.9, 0.1, 7, 4.5
SHORT = 64
ITEM_BYTES = 1 << 20
#: Walks started at a time; their keys stay in the cache.
_WALKS = 1 << 15
_WINDOWS = 1 << 20
#: Bytes of text that one window of the search for short items starts in.
_LANE = 256
_GRAM = 4


def squeezed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case, white space as single spaces; offsets of the texts; where each byte was."""
    space = SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    place = np.flatnonzero(keep)
    out = LOWER[data[place]]
    out[space[place]] = 32
    return out, np.searchsorted(place, offsets), place


@lru_cache
def walks(max_edits: float) -> tuple[np.ndarray, np.ndarray]:
    """The moves of each repetition, step and byte, and which steps are kept, for that share of edits."""
    e = min(max(max_edits, 0.01), 0.9)
    steps = max(4, min(32, 1 + int(np.log(CLEAN / (1 - e)) / np.log(1 - e / 2)))) if CLEAN < 1 - e else 4
    rng = np.random.default_rng(7)
    moves = rng.integers(0, 2, (REPETITIONS, steps, 256)).astype(bool)
    kept = np.stack([np.isin(np.arange(steps), rng.choice(steps, int(np.ceil(SAMPLED * steps)), replace=False)) for _ in range(REPETITIONS)])
    return moves, kept


def walk_keys(data: np.ndarray, n: int, moves: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The sampled coordinates of the walks from the first n bytes as one key each, from the last step back; data has a byte more a step."""
    steps, one = len(kept), np.uint32(1)
    bits = (moves.astype(np.uint32) << np.arange(steps, dtype=np.uint32)[:, None]).sum(0).astype(np.uint32)[data]
    wide, key = data.astype(np.uint32), np.full(n + steps, 7, np.uint32)
    other, moved = np.empty_like(key), np.empty_like(key)
    for j in range(steps - 1, -1, -1):
        m = n + j
        # The key of the next step here or a byte on, chosen by the move's bit without a branch.
        stay, new, bit = key[:m], other[:m], moved[:m]
        np.right_shift(bits[:m], np.uint32(j), out=bit)
        bit &= one
        np.bitwise_xor(key[1 : m + 1], stay, out=new)
        new *= bit
        new ^= stay
        if kept[j]:
            new *= np.uint32(0x9E3779B1)
            new ^= wide[:m]
        key, other = other, key
    key = key[:n]
    key *= np.uint32(0x85EBCA6B)
    return key ^ key >> np.uint32(15)


def walk_ends(data: np.ndarray, n: int, moves: np.ndarray) -> np.ndarray:
    """Where the walks from the first n bytes end."""
    end = np.arange(n + len(moves))
    for j in range(len(moves) - 1, -1, -1):
        end = np.where(moves[j][data[: n + j]], end[1 : n + j + 1], end[: n + j])
    return end


def gram_codes(data: np.ndarray) -> np.ndarray:
    """A 16-bit hash of the 4 bytes from each place; data has 3 bytes more."""
    n = len(data) - _GRAM + 1
    code = data[:n].astype(np.uint32)
    for j in range(1, _GRAM):
        code = code * np.uint32(0x01000193) + data[j : j + n]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16)


class Items:
    """The items' texts and their keys, sorted for lookup."""

    def __init__(self, rows: list[tuple[int, bytes]], max_edits: float = 0.2):
        self.ids, self.texts, self.max_edits, keys, owners, shifts = [], [], max_edits, [], [], []
        self.moves, self.kept = walks(max_edits)
        steps = self.kept.shape[1]
        for item_id, raw in rows:
            data, offsets, _ = squeezed(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            text = data.tobytes().strip()
            if not text:
                continue
            if len(text) > SHORT:
                data = np.frombuffer(text + b" " * steps, np.uint8)
                for r in range(REPETITIONS):
                    starts = np.flatnonzero(walk_ends(data, len(text), self.moves[r]) <= len(text))
                    keys.append(walk_keys(data, len(text), self.moves[r], self.kept[r])[starts].astype(np.uint64) | np.uint64(r << 32))
                    shifts.append(starts)
                    owners.append(np.full(len(starts), len(self.ids)))
            self.ids.append(item_id)
            self.texts.append(text)
        self.short = [k for k, text in enumerate(self.texts) if len(text) <= SHORT]
        self.keys, self.owners, self.shifts = (np.concatenate([*x, np.zeros(0, t)]).astype(t) for x, t in ((keys, U64), (owners, np.int64), (shifts, np.int64)))
        # Sorted by slot: the repetition and the low bits of the key.
        bits = min(22, max(12, int(len(self.keys) * 4).bit_length()))
        self.mask = np.uint32((1 << bits) - 1)
        slot = ((self.keys >> U64(32)) << U64(bits) | self.keys & U64(self.mask)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.owners, self.shifts = self.owners[order], self.shifts[order]
        self.keys = self.keys[order].astype(np.uint32)
        count = np.bincount(slot, minlength=REPETITIONS << bits)
        self.count = count.reshape(REPETITIONS, -1).astype(np.int32)
        self.first = (np.cumsum(count) - count).reshape(REPETITIONS, -1).astype(np.int32)
        size = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.array([int(max_edits * len(t)) for t in self.texts], np.int64)
        expected = REPETITIONS * CLEAN * size
        self.votes = np.maximum(1, np.maximum(expected / SLACK, expected - SPREAD * np.sqrt(expected))).astype(np.int64)
        self.before = max(map(len, self.texts), default=0)
        cuts = [[len(t) * k // -(-len(t) // 64) for k in range(-(-len(t) // 64) + 1)] for t in self.texts]
        self.pieces = np.array([len(c) - 1 for c in cuts], np.int64)
        self.piece = np.cumsum(self.pieces) - self.pieces
        self.cuts = np.array([a for c in cuts for a in c[:-1]], np.int64)
        self.width = np.array([b - a for c in cuts for a, b in zip(c, c[1:])], np.int64)
        self.masks = np.zeros((len(self.width), 256), U64)
        for row, part in enumerate(t[a:b] for t, c in zip(self.texts, cuts) for a, b in zip(c, c[1:])):
            for i, byte in enumerate(part):
                self.masks[row, byte] |= U64(1 << i)

    def voted(self, data: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """item << 40 | offset + self.before of each vote of the walks from data[lo:hi], sorted; data is padded."""
        out, steps = [np.zeros(0, np.int64)], self.kept.shape[1]
        for i in range(lo, hi, _WALKS):
            n = min(_WALKS, hi - i)
            for r in range(REPETITIONS):
                key = walk_keys(data[i : i + n + steps], n, self.moves[r], self.kept[r])
                slot = key & self.mask
                count = self.count[r][slot]
                hit = np.flatnonzero(count)
                count = count[hit]
                skipped = np.cumsum(count) - count
                at = np.repeat(self.first[r][slot[hit]] - skipped, count) + np.arange(count.sum())
                place = np.repeat(hit, count)
                same = self.keys[at] == key[place]
                at, place = at[same], place[same]
                # Offsets may lie before the data; they are counted from there.
                out.append(self.owners[at] << 40 | place + (i + self.before) - self.shifts[at])
        return np.sort(np.concatenate(out))

    def binned(self, votes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item << 40 | bin, votes, least and greatest offset) of sorted votes; a bin is as wide as edits can shift an item."""
        item, offset = votes >> 40, votes & ((1 << 40) - 1)
        bins = item << 40 | offset // (self.most[item] + 1)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]]) if len(bins) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(bins)] - 1 if len(bins) else first
        return bins[first], last - first + 1, offset[first], offset[last]

    def candidates(self, data: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        """(item, first and last place where its start may lie) of the windows with enough votes; data is size bytes and padding."""
        if not len(self.keys):
            return []
        parts = [self.binned(self.voted(data, i, min(size, i + _WINDOWS))) for i in range(0, size, _WINDOWS)]
        bins, votes, least, most = parts[0] if parts else (np.zeros(0, np.int64),) * 4
        if len(parts) > 1:
            bins, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            votes = np.bincount(at, np.concatenate([p[1] for p in parts]), len(bins)).astype(np.int64)
            least, most = np.full(len(bins), 1 << 40), np.zeros(len(bins), np.int64)
            np.minimum.at(least, at, np.concatenate([p[2] for p in parts]))
            np.maximum.at(most, at, np.concatenate([p[3] for p in parts]))
        if not len(bins):
            return []
        # Votes of a bin and the next one: any two places that edits can shift apart lie in such a pair.
        pair = np.r_[bins[1:] == bins[:-1] + 1, False]
        both, top = votes.copy(), most.copy()
        both[:-1] += np.where(pair[:-1], votes[1:], 0)
        top[:-1] = np.where(pair[:-1], most[1:], most[:-1])
        chosen = np.flatnonzero(both >= self.votes[bins >> 40])
        if not len(chosen):
            return []
        good, least, top = bins[chosen], least[chosen], top[chosen]
        # Neighbouring bins are looked at together, up to four of them.
        run = np.cumsum(np.r_[True, np.diff(good) != 1])
        nth = np.arange(len(good)) - np.flatnonzero(np.r_[True, np.diff(run) != 0])[run - 1]
        head = np.flatnonzero(nth % 4 == 0)
        tail = np.r_[head[1:], len(good)] - 1
        # A true vote's offset is off the item's start, and off any of its places, by no more than its edits.
        item = good[head] >> 40
        wide = self.most[item]
        first, last = least[head] - self.before, top[tail] - self.before
        # The pieces of an item have no fewer edits together than the item.
        alive, spent = np.arange(len(item)), np.zeros(len(item), np.int64)
        data = np.concatenate([data[:size], np.zeros(int((last - first + 2 * wide).max()) + 64, np.uint8)])
        for p in range(int(self.pieces.max())):
            more = alive[self.pieces[item[alive]] > p]
            row = self.piece[item[more]] + p
            lo = np.clip(first[more] - wide[more] + self.cuts[row], 0, size)
            hi = np.clip(last[more] + wide[more] + self.cuts[row] + self.width[row], 0, size)
            spent[more] += self.nearest(row, data, lo, hi - lo)
            alive = alive[spent[alive] <= self.most[item[alive]]]
        return list(zip(item[alive].tolist(), first[alive].tolist(), last[alive].tolist()))

    def nearest(self, row: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """The edit distance of a piece of up to 64 bytes to the best substring of data from each start, or less: Myers' bit vectors, one window a lane.

        Windows of about one size run together, each as long as the longest.
        """
        out, one = np.empty(len(row), np.int64), U64(1)
        order = np.argsort(sizes, kind="stable")
        for some in (order[i : i + lanes] for i in range(0, len(order), lanes)):
            masks, base = self.masks.reshape(-1), row[some] * 256
            at = np.minimum(starts[some], len(data) - int(sizes[some[-1]]))
            width = self.width[row[some]]
            top = (width - 1).astype(U64)
            pv, mv = np.full(len(some), (1 << 64) - 1, U64), np.zeros(len(some), U64)
            score = width.copy()
            best = score.copy()
            eq, xh, ph, mh, bit = (np.empty(len(some), U64) for _ in range(5))
            place, byte = np.empty(len(some), np.int64), np.empty(len(some), np.uint8)
            for _ in range(int(sizes[some[-1]])):
                np.take(data, at, out=byte, mode="clip")  # without a check, which would copy
                np.add(base, byte, out=place)
                np.take(masks, place, out=eq, mode="clip")
                at += 1
                np.bitwise_and(eq, pv, out=xh)  # xh = ((eq & pv) + pv ^ pv) | eq
                xh += pv
                xh ^= pv
                xh |= eq
                np.bitwise_or(xh, pv, out=ph)  # ph = mv | ~(xh | pv)
                np.invert(ph, out=ph)
                ph |= mv
                np.bitwise_and(pv, xh, out=mh)
                np.right_shift(ph, top, out=bit)
                bit &= one
                score += bit.view(np.int64)
                np.right_shift(mh, top, out=bit)
                bit &= one
                score -= bit.view(np.int64)
                eq |= mv  # now xv
                ph <<= one
                mh <<= one
                np.bitwise_or(eq, ph, out=pv)  # pv = mh | ~(xv | ph)
                np.invert(pv, out=pv)
                pv |= mh
                np.bitwise_and(ph, eq, out=mv)
                np.minimum(best, score, out=best)
            out[some] = best
        return out

    def lanes(self, data: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        """The same for short items: exact, by windows of _LANE starts."""
        out: list[tuple[int, int, int]] = []
        if not self.short or not size:
            return out
        starts = np.arange(0, size, _LANE)
        data = np.concatenate([data[:size], np.zeros(_LANE + 2 * SHORT + _GRAM, np.uint8)])
        codes = gram_codes(data)
        for k in self.short:
            text, most = self.texts[k], int(self.most[k])
            m, chosen = len(text), starts
            if (shared := m - _GRAM + 1 - _GRAM * most) > 0:
                # Each edit changes at most 4 of an item's strings of 4 bytes; the rest is in the window.
                known = np.zeros(1 << 16, np.int32)
                known[gram_codes(np.frombuffer(text, np.uint8))] = 1
                count = np.concatenate([[0], np.cumsum(known[codes], dtype=np.int64)])
                window = count[np.minimum(starts + _LANE + m + most, len(codes))] - count[starts]
                chosen = starts[window >= shared]
            distance = self.nearest(np.full(len(chosen), self.piece[k]), data, chosen, np.full(len(chosen), _LANE + m + most))
            out += [(k, at, at + _LANE) for at in chosen[distance <= most].tolist()]
        return out


def best_substring(pattern: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """(distance, end) of the substring of text nearest to pattern, by Myers' bit vectors; None beyond most."""
    m, masks = len(pattern), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (most + 1, -1)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += (ph & top != 0) - (mh & top != 0)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


def _matches(data: np.ndarray, offsets: np.ndarray, items: Items, max_edits: float):
    """(text, item, distance, start, stop) of the best match of each item in each text."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    size = len(data)
    padded = np.concatenate([data, np.full(items.kept.shape[1], 32, np.uint8)])
    for item, first, last in items.candidates(padded, size) + items.lanes(data, size):
        pattern = items.texts[item]
        most = int(max_edits * len(pattern))
        lo, hi = max(0, first - most), min(size, last + len(pattern) + most)
        if lo >= hi:
            continue
        for text in range(int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))):
            a, b = max(lo, int(offsets[text])), min(hi, int(offsets[text + 1]))
            if b - a < len(pattern) - most or (text, item) in found and found[text, item][0] == 0:
                continue
            region = data[a:b].tobytes()
            if (k := region.find(pattern)) >= 0:
                new = (0, a + k, a + k + len(pattern))
            elif most and (end := best_substring(pattern, region, most)):
                back = best_substring(pattern[::-1], region[: end[1]][::-1], most)
                new = (end[0], a + end[1] - back[1], a + end[1])
            else:
                continue
            found[text, item] = min(new, found.get((text, item), new))
    return [(text, item, *x) for (text, item), x in sorted(found.items())]


def _hits(texts: pa.Array, items: Items, max_edits: float):
    raw, cuts = binary_buffer(texts)
    for i, j in doc_blocks(cuts, _WINDOWS):
        data, offsets, place = squeezed(raw[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i])
        for text, item, distance, start, stop in _matches(data, offsets, items, max_edits) if len(data) else ():
            base = int(cuts[i + text] - cuts[i])
            yield i + text, items.ids[item], distance, int(place[start]) - base, int(place[stop - 1]) + 1 - base


@lean
def _report(batches, items, max_edits: float):
    for b in batches:
        rows = list(_hits(b.column("text"), items.value, max_edits))
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "item_id", "distance", "start", "stop"])


@lean
def _clean(batches, items, max_edits: float, given: str):
    for b in batches:
        bad = {row for row, *_ in _hits(b.column(given), items.value, max_edits)}
        yield b.drop_columns([given]).filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))


def item_blocks(benchmark: DataFrame, max_edits: float, most: int = ITEM_BYTES):
    """Broadcasts of the items in blocks of about `most` bytes: one block unless the benchmark is larger.

    The driver holds one block at a time.
    """
    small_batches(benchmark.sparkSession)
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // most))
    rows = benchmark.select(F.col("item_id").cast("long"), text_bytes().alias("text"))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        items = Items([(r[0], bytes(r[1])) for r in rows.where(block == k).distinct().collect()], max_edits)
        yield benchmark.sparkSession.sparkContext.broadcast(items)


def contamination(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2) -> DataFrame:
    """(doc_id, item_id, distance, start, stop): each item's best match in each text; places are bytes of the text."""
    texts, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")), None
    schema = "doc_id long, item_id long, distance long, start long, stop long"
    for items in item_blocks(benchmark, max_edits):
        part = texts.mapInArrow(partial(_report, items=items, max_edits=max_edits), schema)
        out = part if out is None else out.union(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2) -> DataFrame:
    """The rows of docs, columns unchanged, that hold no item."""
    given = spare(docs, "bytes of text")
    for items in item_blocks(benchmark, max_edits):
        rows = docs.withColumn(given, text_bytes())
        docs = rows.mapInArrow(partial(_clean, items=items, max_edits=max_edits, given=given), docs.schema)
    return docs
