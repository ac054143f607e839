"""Fingerprints, centroid clustering and conversation repair against plain versions, with nulls, ties, repeats and clashing names."""

import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skarn.llm import centroids, conversation_repair, fingerprints
from tests.llm.conftest import ROWS, prose

# --- 11 ------------------------------------------------------------------------------------------


def entropy_level(window, scale):
    """From counts, by whole numbers as the operator has them."""
    total = sum(int(scale.gain[1 : c + 1].sum()) for c in Counter(window).values())
    top = int(scale.gain.sum())
    return (top - total) * (fingerprints.LEVELS - 1) // top


def plain_features(text, ranks):
    """Features of a text by plain loops over its windows."""
    out = []
    for scale, rank in zip(fingerprints.SCALES, ranks):
        w = scale.window
        if len(text) >= scale.below or len(text) < w:
            continue
        key = [(rank[entropy_level(text[i : i + w], scale)], i) for i in range(len(text) - w + 1)]
        votes = Counter(min(key[max(i, 0) : i + w])[1] for i in range(1 - w, len(key)))
        out += [text[i : i + w] for i in range(len(key)) if votes[i] >= scale.votes]
    return out or ([text] if text else [])


def hash_of(piece):
    return int(fingerprints._hashes(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]))[0])


def plain_digest(text, ranks):
    seen, chain = [], []
    for piece in plain_features(text, ranks):
        if piece in seen:
            continue
        if len(seen) % fingerprints.FILL == 0:
            chain.append(0)
        seen.append(piece)
        for k in range(fingerprints.HASHES):
            bit = hash_of(piece) >> (11 * k) & 2047
            chain[-1] |= 1 << (2047 - bit)
    return b"".join(x.to_bytes(256) for x in chain)


def plain_ranks(texts):
    out = []
    for scale in fingerprints.SCALES:
        counts = Counter(entropy_level(t[i : i + scale.window], scale) for t in texts if len(t) < scale.below for i in range(len(t) - scale.window + 1))
        order = sorted(range(fingerprints.LEVELS), key=lambda k: (counts[k], k))
        out.append(np.array([order.index(k) for k in range(fingerprints.LEVELS)]))
    return out


def descending(rows):
    """Ids fall, none comes last; which of equal ids is first is the hash's affair."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def test_levels_follow_the_entropy():
    r = random.Random(5)
    for scale in fingerprints.SCALES:
        text = bytes(r.choice(b"abcdefghij  ") for _ in range(300)) + b"a" * 50
        found = fingerprints.levels(np.frombuffer(text, np.uint8), scale)
        assert [entropy_level(text[i : i + scale.window], scale) for i in range(len(text) - scale.window + 1)] == found.tolist()
        h = lambda t: -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values())
        want = [h(text[i : i + scale.window]) / math.log2(scale.window) for i in range(len(text) - scale.window + 1)]
        assert np.allclose(found / (fingerprints.LEVELS - 1), want, atol=2 / fingerprints.LEVELS)


def test_fingerprints_are_those_of_plain_loops(spark, docs, monkeypatch):
    texts = [(t or "").encode() for _, t in ROWS]
    ranks = plain_ranks(texts)
    assert all((a == b).all() for a, b in zip(ranks, fingerprints.rarities(docs)))
    want = [plain_digest(t, ranks) for t in texts]
    assert fingerprints.digests(texts, ranks) == want
    monkeypatch.setattr(fingerprints, "BLOCK", 37)  # pieces that cut texts
    assert fingerprints.digests(texts, ranks) == want
    marked = fingerprints.fingerprints(docs, ranks)
    assert marked.columns == [*docs.columns, "fingerprint"]
    assert {(r["row"], base64.b64decode(r["fingerprint"])) for r in marked.collect()} == set(enumerate(want))
    assert want[5] == b"" and all(w for w, t in zip(want, texts) if t)


def test_edited_neighbours(spark, docs):
    ranks = plain_ranks([(t or "").encode() for _, t in ROWS])
    out = [r.asDict() for r in fingerprints.edited_neighbours(docs).collect()]
    assert len(out) == len(ROWS)
    ids = [i for i, _ in ROWS]
    once = [k for k, r in enumerate(descending(ROWS)) if ids.count(r[0]) == 1]
    order, by_id = descending(ROWS), {r["doc_id"]: r for r in out}
    for k in once:
        (i, text), after = order[k], order[(k + 1) % len(order)]
        if ids.count(after[0]) > 1 and len({t for j, t in ROWS if j == after[0]}) > 1:
            continue  # which of them follows depends on the hash
        text, r, n = text or "", by_id[i], len(text or "") // 3
        new = (text[: len(text) - n] + (after[1] or "")[:n]).encode()
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new).hexdigest()
        own, changed, following = (plain_digest(t, ranks) for t in (text.encode(), new, (after[1] or "").encode()))
        assert base64.b64decode(r["fingerprint"]) == own and base64.b64decode(r["edited_fingerprint"]) == changed
        assert r["near_edited"] == fingerprints.likeness(own, changed) and r["near_next"] == fingerprints.likeness(own, following)
    assert len({r["fingerprint"] for r in out if r["doc_id"] in (1, 2)}) == 1


def test_edited_neighbours_over_many_partitions(spark):
    rows = [(k, prose(k, 30 + k % 7)) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {r["doc_id"]: r for r in fingerprints.edited_neighbours(table).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(out) == 300
    for k, text in rows:
        n, after = len(text) // 3, rows[k - 1][1]
        assert out[k]["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()
        assert out[k]["near_edited"] > 0.3 > out[k]["near_next"]


def test_likeness_bounds(spark, no_docs):
    assert fingerprints.likeness(b"", b"") == 1 and fingerprints.likeness(b"", b"\x01" * 256) == 0
    full = b"\xff" * 256
    assert fingerprints.likeness(full, full) == 1 and 0 <= fingerprints.likeness(full, b"\x01" * 512) <= 1
    assert fingerprints.edited_neighbours(no_docs).count() == 0
    one = spark.createDataFrame([(5, "only this text, which is its own next one")], "doc_id long, text string")
    assert fingerprints.edited_neighbours(one).first()["near_next"] == 1


# --- 12 ------------------------------------------------------------------------------------------


def floor_scaled(x, scale=1024):
    from fractions import Fraction

    return math.floor(Fraction(float(x)) * scale)


def plain_clusters(rows, k, width, rounds):
    kept = [(i, [floor_scaled(x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cs = [v for _, v in sorted(kept, key=mark)[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((d(v, c), n) for n, c in enumerate(cs))[::-1]
    for _ in range(rounds):
        members = [[] for _ in cs]
        for _, v in kept:
            members[near(v)[0]].append(v)
        cs = [[sum(col) // len(m) for col in zip(*m)] if m else c for m, c in zip(members, cs)]
    last = [(i, *near(v)) for i, v in kept]
    cap = lambda x: min(x, (1 << 63) - 1)
    inertia = Counter()
    for _, c, x in last:
        inertia[c] += cap(x)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, c, cap(x), cap(inertia[c]), cap(sum(inertia.values())), sha[c]) for i, c, x in last), key=repr)


def vector_rows(seed, n, width, spread=1.0):
    r = random.Random(seed)
    base = [[r.uniform(-spread, spread) for _ in range(width)] for _ in range(5)]
    return [(k, [x + r.gauss(0, 0.2 * spread) for x in r.choice(base)]) for k in range(n)]


ODD = [(900, None), (901, [0.5] * 7), (902, [float("nan")] + [0.0] * 7), (903, [None] + [0.0] * 7), (904, [float("inf")] + [0.0] * 7), (None, [0.25] * 8), (3, [1.0] * 8), (3, [1.0] * 8)]


@pytest.mark.parametrize("spread", [1.0, 1e6, 1e18, 1e40, 1e300])
def test_clusters_are_those_of_whole_numbers(spark, spread):
    rows = vector_rows(7, 300, 8, spread) + ODD
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "'x' as distance").repartition(3)
    out = centroids.cluster_vectors(table, 6, 8, 4)
    assert sorted(map(tuple, out.collect()), key=repr) == plain_clusters(rows, 6, 8, 4)


def test_ties_go_to_the_lowest_number():
    x = np.array([[0, 0], [2, 0], [1, 5]], np.int64)
    assert centroids.nearest(x, [[1, 0], [1, 0], [-1, 0]])[0].tolist() == [0, 0, 0]
    assert centroids.nearest(x, [[-1, 0], [1, 0]])[0].tolist() == [0, 1, 1]


def test_intervals_never_lose_the_nearest():
    r = np.random.default_rng(3)
    for size in (5, 1000, 1 << 26, 1 << 40):
        centre = [int(v) for v in r.integers(-size, size, 64)]
        # Centroids that differ in their last digits only, beyond what single precision can tell.
        cs = [[v + int(d) for v, d in zip(centre, r.integers(-1, 2, 64))] for _ in range(8)]
        x = np.array([[v + int(d) for v, d in zip(centre, r.integers(-2, 3, 64))] for _ in range(200)], object if size >= 1 << 27 else np.int64)
        cluster, distance, doubtful = centroids.nearest(x, cs)
        plain = [min((sum((int(a) - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs)) for v in x.tolist()]
        assert [(int(d), int(c)) for d, c in zip(distance, cluster)] == plain
        assert doubtful > 0
    far = np.array([[0] * 64, [10_000] * 64], np.int64)
    assert centroids.nearest(far, [[1] * 64, [9000] * 64])[2] == 0  # clear cases need no second look


def test_limbs_add_up():
    for v in (0, 1, -1, 1 << 31, -(1 << 31), -(1 << 31) - 1, 10**40, -(10**40)):
        assert sum(x << (32 * k) for k, x in enumerate(centroids.limbs(v))) == v


def test_clusters_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert {(r["vec_id"], r["distance"]) for r in centroids.cluster_vectors(few, 8, 2).collect()} == {(1, 0), (2, 0)}
    none = centroids.cluster_vectors(few.limit(0), 8, 2)
    assert none.count() == 0 and none.columns[0] == "vec_id"


# --- 13 ------------------------------------------------------------------------------------------


def damaged_rows(rows):
    """(conv_id, turn, role, text) after the drill's damage."""
    text = lambda v: " " if v is None else str(v)
    for c, t, role, body in rows:
        code = zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20
        role, body = text(role), text(body)
        if code == 0:
            continue
        body = "" if code == 1 else "".join(x for x in body if x not in ".!?") if code == 2 else body
        yield from [(c, t, "user" if code == 4 else role, body)] * (2 if code == 3 else 1)


def ordered(rows):
    digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))


WHITE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows):
    """The least (cost, audit) by a search over whole audits; only where there are many rows, the first way to a place and state is the only one."""
    import heapq

    many = len(rows) > 6

    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    faults = faults_of(rows)
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:  # by cost, then audit: the first end is the answer
        cost, audit, k, state, lines = heapq.heappop(heap)
        if k == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(lines)
        if (place := (k, state) if many else (cost, audit, k, state)) in done:
            continue
        done.add(place)
        for role in ("user", "assistant"):
            if (state, role[0]) in step and not audit.endswith("III"):
                heapq.heappush(heap, (cost + 5, audit + "I", k, step[state, role[0]], (*lines, f"{role}:")))
        if k < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, state, lines))
            _, _, own, text = rows[k]
            if faults[k] in (1, 2):
                continue
            extra = 5 if faults[k] == 3 else 0
            if (state, own[:1]) in step:
                heapq.heappush(heap, (cost + extra, audit + "K", k + 1, step[state, own[:1]], (*lines, f"{own}:{text}")))
            for role in ("user", "assistant"):
                if (state, role[0]) in step:
                    heapq.heappush(heap, (cost + extra + 1, audit + "R", k + 1, step[state, role[0]], (*lines, f"{role}:{text}")))


def plain_repair(rows, damage=True):
    out = []
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        own = ordered(damaged_rows(own) if damage else [(i, t, " " if role is None else role, " " if x is None else x) for i, t, role, x in own])
        faults, turns = faults_of(own), [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = cheapest(own)
        out.append((c, min(gaps, (1 << 63) - 1), *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = r.choice(["Yes.", "No!", "Yes.", "cut off", "", None, " \t\n", "Is it so? \n", "é.", "…", f"text {r.randrange(5)}."])
            rows.append((c, r.choice([t, t, t, None, t // 2, t * 3]), role, text))
    return rows + [(None, 1, "user", "Who?"), (None, 2, "assistant", "I."), (None, None, "system", "Be brief."), (n, -(1 << 63), "user", "a."), (n, (1 << 63) - 1, "assistant", "b.")]


def conversation_table(spark, rows, parts=3):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return table.selectExpr("*", "1 as n", "true as gone", "'x' as fault", "0 as part").repartition(parts)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_repair_of_damaged_conversations(spark):
    rows = conversations(4, 60)
    table = conversation_table(spark, rows)
    assert collected(conversation_repair.repair(conversation_repair.damaged(table))) == plain_repair(rows)
    assert collected(conversation_repair.repair(conversation_repair.whole(table))) == plain_repair(rows, damage=False)


@pytest.mark.parametrize("partitions", ["1", "23"])
def test_repair_over_blocks_and_partitions(spark, monkeypatch, partitions):
    r = random.Random(9)
    long = [(7, t, r.choice(["user", "assistant", "system"]), r.choice([f"text {t}.", "cut", "same.", ""])) for t in range(60)]
    rows = conversations(8, 20) + long + [(7, 30, "user", "thrice.")] * 3
    monkeypatch.setattr(conversation_repair, "BLOCK", 4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = conversation_repair.whole(conversation_table(spark, rows))
        assert collected(conversation_repair.repair(table)) == plain_repair(rows, damage=False)
        blocks = conversation_repair.repair(table, texts=True).orderBy("conv_id", "part", "no").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    texts = {}
    for b in blocks:
        texts.setdefault(b["conv_id"], []).extend(f"{x['role']}:{x['text']}" for x in b["lines"])
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in texts.items()} == {r[0]: r[-1] for r in plain_repair(rows, damage=False)}


def test_matrices_multiply_to_the_whole_pass():
    r = random.Random(2)
    for _ in range(200):
        lines = [(r.choice(["user", "assistant", "system", "x"]), "", r.choice([0, 0, 1, 2, 3]), r.choice([1, 1, 1, 3])) for _ in range(r.randrange(1, 12))]
        cut = r.randrange(len(lines) + 1)
        both = conversation_repair.product(conversation_repair.matrix(lines[:cut]), conversation_repair.matrix(lines[cut:]))
        once = conversation_repair.matrix(lines)
        assert [conversation_repair.best(v) for v in both[:1]] == [conversation_repair.best(v) for v in once[:1]]
        assert all(a == b for v, w in itertools.zip_longest(both, once) for a, b in zip(v, w))


def test_repair_of_nothing(spark):
    empty = conversation_table(spark, []).limit(0)
    assert conversation_repair.repair(conversation_repair.damaged(empty)).count() == 0
    lost = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    out = conversation_repair.repair(conversation_repair.damaged(conversation_table(spark, [(1, lost, "user", "Hi.")]))).collect()
    assert [tuple(r) for r in out] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert pa.types.is_string(conversation_repair._arrow(conversation_repair._STATS).field("first_role").type)
