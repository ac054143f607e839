"""Each operator against brute force on small fixtures with nulls, empties, ties, repeats and clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from skarn.llm import decontaminate, language_id, lattice_lm, license_scan, max_score, neardup, packing, substring_dedup, toxicity, warc_fixity
from skarn.llm.common import Scratch, crc_mod, salted_join
from skarn.llm.components import components
from tests.llm.conftest import ROWS, prose

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return (text or "").encode().translate(LOWER).split()


# --- 1 -------------------------------------------------------------------------------------------


def edit_distance(pattern, text):
    """Of the pattern to the nearest substring, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        last, row = row, [0]
        for i, p in enumerate(pattern):
            row.append(min(last[i] + (p != c), last[i + 1] + 1, row[-1] + 1))
        best = min(best, row[-1])
    return best


def test_best_substring_is_the_edit_distance():
    r = random.Random(3)
    for _ in range(60):
        p, t = (bytes(r.choice(b"abc") for _ in range(r.randrange(1, 90))) for _ in range(2))
        assert decontaminate.best_substring(p, t, len(p))[0] == edit_distance(p, t)
    assert decontaminate.best_substring(b"abcdef", b"zzzzzz", 2) is None


def mutated(text, share, seed):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else r.choice([w + "s", w[1:], w.upper(), "other"]) for w in text.split(" "))


def test_contamination_finds_edited_items_and_nothing_else(spark):
    items = [(k, prose(500 + k, 20 + k)) for k in range(20)] + [(90, None), (91, ""), (92, "short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    planted = [(k, prose(k, 30) + "\n" + mutated(t, 0.1, k) + " " + prose(k + 50, 30)) for k, t in items[:20]]
    clean = [(100 + k, prose(900 + k, 150)) for k in range(30)] + [(200, None), (201, ""), (None, "x " + items[0][1])]
    docs = spark.createDataFrame(planted + clean, "doc_id long, text string").repartition(3)
    got = decontaminate.contamination(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(20)} | {(None, 0)}
    texts = dict(planted)
    for r in got:
        if r.doc_id is not None:
            squeezed = b" ".join(texts[r.doc_id].encode().translate(LOWER).split())
            item = b" ".join(dict(items)[r.item_id].encode().translate(LOWER).split())
            assert r.distance == edit_distance(item, squeezed)
            part = b" ".join(texts[r.doc_id].encode()[r.start : r.stop].translate(LOWER).split())
            assert edit_distance(item, part) == r.distance
    assert decontaminate.decontaminated(docs, bench).count() == 32
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0


def test_contamination_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (2000,))
    bench = spark.createDataFrame([(k, prose(500 + k, 30)) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(k, prose(500 + k, 30)) for k in range(30)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()) == [(k, k) for k in range(30)]


def test_contamination_recall():
    found = total = 0
    for share in (0.05, 0.1):
        for k in range(100):
            item = prose(3000 + k, 14 + k % 30)
            items = decontaminate.Items([(0, item.encode())])
            text = (prose(k, 20) + " " + mutated(item, share, k) + " " + prose(k + 9, 20)).encode()
            data, offsets, _ = decontaminate.squeezed(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            if edit_distance(items.texts[0], data.tobytes()) <= 0.2 * len(items.texts[0]):
                total += 1
                found += bool(decontaminate._matches(data, offsets, items, 0.2))
    assert found >= 0.98 * total and total > 150


def edited(text, edits, r):
    out = bytearray(text)
    for _ in range(edits):
        at, kind = r.randrange(len(out)), r.randrange(3)
        out[at : at + (kind > 0)] = bytes([r.randrange(97, 123)] * (kind < 2))
    return bytes(out)


def leaks(item, text):
    """(found, there): what the operator says of one item in one text, and the comparison with every place of it."""
    items = decontaminate.Items([(0, item)])
    data, offsets, _ = decontaminate.squeezed(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    pattern = b" ".join(item.translate(LOWER).split())
    best = decontaminate.best_substring(pattern, data.tobytes(), int(0.2 * len(pattern)))
    got = decontaminate._matches(data, offsets, items, 0.2)
    assert not got or best and got[0][2] == best[0]
    return bool(got), best is not None


def test_contamination_recall_up_to_the_most_edits():
    r, found, there = random.Random(8), {}, {}
    for share in (0.1, 0.15, 0.18, 0.2):
        for k in range(100):
            item = prose(4000 + k, 9 + k % 30).encode()
            if k % 4 == 0:  # a script without spaces
                item = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(30 + k % 40)).encode()
            text = prose(k, 20).encode() + edited(item, int(share * len(item)), r) + prose(k + 9, 20).encode()
            got, true = leaks(item, text)
            found[share] = found.get(share, 0) + got
            there[share] = there.get(share, 0) + true
    assert min(there.values()) >= 95 and all(found[s] >= 0.99 * there[s] for s in there), (found, there)


def test_contamination_misses_no_short_or_unspaced_item():
    r = random.Random(9)
    for n in range(1, 100):
        words = prose(5000 + n, 30).encode()
        unspaced = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(34)).encode()
        for source in (words[r.randrange(20) :], unspaced):
            item = source[:n].strip().decode(errors="ignore").encode()
            if not item:
                continue
            edits = int(0.2 * len(item))
            around = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(300)).encode()
            assert leaks(item, around + item + around) == (True, True)
            if len(item) <= decontaminate.SHORT:
                got, there = leaks(item, around + edited(item, edits, r) + around)
                assert got == there


def test_contamination_keeps_short_matches_within_a_text(spark):
    docs = spark.createDataFrame([(1, "xx ab"), (2, "cd yy"), (3, "zabcdz"), (4, "")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(7, "AbCd"), (8, " "), (9, None)], "item_id long, text string")
    assert [tuple(x) for x in decontaminate.contamination(docs, bench).collect()] == [(3, 7, 0, 1, 5)]


# --- 2 -------------------------------------------------------------------------------------------


def brute_spans(texts, depth):
    seen = Counter(t[p : p + depth] for t in texts for p in range(len(t) - depth + 1))
    return [substring_dedup.merged([(p, p + depth) for p in range(len(t) - depth + 1) if seen[t[p : p + depth]] > 1]) for t in texts]


def test_substring_dedup_is_exact(docs, no_docs):
    got = defaultdict(list)
    for r in substring_dedup.substring_dedup(docs, digest=True).collect():
        got[r.row.row] = r
    texts = [(t or "").encode() for _, t in ROWS]
    for k, (t, spans) in enumerate(zip(texts, brute_spans(texts, 200))):
        kept = b"".join(t[a:b] for a, b in zip([0, *(x[1] for x in spans)], [*(x[0] for x in spans), len(t)]))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans) == (len(t), sum(b - a for a, b in spans), len(spans))
        assert got[k].kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert substring_dedup.substring_dedup(no_docs).count() == 0


def test_substring_dedup_in_short_alphabets(spark):
    r = random.Random(5)
    rows = [(k, "".join(r.choice("ab") for _ in range(r.randrange(0, 900))) + "ab" * r.randrange(0, 200)) for k in range(30)]
    rows += [(100 + k, rows[k][1][40:] + "c" + rows[k + 1][1][:250]) for k in range(12)]
    got = {x.row.doc_id: [(s.start, s.stop) for s in x.spans] for x in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = brute_spans([t.encode() for _, t in rows], 200)
    assert got == {i: s for (i, _), s in zip(rows, expected)}


def test_long_texts_are_cut_into_parts(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_CHUNK", 300)
    data = np.frombuffer(("x" * 250 + prose(1, 200)).encode(), np.uint8)
    covered = [0] * (len(data) - 199)
    for _, part, cuts, shift in substring_dedup._chunks(data, np.array([0, len(data)]), 200):
        _, start, count, *_ = substring_dedup.runs(part, cuts, 200)
        for s, c in zip(start, count):
            for p in range(s + shift, s + shift + c):
                covered[p] += 1
    assert set(covered) == {1}


def test_kept_text_has_whole_characters():
    data = "aé€b".encode()
    assert substring_dedup.kept_characters(data, [0, 2, 4, len(data)]) == "aé€b"
    assert substring_dedup.kept_characters(data, [0, 1, 6, len(data)]) == "ab"


# --- 3 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot_bits", [16, 4])
def test_lattice_base_and_score(docs, no_docs, hot_bits):
    got = lattice_lm.lattice_scores(docs, PIECES, hot_bits=hot_bits).collect()
    counts = Counter()
    for i, t in ROWS:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, t in ROWS:
        w = [*words(t), None]
        expected.append((len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(expected)
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert lattice_lm.lattice_scores(no_docs, PIECES).count() == 0


def test_lattice_recursion_sums_all_segmentations():
    vocab = lattice_lm.load_vocabulary(PIECES)
    pieces = {int(h): w for h, w in zip(vocab.hashes, vocab.weights)}

    def brute(word):
        alpha = [0.0] + [-math.inf] * len(word)
        for j in range(1, len(word) + 1):
            terms = [alpha[i] + pieces[h] for i in range(max(0, j - vocab.longest), j) if (h := lattice_lm._spell(word[i:j])) in pieces]
            alpha[j] = max(terms) + math.log(sum(math.exp(x - max(terms)) for x in terms))
        return alpha[-1]

    r = random.Random(3)
    texts = ["the information of things ünïcode", "Them zzz", "x" * 100, "", "information" * 60 + " " + "漢字" * 200]
    texts += ["".join(r.choice("theingo") for _ in range(n)) for n in (62, 63, 64, 65, 127, 128, 129, 300)]
    w = lattice_lm.Words(pa.array([t.encode() for t in texts], pa.binary()))
    scores = lattice_lm.word_scores(w, vocab)
    order = [x for t in texts for x in words(t)]
    for token, k in zip(order, w.word):
        assert scores[k] == pytest.approx(brute(b" " + token), abs=1e-8)
    assert np.exp(vocab.weights[:-1]).sum() + math.exp(vocab.end) == pytest.approx(1, abs=0.02)


def test_lattice_learns_words_and_pieces(spark):
    """Held-out texts of known words cost about what the base says, new words made of known parts less than by the file's weights."""
    r = random.Random(11)
    parts = ["zorq", "vlim", "tekk", "hupo", "wyx", "gnad"]
    common = ["".join(r.choices(parts, k=2)) for _ in range(12)]
    rows = [(k, " ".join([*r.choices(common, k=60), "".join(r.choices(parts, k=5))])) for k in range(400)]
    got = lattice_lm.lattice_scores(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()
    assert all(math.isfinite(x.score) for x in got) and len(got) == len(rows)
    base, score = (sum(x[c] for x in got if x.held_out) for c in ("base_score", "score"))
    assert score > 1.3 * base
    vocab = lattice_lm.load_vocabulary(PIECES)
    fit = lattice_lm.fitted(vocab, [t.split()[-1].encode() for k, t in rows if k < 300])
    new = lattice_lm.Words(pa.array([rows[-1][1].split()[-1].encode()], pa.binary()))
    assert lattice_lm.word_scores(new, fit)[0] > lattice_lm.word_scores(new, vocab)[0] + 10
    assert np.exp(fit.weights[:-1]).sum() == pytest.approx(1 / 1.1) and np.isfinite(fit.weights[:-1]).all()
    learned = np.array([5, 3, 0])
    assert (10 ** lattice_lm._mixed(learned, np.log([0.2, 0.3, 0.4]), 10, 3)).sum() == pytest.approx((8 + 3 * 0.9) / 13)


def test_lattice_scores_a_task_of_many_batches(spark, docs):
    """A task that gets its texts in several batches scores each as one that gets them all at once."""
    key = lambda df: sorted((str(x.doc_id), x.n_tokens, x.n_known, round(x.base_score, 6), round(x.score, 6)) for x in df.collect())
    want = key(lattice_lm.lattice_scores(docs.coalesce(1), PIECES))
    held = spark.conf.get(name := "spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, "2")
    try:
        assert key(lattice_lm.lattice_scores(docs.coalesce(1), PIECES)) == want
    finally:
        spark.conf.set(name, held)


def test_lattice_fits_all_learned_words(spark):
    """The table's fit is that of all its distinct words, however many and long; places of long words count as those of short ones."""
    r = random.Random(5)
    made = sorted({"".join(r.choices("abcdeghilnorst", k=r.randrange(3, 9))) for _ in range(44_000)} | {"".join(r.choices("theingo", k=n)) for n in (62, 63, 64, 200, 300)})
    texts = spark.createDataFrame([(" ".join(made[k::40] + made[k:50]),) for k in range(40)], "text string")
    hot, times, tokens, ends, kinds, table = lattice_lm._pass(texts, 16, lattice_lm.Scratch(spark, "lattice"))
    assert kinds == len(made) > 1 << 15 and ends == 40 and tokens == 40 + sum(len(made[k::40] + made[k:50]) for k in range(40))
    assert sorted(x.word.decode() for x in table.collect()) == made
    vocab = lattice_lm.load_vocabulary(PIECES)
    some = table.where("length(word) > 60 or word < cast('ac' as binary)")
    one = lattice_lm.fitted(vocab, [bytes(x.word) for x in some.collect()])
    assert np.allclose(lattice_lm.fitted_to(vocab, some).weights, one.weights)
    few = lattice_lm.Words(pa.array([w.encode() for w in made if 40 < len(w) < 64], pa.binary()))
    assert np.allclose(lattice_lm._times(few, vocab), lattice_lm._long_times(few, np.argsort(-few.lengths), vocab))


# --- 4 -------------------------------------------------------------------------------------------


def test_license_scan(spark, docs, no_docs):
    import re

    rows = [
        (1, "Intro. Licensed under the Apache License, Version 2.0. apache license version 2"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "released under the MIT  License; CC-BY NC; CC BY-NC 4.0"),
        (4, "This work is licensed under the GNU Genuine General Public License version 3"),
        (5, "general public transport, licensed under the stars"),
        (6, None),
        (None, "cc by nc"),
        (7, "under the MİT license K"),
    ]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].base_labels, got[1].labels, got[1].n_base, got[1].first_word, got[1].last_word) == ("apache-2", "apache-2", 2, 4, 9)
    assert (got[2].base_labels, got[2].labels, got[2].score) == ("", "gpl-3", 1.0)
    assert (got[3].base_labels, got[3].n_base) == ("cc-by-nc,mit", 3)
    assert got[5].labels == "" and got[6].n_words == 0 and got[6].score == 0.0 and got[None].labels == "cc-by-nc"
    for i, t in rows:
        assert got[i].n_words == len(re.findall(license_scan.WORD, (t or "").encode().translate(LOWER).decode()))
    again = "licensed under the moon. " * 4 + "This is licensed under the GNU General Public License, version 3. " + "licensed under the sun " * 3
    one = license_scan.license_scan(spark.createDataFrame([(1, again)], "doc_id long, text string")).first()
    at = again.lower().replace(",", "").replace(".", "").split().index("gnu") - 3
    assert (one.labels, one.score) == ("gpl-3", 1.0) and (one.spans[0].first_word, one.spans[0].last_word) == (at, at + 8)
    # Without an id, texts whose short hashes are alike stay apart.
    nameless = [(None, "cc by nc"), (None, again), (None, "plain")] * 2
    out = license_scan.license_scan(spark.createDataFrame(nameless, "doc_id long, text string"))
    assert sorted(r.labels for r in out.collect()) == ["", "", "cc-by-nc", "cc-by-nc", "gpl-3", "gpl-3"]
    out = license_scan.license_scan(docs)
    assert out.count() == len(ROWS) and out.where("n_base > 0").count() == 1
    assert license_scan.license_scan(no_docs).count() == 0


# --- 5 -------------------------------------------------------------------------------------------


def test_max_score_is_exact(spark, monkeypatch):
    monkeypatch.setattr(max_score, "SHARD", 64)
    monkeypatch.setattr(max_score, "QUERIES", 8)
    r = np.random.default_rng(1)
    rows = [(k, [float(x) for x in r.normal(size=12).astype("f4")]) for k in range(400)]
    rows += [(k, rows[3][1]) for k in range(400, 430)] + [(500, None), (501, [float("nan")] * 12), (502, [1.0, None]), (503, [2.0, 3.0]), (None, [1.0] * 12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for x in max_score.max_score(table, table.where("vec_id % 10 = 0"), 5).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    sound = {i: [math.floor(256 * x) for x in v] + [0] * (12 - len(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in sound if i % 10 == 0):
        best = sorted(((-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert max_score.max_score(table.limit(0), table, 5).count() == 0


def test_max_score_beyond_doubles(spark):
    table = spark.createDataFrame([(k, [1e12 + k, 3.0]) for k in range(0, 60, 10)], "vec_id long, embedding array<double>")
    got = max_score.max_score(table, table, 2).where("query_id = 30").orderBy("rank").collect()
    # Both sums are beyond a long; the true ones decide.
    assert [(r.vec_id, r.score) for r in got] == [(50, (1 << 63) - 1), (40, (1 << 63) - 1)]
    r = np.random.default_rng(2)
    big = [(k, [float(x) for x in r.integers(-(1 << 28), 1 << 28, 6)]) for k in range(80)]
    small = spark.createDataFrame([(k, [x / 256 for x in v]) for k, v in big], "vec_id long, embedding array<double>")
    got = max_score.max_score(small, small.where("vec_id % 9 = 0"), 4).collect()
    whole = {k: [math.floor(256 * (x / 256)) for x in v] for k, v in big}
    for q in range(0, 80, 9):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), k) for k, v in whole.items() if k != q)[:4]
        assert sorted((x.rank, x.vec_id, x.score) for x in got if x.query_id == q) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]


def test_max_score_of_repeated_ids_in_any_order(spark):
    rows = [(0, [1.0, 2.0]), (0, [2.0, 1.0]), (5, [1.0, 1.0]), (6, [3.0, 1.0]), (6, [3.0, 1.0]), (7, []), (8, [1.0])]
    seen = set()
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "vec_id long, embedding array<float>").coalesce(1)
        got = max_score.max_score(table, table.where("vec_id = 0"), 9).collect()
        seen.add(tuple(sorted((r.rank, r.vec_id, r.score) for r in got)))
    q = 256 * 256
    assert seen == {((1, 6, 7 * q), (2, 6, 7 * q), (3, 5, 3 * q), (4, 8, 2 * q), (5, 7, 0))}


def test_essential_terms_shrink_as_the_bar_rises():
    width = np.array([9.0, 5.0, 3.0, 1.0])
    assert [max_score.essential(width, room) for room in (-1, 0.5, 1.5, 4.5, 9.5, 99)] == [4, 4, 3, 2, 1, 0]
    r = np.random.default_rng(3)
    vectors = np.floor(r.normal(size=(5000, 16)) * 256)
    ids = np.arange(5000)
    got = list(max_score.top_k(ids[:40], vectors[:40], ids, vectors, 5))
    scores = vectors[:40] @ vectors.T
    for q in range(40):
        best = [v for v in np.lexsort((ids, -scores[q])) if v != q][:5]
        assert [v for a, v, _ in got if a == q] == best


# --- 6 and 8 ---------------------------------------------------------------------------------------


def test_toxicity_learns_and_keeps_columns(spark, docs, no_docs):
    rows = [(k, prose(k, 40) + (" moron" if k % 3 == 0 else "") + " " + prose(k + 999, 20)) for k in range(600)]
    train = spark.createDataFrame(rows[:400], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(train, labels)
    got = toxicity.scored(spark.createDataFrame(rows[400:], "doc_id long, text string"), model).collect()
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    out = toxicity.scored(docs, model)
    assert out.count() == len(ROWS) and {"doc_id", "text", "source", "row", "score", "predicted"} == set(out.columns)
    assert toxicity.scored(no_docs, model).count() == 0
    assert {r.score for r in toxicity.scored(docs, toxicity.train(train, labels.limit(0))).collect()} == {0.0}


def test_language_codes_and_accuracy(spark, docs, no_docs):
    for n in (2, 3, 5, 9, 40):
        codes = language_id.codewords(n)
        assert len({tuple(c) for c in codes}) == n
    alphabets = {"aa": "abcde", "bb": "efgha", "cc": "xyzab", "dd": "mnopa", "ee": "rstua", "ff": "klabc"}
    r = random.Random(2)
    text = lambda a: " ".join("".join(r.choice(a) for _ in range(r.randrange(2, 7))) for _ in range(40))
    rows = [(k, text(alphabets[x]), x) for k in range(100) for x in alphabets]
    rows = [(n, t, x) for n, (_, t, x) in enumerate(rows)]
    model = language_id.train(spark.createDataFrame(rows[:400] + [(None, "q", "aa"), (9999, "q", None)], "doc_id long, text string, lang string"))
    got = language_id.identified(spark.createDataFrame(rows[400:], "doc_id long, text string, lang string"), model).collect()
    assert np.mean([x.lang_pred == x.lang for x in got]) > 0.95 and all(0 <= x.score <= 1 for x in got)
    out = {x.row: x for x in language_id.identified(docs, model).collect()}
    for k in (5, 6, 7):
        assert out[k].lang_pred == "und" and out[k].score == 0.0
    assert language_id.identified(no_docs, model).count() == 0
    assert {x.lang_pred for x in language_id.identified(docs, language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))).collect()} == {"und"}


# --- 7 -------------------------------------------------------------------------------------------


def brute_components(rows, percent, width=5):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    r = random.Random(8)
    base = [prose(k, 150).split() for k in range(6)]
    rows = []
    for k in range(150):
        w = list(base[k % 6])
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    return rows + [(200 + k, prose(300, 90) + " " + prose(400 + k, 50)) for k in range(90)]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_are_exact(spark, percent, monkeypatch):
    monkeypatch.setattr(neardup, "CROWD", 20)
    rows = near_rows()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edge_cases(docs, no_docs):
    got = neardup.near_duplicates(docs).collect()
    named = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert named == brute_components([(i, t) for i, t in ROWS if i is not None], 85)
    assert [r.kept for r in got if r.doc_id is None] == [True, True]
    assert neardup.near_duplicates(no_docs).count() == 0


def test_components(spark):
    r = random.Random(4)
    links = [(k, k + 1) for k in range(50)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "cc"))
    assert {x.id: x.root for x in got.collect()} == {k: find(k) for k in root}


def test_language_id_learns_rare_languages_too(spark):
    def text(k, seed):  # each language has syllables of its own
        r, own = random.Random(seed), random.Random(70000 + k)
        words = ["".join(own.choice("bcdfghklmnprstvz") + own.choice("aeiou") for _ in range(3)) for _ in range(12)]
        return " ".join(r.choice(words) for _ in range(40))

    n = 120
    learn = [(1000 * k + j, text(k, 1000 * k + j), f"l{k:03}") for k in range(n) for j in range(8 if k < 105 else 4)]
    model = language_id.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    assert model.names == [f"l{k:03}" for k in range(n)]
    names, _, _ = model.predict(pa.array([text(k, 900000 + k).encode() for k in range(n)], pa.binary()))
    right = [name == f"l{k:03}" for k, name in enumerate(names)]
    assert sum(right) >= 0.9 * n and sum(right[105:]) >= 13
    few = language_id.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"), sample=1)
    assert len(few.names) == n


def test_language_id_codewords_are_as_far_apart_as_before():
    c = language_id.codewords(7)
    rng = np.random.default_rng(7)
    best = max((rng.integers(0, 2, (7, 29)) for _ in range(50)), key=lambda c: min((c[i] != c[j]).sum() for i in range(7) for j in range(i)))
    assert (c == best[:, best.min(0) != best.max(0)]).all()


# --- 9 -------------------------------------------------------------------------------------------


def test_packing_round_trip(docs, no_docs):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(BPE)
    size = 256
    got = packing.best_fit_packing(docs, BPE, size).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    expected = Counter()
    for i, t in ROWS:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % size or size
        edges = [0, *range(first, len(ids), size), len(ids)] if len(ids) > size else [0, len(ids)]
        expected.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    assert len(by) <= sum(r.length for r in got) / size * 1.15 + 1
    assert packing.best_fit_packing(no_docs, BPE).count() == 0


def test_best_fit_takes_the_fullest_bin_that_fits():
    r = random.Random(6)
    lengths = [r.randrange(1, 101) for _ in range(3000)]
    bins, places = packing.best_fit(lengths, 100, 10)
    # With the same bins open, the chosen one is the fullest that fits; how many rooms of a size close first does not matter.
    later = {b: set(bins[bins.index(b) :]) for b in set(bins)}
    free: dict[int, int] = {}
    for n, b, p in zip(lengths, bins, places):
        fits = [room for room in free.values() if room >= n]
        if p:
            assert free[b] == 100 - p == min(fits)
        elif fits or b in free:
            raise AssertionError("a bin was opened though one fits")
        elif len(free) == 10:
            del free[max(k for k in free if free[k] == min(free.values()) and k not in later[b])]
        free[b] = 100 - p - n
        if not free[b]:
            del free[b]


def test_special_strings_take_the_exact_tokenizer():
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(BPE)
    texts = ["a<|endoftext|>b", "Ünï 漢字 \n\n  x", "", None, "it's 12,5 km"]
    assert packing.token_ids(texts, BPE) == [exact.encode(t or "", add_special_tokens=False).ids for t in texts]


# --- 10 ------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, file int")


def test_fixity_finds_what_brute_force_finds(spark):
    rows = [(k, f"http://x/{k}", prose(k, 20), 1) for k in range(600)] + [(5000, None, None, 1), (None, "u", "h", 1), (7, "http://x/7", prose(7, 20), 1)]
    archive = warc_fixity.records(pages(spark, rows))
    other = warc_fixity.aged(archive)
    got = warc_fixity.audit(archive, other).collect()
    rotten = {i for i, *_ in rows if i is not None and i % 97 == 5}
    assert Counter(r.status for r in got) == Counter("corrupt" if i in rotten else "sound" for i, *_ in rows)
    assert {r.page_id for r in got if r.status == "corrupt"} == rotten
    assert {r.status for r in warc_fixity.audit(archive, archive).collect()} == {"sound"}
    starts = sorted((r.start, r.length) for r in got if r.file == 0)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0


def test_fixity_of_missing_records(spark):
    rows = [(k, "u", f"h{k}", 1) for k in range(40)] + [(None, "u", f"n{k}", 1) for k in range(3)]
    for lost in (39, 20, 0):
        whole, part = (warc_fixity.records(pages(spark, r), 1) for r in (rows, [r for r in rows if r[0] != lost]))
        for a, b, name in ((whole, part, "missing"), (part, whole, "extra")):
            got = {(r.page_id, r.digest): r.status for r in warc_fixity.audit(a, b).collect()}
            assert len(got) == 43 and {i: s for (i, _), s in got.items() if i is not None} == {k: name if k == lost else "sound" if k < lost else "moved" for k in range(40)}
    assert warc_fixity.audit(whole.limit(0), part.limit(0)).count() == 0


def test_fixity_of_lost_changed_and_repeated_records_at_once(spark):
    rows = [(k, "u", f"h{k}", 1) for k in range(300)] + [(7, "u", "h7", 1), (7, "u", "other", 1)]
    changed = [(k, u, h + "!" if k == 100 else h, f) for k, u, h, f in rows if k != 50] + [(400, "u", "new", 1)]
    got = Counter((r.page_id, r.status) for r in warc_fixity.audit(warc_fixity.records(pages(spark, rows)), warc_fixity.records(pages(spark, changed))).collect())
    # One byte more at 100 makes up for nothing: what is behind 50 has moved.
    assert got[(50, "missing")] == got[(100, "corrupt")] == got[(400, "extra")] == 1
    assert sum(n for (i, s), n in got.items() if s == "moved") == 248 and got[(7, "sound")] == 3


def test_nameless_records_fill_as_many_files_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(warc_fixity, "FILE", 50)
    archive = warc_fixity.records(pages(spark, [(None, f"u{k}", "h", 1) for k in range(1000)]))
    sizes = [r["count"] for r in archive.groupBy("file").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 100 and sum(sizes) == 1000


# --- shared ----------------------------------------------------------------------------------------


def test_crc_mod(docs):
    got = docs.select("doc_id", crc_mod("doc_id", 7).alias("m")).collect()
    assert all(r.m == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 for r in got)


# --- scores of one text alone ------------------------------------------------------------------------


def test_scores_depend_on_the_text_alone(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text", "lang"]).to_pylist()
    texts = [(r["text"] or "").encode() for r in table] + [b"ok", b"a", b"", b"ok"]
    known = [k for k, r in enumerate(table) if r["lang"] is not None]
    ident = language_id.fit([texts[k] for k in known], [table[k]["lang"] for k in known])
    tox = toxicity.fit(texts[:100], np.arange(100) % 2, 0.5)
    together = ident.predict(pa.array(texts, pa.binary()))[1], tox.scores(pa.array(texts, pa.binary()))
    for k, t in enumerate(texts):
        alone = pa.array([t], pa.binary())
        assert ident.predict(alone)[1][0] == together[0][k] and tox.scores(alone)[0] == together[1][k]


def test_language_frequencies_count_every_gram_of_a_text_and_no_other():
    r = random.Random(7)
    texts = [bytes(r.choice(b"abc ") for _ in range(r.randrange(0, 40))) for _ in range(50)]
    weights = language_id.whole(np.random.default_rng(1).normal(size=(1 << language_id.BITS, 2)))
    got = language_id.frequencies(pa.array(texts, pa.binary()), weights)
    for t, row in zip(texts, got):
        data = np.frombuffer(b" " + squeeze(t) + b" ", np.uint8)
        total, n = np.zeros(2), 0
        for order in language_id.ORDERS:
            for at in range(len(data) - order + 1):
                total += weights[language_id.hashed(data[at : at + order], order, language_id.BITS)[0]]
                n += 1
        assert row == pytest.approx(total / max(n, 1) / language_id.ONE, abs=1e-9)


def squeeze(t):
    return decontaminate.squeezed(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tobytes()


def test_sample_takes_one_text_an_id_in_any_order_and_no_more_bytes_than_allowed(spark):
    from pyspark.sql import types as T

    from skarn.llm.samples import sample_texts

    rows = [(1, "a" * 50), (1, "b" * 60), (2, "c" * 500), (3, None), (4, "d"), (None, "e")]
    kind, chosen = T.StructField("toxic", T.IntegerType()), [(2, 0), (1, 0), (3, 1), (4, 1), (9, 1)]
    out = [sample_texts(spark.createDataFrame(x, "doc_id long, text string"), kind, chosen, ["doc_id"], 100) for x in (rows, rows[::-1])]
    assert out[0] == out[1] and [(i, k) for i, k, _ in out[0]] == [(1, 0), (3, 1), (4, 1)]


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "some words", "mine")], "doc_id long, text string, `bytes of text` string")
    assert toxicity.scored(docs, toxicity.Model(None)).first()["bytes of text"] == "mine"
    assert language_id.identified(docs, language_id.Model()).first()["bytes of text"] == "mine"
    items = spark.createDataFrame([(1, "none of it")], "item_id long, text string")
    assert decontaminate.decontaminated(docs, items).first()["bytes of text"] == "mine"


def test_near_duplicates_of_repeated_ids_in_any_order(spark):
    long, other = prose(1, 100), prose(2, 80)
    rows = [(1, long), (1, other), (2, long.rsplit(" ", 3)[0]), (3, other + " more"), (4, ""), (4, "a b")]
    seen = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        seen.add(tuple(sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)))
    assert seen == {((1, 96, 1, True), (2, 93, 1, False), (3, 77, 3, True), (4, 1, 4, True))}


def test_near_duplicates_of_large_classes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HEAVY_ROWS", 4)
    monkeypatch.setattr(neardup, "HEAVY", 2)
    rows = near_rows() + [(1000 + k, prose(77, 50)) for k in range(200)] + [(2000 + k, None) for k in range(50)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 85)


def test_packing_closes_the_fullest_when_all_bins_are_open():
    bins, _ = packing.best_fit([60, 70, 80, 15, 35], 100, 2)
    # 80 finds both bins too full: that of 70 closes, and 15 goes to that of 80, 35 to that of 60.
    assert bins == [0, 1, 2, 2, 0]


def test_fast_tokenizer_equals_the_named_one():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(BPE)
    pieces = st.sampled_from(["it's", " 'll", "\n\n", "  ", " ", "　", "é", "漢字", "12,5", "<|endoftext|>", "​", "é", "🙂", "_x", "\x00"])

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(max_size=80), st.lists(st.one_of(pieces, st.text(max_size=4)), max_size=20).map("".join)))
    def check(text):
        assert packing.token_ids([text], BPE) == [exact.encode(text, add_special_tokens=False).ids]

    check()


def test_substrings_of_nameless_texts_whose_short_hashes_agree(spark):
    from pyspark.sql import functions as F

    # Two texts with one 32-bit hash: the first repeats in a third row, the second is unique.
    r, seen = random.Random(1), {}
    while True:
        texts = ["".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(40000)]
        hashes = [x.h for x in spark.createDataFrame([(t,) for t in texts], "t string").select(F.hash(F.concat("t", F.lit("q" * 292)).cast("binary")).alias("h")).collect()]
        pair = next(((seen[h], t) for h, t in zip(hashes, texts) if seen.setdefault(h, t) != t), None)
        if pair:
            break
    one, two = (t + "q" * 292 for t in pair)
    for ids in ((None, None, None), (1, 1, 1), (1, 2, 3)):
        rows = list(zip(ids, (one, prose(60, 60), one + "!")))
        rows += [(ids[0], two.replace("q", "z")), (ids[0], ""), (ids[1], None)]
        got = sorted((x.n_bytes, x.n_removed) for x in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        spans = brute_spans([(t or "").encode() for _, t in rows], 200)
        assert got == sorted((len((t or "").encode()), sum(b - a for a, b in s)) for (_, t), s in zip(rows, spans))


def test_substrings_of_frequent_digits(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "salted_join", lambda *a: salted_join(*a, least=2, salts=3))
    r = random.Random(6)
    passage = prose(70, 40)
    rows = [(k, prose(800 + k, r.randrange(1, 30)) + passage[: r.randrange(150, 400)] + prose(900 + k, 9)) for k in range(60)]
    rows += [(100 + k, passage) for k in range(40)] + [(200 + k, "same line " * 30) for k in range(20)]
    got = {x.row.doc_id: [(s.start, s.stop) for s in x.spans] for x in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: s for (i, _), s in zip(rows, brute_spans([t.encode() for _, t in rows], 200))}


def test_components_of_large_stars(spark):
    links = [(5000, k) for k in range(1, 700)] + [(k, k + 3000) for k in range(100, 300)] + [(9000, 9001)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "stars")).collect()}
    assert got == {**{k: 1 for k in range(1, 700)}, 5000: 1, **{k + 3000: 1 for k in range(100, 300)}, 9000: 9000, 9001: 9000}


def test_language_sample_is_the_ids_with_the_least_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(k % 900, f"text {k}", "aa" if k % 900 < 800 else "bb") for k in range(2000)] + [(5000 + k, "t", f"r{k}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(language_id, "sample_texts", lambda d, kind, chosen, keys, budget: seen.update(c=chosen) or [])
    language_id.train(docs, sample=50)
    hashes = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id")).distinct().collect()}
    for lang in ("aa", "bb", "r1"):
        least = sorted({i for i, _, x in rows if x == lang}, key=lambda i: (hashes[i], i))[:50]
        assert sorted(least) == sorted(i for i, x in seen["c"] if x == lang)


def test_contamination_of_repeated_item_ids(spark):
    one, two = prose(1, 20), prose(2, 20)
    bench = spark.createDataFrame([(1, one), (1, two), (1, one), (None, two)], "item_id long, text string")
    docs = spark.createDataFrame([(5, f"x {one} y {two} z")], "doc_id long, text string")
    got = sorted(((r.item_id, r.distance, r.start) for r in decontaminate.contamination(docs, bench).collect()), key=str)
    assert got == sorted([(1, 0, 2), (1, 0, 5 + len(one)), (None, 0, 5 + len(one))], key=str)


def test_vocabularies_of_any_size_and_kind(spark, tmp_path):
    """A unigram model that is written, not trained: its scores are log weights, whole numbers or not, and 256,000 pieces find their places."""
    from sentencepiece import sentencepiece_model_pb2

    def model(pieces):
        out = sentencepiece_model_pb2.ModelProto()
        out.trainer_spec.model_type = out.trainer_spec.UNIGRAM
        for piece, kind, score in [("<unk>", 2, 0.0), ("<s>", 3, 0.0), ("</s>", 3, 0.0), *((p, 1, s) for p, s in pieces)]:
            entry = out.pieces.add()
            entry.piece, entry.type, entry.score = piece, kind, score
        (tmp_path / "m.model").write_bytes(out.SerializeToString())
        return lattice_lm.load_vocabulary(str(tmp_path / "m.model"))

    many = model([(f"▁w{k}", -float(k % 9 + 1)) for k in range(256_000)])
    assert (many.ids(many.hashes) == np.arange(len(many.hashes))).all() and len(many.hashes) == 256_000 + 256
    few = model([("▁", -1.0), ("a", -2.0), ("b", -3.0), ("ab", -2.0), ("▁ab", -4.0)])
    weight = {b" ": math.exp(-1), b"a": math.exp(-2), b"b": math.exp(-3), b"ab": math.exp(-2), b" ab": math.exp(-4)}
    least = min(weight.values())
    sums = sum(weight.values()) + least * (256 - 3)
    share = lambda *p: math.prod(weight[x] / (1.1 * sums) for x in p)
    want = math.log(share(b" ", b"a", b"b") + share(b" ", b"ab") + share(b" ab"))
    got = lattice_lm.word_scores(lattice_lm.Words(pa.array([b"ab"], pa.binary())), few)
    assert got[0] == pytest.approx(want, rel=1e-9)


def test_a_worker_gives_back_what_a_step_has_freed():
    import os

    import numpy as np

    from skarn.llm.common import lean

    rss = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
    pins, most = [], []

    @lean
    def step(batches):
        held = [np.ones(1 << 13) for _ in range(4000)]  # 64 KB each, so that they lie in the heap
        pins.append([np.ones(1 << 13) for _ in range(4)])  # above them, so that the heap can't just end sooner
        most.append(rss())
        del held
        yield from batches

    assert list(step(iter([1, 2]))) == [1, 2]
    assert rss() < most[0] - 150


def test_working_arrays_of_a_batch_are_small():
    import tracemalloc

    texts = pa.array([prose(k, 400).encode() for k in range(700)], pa.binary())  # about 2 MB
    packed = pa.RecordBatch.from_arrays([pa.array(range(700), pa.int64()), pa.array([substring_dedup.packer().compress(t.as_py()) for t in texts], pa.binary())], ["id", "z"])
    steps = {
        "toxicity": lambda m=toxicity.Model(np.ones(1 << toxicity.BITS)): m.scores(texts),
        "substrings": lambda: [None for _ in substring_dedup._anchors([packed], 200)],
    }
    for (name, step), most in zip(steps.items(), (60, 30)):
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
        assert peak < most, (name, peak)


def test_sample_starts_no_python_workers(spark, monkeypatch):
    from pyspark import SparkContext
    from pyspark.sql import types as T

    from skarn.llm.samples import sample_texts

    docs = spark.createDataFrame([(1, "a", "en"), (2, "b", "fr")], "doc_id long, text string, lang string")
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: pytest.fail("an RDD of Python rows"))
    assert sample_texts(docs, T.StructField("lang", T.StringType()), [(1, "en"), (2, "de")], ["doc_id", "lang"], 100) == [(1, "en", b"a")]


def test_packing_loads_the_exact_tokenizer_only_for_special_strings():
    packing._exact.cache_clear()
    packing.token_ids(["plain words", None], BPE)
    assert not packing._exact.cache_info().currsize
