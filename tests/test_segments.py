"""The segmented lexical index against one that is built at once, and the maintained fingerprint of a library."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skarn.config import Settings
from skarn.library import Library
from skarn.operators import index, lexical, segments


def bag(spark, docs: dict[str, str]):
    return index.bags(spark.createDataFrame(list(docs.items()), "chunk_id string, text string"))


def state(words):
    asked = words.asked(words.spark.createDataFrame([(0, "w1 w2 w2 w7 nothing"), (1, "w3")], "query_id long, text string"))
    scores = {(r.query_id, r.chunk_id): round(r.score, 9) for r in words.scores(asked).collect()}
    return scores, {r.term: (r.df, round(r.idf, 9)) for r in words.terms().collect()}, words.total, round(words.average, 9)


def check(spark, made, docs, tmp_path, n):
    assert state(made.live()) == state(lexical.build(bag(spark, docs), f"{tmp_path}/plain{n}", "chunk_id"))


def test_segments_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MERGE", 3)
    rnd = random.Random(1)
    text = lambda: " ".join(f"w{rnd.randrange(12)}" for _ in range(rnd.randrange(1, 9)))
    made, docs = segments.Segments(spark, f"{tmp_path}/s", "chunk_id"), {}
    assert state(made.live()) == ({}, {}, 0, 0)
    for n in range(7):
        new = {f"d{n}-{k}": text() for k in range(4)}
        made.add(bag(spark, new), f"a{n}")
        docs |= new
        if n % 2:
            # Some go; one of them comes back with another text.
            gone = {k: docs.pop(k) for k in rnd.sample(sorted(docs), 3)}
            made.delete(bag(spark, gone), f"d{n}")
            back = {min(gone): text()}
            made.add(bag(spark, back), f"b{n}")
            docs |= back
        if n in (1, 3, 6):
            check(spark, made, docs, tmp_path, n)
    rows = made._rows()
    assert made.stamp() == "a6" and len([r for r in rows if r["kind"] == "added"]) < 8
    # Another opener sees the same; repeated, missing and extra documents are made up for; a bag without tokens adds nothing.
    other = segments.Segments(spark, f"{tmp_path}/s", "chunk_id")
    docs = {k: v for n, (k, v) in enumerate(docs.items()) if n % 3} | {"x": "w1 w1", "blank": " "}
    other.sync(bag(spark, docs), "z")
    other.add(bag(spark, {"empty": "?"}), "z")
    check(spark, other, docs, tmp_path, "z")
    other.delete(bag(spark, docs))
    assert state(segments.Segments(spark, f"{tmp_path}/s", "chunk_id").live())[0] == {}


def test_fingerprints_add_and_subtract(spark):
    prints = lambda n: index.corpus_fingerprint(spark.range(*n).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))).first().asDict()
    whole, part, rest = prints((0, 50)), prints((0, 20)), prints((20, 50))
    assert index.combined(part, rest) == whole and index.combined(whole, rest, -1) == part
    assert index.combined(part, prints((0, 0))) == part and index.combined(part, part) != prints((0, 0)) | {"n": 40}


def test_library_keeps_its_fingerprint_and_index(spark, tmp_path, monkeypatch):
    up, root = tmp_path / "up", str(tmp_path / "lib")
    up.mkdir()
    settings = Settings(chunk_strategy="fixed", chunk_size=40, chunk_overlap=0)
    lib = Library(spark, root, settings)
    for n, word in enumerate(("apples", "pears", "plums")):
        (up / f"{word}.txt").write_text(f"{word} grow on trees, and trees grow in orchards. All {word} are fruit.")
        lib.load(str(up))
    counted = index.corpus_fingerprint(lib.chunks.read().select(F.sha2("chunk_id", 256).alias("h"))).first().asDict()
    with monkeypatch.context() as m:  # neither an answer's scope nor a search counts or indexes the chunks again
        m.setattr(Library, "_print_of", None)
        m.setattr(segments.Segments, "sync", None)
        m.setattr(segments.Segments, "add", None)
        assert lib.fingerprint() == counted and lib.bm25("pears").count() > 0
        assert Library(spark, root, settings).bm25("plums").count() > 0
    one, scope = lib.bm25("pears").join(lib.chunks.read(), "chunk_id").first().doc_id, lib.scope()
    assert lib.delete(one) > 0 and lib.scope() != scope and lib.bm25("pears").count() == 0
    assert lib.fingerprint() == index.combined(index.corpus_fingerprint(lib.chunks.read().select(F.sha2("chunk_id", 256).alias("h"))).first().asDict(), {"low": "", "middle": "", "high": "", "n": 0})
    # A load that stops before its chunks are written leaves index and fingerprint to be made right.
    (up / "figs.txt").write_text("figs are sweet")
    with monkeypatch.context() as m:
        m.setattr(lib.chunks, "append", lambda rows: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            lib.load(str(up))
    assert lib.bm25("figs").count() == 0
    lib.load(str(up))
    assert lib.bm25("figs").count() == 1 and lib.bm25("pears").count() > 0


def test_shards_grow_in_number_with_the_table(spark, tmp_path, monkeypatch):
    """A task makes the postings of a bounded part of the files, within the rows of documents."""
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(k, f"w{k} Common common {k % 7} 注意") for k in range(4000)], "doc_id long, text string").coalesce(1).write.parquet(path)
    monkeypatch.setattr(index, "SHARD", 2000)
    bag = index.bags(index.dealt(spark.read.parquet(path), "doc_id", path), "doc_id")
    assert bag.rdd.getNumPartitions() > 8
    rows = index.postings(bag, "doc_id")
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in text and len(re.findall("Exchange", text.split("== Initial Plan ==")[0])) == 1
    got = {(r.term, r.tf) for r in rows.where("doc_id = 8").collect()}
    assert got == {("w8", 1), ("common", 2), ("1", 1), ("注", 1), ("意", 1)} and rows.where("doc_id = 8 and n = 6").count() == 5
    assert len(spark.read.parquet(f"{lexical.index_of(spark, path, 'doc_id').root.rstrip('/')}/postings").inputFiles()) > 8
