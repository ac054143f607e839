"""The vector index against exact search: recall, pruned cells, additions and deletions; the library's use of it."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skarn.library import Library
from skarn.operators import ivf, memory, retrieve
from skarn.plans import QUERIES

D = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def index(spark):
    return ivf.index_of(spark, f"{D}/embeddings.parquet")


def found(rows):
    return {(r["query_id"], r["doc_id"]) for r in rows.collect()}


def test_recall_at_ten(spark, index):
    want, got = found(QUERIES["vector_topk"](spark, D)), found(QUERIES["vector_index_topk"](spark, D))
    assert len(want) == 1000 and len(want & got) / len(want) >= 0.95


def test_all_cells_give_the_exact_result(spark, index):
    e = spark.read.parquet(f"{D}/embeddings.parquet")
    asked = e.where("vec_id % 200 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = index.nearest(asked, 10, probes=10_000)
    want = retrieve.top(retrieve.nearest(e, asked, 10), 10, "query_id", F.desc("score"), F.col("vec_id"))
    key = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in df.collect())
    assert key(got) == key(want)


def test_a_search_reads_its_cells_alone(spark, index):
    one = spark.read.parquet(f"{D}/embeddings.parquet").where("vec_id = 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    plan = index.candidates(one)._jdf.queryExecution().executedPlan().toString()
    pruned = re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (?:IN|INSET) \(?([^)\]]*)", plan)
    cells = index.rows().select("cell").distinct().count()
    assert pruned and 0 < pruned.group(1).count(",") + 1 < 0.6 * cells
    assert "embedding" not in re.findall(r"ReadSchema: struct<([^>]*)>", plan)[0]


def test_additions_deletions_and_ties(spark, tmp_path):
    rows = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = ivf.build(table.where("vec_id < 40"), f"file://{tmp_path}/i", cells=4)
    index.add(table.where("vec_id >= 40"))
    index.add(table.where("vec_id = 59"))  # an addition that ran twice
    index.delete(spark.createDataFrame([(21,)], "vec_id long"))
    asked = spark.createDataFrame([(0, [0.0, 1.0, 0.0])], "query_id long, query array<float>")
    got = [r["vec_id"] for r in index.nearest(asked, 3, probes=4, shortlist=60).orderBy("rank").collect()]
    assert got[:2] == [0, 42] and len(got) == 3
    with pytest.raises(Exception, match="length"):
        index.add(spark.createDataFrame([(1, [0.0, 0.0, 0.0])], "vec_id long, embedding array<float>"))


def test_the_library_searches_by_its_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(6):
        (tmp_path / "in" / f"{k}.txt").write_text(f"Apple pie number {k} with sugar and cinnamon.")
    library = Library(spark, f"file://{tmp_path}/lib")
    library.load(f"file://{tmp_path}/in")
    exact = [r["chunk_id"] for r in library.vector("apple pie", 3).orderBy("rank").collect()]
    library.index_vectors(cells=2)
    assert [r["chunk_id"] for r in library.vector("apple pie", 3).orderBy("rank").collect()] == exact
    (tmp_path / "in" / "new.txt").write_text("apple pie")
    library.load(f"file://{tmp_path}/in")
    best = library.vector("apple pie", 1).first()["chunk_id"]
    added = library.chunks.read().where(F.col("chunk_id") == best).first()
    assert added["text"] == "apple pie"
    library.delete(added["doc_id"])
    assert library.vector("apple pie", 1).first()["chunk_id"] == exact[0]


def test_placeholders_are_fetched_past(spark, tmp_path):
    """Thirty image marks come before six texts in both branches."""
    (tmp_path / "in").mkdir()
    for k in range(30):
        (tmp_path / "in" / f"image{k}.txt").write_text(f"[图像区域 apple {k}]")
    for k in range(6):
        (tmp_path / "in" / f"text{k}.txt").write_text(f"An apple a day, says text {k}, keeps them away.")
    library = Library(spark, f"file://{tmp_path}/lib")
    library.load(f"file://{tmp_path}/in")
    rows = library.hybrid("apple", 5).collect()
    assert len(rows) == 5 and all("says text" in r["text"] for r in rows)


def test_products_are_bounded_and_hold_groups(spark, monkeypatch):
    """Slices of a batch give what all pairs give, ties by key, each question within its group; one task gives on k rows a question."""
    monkeypatch.setattr(retrieve, "PRODUCT", 64)
    r = np.random.default_rng(5)
    v, group = r.integers(-2, 3, (300, 4)) + 0.5, r.integers(0, 4, 300)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    ids, asks = np.arange(300)[::-1].copy(), np.arange(0, 300, 11)
    shared = lambda x: type("Shared", (), {"value": x})
    batch = lambda a, b: pa.RecordBatch.from_pydict({"vec_id": ids[a:b], "embedding": v[a:b].tolist(), "g": group[a:b]})
    for by in (None, "g"):
        asked = shared((asks, unit[asks], [None] * len(asks) if by is None else group[asks].tolist()))
        found = pa.Table.from_batches(retrieve._nearest([batch(0, 170), batch(170, 300)], "vec_id", asked, 5, by)).to_pylist()
        score = np.round(np.clip(unit[asks] @ unit.T, -1, 1), 9)
        want = set()
        for n, a in enumerate(asks):
            rows = [x for x in range(300) if by is None or group[x] == group[a]]
            want |= {(int(a), int(ids[x]), score[n, x]) for x in sorted(rows, key=lambda x: (-score[n, x], ids[x]))[:5]}
        assert {(f["query_id"], f["vec_id"], f["score"]) for f in found} == want and len(found) == len(want)
    pairs = pa.Table.from_batches(retrieve._scored([batch(0, 170), batch(170, 300)], "vec_id", shared((asks, unit[asks], None)))).to_pylist()
    assert {(p["query_id"], p["vec_id"]): p["score"] for p in pairs} == {(int(a), int(ids[x])): score[n, x] for n, a in enumerate(asks) for x in range(300)}


def test_probes_hold_numbers_of_questions():
    r = np.random.default_rng(2)
    unit, centroids = r.normal(size=(40, 6)), r.normal(size=(9, 6))
    got = ivf._probed(unit, centroids, 3)
    far = ((unit[:, None] - centroids) ** 2).sum(2)
    assert {(int(w), c) for c, (who, _) in got.items() for w in who} == {(q, int(c)) for q in range(40) for c in np.argsort(far[q])[:3]}
    assert all(np.allclose(base, unit[who] @ centroids[c], atol=1e-5) and base.nbytes == who.nbytes == 4 * len(who) for c, (who, base) in got.items())
    assert ivf._probed(unit[:0], centroids, 3) == {}


def test_cache_by_products(spark):
    q = spark.createDataFrame([(1, "a", "x", [1.0, 0.0]), (2, "b", "y", [0.0, 1.0]), (3, "c", None, [1.0, 0.0]), (4, "e7", "x", [1.0, 1.0])], "query_id long, question string, c string, vector array<double>")
    held = spark.createDataFrame([(7, "e7", "x", [0.9, 0.1]), (5, "e5", "x", [1.8, 0.2]), (6, "e6", "y", [1.0, 0.1]), (9, "e9", None, [1.0, 0.0])], "entry long, e_question string, e_c string, e_vector array<double>")
    assert sorted((r.query_id, r.entry, r.mode) for r in memory.cache_lookup(q, held, threshold=0.5).collect()) == [(1, 5, "semantic"), (4, 7, "exact")]
