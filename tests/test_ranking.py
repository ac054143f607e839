"""The best documents of a stated set of questions, straight from the texts, are those of the lexical index."""

import pytest
from pyspark.sql import functions as F

from skarn.operators import index, lexical, ranking, retrieve
from skarn.plans import QUERIES

D = "/root/testdata/sf0.001"
TEXTS = [(k, f"apple {'pear ' * (k % 5)}fig{k % 11} 注意{'力' * (k % 2)} Common COMMON {k}") for k in range(120)] + [(200, None), (201, ""), (202, "apple fig3"), (203, "apple fig3"), (204, "…")]
ASKED = [(1, "apple Fig3 fig3 common"), (2, "注意力 pear"), (3, "nothing here"), (4, "common 7 apple"), (5, "")]


@pytest.mark.parametrize(("block", "hits"), [(4096, 1 << 20), (2, 40)])
def test_best_as_by_the_index(spark, tmp_path, monkeypatch, block, hits):
    monkeypatch.setattr(ranking, "QUESTIONS", block)
    monkeypatch.setattr(ranking, "_HITS", hits)
    monkeypatch.setattr(ranking, "_TERMS", 50)
    docs, asked = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ASKED, "query_id long, text string")
    built = lexical.build(index.bags(docs, "doc_id"), f"file://{tmp_path}/i", "doc_id")
    first = lambda scores: {(r.query_id, r.rank, r.doc_id, round(r.score, 8)) for r in retrieve.top(scores, 7, "query_id", F.desc("score"), F.col("doc_id")).collect()}
    want = first(built.scores(built.asked(asked)).withColumn("score", F.round("score", 9)))
    assert len(want) == 21 and first(ranking.best(docs, asked, 7)) == want


def test_no_texts_no_questions_and_repeated_ids(spark):
    docs, asked = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ASKED, "query_id long, text string")
    assert ranking.best(docs.limit(0), asked, 3).count() == ranking.best(docs, asked.limit(0), 3).count() == 0
    assert ranking.best(docs.union(docs.limit(1)), asked, 3) is None


@pytest.mark.parametrize("name", ["relevance_gate", "context_pack", "overfetch_topk", "context_prefix", "rerank_topk", "rrf_fusion"])
def test_searches_of_the_stated_set_need_no_index(spark, monkeypatch, name):
    monkeypatch.setattr(lexical, "index_of", lambda *_: pytest.fail("the index was built"))
    assert QUERIES[name](spark, D).count() > 0
