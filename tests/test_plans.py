"""Plans are what they are meant to be: pruned scans, pushed filters, early limits, no Python where none is needed."""

import re

import pytest
from pyspark.sql import functions as F

from skarn.plans import QUERIES

D = "/root/testdata/sf0.001"
#: Queries whose work is a fold, a parser or keyed state.
PYTHON = {"chunk_recursive", "chunk_semantic", "table_windows", "context_pack", "rag_answer", "layout_captions", "calculator", "paper_metadata", "import_status", "chunk_line_spans"}
#: Vector search is one matrix product a batch.
PYTHON |= {"vector_topk", "rrf_fusion", "hybrid_search", "overfetch_topk", "vector_index_topk"}
#: Names are found by automata, claims in normal forms.
PYTHON |= {"alias_mentions", "paper_evidence"}
#: Pages are parsed as trees.
PYTHON |= {"page_tree", "chunk_lateral", "chunk_invariants"}
STREAMS = {n for n in QUERIES if n.startswith(("stream_", "win_")) or n == "cache_replay"}


def plan(spark, name):
    return QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON - STREAMS))
def test_stays_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", text)
    assert "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(label,3\)", plan(spark, "filter_doc"))
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in plan(spark, "filter_doc")
    assert "text" not in re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "project_refs"))[0]
    assert re.search(r"PushedFilters: \[[^]]*event_type", plan(spark, "ext_asof"))


def test_limits_come_early(spark):
    for name in ("bm25_topk", "vector_topk", "vector_topk_filtered", "hybrid_search", "fifo_cap", "keywords_tfidf"):
        assert "WindowGroupLimit" in plan(spark, name)


def test_snapshots_are_aggregates(spark):
    text = plan(spark, "log_latest_snapshot")
    assert "Window" not in text and "Aggregate" in text


def test_searches_read_postings_and_no_text(spark):
    for name in ("bm25_topk", "hybrid_search", "keywords_tfidf"):
        scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
        assert any("tf:" in x for x in scans) and not any("lang" in x for x in scans)
        # Only the questions are tokenised, not the documents.
        assert sum("text:string" in x for x in scans) <= (name != "keywords_tfidf")
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(spark, "bm25_topk"))
    assert exchanges and not any(re.match(r"doc_id#\d+L?, term", e) for e in exchanges)


def test_chunks_leave_the_whole_text_behind(spark):
    # Below the generator, the text goes in; no output column beside the pieces carries it on.
    generate = re.search(r"Generate posexplode\([^\n]*?\), \[([^\]]*)\]", plan(spark, "chunk_fixed"))
    assert generate and "text" not in generate.group(1)


def test_neighbours_need_no_join(spark):
    assert "Join" not in plan(spark, "neighbor_expand")


def test_range_join_is_bound_to_a_document(spark):
    assert re.search(r"(SortMergeJoin|HashJoin) \[doc_id", plan(spark, "interval_overlap"))


def test_adaptive_execution_is_on(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_whole_texts_go_to_python_in_bounded_batches(spark, tmp_path):
    import pyarrow as pa

    from skarn.plans.registry import BATCH_BYTES, table

    spark.createDataFrame([(k, "x" * 100_000) for k in range(200)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    held = spark.conf.get(key := "spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.set(key, str(1 << 30))
        sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
        got = [r.n for r in table(spark, str(tmp_path), "documents").mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.set(key, held)
    assert len(got) > 1 and max(got) <= BATCH_BYTES + (1 << 20)


def test_a_page_of_rules_stays_in_its_row(spark):
    text = plan(spark, "layout_rule_tables")
    assert len(re.findall(r"Exchange hashpartitioning", text.split("== Initial Plan ==")[0])) <= 1
    assert "Window" not in text and "Join" not in text


def test_pages_are_dealt_by_the_size_of_the_table(spark, monkeypatch):
    monkeypatch.setattr("skarn.operators.index.SHARD", 10_000)
    for name in ("layout_table", "layout_order"):
        text = plan(spark, name).split("== Initial Plan ==")[0]
        dealt = re.findall(r"Exchange hashpartitioning\(page#\d+L?, (\d+)\), REPARTITION_BY_NUM", text)
        assert len(dealt) == 1 and int(dealt[0]) > 4 and len(re.findall("Exchange hashpartitioning", text)) == 1
