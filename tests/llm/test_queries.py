"""The registered queries and the pipeline over the smallest tables."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skarn.llm.decontaminate import best_substring
from skarn.llm.neardup import near_duplicates
from skarn.llm.queries import oracle_sql, queries
from skarn.llm.substring_dedup import merged
from skarn.llm.toxicity import scored, train
from tests.llm.test_operators import LOWER, brute_components

D = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "item_id", "distance", "start", "stop"],
    "op2": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op3": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op5": ["query_id", "rank", "vec_id", "score"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8": ["doc_id", "held_out", "lang_pred", "score"],
    "op9": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op10": ["file", "seq", "page_id", "start", "length", "digest", "status"],
    "op11": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op12": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op13": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
}


def rows(pdf):
    """Cells as text, numbers alike whether a null made pandas read them as floats or not."""
    cell = lambda v: str(v) if isinstance(v, (str, bool)) else "" if str(v) in ("None", "nan", "<NA>") else f"{float(v):.6f}"
    return sorted(tuple(cell(v.item() if hasattr(v, "item") else v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    out = queries()[name](spark, D)
    wanted = COLUMNS[name.split("_")[0]]
    assert out.columns[: len(wanted)] == wanted
    ours = out.toPandas()
    assert len(ours) > 0
    if name in oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "conversations"):
            con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
        theirs = con.sql(oracle_sql()[name]).df()
        key = sorted(out.columns)
        assert rows(ours[key]) == rows(theirs[key])


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{D}/documents.parquet")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, D).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(stages):
    for name in list(stages)[1:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_stage_toxicity(spark, stages):
    docs = stages["documents"]
    marked = scored(docs, train(docs, spark.read.parquet(f"{D}/labels.parquet")))
    assert ids(stages["toxicity"]) == ids(marked.where("score < 0.3")) and ids(stages["toxicity"]) < ids(docs)


def test_stages_take_clashing_columns_and_empty_tables(spark, stages):
    docs = stages["documents"].withColumns({"score": F.lit("mine"), "z": F.lit(1), "row": F.lit(2)}).limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, D)
        assert docs.columns == [*stages["documents"].columns, "score", "z", "row"]
    assert {r.score for r in docs.collect()} == {"mine"}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, stages["documents"].limit(0), D).count() == 0


def test_stage_near_duplicates(stages):
    before = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    groups = brute_components(before, 80)
    assert ids(stages["minhash_near_dedup"]) == {i for i, (_, root) in groups.items() if i == root}
    assert near_duplicates(stages["minhash_near_dedup"], 80).where("not kept").count() == 0


def test_stage_repeated_passages(stages):
    before = {r.doc_id: r.text.encode() for r in stages["minhash_near_dedup"].collect()}
    seen = {}
    for t in before.values():
        for p in range(len(t) - 199):
            k = hashlib.blake2b(t[p : p + 200], digest_size=12).digest()
            seen[k] = seen.get(k, 0) + 1
    for r in stages["suffix_array_dedup"].collect():
        t = before[r.doc_id]
        spans = merged([(p, p + 200) for p in range(len(t) - 199) if seen[hashlib.blake2b(t[p : p + 200], digest_size=12).digest()] > 1])
        gone = [False] * len(t)
        for lo, hi in spans:
            gone[lo:hi] = [True] * (hi - lo)
        # A character goes if all its bytes are covered.
        kept, at = [], 0
        for c in t.decode():
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        assert r.text == "".join(kept) and r.n_chars == len(r.text)


def test_stage_benchmark_leaks(spark, stages):
    """Every item against every place of every text."""
    lower = lambda t: b" ".join((t or "").encode().translate(LOWER).split())
    items = [x for x in (lower(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()) if x]
    before = {r.doc_id: lower(r.text) for r in stages["suffix_array_dedup"].collect()}
    held = {i for i, t in before.items() if any(best_substring(x, t, int(0.2 * len(x))) for x in items)}
    assert set(before) - held == ids(stages["benchmark_decontamination"]) and held


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null").collect()}
    got = [r for r in queries()["op6_toxicity"](spark, d).collect() if r.held_out and r.doc_id in truth]
    toxic, other = ([r.score for r in got if truth[r.doc_id] == k] for k in (1, 0))
    # About one label in twenty of this table marks a text with nothing toxic in it, in any language.
    above = sum((x > y) + 0.5 * (x == y) for x in toxic for y in other) / (len(toxic) * len(other))
    assert len(got) > 900 and above >= 0.9 and sum(r.predicted == truth[r.doc_id] for r in got) >= 0.93 * len(got)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").where("lang is not null").collect()}
    got = [r for r in queries()["op8_language_id"](spark, d).collect() if r.held_out and r.doc_id in langs]
    sure = [r for r in got if not r.ambiguous]
    assert len(got) > 100 and sum(r.lang_pred == langs[r.doc_id] for r in got) >= 0.95 * len(got)
    # What is flagged is where the errors are.
    assert sum(r.lang_pred == langs[r.doc_id] for r in sure) * len(got) >= sum(r.lang_pred == langs[r.doc_id] for r in got) * len(sure)


def test_stage_packing_and_run(spark, stages):
    packed = stages["best_fit_packing"]
    assert ids(packed) == ids(stages["benchmark_decontamination"])
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
    assert corpus_pipeline.run(spark, D).count() == packed.count()


def test_stages_keep_one_of_repeated_rows(spark):
    from tests.llm.conftest import prose

    text, other = prose(1, 200), prose(2, 200)
    rows = [(1, text), (1, text), (2, other), (2, prose(3, 200)), (None, prose(4, 200)), (None, prose(4, 200)), (None, other), (3, ""), (3, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates_out(spark, docs.repartition(3), D)
    left = sorted((r.text or "") for r in out.collect())
    assert left == sorted([text, other, prose(3, 200), prose(4, 200), "", "", ""])
    after = corpus_pipeline.repeated_passages_out(spark, out, D)
    assert sorted((r.text or "") for r in after.collect()) == left and after.columns == docs.columns


def test_passages_leave_null_texts_alone(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (2, "", 0, "y"), (3, "a short one", 11, None)], "doc_id long, text string, n_chars long, source string")
    kept = dict(corpus_pipeline.STAGES)["suffix_array_dedup"](spark, rows, D)
    assert kept.columns == rows.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))
