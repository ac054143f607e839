"""The library and session stores end to end: import, partial index, search, answer, delete, isolation, compaction."""

import pytest
from pyspark.sql import functions as F

import skarn.assistant as assistant_module
from skarn.assistant import Assistant, reading_order, run_session
from skarn.config import Settings, load
from skarn.functions.models import ExtractiveGenerator, HashEncoder
from skarn.library import Library
from skarn.operators import agent
from skarn.sessions import Sessions
from skarn.sources import files


@pytest.fixture
def library(spark, tmp_path):
    up = tmp_path / "up"
    up.mkdir()
    (up / "a.txt").write_text("Image classification reaches an accuracy of 91 percent. The encoder uses patches.")
    (up / "b.md").write_text("Contrastive learning pulls views together. Attention weighs tokens.")
    (up / "c.txt").write_text(" ")
    lib = Library(spark, str(tmp_path / "lib"), Settings(chunk_strategy="fixed", chunk_size=60, chunk_overlap=10))
    lib.load(str(up))
    return lib, up, tmp_path


def test_library_life(spark, library):
    lib, up, tmp_path = library
    n = lib.count()
    assert {(r.source_file, r.status, r.complete) for r in lib.manifest.read().collect()} == {("a.txt", "success", True), ("b.md", "success", True), ("c.txt", "failed", False)}
    assert lib.load(str(up)).count() == 0 and lib.count() == n
    top = lib.hybrid("accuracy of image classification", 2, rerank=True).orderBy("rank").collect()
    assert "accuracy" in top[0].text and top[0].score >= top[1].score
    got = Assistant(lib, ExtractiveGenerator()).answer("What accuracy does image classification reach?")
    assert got["mode"] == "grounded" and got["cited"] == [1] and "a.txt" in got["answer"]
    assert {(r.name, r.copies) for r in lib.stored().collect()} == {("a.txt", 1), ("b.md", 1)} and lib.original(top[0].doc_id)[0] == "a.txt"
    one = top[0].doc_id
    assert lib.bm25("attention", 5, one).count() == 0 and lib.bm25("attention", 5).count() == 1
    assert lib.vector("attention", 1).first().rank == 1 and lib.resolve(one[:8]) == one
    # A lost chunk makes the document partial, and loading again completes it.
    lib.chunks.rewrite(lib.chunks.read().where(F.col("chunk_id") != top[0].chunk_id))
    assert {r.doc_id: r.status for r in lib.status().collect()}[one] == "partial"
    lib.audit()
    lib.load(str(up))
    assert lib.count() == n and {r.status for r in lib.status().collect()} == {"vectorised"}
    assert lib.delete(one) > 0 and lib.list_chunks(one).count() == 0 and one not in {r.doc_id for r in lib.status().collect()}
    assert lib.health()["documents"] == 2 and [r.name for r in lib.stored().collect()] == ["b.md"]
    with pytest.raises(ValueError):
        lib.original(one)
    with pytest.raises(ValueError):
        Library(spark, str(tmp_path / "lib"), make_encoder=lambda: HashEncoder(8))
    with pytest.raises(ValueError):
        lib.bm25("x", 0)


def test_sessions(spark, tmp_path):
    store = Sessions(spark, str(tmp_path / "s"), Settings(summary_trigger=4, summary_keep=2))
    a, b = store.create("ann"), store.create("ben")
    for k in range(6):
        store.append_turn("ann", a, f"question {k}", f"answer {k}")
    store.append_turn("ben", b, "hello there, this is a long first question", "hi")
    calls = []
    got = store.context("ann", a, lambda old, turns: calls.append(len(turns)) or "short")
    assert calls == [4] and got["summary"] == "short" and [q for q, _ in got["turns"]] == ["question 4", "question 5"]
    assert store.messages("ann", a).count() == 12 and store.title("ben", b) == "hello there, this is a lo"[:24]
    assert store.context("ann", a, lambda old, turns: calls.append(0))["summary"] == "short" and calls == [4]
    with pytest.raises(ValueError):
        store.messages("ben", a)
    store.delete("ann", a)
    assert store.list("ann").count() == 0 and store.messages("ben", b).count() == 2
    with pytest.raises(ValueError):
        store.messages("ann", a)


def test_settings(monkeypatch):
    monkeypatch.setenv("SKARN_TOP_K", "7")
    assert load().top_k == 7
    for bad in ({"top_k": 0}, {"chunk_overlap": 512}, {"chunk_strategy": "x"}, {"online_search": 1}, {"low_relevance": 2.0}):
        with pytest.raises(ValueError):
            Settings(**bad)


# --- answers over a library -------------------------------------------------------------------------

METHOD = "Abstract: We propose a patch encoder. The method uses attention over patches. We use the encoder by adding position vectors. It trains on ImageNet and other datasets for evaluation."
OTHER = "Abstract: We propose contrastive learning of views. The model architecture has two branches. Conclusion: quantitative experimental results achieve 77 percent."


@pytest.fixture
def assistant(spark, tmp_path):
    up = tmp_path / "up"
    up.mkdir()
    (up / "patch.txt").write_text(METHOD + "\nConclusions\nThe model reaches quantitative experimental results of 91 percent in 2021.")
    (up / "views.txt").write_text(OTHER + "\nDatasets used for training and evaluation are small.")
    lib = Library(spark, str(tmp_path / "lib"), Settings(chunk_strategy="fixed", chunk_size=90, chunk_overlap=10, low_relevance=0.05, online_search=True))
    lib.load(str(up))
    page = '<div class="result"><a class="result__a" href="//x/?uddg=https%3A%2F%2Fa.org%2Fp">One &amp; two</a><span class="result__snippet">s</span></div><div class="result"><a href="ftp://b" class="result__a">b</a></div>'
    return Assistant(lib, ExtractiveGenerator(), str(tmp_path / "log"), lambda q: page), tmp_path


def test_answers_are_cached_logged_and_forgotten_with_the_library(spark, assistant):
    who, tmp_path = assistant
    q = "How does the method use the patch encoder?"
    first = who.answer(q)
    assert first["status"] == "answered" and first["mode"] == "grounded" and not first.get("cache")
    again = who.answer(q)
    assert again["cache"]["mode"] == "exact" and again["answer"] == first["answer"]
    assert "cache" not in who.answer("What does this paper use as the encoder?")  # leans on what was said
    rows, invalid = files.read_requests(spark, str(tmp_path / "log"))
    assert sorted(r.retrieval.status for r in rows.collect()) == ["cache", "success", "success"] and invalid.first()[0] == 0
    views = next(r.doc_id for r in who.library.stored().collect() if r.name == "views.txt")
    who.library.delete(views)
    assert "cache" not in who.answer(q)
    with pytest.raises(ValueError):
        who.answer(" ")
    with pytest.raises(ValueError):
        who.answer(q, views)


def test_low_relevance_waits_for_the_same_session(spark, assistant, monkeypatch):
    who, _ = assistant
    monkeypatch.setattr(who.library, "settings", Settings(chunk_strategy="fixed", chunk_size=90, chunk_overlap=10, low_relevance=0.99))
    asked = who.answer("patch encoder attention", session_id="s")
    assert asked["status"] == "needs_confirmation" and asked["answer"] and not asked["cited"]
    for args in (("patch encoder attention", None, "other"), ("views", None, "s")):
        with pytest.raises(ValueError):
            who.answer(*args, confirm=asked["confirmation"])
    good = who.answer("patch encoder attention", session_id="s", confirm=asked["confirmation"])
    assert good["confirmed"] and good["cited"] and good["answer"].startswith("检索结果相关性低；已按你的确认")
    who.library.delete(next(r.doc_id for r in who.library.stored().collect() if r.name == "views.txt"))
    with pytest.raises(ValueError):
        who.answer("patch encoder attention", session_id="s", confirm=asked["confirmation"])


def test_tools_and_sessions(spark, assistant):
    who, tmp_path = assistant
    ids = {r.name: r.doc_id for r in who.library.stored().collect()}
    tools = who.tools("s")
    assert [t.name for t in tools] == [*agent.LOCAL_TOOLS, "web_search"] or {t.name for t in tools} == {*agent.LOCAL_TOOLS, "web_search"}
    call = lambda name, **args: agent.execute(tools, name, args)
    meta = call("paper_metadata", doc_id=ids["patch.txt"])["result"]
    assert meta["year"] == 2021 and meta["title"].startswith("Abstract")
    words = call("keyword_extract", doc_id=ids["patch.txt"])["result"]["keywords"]
    assert 0 < len(words) <= 5 and all(w["lines"] for w in words)
    summary = call("paper_summary", doc_id=ids["patch.txt"])["result"]
    assert summary["status"] == "answered" and summary["answer"].count("###") == 4 and summary["cited"]
    both = call("paper_compare", paper_a_id=ids["patch.txt"], paper_b_id=ids["views.txt"])["result"]
    assert len(both["coverage"]) == 6 and {r["doc_id"] for r in both["references"]} == set(ids.values()) and [r["id"] for r in both["references"]] == list(range(1, len(both["references"]) + 1))
    assert call("paper_compare", paper_a_id=ids["patch.txt"], paper_b_id=ids["patch.txt"])["error_kind"] == "input"
    assert [r["source_file"] for r in call("paper_list")["result"]] == ["patch.txt", "views.txt"]
    assert call("web_search", query="x")["result"]["results"] == [{"title": "One & two", "snippet": "s", "url": "https://a.org/p"}]
    sessions = Sessions(spark, str(tmp_path / "s"))
    mine = sessions.create("ann")
    got = run_session(who, sessions, "ann", mine, "计算 2*21")
    assert got["answer"] == '"42"' and got["stop"] == "task_complete" and set(got["trace"][0]) <= {"iteration", *agent.TRACE_KEYS}
    assert run_session(who, sessions, "ann", mine, "总结论文 patch.txt")["results"][0]["result"]["doc_id"] == ids["patch.txt"]
    assert sessions.messages("ann", mine).count() == 4
    with pytest.raises(ValueError):
        run_session(who, sessions, "ben", mine, "计算 1+1")
    assert sessions.messages("ann", mine).count() == 4


def test_web_results_tell_no_hits_from_no_result_page():
    assert files.web_results('<div class="no-results">none</div>') == []
    for page in ("<html>hello</html>", '<form id="challenge-form"></form>'):
        with pytest.raises(ValueError):
            files.web_results(page)
    many = "".join(f'<div class="result results_links"><a class="result__a" href="https://a.org/{k}">t{k}</a></div>' for k in range(9))
    assert [r["url"] for r in files.web_results(many)] == [f"https://a.org/{k}" for k in range(5)]


def test_names_and_order():
    names = [("a.pdf", "1"), ("deep a.pdf", "2"), ("b.txt", "3"), ("B.md", "4")]
    assert agent.named_documents("compare Deep A.pdf with b.txt", names) == ["2", "3"]
    assert agent.named_documents("what of b?", names) == [] and agent.named_documents("a and b.md", names) == ["1", "4"]
    texts = ["title", "Abstract. x", "i", "ii", "iii", "iv", "v", "5. Conclusions", "after", "more", "last"]
    assert reading_order(texts) == [1, 2, 3, 4, 5, 7, 8, 9, 6, 10]


def test_answers_fit_the_window_of_the_model(spark, assistant):
    who, _ = assistant
    q = "How does the method use the patch encoder?"
    whole = who.answer(q, confirm=None)
    counted = []

    def tokens(question, context):
        counted.append(len(context))
        return len(context) // 2 + len(question)

    narrow = Settings(**{**vars(who.library.settings), "window_tokens": 200, "output_tokens": 40})
    who.library.settings = narrow
    got = Assistant(who.library, ExtractiveGenerator(), tokens=tokens).answer(q)
    size = lambda rows: len(assistant_module.context_of(rows))
    assert size(got["references"]) // 2 + len(q) <= 160 < size(whole["references"]) // 2 + len(q) and got["references"] and len(counted) > 2
    with pytest.raises(ValueError):
        Assistant(who.library, ExtractiveGenerator(), tokens=lambda question, context: 161).answer(q)


def test_long_questions_are_answered_by_their_equal_alone(spark, assistant):
    who, _ = assistant
    cache, base = who.cache, "what use has the encoder " * 11
    kept = {"status": "answered", "mode": "grounded", "warnings": [], "invalid": [], "missing": False, "cited": [1], "answer": "x"}
    assert len(base) > assistant_module.COMPARED and cache.put(base, kept, "s")
    assert cache.lookup(base, "s")["cache"]["mode"] == "exact" and cache.lookup(base + "?", "s") is None
    assert cache.put("what use has the encoder", kept, "s") and cache.lookup("what use has the encoder?", "s")["cache"]["mode"] == "semantic"
    assert cache.lookup(base + "?", "s") is None
