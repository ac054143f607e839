"""Hand-written cases for what the tables do not hold: splitters, packing, citations, arithmetic, routing, files and state."""

import io
import json
import zipfile
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skarn.functions import text as tx
from skarn.functions.calculator import calculate
from skarn.operators import agent, chunking, evidence, index, layout, memory, retrieve, telemetry
from skarn.sources import files

TEXTS = st.text(alphabet="ab .。！\n\r\t", max_size=200)


# --- chunking ----------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40), st.integers(0, 39))
def test_recursive_ranges_hold(text, size, overlap):
    overlap = min(overlap, size - 1)
    got = chunking.recursive_ranges(text, size, overlap)
    covered = set()
    for (a, b), (c, _) in zip(got, got[1:] + [(len(text), 0)]):
        assert 0 <= a < b <= len(text) and a < c and b - a <= size
        covered.update(range(a, b))
    assert covered == set(range(len(text)))


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40), st.integers(0, 39))
def test_semantic_ranges_hold(text, size, overlap):
    overlap = min(overlap, size - 1)
    got = chunking.semantic_ranges(text, size, overlap)
    assert {k for a, b in got for k in range(a, b)} == set(range(len(text)))
    assert all(b - a <= size for a, b in got)
    assert all(a < c and b - c <= overlap for (a, b), (c, _) in zip(got, got[1:]))


def test_recursive_keeps_separators_and_finds_repeats():
    text = "aa bb\n\ncc aa bb. aa"
    assert "".join(text[a:b] for a, b in chunking.recursive_ranges(text, 7, 0)) == text
    assert chunking.recursive_ranges("", 5, 0) == []
    assert chunking.recursive_ranges("aaaaaa", 3, 2)[0] == (0, 3)


def test_semantic_units():
    text = "第一句。第二句！\n\nOne two. 3.14 is a number. End"
    parts = [text[a:b] for a, b in chunking.semantic_ranges(text, 12, 0)]
    assert parts[0] == "第一句。第二句！\n\n" and "3.14 is" in "".join(parts)


def test_chunks_of_tables_and_blanks(spark):
    rows = [("a", "x" * 30, "table"), ("b", "  \n ", "paragraph"), ("c", "x" * 10 + " " * 10 + "y" * 10, "paragraph")]
    got = chunking.chunks(spark.createDataFrame(rows, "doc_id string, text string, block_type string"), "fixed", 10, 0).collect()
    assert [(r.doc_id, r.chunk_index, r.start_index, r.end_index) for r in sorted(got, key=lambda r: (r.doc_id, r.chunk_index))] == [("a", 0, 0, 30), ("c", 0, 0, 10), ("c", 2, 20, 30)]
    assert len({r.chunk_id for r in got}) == 3


@pytest.mark.parametrize("strategy", ["fixed", "recursive", "semantic"])
def test_chunks_are_cut_where_they_say(spark, strategy):
    texts = ["é🙂 one. two\r\nthree\n" * 9, "x" * 23, "ab " * 30 + "\u2028end", "y"]
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id int, text string, line_start int")
    for size, overlap in ((10, 0), (10, 9), (10, 3), (64, 40), (500, 2)):
        for r in chunking.chunks(docs, strategy, size, overlap).collect():
            t = texts[r.doc_id]
            ends = [m.end() for m in __import__("re").finditer(chunking.LINE_END, t)]
            assert r.text == t[r.start_index : r.end_index] and len(r.text) <= size
            assert (r.line_start, r.line_end) == tuple(5 + sum(e <= at for e in ends) for at in (r.start_index, r.end_index - 1))
        if strategy == "fixed":
            starts = {(r.doc_id, r.chunk_index): r.start_index for r in chunking.chunks(docs, strategy, size, overlap).collect()}
            expected = {(d, k): k * (size - overlap) for d, t in enumerate(texts) for k in range(max(0, -(-(len(t) - size) // (size - overlap))) + 1) if t[k * (size - overlap) :][:size].strip()}
            assert starts == expected


@pytest.mark.parametrize("size, overlap", [(0, 0), (5, 5), (5, -1), (True, 0), (5.0, 0)])
def test_bad_sizes(size, overlap):
    with pytest.raises(ValueError):
        chunking.check_size(size, overlap)


def test_line_numbers_and_sentences(spark):
    df = spark.createDataFrame([("a\r\nb\nc d",)], "text string")
    at = [df.select(chunking.line_of(F.col("text"), F.lit(k), F.lit(1))).first()[0] for k in (0, 3, 5, 7)]
    assert at == [1, 2, 3, 4]
    pairs = chunking.sentence_bigrams(spark.createDataFrame([(1, "A b. C? D! E"), (2, "one. two."), (3, "x is 3.14 y.")], "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.k, r.start, r.stop) for r in pairs) == [(1, 0, 0, 8), (1, 1, 5, 11), (1, 2, 8, 12), (2, 0, 0, 9), (3, 0, 0, 12)]


def test_table_windows():
    assert chunking.table_windows(["r1", "r2", "r3"], "head", 10) == ["head\nr1\nr2", "head\nr3"]
    with pytest.raises(ValueError):
        chunking.table_windows(["x" * 10], "head", 10)


def test_table_windows_query_leaves_no_character_out(spark):
    from skarn.plans import QUERIES

    d = "/root/testdata/sf0.001"
    passages = {}
    for r in sorted(QUERIES["table_windows"](spark, d).collect(), key=lambda r: (r.doc_id, r.w)):
        header, rest = r.passage.split("\n", 1)
        assert header == "| a | b |" and len(r.passage) <= 600
        passages.setdefault(r.doc_id, []).append(rest.replace("\n", ""))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert any(len(line) > 590 for t in texts.values() for line in t.split("\n"))
    assert {i: "".join(x) for i, x in passages.items()} == {i: t.replace("\n", "") for i, t in texts.items()}
    assert chunking.table_rows("abc\n\nabcdefgh", "head", 10) == ["abc", "", "abcde", "fgh"]


# --- text --------------------------------------------------------------------------------------


def test_tokens_fold_full_width_and_split_cjk(spark):
    df = spark.createDataFrame([("ＢＥＲＴ与attention 2层",), (None,)], "text string")
    assert [r[0] for r in df.select(tx.tokens(F.col("text"), normalize=True)).collect()] == [["bert", "attention", "2", "与", "层"], []]


def test_placeholder_strip_and_prefix(spark):
    df = spark.createDataFrame([("[图像区域 1] 12 ",), ("[图像区域 1] x",), ("12",)], "text string")
    assert [r[0] for r in df.select(tx.is_placeholder(F.col("text"))).collect()] == [True, False, False]
    q = spark.createDataFrame([("什么是注意力？请用中文回答并注明页码。",), ("What?",)], "q string")
    assert [r[0] for r in q.select(tx.stripped_request(F.col("q"))).collect()] == ["什么是注意力？", "What?"]
    p = spark.createDataFrame([("a[参考文档1]b[参考",), ("a[参考文档12",), ("a[x",)], "t string")
    assert [r[0] for r in p.select(tx.visible_prefix(F.col("t"))).collect()] == ["a[参考文档1]b", "a", "a[x"]


def test_constraints_differ_where_meaning_does(spark):
    base = "Is BERT above 5 %?"
    for other in ("Is BERT above 6 %?", "Is GPT above 5 %?", "Is BERT not above 5 %?", "Is BERT more than 5 %?", "Is BERT above 5 % in English?", "Is BERT above -5 %?"):
        df = spark.createDataFrame([(base, other)], "a string, b string")
        assert not df.select(tx.constraints(F.col("a")) == tx.constraints(F.col("b"))).first()[0], other


# --- evidence ----------------------------------------------------------------------------------


def row(text, score):
    return {"text": text, "score": score, "name": "f.pdf", "place": "行1–2"}


def test_packing_skips_and_continues():
    head = len(evidence.HEADER.format(n=1, name="f.pdf", place="行1–2"))
    got = evidence.pack([row("a" * 50, 0.9), row("b" * 400, 0.8), row("c" * 5, 0.7)], head * 2 + 50 + len(evidence.SEPARATOR) + 5)
    assert [(r["id"], r["text"][0], r["truncated"]) for r in got] == [(1, "a", False), (2, "c", False)]


def test_packing_cuts_at_a_sentence_in_the_second_half():
    head = len(evidence.HEADER.format(n=1, name="f.pdf", place="行1–2"))
    text = "One. " + "w" * 20 + ". " + "x" * 100
    got = evidence.pack([row(text, 1.0)], head + 45)
    assert got[0]["truncated"] and got[0]["text"] == "One. " + "w" * 20 + "."
    assert evidence.pack([row("  ", 1.0)], 1000) == []


def test_packing_refuses_a_budget_without_room_and_skips_bare_marks():
    with pytest.raises(ValueError):
        evidence.pack([row("a" * 50, 0.9)], 20)
    assert evidence.pack([row("[图像区域 1] 12", 0.9)], 1000) == []
    with pytest.raises(ValueError):
        evidence.pack([row("a", float("nan"))], 1000)


@pytest.mark.parametrize("most", [40, 60, 100, 199, 10**6])
def test_token_budget_takes_the_largest_context_that_fits(most):
    rows = [row("word " * 30, 0.9), row("other " * 20, 0.8), row("x. " * 9, 0.7)]
    tokens = lambda packed: 10 + sum(len(r["text"].split()) for r in packed)
    got = evidence.pack_tokens(rows, 600, tokens, most)
    assert tokens(got) <= most
    sizes = []
    for budget in range(1, 601):
        try:
            sizes.append(tokens(evidence.pack(rows, budget)))
        except ValueError:
            pass
    assert tokens(got) == max(n for n in sizes if n <= most)
    with pytest.raises(ValueError):
        evidence.pack_tokens(rows, 600, tokens, 9)


def test_gate_notices_and_warnings():
    assert evidence.gate([]) == "empty" and evidence.gate([{"score": 0.05}]) == "low" and evidence.gate([{"score": 0.05}, {"score": 0.1}]) == "grounded"
    with pytest.raises(ValueError):
        evidence.gate([{"score": 7.0}])
    assert evidence.with_notice("a", "grounded") == "a" and evidence.with_notice("a", "empty").endswith("\n\na")
    assert evidence.with_notice("a", "low", True) != evidence.with_notice("a", "low")
    assert evidence.reference_warnings([{"warning": "w"}, {"warning": "w"}, {"excerpt": True}]) == ["w", evidence.EXCERPT_NOTE]


def test_source_lists_are_built_anew():
    answer = "A [参考文档2] and [参考文档7], again [参考文档2].\n## Sources\n- made up"
    got = evidence.resolve_citations(answer, {1: ("a.pdf", "行1–2", False), 2: ("b.pdf", "位置未记录", True)})
    assert got["answer"].endswith("## 参考来源\n- [参考文档2] b.pdf；位置未记录；正文已截断，仅展示已送入上下文的证据")
    assert got["warnings"] == [evidence.PLACELESS_WARNING.format(n=2), evidence.UNKNOWN_WARNING.format(n=7)]
    none = evidence.resolve_citations("x `[参考文档1]`", {1: ("a", "b")})
    assert none["missing"] and none["warnings"] == [evidence.UNCITED_WARNING] and none["answer"].endswith(evidence.NO_SOURCES)
    with pytest.raises(ValueError):
        evidence.resolve_citations("  ", {})


def test_citations_outside_code_only():
    answer = "See [参考文档1](http://x) and [参考文档9].\n```\n[参考文档2]\n```\n\n    [参考文档2]\n`[参考文档2]` again [参考文档1]\n## References\n[参考文档2]"
    got = evidence.resolve_citations(answer, {1: ("a_b.pdf", "行1–2"), 2: (None, "位置未记录")})
    assert got["cited"] == [1] and got["invalid"] == [9] and not got["missing"]
    assert got["answer"].count("[参考文档2]") == 3 and "a\\_b.pdf" in got["answer"] and "http" not in got["answer"]
    assert evidence.resolve_citations("none", {1: ("a", "b")})["missing"]


def test_reading_order_and_glyphs(spark):
    # Across the top, two bodies on either side, across the middle, and one more on either side.
    items = [(1, 0, 0.0, 0.0, 100.0, 10.0), (1, 1, 0.0, 20.0, 45.0, 60.0), (1, 2, 55.0, 15.0, 100.0, 60.0), (1, 3, 0.0, 62.0, 45.0, 90.0), (1, 4, 55.0, 61.0, 100.0, 90.0)]
    items += [(1, 5, 0.0, 95.0, 100.0, 99.0), (1, 6, 55.0, 100.0, 100.0, 120.0), (1, 7, 0.0, 101.0, 45.0, 120.0)]
    df = spark.createDataFrame([(*i, 100.0) for i in items], "page int, n int, x0 double, y0 double, x1 double, y1 double, width double")
    assert [r.n for r in layout.reading_order(df).orderBy("order").collect()] == [0, 1, 3, 2, 4, 5, 7, 6]
    # With one body on a side only, the page has one column.
    assert [r.n for r in layout.reading_order(df.where("n < 4")).orderBy("order").collect()] == [0, 2, 1, 3]
    glyphs = [(1, 1, float(k), b, s, c) for k, (b, s, c) in enumerate([(10.0, 10.0, "x"), (6.0, 6.0, "2"), (12.0, 6.0, "i"), (10.0, 10.0, "y")])]
    got = layout.marked_lines(spark.createDataFrame(glyphs, "page int, line int, x double, baseline double, size double, char string")).first()
    assert got.text == "x^{2}_{i}y"


def test_tables(spark):
    words = [(1, 0.0, 10.0, 5.0, "a"), (1, 30.0, 40.0, 5.5, "b"), (1, 0.0, 8.0, 20.0, "c"), (1, 31.0, 40.0, 20.0, "d"), (2, 0.0, 9.0, 5.0, "alone")]
    got = layout.table_cells(spark.createDataFrame(words, "page int, x0 double, x1 double, y double, word string")).collect()
    assert sorted((r.row, r.col, r.text) for r in got) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d")]
    box = "page long, {} long, x0 double, x1 double, top double, bottom double"
    # The first caption can have the upper table only; the second, nearer to it, then takes the lower one. Far aside does not count.
    caps = spark.createDataFrame([(1, 1, 0.0, 50.0, 0.0, 10.0), (1, 2, 0.0, 50.0, 62.0, 70.0), (1, 3, 300.0, 350.0, 62.0, 70.0)], box.format("caption_id"))
    tabs = spark.createDataFrame([(1, 1, 0.0, 60.0, 30.0, 60.0), (1, 2, 0.0, 60.0, 95.0, 120.0)], box.format("table_id"))
    assert sorted((r.table_id, r.caption_id) for r in layout.assign_captions(caps, tabs).collect()) == [(1, 1), (2, 2)]
    assert layout.greedy_pairs([{"caption_id": 1, "gap": 1.0, "table_id": 1}, {"caption_id": 2, "gap": 2.0, "table_id": 1}, {"caption_id": 2, "gap": 5.0, "table_id": 2}]) == [{"table_id": 1, "caption_id": 1}, {"table_id": 2, "caption_id": 2}]
    shown = lambda rows: spark.createDataFrame([(rows,)], "rows array<array<string>>").select(layout.markdown(F.col("rows"))).first()[0]
    assert shown([["h", "a|b"], ["x\ny", "1\n2"], ["u\nv", "w"]]) == "| h | a\\|b |\n| --- | --- |\n| x | 1 |\n| y | 2 |\n| u<br>v | w |"
    assert shown([]) == ""


def fragment(page, top, bottom, number=None, header="h", continued=False, left=0.0):
    return {"page": page, "n": 1, "top": top, "bottom": bottom, "height": 800.0, "lefts": [left, 50.0], "rights": [40.0, 90.0], "number": number, "header": header, "continued": continued}


def test_tables_over_pages(spark):
    schema = "doc_id int, page int, n int, top double, bottom double, height double, lefts array<double>, rights array<double>, number string, header string, continued boolean"

    def grouped(fragments):
        rows = spark.createDataFrame([{"doc_id": 1, **f} for f in fragments], schema)
        return [r["table_id"] for r in layout.stitched_tables(rows).orderBy("page", "n").collect()]

    first, rest = fragment(1, 700.0, 790.0, "1"), fragment(2, 10.0, 790.0)
    assert grouped([first, rest, fragment(3, 10.0, 90.0)]) == [1, 1, 1]  # the number of the first holds for all
    assert grouped([fragment(1, 700.0, 790.0), rest]) == [1, 2]  # a header alone is no sign
    assert grouped([first, fragment(2, 10.0, 90.0, "1", "x", True)]) == [1, 1]
    for other in (fragment(2, 300.0, 400.0), fragment(3, 10.0, 90.0), fragment(2, 10.0, 90.0, "2"), fragment(2, 10.0, 90.0, left=9.0), fragment(2, 10.0, 90.0, header="x")):
        assert grouped([first, other]) == [1, 2]


def test_tables_between_rules(spark):
    """A table below its caption; one whose head has parts that its columns lack; one that a grid covers; two rules are none."""
    rule = lambda page, y, x0=20.0, x1=200.0: (page, x0, x1, y, y + 1.0, 250.0, 800.0)
    rules = [rule(p, y, 20.0 + k % 2, 201.0 - k % 2) for p in (1, 2, 3) for k, y in enumerate((120.0, 140.0, 200.0))] + [rule(4, 120.0), rule(4, 140.0)] + [rule(5, y) for y in (300.0, 320.0, 400.0)]
    captions = [(p, 1, 20.0, 90.0, 100.0, 112.0) for p in range(1, 6)]
    word = lambda page, x, y, text, wide=30.0: (page, x, x + wide, y - 8, y, text)
    words = [word(p, x, y, f"{x:.0f}/{y:.0f}") for p in range(1, 6) for y in (135.0, 160.0, 161.5, 180.0) for x in (25.0, 120.0)]
    words += [word(2, 60.0, 135.0, "more", 20.0), word(2, 30.0, 180.0, "long", 60.0)]
    frames = [
        spark.createDataFrame(rules, "page int, x0 double, x1 double, y0 double, y1 double, width double, height double"),
        spark.createDataFrame(captions, "page int, caption_id int, x0 double, x1 double, top double, bottom double"),
        spark.createDataFrame(words, "page int, x0 double, x1 double, top double, y double, word string"),
    ]
    grids = spark.createDataFrame([(3, 30.0, 60.0, 150.0, 170.0), (1, 30.0, 60.0, 500.0, 600.0)], "page int, x0 double, x1 double, top double, bottom double")
    tables = layout.rule_tables(*frames, grids)
    assert [(r["page"], r["caption_id"], r["top"], r["head"], r["bottom"]) for r in tables.collect()] == [(1, 1, 120.5, 140.5, 200.5)]
    cells = {(r["row"], r["col"]): r["text"] for r in layout.rule_cells(tables, frames[2]).collect()}
    assert cells == {(0, 0): "25/135", (0, 1): "120/135", (1, 0): "25/160 25/162", (1, 1): "120/160 120/162", (2, 0): "25/180", (2, 1): "120/180"}


def test_pages_and_tables_become_documents(spark):
    line = "doc_id string, page int, n int, x0 double, y0 double, x1 double, y1 double, width double, text string"
    lines = [("d", 1, 1, 0.0, 5.0, 90.0, 15.0, 100.0, "Title"), ("d", 1, 2, 0.0, 680.0, 50.0, 690.0, 100.0, "Table 1 Results"), ("d", 2, 1, 0.0, 400.0, 90.0, 410.0, 100.0, "after"), ("d", 3, 1, 0.0, 4.0, 5.0, 9.0, 100.0, "  ")]
    tab = "doc_id string, page int, n int, x0 double, x1 double, top double, bottom double, height double, lefts array<double>, rights array<double>, rows string"
    tables = [("d", 1, 1, 0.0, 90.0, 700.0, 790.0, 800.0, [0.0, 50.0], [40.0, 90.0], json.dumps([["k", "v"], ["a", "1"]])), ("d", 2, 1, 0.0, 90.0, 10.0, 90.0, 800.0, [1.0, 51.0], [41.0, 91.0], json.dumps([["k", "v"], ["b", "2"]])), ("d", 2, 2, 0.0, 90.0, 500.0, 600.0, 800.0, [0.0, 9.0], [5.0, 90.0], json.dumps([["", "x"], ["", ""]]))]
    got = layout.documents(spark.createDataFrame(lines, line), spark.createDataFrame(tables, tab)).collect()
    assert sorted((r.page_number, r.page_end, r.content_type, r.text) for r in got) == [(1, 1, "text", "Title\nTable 1 Results"), (1, 2, "table", "Table 1 Results\n| k | v |\n| --- | --- |\n| a | 1 |\n| b | 2 |"), (2, 2, "text", "after")]


# --- arithmetic and agent ------------------------------------------------------------------------


@pytest.mark.parametrize("text, value", [("(1+2)/3", "1"), ("1/3", "0.3333333333333333333333333333"), ("3.14×2", "6.28"), ("10除以4", "2.5"), ("-(2-5)*2", "6"), ("2--3", "5"), ("0*-1", "0"), ("1-2-3", "-4"), ("8/2/2", "2")])
def test_calculator(text, value):
    assert calculate(text) == value


@pytest.mark.parametrize("text", ["", "1/0", "2**3", "(1", "1)", "a+1", "1+", "1 2", "9" * 300, "1" + "+1" * 120])
def test_calculator_refuses(text):
    with pytest.raises(ValueError):
        calculate(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 999), min_size=1, max_size=8), st.lists(st.sampled_from("+-*"), min_size=7, max_size=7))
def test_calculator_like_python(numbers, signs):
    text = str(numbers[0]) + "".join(s + str(n) for s, n in zip(signs, numbers[1:]))
    assert Decimal(calculate(text)) == eval(text)  # noqa: S307 - digits and signs only


TOOLS = agent.LOCAL_TOOLS
ID = "a" * 64


@pytest.mark.parametrize(
    "question, tool",
    [("列出论文", "paper_list"), ("现在几点", "current_time"), ("提取这篇的关键词", "keyword_extract"), ("请对比两篇论文", "paper_compare"), ("这篇论文的主要贡献", "knowledge_base_search"), ("计算 3+4*2", "calculator"), ("what is attention?", None)],
)
def test_route(question, tool):
    plan = agent.route(question, TOOLS)
    assert plan is not None and plan.tool == tool and not plan.unavailable


def test_route_falls_back_and_batches():
    assert agent.route("先总结论文再提取关键词", TOOLS) is None
    assert agent.route("hello there", TOOLS) is None
    assert agent.route("最新的论文", TOOLS).unavailable == "web_search"
    assert agent.route("分别总结两篇论文", TOOLS).batch == ["paper_summary"] * 2
    assert agent.route("列出论文", TOOLS, executed=True) is None
    with pytest.raises(ValueError):
        agent.route("  ", TOOLS)


def tools(fails=False):
    def summary(doc_id):
        if fails:
            raise TimeoutError("slow")
        return {"doc_id": doc_id}

    return [agent.Tool("paper_summary", summary, {"doc_id"}, {"doc_id"}), agent.Tool("calculator", lambda expression: calculate(expression), {"expression"}, {"expression"})]


def test_loop_completes_recovers_and_stops():
    done = agent.run_loop("计算 1+1", tools(), lambda t, q, k: {"expression": "1+1"})
    assert done["stop"] == "task_complete" and done["results"][0]["result"] == "2"
    both = agent.run_loop(f"分别总结论文 {ID} 和 {'b' * 64}", tools(), lambda t, q, k: {"doc_id": (ID, "b" * 64)[k]})
    assert both["stop"] == "task_complete" and len(both["results"]) == 2
    slow = agent.run_loop("总结论文", tools(fails=True), lambda t, q, k: {"doc_id": ID})
    assert slow["stop"] == "incomplete" and slow["results"][0]["error_kind"] == "timeout" and slow["results"][0]["attempts"] == 2
    assert agent.execute(tools(), "calculator", {"x": 1})["error_kind"] == "input"
    assert agent.execute(tools(), "calculator", {"expression": float("nan")})["status"] == "error"


def test_batches_have_a_deadline_and_a_common_capacity():
    import threading
    import time

    stop, running, most = threading.Event(), [], []

    def wait(n):
        running.append(n)
        most.append(len(running))
        time.sleep(0.05)
        running.remove(n)
        return n

    slow = [agent.Tool("wait", wait, {"n"}), agent.Tool("hang", lambda: stop.wait(5), set())]
    rows = agent.execute_batch(slow, [("wait", {"n": k}) for k in range(6)], parallel=6)
    assert [r["result"] for r in rows] == list(range(6)) and max(most) <= agent.CAPACITY
    late = agent.execute_batch(slow, [("hang", {}), ("hang", {})], timeout=0.1)
    assert {r["error_kind"] for r in late} == {"deadline"} and all(r["pending"] for r in late)
    # Calls given up still hold their places.
    assert agent.execute_batch(slow, [("wait", {"n": 1})], timeout=0.1)[0]["error_kind"] in ("capacity", "deadline")
    stop.set()
    time.sleep(0.1)
    assert agent.execute_batch(slow, [("wait", {"n": 1})])[0]["status"] == "success"
    p = agent.Progress()
    for k in range(40):
        p.put({"k": k})
    assert [x["k"] for x in p.drain()] == list(range(8, 40)) and p.drain() == []


def test_agent_records_show_the_trace_at_the_end_only():
    metrics = {"trace": [{"a": 1}, {"a": 2}], "seconds": 1}
    some = telemetry.agent_record("r", "u", "s", "q", "tool_result", metrics, iteration=1)
    assert some["step"] == {"a": 2} and "trace" not in some["metrics"]
    assert telemetry.agent_record("r", "u", "s", "q", "done", metrics, stop_reason="task_complete")["metrics"] == metrics


def test_vector_search_guards_and_ties(spark, monkeypatch):
    rows = [(k, [1.0, float(k % 3)]) for k in range(9)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(10 + k, [1.0, float(k)]) for k in range(3)], "query_id long, query array<float>")
    best = {(r.query_id, r.vec_id) for r in retrieve.top(retrieve.nearest(v, q, 2), 2, "query_id", F.desc("score"), F.col("vec_id")).collect()}
    assert best == {(10, 0), (10, 3), (11, 1), (11, 4), (12, 2), (12, 5)}
    monkeypatch.setattr(retrieve, "QUESTIONS", 1)
    assert retrieve.nearest(v, q, 9).count() == 27 and retrieve.nearest(v, q.limit(0), 2).count() == 0
    for bad in ([0.0, 0.0], [1.0], None, [None, 1.0]):
        with pytest.raises(Exception):
            retrieve.nearest(spark.createDataFrame([(1, bad)], v.schema), q, 1).collect()


def test_late_events_are_left_out(spark, tmp_path):
    from skarn.streaming import jobs

    at = lambda h, m: f"2024-01-01 {h:02}:{m:02}:00"
    batches = [[(at(1, 10), "a"), (at(5, 0), "a")], [(at(4, 50), "a"), (at(9, 0), "a")], [(at(1, 20), "a"), (at(12, 0), "a")], [(at(12, 1), "a")]]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.run(jobs.windows(jobs.event_time(stream, "1 hour"), "1 hour"), "append", "late")
    # 04:50 comes while its hour is open; 01:20 comes when the watermark has passed its own.
    assert {(r.start // 3600000000 % 24, r.n) for r in out.collect()} == {(1, 1), (4, 1), (5, 1), (9, 1)}


def test_metadata_and_keywords():
    lines = ["A Title", "Someone 2021", "Abstract. First part", "second part", "1 Introduction", "doi 10.1234/abc.5, and"]
    got = agent.metadata(lines)
    assert (got["title"], got["year"], got["doi"], got["abstract"]) == ("A Title", 2021, "10.1234/abc.5", "First part\nsecond part")
    assert agent.verified_keywords(["title", "TITLE", "part second", "nothing"], lines) == [("Title", [0]), ("part\nsecond", [2, 3])]


# --- library, files, logs, memory ----------------------------------------------------------------


def docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p(" one ") + p("") + f"<w:tbl><w:tr>{cell(' a ')}{cell('b')}</w:tr><w:tr>{cell('c')}{cell('d')}</w:tr></w:tbl>" + p("two")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    path.write_bytes(data.getvalue())


def test_import_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿Images reach 90 %.\r\nEnd".encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.txt").write_bytes((tmp_path / "a.txt").read_bytes())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "blank.md").write_text(" \n")
    (tmp_path / "x.exe").write_text("x")
    (tmp_path / "x.pdf").write_text("not a pdf")
    docx(tmp_path / "b.docx")
    loaded = files.load(files.import_tasks(files.scan_files(spark, str(tmp_path))))
    assert sorted(r.status for r in loaded.collect()) == ["failed"] * 4 + ["success"] * 2
    docs = sorted(files.documents(loaded).collect(), key=lambda r: (r.file_type, r.block_index or 0))
    assert [(r.block_index, r.block_type, r.paragraph_index, r.table_index, r.text) for r in docs[:3]] == [(1, "paragraph", 1, None, "one"), (3, "table", None, 1, "a\tb\nc\td"), (4, "paragraph", 3, None, "two")]
    assert docs[3].text == "Images reach 90 %.\r\nEnd" and (docs[3].line_start, docs[3].line_end) == (1, 2)
    assert files.load(files.scan_files(spark, str(tmp_path / "a.txt")), max_bytes=3).first().error == "the file is too large"


def test_delete_and_reinsert(spark):
    store = spark.createDataFrame([("c1", "d1"), ("c2", "d2")], "chunk_id string, doc_id string")
    assert [r.chunk_id for r in index.delete_documents(store, store.where("doc_id = 'd1'")).collect()] == ["c2"]
    new = spark.createDataFrame([("c2", 1), ("c3", 1), ("c3", 2)], "chunk_id string, seq int")
    assert [(r.chunk_id, r.seq) for r in index.insert_absent(store, new).collect()] == [("c3", 2)]
    assert index.insert_absent(new.select("chunk_id"), new).count() == 0


def test_library_status_cases(spark):
    indexed = spark.createDataFrame([("full", 2), ("part", 1), ("free", 1)], "doc_id string, chunks long")
    originals = spark.createDataFrame([("full",), ("part",), ("none",), ("bad",), ("empty",)], "doc_id string")
    manifest = spark.createDataFrame([("full", 2, True, True), ("part", 2, True, True), ("bad", 1, True, False), ("empty", 1, False, True)], "doc_id string, expected long, complete boolean, readable boolean")
    got = {r.doc_id: r.status for r in index.library_status(indexed, originals, manifest).collect()}
    assert got == {"full": "vectorised", "part": "partial", "free": "unverified", "none": "not vectorised", "bad": "status error", "empty": "not vectorised"}


def test_logs_keep_the_last_snapshot(spark, tmp_path):
    base = {"schema_version": 1, "request_id": "r", "retrieval": {"status": "success", "score_model": "m", "score_revision": "1"}}
    lines = [json.dumps(base | {"status": "started"}), "", "{half", json.dumps(base | {"status": "done"}), json.dumps({"schema_version": 2})]
    (tmp_path / "rag_20240101.jsonl").write_text("\n".join(lines) + "\n")
    rows, invalid = files.read_requests(spark, str(tmp_path))
    assert [(r.request_id, r.status) for r in rows.collect()] == [("r", "done")] and invalid.first()[0] == 2
    files.append_requests(rows.withColumn("timestamp", F.lit("2024-01-02T00:00:00+08:00")), str(tmp_path / "out"))
    assert (tmp_path / "out/day=2024-01-02").is_dir()


def test_model_stream():
    part = lambda t, **k: json.dumps({"message": {"content": t}, **k})
    good = files.fold_stream([part("a"), "", part("b", done=True, done_reason="stop", eval_count=2)])
    assert good["text"] == "ab" and good["done_reason"] == "stop" and good["error"] is None
    assert files.fold_stream([part("a")])["error"] and files.fold_stream([part("a"), "{"])["text"] == "a"
    assert files.html_text("<head><title>x</title></head><p>a &amp; b<script>1</script>") == "a & b"


def test_streamed_answers_and_their_errors():
    from urllib.error import HTTPError, URLError

    from skarn.functions.models import ModelError, StreamGenerator, checked_options, error_class, model_health

    part = lambda t, **k: json.dumps({"message": {"content": t}, **k})
    sent, shown = [], []
    post = lambda lines: lambda url, payload: sent.append((url, payload)) or iter(lines)
    good = StreamGenerator("http://h/", "m", {"top_k": 3}, post([part("a"), "", part("b", done=True, eval_count=2)]), shown.append)
    assert good.generate("q", "c") == "ab" and shown == ["a", "ab"] and good.usage["eval_count"] == 2
    assert sent[0][0] == "http://h/api/chat" and sent[0][1]["options"] == {"top_k": 3}
    for lines, kind in (([part("a")], "model"), ([part("a"), "{"], "format"), ([part("a"), '{"error": "x"}'], "model"), ([part("a"), part(5)], "format")):
        with pytest.raises(ModelError) as e:
            StreamGenerator("http://h", "m", post=post(lines)).generate("q", "c")
        assert (e.value.kind, e.value.text) == (kind, "a")
    kinds = {"not_found": HTTPError("u", 404, "", {}, None), "refused": HTTPError("u", 400, "", {}, None), "busy": HTTPError("u", 503, "", {}, None), "timeout": URLError(TimeoutError()), "unreachable": URLError("x"), "input": ValueError()}
    assert {k: error_class(v) for k, v in kinds.items()} == {k: k for k in kinds}
    for bad in ({"temperature": -1}, {"top_p": 0}, {"top_k": 2.0}, {"other": 1}, {"temperature": float("nan")}):
        with pytest.raises(ValueError):
            checked_options(bad)
    assert model_health("u", "m", lambda url: '{"models": [{"name": "m:latest"}]}') == {"service": True, "model": True, "error": None}
    assert model_health("u", "m", lambda url: "{")["service"] is False


def test_compaction_of_six_turns(spark):
    messages = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], f"m{t}") for t in range(12)], "conv_id int, turn int, role string, text string")
    pairs = memory.turn_pairs(messages)
    assert [r.pair for r in memory.compaction_batch(pairs, 4, 2).orderBy("pair").collect()] == [1, 2, 3, 4]
    assert memory.compaction_batch(pairs, 7, 2).count() == 0
    cost = pairs.withColumn("cost", F.lit(10))
    assert [r.pair for r in memory.trailing_window(cost, "cost", 25, at="pair").orderBy("pair").collect()] == [5, 6]
    assert [r.pair for r in memory.prefix_window(cost, "cost", 25, at="pair").orderBy("pair").collect()] == [1, 2]


def test_summary_upsert_needs_its_boundary(spark):
    old = spark.createDataFrame([("a", 2, "old"), ("b", 2, "old")], "session_id string, through long, content string")
    new = spark.createDataFrame([("a", 2, 4, "new"), ("b", 0, 4, "new"), ("c", 0, 3, "new")], "session_id string, seen long, through long, content string")
    messages = spark.createDataFrame([(s, k, "ai" if k % 2 == 0 else "human") for s in "abc" for k in range(5)], "session_id string, id long, role string")
    got = {r.session_id: (r.through, r.content) for r in memory.summary_upsert(old, new, messages).collect()}
    assert got == {"a": (4, "new"), "b": (2, "old")}


def test_unknown_is_not_zero(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 3.0)], "k int, v double")
    got = {r.k: r.s for r in df.groupBy("k").agg(telemetry.known_sum(F.col("v")).alias("s")).collect()}
    assert got == {1: None, 2: 3.0}


def test_tokens_of_requests():
    from skarn.config import Settings
    from skarn.functions.models import request_tokens

    assert request_tokens("", "") == 0 and request_tokens("ab", "") == 1 and request_tokens("abcde", "") == 2 and request_tokens("什么?", "a b") == 5
    with pytest.raises(ValueError):
        Settings(window_tokens=10, output_tokens=10)


def test_unended_references_of_pages(spark):
    html = '<title>a &amp;&amp;amp &lt; &#x27;&amp</title><body><a href="/x?a=1&copy=2">l &copy</a></body>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    plain, ended = files.parsed_pages(pages).first(), files.parsed_pages(pages, ended=True).first()
    assert plain.title == "a &&amp < '&" and ended.title == "a &&amp < '&amp"
    assert ended.links[0].href == "/x?a=1&copy=2" and (plain.links[0].text, ended.links[0].text) == ("l ©", "l &copy")
