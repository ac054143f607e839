"""Claims found again in texts: normal forms, their offsets and the lines of a match."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.operators import agent, spans

LETTERS = "aÉ́ȩ́ ﬁ①²ｶﾞ각ß \n\tZ中ো㍿.9"


@settings(max_examples=300, deadline=None)
@given(st.text(LETTERS, max_size=30))
def test_normal_form_of_parts_is_that_of_the_whole(text):
    form, begins, ends = spans.normal(text)
    whole = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    assert form == " ".join(whole.split())
    assert len(form) == len(begins) == len(ends) and begins == sorted(begins) and all(a < b <= len(text) for a, b in zip(begins, ends))


def test_values_stand_as_in_the_source():
    text = "Deep  Learn-\ning for ﬁelds\nAda Lovelace^{1,2}, Alan Turing^{3}\nself-made e-\n2020"
    source = spans.normal(text)
    at = lambda claim: (x := spans.find(claim, source)) and text[slice(*x)]
    assert at("deep learning FOR fields") == "Deep  Learn-\ning for ﬁelds"
    assert at("Ada Lovelace, Alan Turing") == "Ada Lovelace^{1,2}, Alan Turing"
    assert at("self-made") == "self-made" and at("selfmade") is None and at("lace") is None and at("") is None and at(" ") is None
    assert at("e- 2020") == "e-\n2020"


def test_claims_of_documents(spark):
    docs = [(1, "Title of\nit\n\n2020 x"), (2, None), (3, ""), (4, "a\n" * 20000 + "end of it")]
    claims = [(1, "title", "title OF it"), (1, "title", "title OF it"), (1, "year", "2020"), (1, "year", "2021"), (1, "none", None), (1, "blank", " "), (2, "title", "x"), (3, "title", "x"), (4, "end", "End of IT"), (9, "title", "x")]
    got = spans.verified(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(claims, "doc_id long, field string, value string"))
    assert sorted(map(tuple, got.collect())) == [(1, "title", "Title of\nit", 1, 2), (1, "year", "2020", 4, 4), (4, "end", "end of it", 20001, 20001)]


def test_metadata_with_authors_and_lines():
    lines = ["Deep Learn-", "ing of Things", "", "Ada Lovelace^{1}, Alan M. Turing^{2} and", "Ludwig van Beethoven", "University of X, 2021", "Abstract. First part", "second part", "1 Introduction", "doi 10.1234/abc.5, and By Nobody Else"]
    got = agent.with_evidence(agent.metadata(lines), lines)
    assert got["evidence"]["year"] == [6] and got["evidence"]["doi"] == [10] and got["evidence"]["abstract"] == [7, 8] and got["missing"] == []
    assert got["title"] == "Deep Learning of Things" and got["evidence"]["title"] == [1, 2] and got["authors"] == ["Ada Lovelace", "Alan M. Turing", "Ludwig van Beethoven"]
    two = ["A Title", "Ada Lovelace^{1}, Alan M. Turing^{2}", "Ludwig van Beethoven", "University of X, 2021"]
    got = agent.with_evidence(agent.metadata(two), two)
    assert got["authors"] == ["Ada Lovelace", "Alan M. Turing", "Ludwig van Beethoven"] and got["evidence"] == {"title": [1], "authors": [2, 3], "year": [4]}
    assert got["missing"] == ["doi", "abstract"]
    none = agent.with_evidence(agent.metadata([]), [])
    assert none["evidence"] == {} and none["missing"] == ["title", "year", "doi", "abstract", "authors"]


def test_exact_claims_are_taken_as_written(spark):
    docs = [(1, "The The\n\n  the  the end"), (2, "lathe\tthe end"), (3, "THE END"), (4, "a  b\nc")]
    claims = [(1, "f", "the the"), (1, "g", "e the"), (2, "f", "the the end"), (3, "f", "the end"), (4, "f", "a b c"), (4, "g", " ")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(claims, "doc_id long, field string, value string")
    got = spans.verified(*frames, exact=True)
    assert sorted(map(tuple, got.collect())) == [(1, "f", "the  the", 3, 3), (1, "g", "e\n\n  the", 1, 3), (2, "f", "the\tthe end", 1, 1), (4, "f", "a  b\nc", 1, 2)]
    assert ("f", "THE END") in {(r.field, r.value) for r in spans.verified(*frames).collect()}
