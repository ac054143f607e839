"""Claims about documents found again in their texts, whatever the spelling of either, with the lines that hold them.

Both sides are normalised alike: compatibility forms (NFKC), marks of superscripts removed, words that a hyphen parts at a line's end
joined, case folded, white space as one blank. Each letter of the normal text knows its place in the source, so a match is given as it
stands there, and its range tells the lines that it touches.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is left out of a text: superscripts as page layout marks them, and a hyphen between letters with the line break behind it.
_DROPPED = re.compile(r"\^\{[^}\n]*\}|(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\t\n\f\r ]+")
_PIECE = re.compile(r"\s+|[\x21-\x7e]+|.", re.DOTALL)


def _joins(before: str, c: str) -> bool:
    """Whether a letter belongs to what stands before it: as a mark, or by composing with it, as jamo and some vowel signs do."""
    if unicodedata.combining(unicodedata.normalize("NFKC", c)[0]):
        return True
    size = lambda x: len(unicodedata.normalize("NFKC", x))
    return size(before + c) < size(before) + size(c)


def _clusters(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that are normalised on their own: a letter with the marks and jamo that compose with it."""
    start = 0
    for k in range(1, len(text) + 1):
        if k < len(text) and text[k] >= "\u0300" and _joins(text[start:k], text[k]):
            continue
        yield start, k
        start = k


def normal(text: str) -> tuple[str, list[int], list[int]]:
    """The normal form of a text, and where each of its letters begins and ends in the text."""
    out: list[str] = []
    begins: list[int] = []
    ends: list[int] = []

    def put(letters: str, a: int, b: int) -> None:
        for c in letters:
            if not c.isspace():
                out.append(c)
            elif out and out[-1] != " ":
                out.append(" ")
            else:
                continue
            begins.append(a), ends.append(b)

    def kept(a: int, b: int) -> None:
        if text[a:b].isascii():
            for m in _PIECE.finditer(text, a, b):
                if m.group().isspace():
                    put(" ", m.start(), m.end())
                else:
                    out.extend(m.group().lower()), begins.extend(range(m.start(), m.end())), ends.extend(range(m.start() + 1, m.end() + 1))
            return
        for x, y in _clusters(text[a:b]):
            put(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text[a + x : a + y]).casefold()), a + x, a + y)

    at = 0
    for m in _DROPPED.finditer(text):
        kept(at, m.start())
        at = m.end()
    kept(at, len(text))
    if out and out[-1] == " ":
        out.pop(), begins.pop(), ends.pop()
    return "".join(out), begins, ends


def plain(text: str) -> str:
    """A text without marks of superscripts and with parted words joined, in compatibility forms."""
    return unicodedata.normalize("NFKC", _DROPPED.sub("", text))


def find(claim: str, source: tuple[str, list[int], list[int]]) -> tuple[int, int] | None:
    """The first place of a claim in a normalised source, as a range of the source's own text; words of ASCII letters and digits only whole."""
    form, begins, ends = source
    wanted = normal(claim)[0]
    m = wanted and re.search(rf"(?<![a-z0-9]){re.escape(wanted)}(?![a-z0-9])" if wanted[0].isascii() and wanted[-1].isascii() and wanted[0].isalnum() and wanted[-1].isalnum() else re.escape(wanted), form)
    return (begins[m.start()], ends[m.end() - 1]) if m else None


def _words(text: str) -> tuple[str, list[int], list[int]]:
    """The words of a text with one blank between, and where each begins, in that form and in the text."""
    words = [(m.group(), m.start()) for m in _WORD.finditer(text)]
    places, at = [], 0
    for w, _ in words:
        places.append(at)
        at += len(w) + 1
    return " ".join(w for w, _ in words), places, [a for _, a in words]


def find_exact(claim: str, source: tuple[str, list[int], list[int]]) -> tuple[int, int] | None:
    """The first place of a claim as it is written, but for white space, in a source of words; also within words."""
    form, places, begins = source
    wanted = " ".join(_WORD.findall(claim))
    p = form.find(wanted) if wanted else -1
    if p < 0:
        return None
    place = lambda x: (k := bisect_right(places, x) - 1, begins[k] + x - places[k])[1]
    return place(p), place(p + len(wanted) - 1) + 1


def _found(batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[pa.RecordBatch]:
    form, find_in = (_words, find_exact) if exact else (normal, find)
    for b in batches:
        docs, fields, values, starts, stops = [], [], [], [], []
        for doc, text, claims in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            source = form(text)
            for c in claims:
                if c["value"] and (span := find_in(c["value"], source)):
                    docs.append(doc), fields.append(c["field"]), values.append(text[slice(*span)]), starts.append(1 + text.count("\n", 0, span[0])), stops.append(1 + text.count("\n", 0, span[1] - 1))
        yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field(0).type), pa.array(fields, pa.string()), pa.array(values, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["doc_id", "field", "value", "first_line", "last_line"])


def verified(documents: DataFrame, claims: DataFrame, exact: bool = False) -> DataFrame:
    """(doc_id, field, value, first_line, last_line): claims (doc_id, field, value) that their documents (doc_id, text) hold.

    A value is given as it stands in the text, at its first place. Claims that are not there, null or blank, or about no document are left
    out; repeated ones stay once. A document is normalised once for all of its claims, which are few. With exact only white space may
    differ: letters, marks and hyphens are taken as they are written, and a claim may stand within words.
    """
    type_ = documents.schema["doc_id"].dataType.simpleString()
    asked = claims.where("value is not null").groupBy("doc_id").agg(F.collect_set(F.struct("field", "value")).alias("claims"))
    both = documents.where("text is not null").select("doc_id", "text").join(asked, "doc_id")
    return both.mapInArrow(partial(_found, exact=exact), f"doc_id {type_}, field string, value string, first_line int, last_line int").distinct()
