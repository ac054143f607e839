"""Data sources: logs that grow while they are read, spans of large files, page ranges, and documents from pages; table functions in SQL."""

import json

import pytest
from pyspark.sql import functions as F

from skarn.operators import lateral
from skarn.sources import readers


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    readers.register(spark)
    lateral.register(spark)


def taken(spark, folder, root):
    """What one more run of the stream adds to its table."""
    stream = spark.readStream.format("skarn_lines").load(f"file://{folder}")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"file://{root}/out/{n}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"file://{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted(r["value"] for r in spark.read.option("recursiveFileLookup", "true").parquet(f"file://{root}/out").collect())


def test_a_log_that_grows_loses_and_repeats_nothing(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.jsonl").write_bytes(b'{"k": 1}\n{"k": 2}\n{"k": 3')  # the last line is torn
    (log / "_hidden.jsonl").write_bytes(b"{}\n")
    assert taken(spark, log, tmp_path) == ['{"k": 1}', '{"k": 2}']
    with (log / "a.jsonl").open("ab") as f:
        f.write(b'3}\n{"k": 4}\n')
    (log / "b.jsonl").write_bytes('{"k": "é"}\r\n'.encode())
    assert taken(spark, log, tmp_path) == sorted(['{"k": 1}', '{"k": 2}', '{"k": 33}', '{"k": 4}', '{"k": "é"}'])
    assert len(taken(spark, log, tmp_path)) == 5


def test_an_append_ends_a_torn_line(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    readers.append_lines(str(path), [{"k": 1}])
    with path.open("ab") as f:
        f.write(b'{"k": 2')  # a crash
    with pytest.raises(ValueError):
        readers.append_lines(str(path), [{"k": 5}, {"k": float("nan")}])  # no text, no write
    readers.append_lines(str(path), [{"k": 3}])
    lines = spark.read.format("skarn_lines").load(f"file://{path}")
    assert [r["value"] for r in lines.orderBy("offset").collect()] == ['{"k": 1}', '{"k": 2', '{"k": 3}']
    rows = readers.parsed_lines(lines, "k long").orderBy("offset").collect()
    assert [(r["k"], r["invalid"]) for r in rows] == [(1, False), (None, True), (3, False)]


def test_spans_share_lines_without_loss(tmp_path, monkeypatch):
    body = b"".join(b"x" * (k % 13) + b"\n" for k in range(200)) + b"torn"
    (tmp_path / "a.jsonl").write_bytes(body)
    want, at = [], 0
    for line in body.split(b"\n")[:-1]:
        want.append((at, line.decode()))
        at += len(line) + 1
    for split in (1, 7, 64, 10_000):
        monkeypatch.setattr(readers, "SPLIT", split)
        monkeypatch.setattr(readers, "TAIL", 5)
        lines = readers._Lines(str(tmp_path), ".jsonl")
        for first in (0, want[50][0]):
            spans = lines.spans({str(tmp_path / "a.jsonl"): first}, lines.ends())
            assert [r[1:] for s in spans for r in lines.rows(s)] == [w for w in want if w[0] >= first]


def test_pages_come_in_ranges_and_become_documents(spark, tmp_path):
    line = lambda y, text: ("line", 20.0, y, 200.0, y + 10, text)
    words = [("word", x, y - 8, x + 30, y, f"w{int(x)}.{int(y)}") for y in (135.0, 160.0, 180.0) for x in (25.0, 120.0)]
    rules = [("rule", 20.0, y, 201.0, y + 1, None) for y in (120.0, 140.0, 200.0)]
    pages = [[line(60.0, "A title")], [line(100.0, "Table 1 Results"), *words, *rules], [], [line(90.0, "The end")]]
    (tmp_path / "p.pages").write_text(json.dumps(pages))
    source = spark.read.format("skarn_pages").options(suffix=".pages", range=1, opener="tests.fake_pages:open_pages").load(f"file://{tmp_path}")
    assert source.rdd.getNumPartitions() == 4 and source.count() == 12
    out = readers.page_documents(source.withColumn("doc_id", F.lit("p")))
    got = {(r["page_number"], r["content_type"]): r["text"] for r in out.collect()}
    table = "Table 1 Results\n| w25.135 | w120.135 |\n| --- | --- |\n| w25.160 | w120.160 |\n| w25.180 | w120.180 |"
    assert got == {(1, "text"): "A title", (2, "text"): "Table 1 Results", (2, "table"): table, (4, "text"): "The end"}


def test_table_functions_in_sql(spark):
    spark.createDataFrame([(1, "One. Two!\n\nThree? " * 9), (2, ""), (3, None), (4, "  \n ")], "doc_id int, text string").createOrReplaceTempView("texts")
    for strategy in ("fixed", "recursive", "semantic"):
        rows = spark.sql(f"SELECT doc_id, c.* FROM texts t, LATERAL chunk_text(t.text, '{strategy}', 40, 8) c ORDER BY doc_id, chunk_index").collect()
        assert {r["doc_id"] for r in rows} == {1} and all(0 < r["end_index"] - r["start_index"] <= 40 for r in rows)
        assert [r["text"] for r in rows] == [("One. Two!\n\nThree? " * 9)[r["start_index"] : r["end_index"]] for r in rows]
    windows = spark.sql("SELECT w, passage FROM LATERAL token_windows(split('a b c d e f', ' '), 4) ORDER BY w").collect()
    assert [tuple(r) for r in windows] == [(0, "a b c d"), (1, "d e f")]
    with pytest.raises(Exception, match="size"):
        spark.sql("SELECT * FROM chunk_text('x', 'fixed', 0, 0)").collect()
