"""Streams cut into several batches give what one batch gives; rows of two streams leave after the watermark; tables have no moment without a version."""

import pytest
from pyspark.sql import functions as F

from skarn.streaming import jobs
from skarn.tables import Table

EVENTS = [(u, i, "ab"[(i // 40) % 2], (i * i + u) % 7) for i in range(120) for u in (1, 2)]
SCHEMA = "user_id long, event_id long, scope string, question long"


def in_files(spark, folder, rows, schema, files):
    """A stream of as many batches as files, in order of the rows."""
    for n in range(files):
        part = rows[len(rows) * n // files : len(rows) * (n + 1) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{folder}")


def replayed(rows, capacity):
    """Hits, misses and entries of each user by a plain loop."""
    out = {}
    for u, _, scope, question in sorted(rows, key=lambda r: r[1]):
        s = out.setdefault(u, {"scope": None, "held": [], "hits": 0, "misses": 0})
        if s["scope"] != scope:
            s |= {"scope": scope, "held": []}
        hit = question in s["held"]
        s["hits" if hit else "misses"] += 1
        if not hit:
            s["held"] = [*s["held"], question][-capacity:]
    return {(u, s["hits"], s["misses"], len(s["held"])) for u, s in out.items()}


@pytest.mark.parametrize("files", [1, 4])
def test_cache_replay_counts_over_all_batches(spark, tmp_path, files):
    stream = in_files(spark, tmp_path, EVENTS, SCHEMA, files)
    out = jobs.run(jobs.cache_replay(stream, 3), "update", "cache", keys=["user_id"])
    assert {tuple(r) for r in out.select("user_id", "hits", "misses", "held").collect()} == replayed(EVENTS, 3)


def test_session_memory_over_batches(spark, tmp_path):
    rows = [(c, t, f"text {t}") for t in range(10) for c in (1, 2)]
    stream = in_files(spark, tmp_path, rows, "conv_id long, turn long, text string", 3)
    out = jobs.run(jobs.session_memory(stream), "update", "memory", keys=["conv_id"])
    assert {tuple(r) for r in out.select("conv_id", "stored", "retained", "newest").collect()} == {(1, 10, 4, 9), (2, 10, 4, 9)}


def test_update_results_keep_every_key(spark, tmp_path):
    stream = in_files(spark, tmp_path, [(k, k % 2) for k in range(10)], "k long, v long", 2)
    counts = jobs.run(stream.groupBy("k").agg(F.count("*").alias("n")), "update", "keys", keys=["k"])
    assert {tuple(r) for r in counts.collect()} == {(k, 1) for k in range(10)}
    with pytest.raises(ValueError, match="keys"):
        jobs.run(stream, "update", "none")


def test_unmatched_rows_leave_after_the_watermark(spark, tmp_path):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    phases = [(1, "plan", at(0)), (2, "act", at(1)), (9, "late", at(20))]
    tools = [(1, 0.5, at(0)), (3, 0.7, at(2)), (2, 0.1, at(8)), (8, 0.2, at(20))]
    typed = lambda folder, rows, schema: in_files(spark, tmp_path / folder, rows, schema, 2).withColumn("at", F.to_timestamp("at"))
    p, t = typed("p", phases, "call_id long, phase string, at string"), typed("t", tools, "call_id long, seconds double, at string")
    open_end = {tuple(r) for r in jobs.run(jobs.joined_calls(p, t), "append", "open").select("call_id", "status").collect()}
    assert (1, "done") in open_end and (9, "no tool") not in open_end and (8, "running") not in open_end
    closed = jobs.run(jobs.joined_calls(jobs.ended(p, "p"), jobs.ended(t, "t")), "append", "closed").where("call_id is not null")
    got = sorted(tuple(r) for r in closed.select("call_id", "phase", "status").collect())
    # The tool of call 2 came seven hours after its phase, beyond the bound.
    assert got == [(1, "plan", "done"), (2, "act", "no tool"), (2, "tool", "running"), (3, "tool", "running"), (8, "tool", "running"), (9, "late", "no tool")]


def test_a_table_always_has_a_version(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", "k long")
    assert table.version == 0 and table.read().count() == 0
    for n in range(1, 12):
        table.rewrite(spark.range(n).withColumnRenamed("id", "k"))
        assert table.version == n and table.read().count() == n
    # A writer that stops before its pointer leaves the version before it; old pointers go.
    spark.range(99).withColumnRenamed("id", "k").write.parquet(f"file://{tmp_path}/t/v12")
    assert Table(spark, f"file://{tmp_path}/t", "k long").read().count() == 11
    assert len(list((tmp_path / "t").glob("current-*"))) <= 9


class _Store:
    """A state variable that counts how often it is read and written."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class _Handle:
    def __init__(self):
        self.stores = []

    def getValueState(self, *_):
        self.stores.append(_Store())
        return self.stores[-1]


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


@pytest.mark.parametrize("batches", [1, 5])
def test_a_batch_calls_the_state_store_a_few_times_however_many_rows_it_has(batches):
    cache, handle = jobs._Cache(3, None), _Handle()
    cache.init(handle)
    rows = [r for r in EVENTS if r[0] == 1]
    for n in range(batches):
        part = rows[len(rows) * n // batches : len(rows) * (n + 1) // batches]
        (out,) = cache.handleInputRows((1,), iter(part[::-1]), None)
    assert (1, out.hits, out.misses, out.held) in replayed(rows, 3)
    assert sum(s.calls for s in handle.stores) <= 2 * batches


def test_an_entry_past_its_time_answers_no_more():
    cache, handle = jobs._Cache(2, 1000), _Handle()
    cache.init(handle)
    ask = lambda now, *questions: next(cache.handleInputRows((1,), iter([(1, now + k, "s", q) for k, q in enumerate(questions)]), _Clock(now)))
    assert ask(0, 7, 8, 7).asDict() == {"user_id": 1, "hits": 1, "misses": 2, "held": 2}
    assert ask(999, 7).hits == 2
    assert ask(1000, 7, None).asDict() == {"user_id": 1, "hits": 3, "misses": 3, "held": 1}
