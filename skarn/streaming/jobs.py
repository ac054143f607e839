"""Streaming twins of the batch operators: file streams, available-now runs and keyed state."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skarn.sources.files import scratch_path


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a file stream with the schema that it has as a batch."""
    path = f"{d}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    # A stream watches folders: a table that is one file is picked out of its folder by name.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def run(result: DataFrame, mode: str, name: str, sink: Callable[[DataFrame, str], None] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Runs what is available now, checkpointed in the shared folder, and reads what was written.

    A batch is written under its number, so one that is run again replaces itself. append results add up; of complete results the
    last batch counts; of update results the last row of each key. A sink writes where it likes below the folder that it is given.
    """
    spark = result.sparkSession
    if mode == "update" and not (keys or sink):
        raise ValueError("update results need their keys")
    root = scratch_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        if sink:
            sink(batch, f"{root}/table")
        else:
            batch.write.mode("overwrite").parquet(f"{root}/table/batch={number}")

    q = result.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if sink:
        return spark.read.parquet(f"{root}/table")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/table")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # there was no batch
        return spark.createDataFrame([], result.schema)
    rows = spark.read.schema(T.StructType([*result.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/table")
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == last).drop("batch")
    rest = [c for c in result.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def event_time(events: DataFrame, delay: str = "40 days") -> DataFrame:
    """Events with a watermark. Their time has no zone, which a watermark needs; the session's zone is UTC."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)


def online_metrics(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"), F.max("event_id").alias("last"))


def online_latest(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("s")).select("user_id", "s.event_id", "s.event_type")


class _Memory(StatefulProcessor):
    """A session's newest messages as a list, what it has stored in all, and a timer that forgets it when it rests too long."""

    def __init__(self, keep: int, idle_ms: int | None):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getListState("newest", "turn long, text string")
        self.stored = handle.getValueState("stored", "n long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), x) for pdf in rows for t, x in zip(pdf.turn, pdf.text)]
        held = sorted([*self.newest.get(), *new])[-self.keep :] if self.newest.exists() else sorted(new)[-self.keep :]
        n, timer = self.stored.get() if self.stored.exists() else (0, 0)
        self.newest.put(held)
        if self.idle_ms:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.stored.update((n + len(new), timer))
        yield self._row(key, n + len(new), held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, _ = self.stored.get()
        self.newest.clear()
        self.stored.clear()
        yield self._row(key, n, [])

    def _row(self, key, stored: int, held: list) -> pd.DataFrame:
        newest = pd.array([held[-1][0] if held else None], "Int64")
        return pd.DataFrame({"conv_id": [key[0]], "stored": [stored], "retained": [len(held)], "chars": [sum(len(x) for _, x in held)], "newest": newest})


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, timed: bool, pandas: bool = True) -> DataFrame:
    """Keyed state of several variables, which only the RocksDB store keeps. With timers a run over what is available never ends.

    Without pandas the processor takes and gives plain rows, which costs far less for keys of few rows.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    groups = rows.groupBy(key)
    return (groups.transformWithStateInPandas if pandas else groups.transformWithState)(processor, schema, "Update", "ProcessingTime" if timed else "None")


def session_memory(messages: DataFrame, keep: int = 4, idle_ms: int | None = None) -> DataFrame:
    """Keyed state of each session: its newest `keep` messages and how many it has stored in all.

    With idle_ms a session that gets nothing for so long gives a last row without messages and is forgotten.
    """
    return _with_state(messages.select("conv_id", "turn", "text"), "conv_id", _Memory(keep, idle_ms), "conv_id long, stored long, retained long, chars long, newest long", bool(idle_ms))


def _accumulate(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    text = state.get[0] if state.exists else ""
    h, out = hashlib.sha256(text.encode()), []
    chars = len(text)
    rows = sorted((int(t), x or "") for pdf in parts for t, x in zip(pdf.turn, pdf.text))
    for turn, part in rows:
        h.update(part.encode())  # only the new part is hashed
        chars += len(part)
        out.append((key[0], turn, chars, h.hexdigest()))
    state.update((text + "".join(x for _, x in rows),))
    yield pd.DataFrame(out, columns=["conv_id", "turn", "chars", "snapshot"])


def accumulated(parts: DataFrame) -> DataFrame:
    """Keyed state of each conversation: its text so far; a row for each part with the length and hash of the text up to it."""
    return parts.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandasWithState(
        _accumulate, "conv_id long, turn long, chars long, snapshot string", "text string", "append", GroupStateTimeout.NoTimeout
    )


class _Cache(StatefulProcessor):
    """A user's answer cache: what it has counted, and the questions that it holds with the times they came, oldest first.

    A batch reads both once, replays its rows in memory and writes both once: a call to the state store costs more than
    hundreds of rows. What is held has at most `capacity` entries.
    """

    def __init__(self, capacity: int, ttl_ms: int | None):
        self.capacity, self.ttl_ms = capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cache", "scope string, hits long, misses long, questions array<long>, since array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        scope, hits, misses, questions, since = self.state.get() or (None, 0, 0, [], [])
        now, held = 0, dict(zip(questions, since))  # in the order in which entries came
        if self.ttl_ms:
            now = timerValues.getCurrentProcessingTimeInMs()
            held = {q: t for q, t in held.items() if now - t < self.ttl_ms}
        new = ((i is None, i, s is None, s, q is None, q) for _, i, s, q in rows)
        for _, _, _, s, _, question in sorted(new):
            if s != scope:
                held, scope = {}, s
            if question is None or question in held:  # as in the query's SQL, no question is no miss
                hits += 1
                continue
            misses += 1
            held[question] = now
            if len(held) > self.capacity:
                del held[next(iter(held))]
        self.state.update((scope, hits, misses, list(held), list(held.values())))
        yield Row(user_id=key[0], hits=hits, misses=misses, held=len(held))


def cache_replay(questions: DataFrame, capacity: int = 100, ttl_ms: int | None = None) -> DataFrame:
    """Each user's answer cache over a stream of (user_id, event_id, scope, question): a change of scope empties it, the oldest entries leave first.

    Rows count all events so far, so the last row of a user does not depend on how events were cut into batches. With
    ttl_ms an entry that is so old answers no more and has left.
    """
    rows = questions.select("user_id", "event_id", "scope", "question")
    return _with_state(rows, "user_id", _Cache(capacity, ttl_ms), "user_id long, hits long, misses long, held long", bool(ttl_ms), pandas=False)


def joined_calls(phases: DataFrame, tools: DataFrame, bound: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(call_id, phase, seconds, status) of two streams, phases (call_id, phase, at) and tools (call_id, seconds, at), by call.

    Both have watermarks and a call's two rows lie within `bound`, so a row without the other leaves the state, and
    is given as such, once the watermark is `bound` past it.
    """
    p = phases.select(F.col("call_id").alias("p_id"), "phase", F.col("at").alias("p_at")).withWatermark("p_at", delay)
    t = tools.select(F.col("call_id").alias("t_id"), "seconds", F.col("at").alias("t_at")).withWatermark("t_at", delay)
    span = F.expr(f"p_id = t_id AND t_at BETWEEN p_at - INTERVAL {bound} AND p_at + INTERVAL {bound}")
    status = F.when(F.col("t_id").isNull(), "no tool").when(F.col("p_id").isNull(), "running").otherwise("done")
    return p.join(t, span, "full").select(F.coalesce("p_id", "t_id").alias("call_id"), F.coalesce("phase", F.lit("tool")).alias("phase"), "seconds", status.alias("status"))


def ended(rows: DataFrame, name: str, at: str = "at") -> DataFrame:
    """A stream that ends: behind its rows one more of year 9999, all else null, that moves the watermark past all of them."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    last = [F.expr("timestamp '9999-01-01'").alias(c) if c == at else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    spark.range(1).select(last).write.parquet(path)
    return rows.union(spark.readStream.schema(rows.schema).parquet(path))


def insert_absent_sink(key: str) -> Callable[[DataFrame, str], None]:
    """A sink that appends rows whose key the table lacks; a batch that is run again adds nothing."""

    def sink(batch: DataFrame, path: str) -> None:
        new, spark = batch.dropDuplicates([key]), batch.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        new.write.mode("append").parquet(path)

    return sink


def windows(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    w = F.window("at", length, slide) if slide else F.window("at", length)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("stop"), "n")
