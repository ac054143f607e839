"""Queries that run as streams over what is there now; their final state is checked against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.plans import conversation  # noqa: F401 - its trace is what the stream has to give
from skarn.plans.registry import ORACLES, query, table
from skarn.sources import files, readers
from skarn.streaming import jobs


@query("stream_accumulate", "SELECT conv_id, turn, length(string_agg(text, '' ORDER BY turn) OVER w) AS chars, sha256(string_agg(text, '' ORDER BY turn) OVER w) AS snapshot FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def stream_accumulate(spark, d):
    """A token stream: every part gives a cumulative snapshot of its conversation's text so far."""
    return jobs.run(jobs.accumulated(jobs.stream(spark, d, "conversations")), "append", "accumulate")


@query("stream_metrics", "SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS value, max(event_id) AS last FROM events GROUP BY user_id, event_type")
def stream_metrics(spark, d):
    return jobs.run(jobs.online_metrics(jobs.stream(spark, d, "events")), "complete", "metrics")


@query("stream_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest(spark, d):
    return jobs.run(jobs.online_latest(jobs.stream(spark, d, "events")), "complete", "latest")


@query("stream_ingest", "SELECT sha256(text) AS doc_id, count(*) > 0 AS stored FROM documents GROUP BY 1")
def stream_ingest(spark, d):
    docs = jobs.stream(spark, d, "documents").select(F.sha2("text", 256).alias("doc_id"), F.lit(True).alias("stored"))
    return jobs.run(docs, "append", "ingest", jobs.insert_absent_sink("doc_id"))


@query("stream_memory", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, count(*) AS stored, count(*) FILTER (WHERE k <= 4) AS retained, CAST(sum(length(text)) FILTER (WHERE k <= 4) AS BIGINT) AS chars, max(turn) AS newest FROM r GROUP BY conv_id")
def stream_memory(spark, d):
    return jobs.run(jobs.session_memory(jobs.stream(spark, d, "conversations")), "update", "memory", keys=["conv_id"])


CACHE_REPLAY_SQL = """
WITH e AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS scope, CAST(json_extract(props, '$.k') AS BIGINT) AS question FROM events),
f AS (SELECT *, CASE WHEN scope IS NOT DISTINCT FROM lag(scope) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
r AS (SELECT user_id, run, count(*) AS n, count(DISTINCT question) AS kinds FROM g GROUP BY user_id, run)
SELECT user_id, CAST(sum(n - kinds) AS BIGINT) AS hits, CAST(sum(kinds) AS BIGINT) AS misses, CAST(least(max_by(kinds, run), 100) AS BIGINT) AS held FROM r GROUP BY user_id
"""


@query("cache_replay", CACHE_REPLAY_SQL)
def cache_replay(spark, d):
    e = jobs.stream(spark, d, "events").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("scope"), F.get_json_object("props", "$.k").cast("long").alias("question"))
    return jobs.run(jobs.cache_replay(e), "update", "cache", keys=["user_id"])


@query("stream_trace", ORACLES["trace_rows"])
def stream_trace(spark, d):
    """Phases of calls and their tools as two streams: what the other stream never matches leaves after the watermark."""
    at = F.col("ts").cast("timestamp").alias("at")
    m = jobs.stream(spark, d, "events").where("event_id % 3 <> 0").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("phase"), at)
    t = jobs.stream(spark, d, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("call_id"), F.col("value").alias("seconds"), at)
    rows = jobs.joined_calls(jobs.ended(m, "phases-end"), jobs.ended(t, "tools-end"))
    rows = jobs.run(rows, "append", "trace").where("call_id is not null")
    return rows.select("call_id", "phase", F.round("seconds", 3).alias("seconds"), "status")


@query("win_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def win_tumbling(spark, d):
    return jobs.run(jobs.windows(jobs.event_time(jobs.stream(spark, d, "events")), "1 hour"), "complete", "tumbling")


@query("win_sliding", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)), epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) - 1800000000]) AS start FROM events) GROUP BY ALL")
def win_sliding(spark, d):
    return jobs.run(jobs.windows(jobs.event_time(jobs.stream(spark, d, "events")), "1 hour", "30 minutes"), "complete", "sliding")


@query("win_session", "WITH f AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, min(t) AS start, max(t) + 21600000000 AS stop, count(*) AS n FROM g GROUP BY user_id, s")
def win_session(spark, d):
    return jobs.run(jobs.sessions(jobs.event_time(jobs.stream(spark, d, "events")), "6 hours"), "complete", "sessions")


@query("stream_lines", "SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def stream_lines(spark, d):
    """Events written as JSON lines, read back as a stream by bytes."""
    readers.register(spark)
    root = files.scratch_path(spark, "lines")
    table(spark, d, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value")).write.text(root)
    lines = spark.readStream.format("skarn_lines").option("suffix", ".txt").load(root)
    events = readers.parsed_lines(lines, "event_id long, user_id long").where("not invalid")
    return jobs.run(events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last")), "complete", "lines-read")
