"""Request and agent telemetry: snapshots, ratios with exclusion rules, histograms and null-aware sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last snapshot of each key. A max over a struct aggregates before the shuffle; a window would not."""
    rest = [c for c in rows.columns if c != key and c not in order]
    top = F.max(F.struct(*order, *rest)).alias("s")
    return rows.groupBy(key).agg(top).select(key, *(f"s.{c}" for c in [*order, *rest]))


def known_sum(value: Column) -> Column:
    """The sum, or null if any value is unknown."""
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value))


def sound(value: Column) -> Column:
    """The value if it is finite and not negative, else null."""
    return F.when((value >= 0) & (value < float("inf")), value)


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.when(whole > 0, part / whole)


def attempt_usage(tokens: Column, failed: Column) -> list[Column]:
    """Tokens of all attempts whose use is known, and whether that is not all: a use is unknown or an attempt failed."""
    return [F.sum(tokens), F.bool_or(tokens.isNull() | F.coalesce(failed, F.lit(True)))]


def within_deadline(seconds: Column, deadline: Column, status: Column) -> list[Column]:
    """Whether a result came in time, and the status that counts: late results are timeouts and their content is discarded."""
    in_time = F.coalesce(seconds <= deadline, F.lit(False))
    return [in_time, F.when(in_time, status).otherwise("timeout")]


def call_summary(status: Column, seconds: Column) -> list[Column]:
    """Started, completed, successes, failures, pending, success rate and mean seconds of tool calls."""
    ok, bad = F.count_if(status == "success"), F.count_if(status == "error")
    finished = status.isin("success", "error")
    return [
        F.count("*").alias("started"),
        (ok + bad).alias("completed"),
        ok.alias("successes"),
        bad.alias("failures"),
        (F.count("*") - ok - bad).alias("pending"),
        F.round(rate(ok, ok + bad), 6).alias("success_rate"),
        F.round(F.avg(F.when(finished, sound(seconds))), 6).alias("mean_seconds"),
    ]


def retrieval_metrics(requests: DataFrame) -> DataFrame:
    """One row over requests: status, cache_hit, retrieval_status, documents, retrieval_seconds, response_seconds."""
    tried = ~F.coalesce(F.col("cache_hit"), F.lit(False)) & F.col("retrieval_status").isin("success", "empty", "error")
    done = tried & (F.col("retrieval_status") != "error")
    final = tried & ~F.col("status").isin("started", "retrieved")
    n, m, hits = F.count_if(tried), F.count_if(done), F.count_if(done & (F.col("documents") > 0))
    return requests.agg(
        n.alias("attempts"),
        m.alias("completed"),
        hits.alias("hits"),
        F.round(rate(hits, m), 6).alias("hit_rate"),
        (n - m).alias("failed"),
        F.round(F.avg(F.when(tried, sound(F.col("retrieval_seconds")))), 6).alias("retrieval_seconds"),
        F.round(F.avg(F.when(final, sound(F.col("response_seconds")))), 6).alias("response_seconds"),
    )


def score_histogram(scores: DataFrame, groups: list[str], bins: int = 10) -> DataFrame:
    """(groups, bin, n, count, mean, min, max): equal bins over [0, 1], 1 in the last, empty ones with 0."""
    kept = scores.where("score >= 0 and score <= 1")
    per = kept.groupBy(*groups).agg(F.count("*").alias("count"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"))
    counts = kept.groupBy(*groups, F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = per.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*groups, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def token_rules(cache_hit: Column, attempted: Column, reported_in: Column, reported_out: Column) -> list[Column]:
    """Input, output, total and source: zero if nothing was called, else what was reported, else unknown."""
    skipped = cache_hit | ~attempted
    i, o = F.when(skipped, 0).otherwise(reported_in), F.when(skipped, 0).otherwise(reported_out)
    source = F.when(cache_hit, "cache").when(skipped, "not_called").when((i + o).isNotNull(), "ollama").otherwise("unavailable")
    return [i.alias("input"), o.alias("output"), (i + o).alias("total"), source.alias("source")]


def agent_record(request_id: str, user_id: str, session_id: str, question: str, event: str, metrics: dict, **facts) -> dict:
    """One line of the agent's log: the whole trace only with the event that ends a request, else its last step."""
    trace = metrics.get("trace") or []
    shown = metrics if event == "done" else {k: v for k, v in metrics.items() if k != "trace"}
    row = {"schema_version": 1, "request_id": request_id, "user_id": user_id, "session_id": session_id, "question": question, "event": event, "metrics": shown}
    row |= {k: facts.get(k) for k in ("timestamp", "iteration", "stop_reason", "task_complete")}
    return row if event == "done" or not trace else row | {"step": trace[-1]}
