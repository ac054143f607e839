"""Conversation memory: turns, budgets, compaction, and the answer cache's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skarn.operators.retrieve import nearest

#: How roles of other systems map to human and ai; the rest has none.
ROLES = {"user": "human", "human": "human", "assistant": "ai", "ai": "ai"}


def role(name: Column) -> Column:
    return F.coalesce(*(F.when(F.lower(name) == k, F.lit(v)) for k, v in ROLES.items()))


def turn_pairs(messages: DataFrame, session: str = "conv_id", at: str = "turn") -> DataFrame:
    """Each human message with the ai message that follows it at once, or null: (session, pair, question_at, answer_at, question, answer)."""
    w = W.partitionBy(session).orderBy(at)
    m = messages.withColumn("role", role(F.col("role"))).withColumn("next", F.lead(F.struct("role", at, "text")).over(w))
    q = m.where("role = 'human'").withColumn("pair", F.row_number().over(w))
    answered = F.col("next.role") == "ai"
    return q.select(session, "pair", F.col(at).alias("question_at"), F.when(answered, F.col(f"next.{at}")).alias("answer_at"), F.col("text").alias("question"), F.when(answered, F.col("next.text")).alias("answer"))


def trailing_window(rows: DataFrame, cost: str, limit: int, session: str = "conv_id", at: str = "turn") -> DataFrame:
    """The newest rows of each session whose costs, summed from the end, stay within the limit."""
    total = F.sum(cost).over(W.partitionBy(session).orderBy(F.desc(at)).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("spent", total).where(F.col("spent") <= limit)


def prefix_window(rows: DataFrame, cost: str, limit: int, session: str = "conv_id", at: str = "turn") -> DataFrame:
    """The oldest rows of each session up to the first that passes the limit. Costs are never negative, so the running sum decides alone."""
    total = F.sum(cost).over(W.partitionBy(session).orderBy(at).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("spent", total).where(F.col("spent") <= limit)


def compaction_batch(pairs: DataFrame, trigger: int, keep: int, session: str = "conv_id") -> DataFrame:
    """Pairs to summarise: where at least trigger are pending, all but the newest keep."""
    w = W.partitionBy(session)
    ranked = pairs.withColumn("pending", F.count("*").over(w)).withColumn("newest", F.row_number().over(w.orderBy(F.desc("pair"))))
    return ranked.where((F.col("pending") >= trigger) & (F.col("newest") > keep)).drop("newest")


def summary_upsert(summaries: DataFrame, proposed: DataFrame, messages: DataFrame) -> DataFrame:
    """Summaries after optimistic updates.

    summaries: session_id, through, content; proposed: session_id, seen (the boundary it was made from), through,
    content; messages: session_id, id, role. An update counts if the boundary is unchanged and it ends on an ai message.
    """
    ends = messages.where("role = 'ai'").select("session_id", F.col("id").alias("through"))
    p = proposed.join(ends, ["session_id", "through"], "left_semi").select("session_id", F.col("through").alias("new_through"), F.col("content").alias("new_content"), "seen")
    both = summaries.join(p, "session_id", "full")
    ok = F.col("new_through").isNotNull() & F.coalesce("through", F.lit(0)).eqNullSafe(F.coalesce("seen", F.lit(0)))
    return both.select("session_id", F.when(ok, F.col("new_through")).otherwise(F.col("through")).alias("through"), F.when(ok, F.col("new_content")).otherwise(F.col("content")).alias("content")).where("through is not null")


def fifo(entries: DataFrame, capacity: int, key: str = "question", order: str = "seq", scope: str | None = None) -> DataFrame:
    """What a cache holds after all puts: the newest put of each key, and of those the newest `capacity` (of each scope)."""
    by = [scope] if scope else []
    latest = entries.groupBy(*by, key).agg(F.max(order).alias(order))
    if not by:
        return latest.orderBy(F.desc(order)).limit(capacity)
    return latest.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("r") <= capacity).drop("r")


def admissible(done: Column, mode: Column, answer: Column, citations: Column, warnings: Column, invalid: Column, missing: Column) -> Column:
    """An answer that may be cached: finished, grounded, not blank, cited, without complaints."""
    return F.coalesce(done & ~mode.isin("empty", "low") & (F.length(F.trim(answer)) > 0) & (citations > 0) & (warnings == 0) & (invalid == 0) & ~missing, F.lit(False))


#: Questions that are sent to every task.
SMALL = 10_000


def cache_lookup(questions: DataFrame, entries: DataFrame, similarity: Column | None = None, threshold: float = 0.97) -> DataFrame:
    """(query_id, entry, mode, similarity) of each question's hit: the same text first, else the most similar entry with equal constraints, the earliest of equals.

    questions: query_id, question, c (constraints), vector; entries: entry, e_question, e_c, e_vector. The constraints are
    the join key, so similarity is computed within a key alone. Up to SMALL questions go to every task: entries then stay
    where they are, and no key is gathered. Without a similarity it is the cosine of the vectors to nine digits, as matrix products.
    """
    plain = questions
    if questions.limit(SMALL + 1).count() <= SMALL:
        questions = F.broadcast(questions)
    exact = questions.join(entries, F.col("question") == F.col("e_question")).groupBy("query_id").agg(F.min("entry").alias("entry")).select("query_id", "entry", F.lit("exact").alias("mode"), F.lit(1.0).alias("similarity"))
    rest = questions.join(exact.select("query_id"), "query_id", "left_anti")
    if similarity is None:
        # Constraints of any type as one text; those that are null fit none.
        form = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct(c))).alias("c")
        held = entries.select("entry", F.col("e_vector").alias("embedding"), F.col("e_c").alias("c")).withColumn("c", form("c"))
        asked = plain.join(exact.select("query_id"), "query_id", "left_anti").select("query_id", F.col("vector").alias("query"), form("c"))
        near = nearest(held, asked, 1, "entry", by="c").withColumnRenamed("score", "similarity").where(F.col("similarity") >= threshold)
    else:
        near = rest.join(entries, F.col("c") == F.col("e_c")).withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    best = near.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("entry")).alias("e"))).alias("b"))
    return exact.union(best.select("query_id", (-F.col("b.e")).alias("entry"), F.lit("semantic").alias("mode"), "b.similarity"))
