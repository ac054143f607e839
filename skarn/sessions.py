"""Sessions of users: messages in whole turns, summaries by optimistic update, context within a budget."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.config import Settings
from skarn.functions.text import tokens
from skarn.operators import memory
from skarn.tables import Table


class Sessions:
    """Three tables: sessions, messages, summaries. Every call checks that the session is the user's."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark, self.settings = spark, settings
        self._sessions = Table(spark, f"{root}/sessions", "session_id string, user_id string")
        self._messages = Table(spark, f"{root}/messages", "session_id string, id long, role string, content string")
        self._summaries = Table(spark, f"{root}/summaries", "session_id string, through long, content string")

    def create(self, user_id: str) -> str:
        if not user_id.strip():
            raise ValueError("a user must have a name")
        session_id = uuid.uuid4().hex
        self._sessions.append(self.spark.createDataFrame([(session_id, user_id)], self._sessions.schema))
        return session_id

    def _check(self, user_id: str, session_id: str) -> None:
        if self._sessions.read().where((F.col("session_id") == session_id) & (F.col("user_id") == user_id)).isEmpty():
            raise ValueError("no such session of this user")

    def list(self, user_id: str) -> DataFrame:
        return self._sessions.read().where(F.col("user_id") == user_id)

    def messages(self, user_id: str, session_id: str) -> DataFrame:
        self._check(user_id, session_id)
        return self._messages.read().where(F.col("session_id") == session_id).orderBy("id")

    def append_turn(self, user_id: str, session_id: str, question: str, answer: str) -> None:
        """Both messages of a turn in one write."""
        self._check(user_id, session_id)
        if not question.strip() or not answer.strip():
            raise ValueError("a turn has a question and an answer")
        last = self._messages.read().where(F.col("session_id") == session_id).agg(F.max("id")).first()[0] or 0
        self._messages.append(self.spark.createDataFrame([(session_id, last + 1, "human", question), (session_id, last + 2, "ai", answer)], self._messages.schema).coalesce(1))

    def title(self, user_id: str, session_id: str) -> str | None:
        first = self.messages(user_id, session_id).where("role = 'human'").agg(F.min_by("content", "id")).first()[0]
        return first[:24] if first else None

    def clear(self, user_id: str, session_id: str) -> None:
        """Forgets messages and summary; the session stays."""
        self._check(user_id, session_id)
        for t in (self._messages, self._summaries):
            t.rewrite(t.read().where(F.col("session_id") != session_id))

    def delete(self, user_id: str, session_id: str) -> None:
        self.clear(user_id, session_id)
        self._sessions.rewrite(self._sessions.read().where(F.col("session_id") != session_id))

    def context(self, user_id: str, session_id: str, summarise=None) -> dict:
        """Summary and newest whole turns within the token budget; older turns are summarised once enough are pending.

        summarise(old_summary, texts) may be None or fail: the old summary then stays.
        """
        s = self.settings
        rows = self.messages(user_id, session_id)
        held = self._summaries.read().where(F.col("session_id") == session_id).first()
        through, summary = (held["through"], held["content"]) if held else (0, "")
        n = F.size(tokens(F.col("question"))) + F.size(tokens(F.coalesce("answer", F.lit(""))))
        pending = memory.turn_pairs(rows.where(F.col("id") > through).withColumnRenamed("content", "text"), "session_id", "id").withColumn("cost", n.cast("long"))
        batch = memory.compaction_batch(pending, s.summary_trigger, s.summary_keep, "session_id").orderBy("pair").collect()
        if batch and summarise:
            try:
                text = summarise(summary, [(r["question"], r["answer"]) for r in batch])
                new = self.spark.createDataFrame([(session_id, through, batch[-1]["answer_at"], text)], "session_id string, seen long, through long, content string")
                self._summaries.rewrite(memory.summary_upsert(self._summaries.read(), new, self._messages.read()))
                through, summary = batch[-1]["answer_at"], text
                pending = pending.where(F.col("answer_at") > through)
            except Exception:  # noqa: BLE001 - a summary is optional; the old one holds
                pass
        kept = memory.trailing_window(pending, "cost", s.history_tokens, "session_id", "pair").orderBy("pair").collect()
        return {"summary": summary, "through": through, "turns": [(r["question"], r["answer"]) for r in kept], "dropped": pending.count() - len(kept)}
