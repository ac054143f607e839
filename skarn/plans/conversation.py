"""Queries over evidence, conversation memory, the answer cache and telemetry."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skarn.functions import text as tx
from skarn.operators import aliases, evidence, memory, retrieve, telemetry
from skarn.plans.library import CHUNKS_SQL, fixed_chunks
from skarn.plans.registry import query, table
from skarn.plans.retrieval import BM25_SQL, bm25_best

# --- evidence --------------------------------------------------------------------------------


@query("neighbor_expand", f"WITH {CHUNKS_SQL}, n AS (SELECT *, lag(chunk_index) OVER w AS pi, lag(start_index) OVER w AS ps, lag(end_index) OVER w AS pe, lead(chunk_index) OVER w AS ni, lead(start_index) OVER w AS ns, lead(end_index) OVER w AS ne FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY start_index, end_index)) SELECT doc_id, chunk_index, CASE WHEN pe >= start_index THEN pi END AS prev_index, CASE WHEN ns <= end_index THEN ni END AS next_index, CASE WHEN pe >= start_index THEN ps ELSE start_index END AS from_index, CASE WHEN ns <= end_index THEN ne ELSE end_index END AS to_index FROM n")
def neighbor_expand(spark, d):
    return evidence.neighbours(fixed_chunks(spark, d).select("doc_id", "chunk_index", "start_index", "end_index"))


SCORED_SQL = "scored AS (SELECT vec_id AS chunk_id, label AS doc_id, round((CAST(embedding[1] AS DOUBLE) + 1) / 2, 6) AS score, vec_id % 50 AS page, CAST(embedding[2] AS DOUBLE) > 0.1 AS says FROM embeddings)"


@query("best_per_doc_tiers", f"WITH {SCORED_SQL} SELECT doc_id, chunk_id, round(score, 6) AS score, CAST(CASE WHEN page < 40 AND score >= 0.4 AND says THEN 0 WHEN page < 40 AND score >= 0.4 THEN 1 ELSE 2 END AS INT) AS tier FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN page < 40 AND score >= 0.4 AND says THEN 0 WHEN page < 40 AND score >= 0.4 THEN 1 ELSE 2 END, score DESC, chunk_id) = 1")
def best_per_doc_tiers(spark, d):
    e = F.col("embedding")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.round((e[0].cast("double") + 1) / 2, 6).alias("score"), (F.col("vec_id") % 50).alias("page"), (e[1].cast("double") > 0.1).alias("says"))
    main = (F.col("page") < 40) & (F.col("score") >= 0.4)
    return evidence.best_per_document(rows, [main & F.col("says"), main]).select("doc_id", "chunk_id", "score", "tier")


@query("before_first_marker", "WITH m AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT event_id, e.user_id FROM events e LEFT JOIN m ON e.user_id = m.user_id WHERE first IS NULL OR event_id < first")
def before_first_marker(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    first = e.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("first"))
    return e.join(first, "user_id", "left").where("first is null or event_id < first").select("event_id", "user_id")


def candidates(spark, d):
    best = retrieve.top(bm25_best(spark, d, 20), 20, "query_id", F.desc("score"), F.col("doc_id"))
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("name"))
    return docs.join(F.broadcast(best), "doc_id").select("query_id", "doc_id", "text", "score", "name", F.concat(F.lit("行1–"), F.size(F.split("text", "\n")).cast("string")).alias("place"))


#: The greedy fold over each question's candidates, one recursion step a candidate.
PACK_SQL = f"""{BM25_SQL.replace("posted AS", "RECURSIVE posted AS", 1)},
cand AS (SELECT query_id, rank AS rk, b.doc_id, text, source AS name, '行1–' || len(string_split(text, chr(10))) AS place FROM bm_top b JOIN documents d ON b.doc_id = d.doc_id),
walk AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS rk, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS chars, false AS truncated, false AS taken FROM cand
 UNION ALL
 SELECT query_id, rk, CASE WHEN ok THEN used + fixed + shown + CASE WHEN whole THEN 0 ELSE 8 END ELSE used END, CASE WHEN ok THEN n + 1 ELSE n END, doc_id, shown, NOT whole, ok
 FROM (SELECT *, whole OR (room - 8 > 0 AND shown > 0) AS ok
  FROM (SELECT *, CASE WHEN whole THEN length(text) WHEN 2 * last >= room - 8 THEN length(rtrim(substring(head, 1, last), blanks)) ELSE length(head) END AS shown
   FROM (SELECT *, greatest(length(regexp_extract(head, '(?s)^(.*(?:\n|[。！？]))', 1)), length(regexp_extract(head, '(?s)^(.*[.!?])\\s', 1))) AS last
    FROM (SELECT *, length(text) <= room AS whole, rtrim(substring(text, 1, greatest(room - 8, 0)), blanks) AS head
     FROM (SELECT *, 9000 - used - fixed AS room
      FROM (SELECT c.query_id, CAST(c.rk AS BIGINT) AS rk, w.used, w.n, c.doc_id, c.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS blanks,
        CASE WHEN w.n > 0 THEN 7 ELSE 0 END + length('[参考文档' || (w.n + 1) || '] 来源: ' || c.name || '；原始块位置: ' || c.place || chr(10)) AS fixed
       FROM walk w JOIN cand c ON c.query_id = w.query_id AND c.rk = w.rk + 1)))))))
"""


@query("context_pack", f"WITH {PACK_SQL} SELECT query_id, CAST(n AS INT) AS id, doc_id, CAST(chars AS INT) AS chars, truncated, CAST(used AS INT) AS used FROM walk WHERE taken")
def context_pack(spark, d):
    return evidence.packed_context(candidates(spark, d), 9000)


@query("context_prefix", f"WITH {BM25_SQL}, c AS (SELECT query_id, rank, b.doc_id, length(text) AS n, sum(length(text) + 60) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM bm_top b JOIN documents d ON b.doc_id = d.doc_id) SELECT query_id, CAST(rank AS INT) AS rank, doc_id, CAST(used AS BIGINT) AS used FROM c WHERE used <= 9000")
def context_prefix(spark, d):
    """The packing without skips: the longest prefix by rank that fits."""
    best = retrieve.top(bm25_best(spark, d, 20), 20, "query_id", F.desc("score"), F.col("doc_id"))
    c = table(spark, d, "documents").select("doc_id", F.length("text").alias("n")).join(F.broadcast(best), "doc_id").withColumn("cost", F.col("n") + 60)
    return memory.prefix_window(c, "cost", 9000, "query_id", "rank").select("query_id", "rank", "doc_id", F.col("spent").alias("used"))


@query("citation_resolve", "WITH a AS (SELECT doc_id AS request_id, unnest([doc_id % 3 + 1, doc_id % 5 + 1, doc_id % 3 + 1]) AS id, unnest([0, 1, 2]) AS pos FROM documents), f AS (SELECT request_id, CAST(id AS INT) AS id, CAST(min(pos) AS INT) AS first_use FROM a GROUP BY 1, 2) SELECT request_id, id, first_use, id <= 3 AS valid FROM f")
def citation_resolve(spark, d):
    mark = lambda n: F.concat(F.lit("[参考文档"), (F.col("doc_id") % n + 1).cast("string"), F.lit("]"))
    answers = table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.concat(F.lit("x"), mark(3), F.lit(" y "), mark(5), F.lit("(link) "), mark(3)).alias("answer"))
    refs = answers.select("request_id", F.explode(F.array(*(F.lit(k) for k in (1, 2, 3)))).alias("id"))
    return evidence.citations_in(answers, refs)


@query("unique_alias", "WITH a AS (SELECT lower(source) || '-' || (doc_id % 97) AS alias, doc_id FROM documents) SELECT alias, min(doc_id) AS doc_id FROM a GROUP BY alias HAVING count(DISTINCT doc_id) = 1")
def unique_alias(spark, d):
    a = table(spark, d, "documents").select(F.concat(F.lower("source"), F.lit("-"), (F.col("doc_id") % 97).cast("string")).alias("alias"), "doc_id")
    return a.groupBy("alias").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most")).where("doc_id = most").drop("most")


MENTIONS_SQL = """
WITH n AS (SELECT doc_id, regexp_extract(lower(text), '[a-z]+ [a-z]+') AS name FROM documents),
a AS (SELECT name AS alias, doc_id FROM n WHERE name <> '' UNION SELECT string_split(name, ' ')[1], doc_id FROM n WHERE name <> ''),
u AS (SELECT alias, CASE WHEN count(DISTINCT doc_id) = 1 THEN min(doc_id) END AS doc, length(alias) AS size FROM a GROUP BY alias),
t AS (SELECT conv_id, turn, x, unnest(generate_series(1, length(x))) AS i FROM (SELECT conv_id, turn, lower(text) AS x FROM conversations)),
p AS (SELECT conv_id, turn, i, size, substr(x, i, size) AS alias FROM t, (SELECT DISTINCT size FROM u)
 WHERE i + size <= length(x) + 1 AND (i = 1 OR NOT regexp_matches(substr(x, i - 1, 1), '[a-z0-9]')) AND NOT regexp_matches(substr(x, i + size, 1), '[a-z0-9]')),
h AS (SELECT conv_id, turn, i - 1 AS start, i - 1 + p.size AS stop, alias, doc FROM p JOIN u USING (alias))
SELECT conv_id, turn, CAST(start AS INT) AS start, alias, doc AS doc_id FROM h WHERE doc IS NOT NULL AND NOT EXISTS
 (SELECT 1 FROM h e WHERE e.conv_id = h.conv_id AND e.turn = h.turn AND e.start <= h.start AND h.stop <= e.stop AND e.stop - e.start > h.stop - h.start)
"""


@query("alias_mentions", MENTIONS_SQL)
def alias_mentions(spark, d):
    """Documents that conversations name: by the first two plain words of their texts, or the first alone, where no other document has them."""
    name = F.regexp_replace(F.regexp_extract(F.lower("text"), "[a-z]+ [a-z]+", 0), " ", ".")
    held = aliases.aliases(table(spark, d, "documents").select("doc_id", name.alias("name"))).withColumn("alias", F.replace("alias", F.lit("."), F.lit(" ")))
    found = aliases.mentions(table(spark, d, "conversations"), held, ["conv_id", "turn"])
    return found.select("conv_id", "turn", "start", "alias", F.col("doc").alias("doc_id"))


@query("distinct_pages", "SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page FROM lineitem")
def distinct_pages(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).distinct()


@query("project_refs", "SELECT doc_id, source AS source_file, n_chars % 9 AS page_number FROM documents")
def project_refs(spark, d):
    refs = table(spark, d, "documents").withColumnRenamed("source", "source_file").withColumn("page_number", F.col("n_chars") % 9)
    return evidence.projected(refs).select("doc_id", "source_file", "page_number")


# Every document gets an abstract in its second chunk, and conclusions now and then.
READING_SQL = f"""WITH {CHUNKS_SQL}, h AS (SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS pos, CASE WHEN chunk_index % 7 = 5 THEN 1 ELSE 0 END AS ending FROM chunks),
f AS (SELECT *, coalesce(min(CASE WHEN chunk_index = 1 AND pos < 5 THEN pos END) OVER (PARTITION BY doc_id), 0) AS first, max(ending) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ends FROM h),
t AS (SELECT *, CASE WHEN pos - first BETWEEN 0 AND 4 THEN 0 WHEN ends = 1 THEN 1 WHEN pos >= first THEN 2 END AS tier FROM f)
SELECT doc_id, chunk_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tier, pos) AS INT) AS place FROM t WHERE tier IS NOT NULL"""


@query("reading_order", READING_SQL)
def reading_order(spark, d):
    i = F.col("chunk_index")
    text = F.when(i == 1, "Abstract: x").when(i % 7 == 5, "5. Conclusions\nx").otherwise("x")
    return evidence.reading_places(fixed_chunks(spark, d).select("doc_id", i, text.alias("text"))).select("doc_id", "chunk_index", "place")


# --- sets and lists --------------------------------------------------------------------------


@query("ordered_distinct", "SELECT conv_id, array_to_string(list(role ORDER BY turn), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def ordered_distinct(spark, d):
    first = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


@query("multiset_cover", "WITH p AS (SELECT user_id, event_type, count(*) AS planned FROM events WHERE event_id % 2 = 0 GROUP BY ALL), c AS (SELECT user_id, event_type, count(*) AS completed FROM events WHERE event_id % 2 = 1 GROUP BY ALL) SELECT p.user_id, p.event_type, planned, coalesce(completed, 0) AS completed, coalesce(completed, 0) >= planned AS covered FROM p LEFT JOIN c ON p.user_id = c.user_id AND p.event_type = c.event_type")
def multiset_cover(spark, d):
    # One aggregate over both bags instead of two and a join.
    even = F.col("event_id") % 2 == 0
    both = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_if(even).alias("planned"), F.count_if(~even).alias("completed"))
    return both.where("planned > 0").withColumn("covered", F.col("completed") >= F.col("planned"))


@query("set_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id")).distinct()


@query("set_subset", "WITH k AS (SELECT conv_id, list_sort(list_distinct(list(role))) AS roles FROM conversations GROUP BY conv_id) SELECT conv_id, list_has_all(['assistant', 'user'], roles) AS subset, roles = ['assistant', 'user'] AS equal FROM k")
def set_subset(spark, d):
    wanted = F.array(F.lit("assistant"), F.lit("user"))
    k = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return k.select("conv_id", (F.size(F.array_except("roles", wanted)) == 0).alias("subset"), (F.col("roles") == wanted).alias("equal"))


@query("renumber_union", "WITH u AS (SELECT label, vec_id, 0 AS side FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT label, vec_id, 1 FROM embeddings WHERE vec_id % 3 = 0) SELECT label, vec_id, side, CAST(row_number() OVER (PARTITION BY label ORDER BY side, vec_id) AS INT) AS id FROM u")
def renumber_union(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id")
    u = e.where("vec_id % 2 = 0").withColumn("side", F.lit(0)).unionByName(e.where("vec_id % 3 = 0").withColumn("side", F.lit(1)))
    return u.withColumn("id", F.row_number().over(W.partitionBy("label").orderBy("side", "vec_id")))


# --- memory ----------------------------------------------------------------------------------


def conversations(spark, d):
    return table(spark, d, "conversations")


@query("session_messages", "SELECT conv_id, turn, role, length(text) AS chars FROM conversations")
def session_messages(spark, d):
    return conversations(spark, d).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("session_delete", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0 AND role = 'system')")
def session_delete(spark, d):
    c = conversations(spark, d).select("conv_id", "turn", "role")
    return c.join(c.where("turn = 0 and role = 'system'").select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "turn")


PAIRS_SQL = "m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' END AS role, text FROM conversations), n AS (SELECT *, lead(role) OVER w AS nr, lead(turn) OVER w AS nt, lead(text) OVER w AS nx FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), pairs AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pair, turn AS question_at, CASE WHEN nr = 'ai' THEN nt END AS answer_at, length(text) + coalesce(CASE WHEN nr = 'ai' THEN length(nx) END, 0) AS cost FROM n WHERE role = 'human')"


def pairs(spark, d):
    p = memory.turn_pairs(conversations(spark, d))
    return p.select("conv_id", "pair", "question_at", "answer_at", (F.length("question") + F.coalesce(F.length("answer"), F.lit(0))).cast("long").alias("cost"))


@query("turn_pairs", f"WITH {PAIRS_SQL} SELECT conv_id, CAST(pair AS INT) AS pair, question_at, answer_at FROM pairs")
def turn_pairs(spark, d):
    return pairs(spark, d).drop("cost")


@query("role_normalize", "SELECT CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' END AS role, count(*) AS n FROM conversations GROUP BY 1")
def role_normalize(spark, d):
    return conversations(spark, d).groupBy(memory.role(F.col("role")).alias("role")).agg(F.count("*").alias("n"))


@query("memory_window", f"WITH {PAIRS_SQL}, s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY pair DESC) AS spent FROM pairs) SELECT conv_id, CAST(pair AS INT) AS pair, CAST(spent AS BIGINT) AS spent FROM s WHERE spent <= 2000")
def memory_window(spark, d):
    return memory.trailing_window(pairs(spark, d), "cost", 2000, at="pair").select("conv_id", "pair", "spent")


@query("prefix_budget", f"WITH {PAIRS_SQL}, s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY pair) AS spent FROM pairs) SELECT conv_id, CAST(pair AS INT) AS pair, CAST(spent AS BIGINT) AS spent FROM s WHERE spent <= 2000")
def prefix_budget(spark, d):
    return memory.prefix_window(pairs(spark, d), "cost", 2000, at="pair").select("conv_id", "pair", "spent")


@query("compaction_batch", f"WITH {PAIRS_SQL}, r AS (SELECT conv_id, pair, count(*) OVER (PARTITION BY conv_id) AS pending, row_number() OVER (PARTITION BY conv_id ORDER BY pair DESC) AS newest FROM pairs) SELECT conv_id, CAST(pair AS INT) AS pair, pending FROM r WHERE pending >= 4 AND newest > 2")
def compaction_batch(spark, d):
    return memory.compaction_batch(pairs(spark, d), 4, 2).select("conv_id", "pair", "pending")


@query("session_title", "SELECT conv_id, substring(arg_min(text, turn), 1, 24) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def session_title(spark, d):
    return conversations(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 24).alias("title"))


@query("summary_upsert", "WITH s AS (SELECT conv_id, max(turn) AS top FROM conversations GROUP BY conv_id), p AS (SELECT s.conv_id, CASE WHEN s.conv_id % 4 = 0 THEN 1 ELSE 0 END AS seen, top AS through FROM s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn = top AND c.role = 'assistant'), o AS (SELECT conv_id, 0 AS through FROM s WHERE conv_id % 2 = 0) SELECT coalesce(o.conv_id, p.conv_id) AS session_id, CASE WHEN p.through IS NOT NULL AND coalesce(o.through, 0) = p.seen THEN p.through ELSE o.through END AS through, CASE WHEN p.through IS NOT NULL AND coalesce(o.through, 0) = p.seen THEN 'new' ELSE 'old' END AS content FROM o FULL JOIN p ON o.conv_id = p.conv_id WHERE CASE WHEN p.through IS NOT NULL AND coalesce(o.through, 0) = p.seen THEN p.through ELSE o.through END IS NOT NULL")
def summary_upsert(spark, d):
    c = conversations(spark, d)
    messages = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), memory.role(F.col("role")).alias("role"))
    last = messages.groupBy("session_id").agg(F.max("id").alias("through"))
    old = last.where("session_id % 2 = 0").select("session_id", F.lit(0).cast("long").alias("through"), F.lit("old").alias("content"))
    proposed = last.select("session_id", F.when(F.col("session_id") % 4 == 0, 1).otherwise(0).cast("long").alias("seen"), "through", F.lit("new").alias("content"))
    return memory.summary_upsert(old, proposed, messages)


# --- cache -----------------------------------------------------------------------------------


CACHE_LOOKUP_SQL = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
hits AS (SELECT q.vec_id AS query_id, c.vec_id AS entry, round(list_cosine_similarity(q.e, c.e), 9) AS s FROM v q JOIN v c ON q.label = c.label AND c.vec_id % 20 <> 0 WHERE q.vec_id % 20 = 0)
SELECT query_id, entry, 'semantic' AS mode, round(s, 6) AS similarity FROM hits WHERE s >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entry) = 1
"""


@query("cache_lookup", CACHE_LOOKUP_SQL)
def cache_lookup(spark, d):
    """The stated query set asks; all other rows are what the cache holds."""
    e, i = table(spark, d, "embeddings"), F.col("vec_id").cast("string")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("q"), i).alias("question"), F.col("label").alias("c"), F.col("embedding").alias("vector"))
    held = e.where("vec_id % 20 <> 0").select(F.col("vec_id").alias("entry"), F.concat(F.lit("e"), i).alias("e_question"), F.col("label").alias("e_c"), F.col("embedding").alias("e_vector"))
    hit = memory.cache_lookup(q, held, threshold=0.2)
    return hit.select("query_id", "entry", "mode", F.round("similarity", 6).alias("similarity"))


@query("fifo_cap", "WITH l AS (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS question, event_id FROM events), m AS (SELECT user_id AS scope, question, max(event_id) AS seq FROM l GROUP BY 1, 2) SELECT scope, question, seq FROM m QUALIFY row_number() OVER (PARTITION BY scope ORDER BY seq DESC) <= 20")
def fifo_cap(spark, d):
    puts = table(spark, d, "events").select(F.col("user_id").alias("scope"), F.get_json_object("props", "$.k").cast("int").alias("question"), F.col("event_id").alias("seq"))
    return memory.fifo(puts, 20, scope="scope")


@query("cache_admission", "SELECT event_id, event_type = 'purchase' AND event_id % 3 <> 0 AND event_id % 5 > 0 AND value >= 1 AS admitted FROM events")
def cache_admission(spark, d):
    i = F.col("event_id")
    ok = memory.admissible(F.col("event_type") == "purchase", F.when(i % 3 == 0, "low").otherwise("grounded"), F.lit("answer"), i % 5, F.when(F.col("value") < 1, 1).otherwise(0), F.lit(0), F.lit(False))
    return table(spark, d, "events").select("event_id", ok.alias("admitted"))


@query("cache_bypass", "SELECT conv_id, turn, regexp_matches(lower(text), '刚才|之前|上一|前面|上述|它|这(?:篇|份|个|些)|本文|该(?:论文|文档)|\\b(?:it|this|that|previous|above)\\b') AS bypass FROM conversations")
def cache_bypass(spark, d):
    return conversations(spark, d).select("conv_id", "turn", tx.refers_back(F.col("text")).alias("bypass"))


# --- telemetry -------------------------------------------------------------------------------

REQ_SQL = "req AS (SELECT event_id, user_id, event_type AS status, event_id % 7 = 0 AS cache_hit, CASE event_type WHEN 'click' THEN 'success' WHEN 'view' THEN 'empty' WHEN 'error' THEN 'error' ELSE 'not_started' END AS retrieval_status, event_id % 4 AS documents, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS seconds FROM events)"


def requests(spark, d):
    i, t = F.col("event_id"), F.col("event_type")
    status = F.when(t == "click", "success").when(t == "view", "empty").when(t == "error", "error").otherwise("not_started")
    return table(spark, d, "events").select(i, "user_id", t.alias("status"), (i % 7 == 0).alias("cache_hit"), status.alias("retrieval_status"), (i % 4).alias("documents"), F.when(i % 11 != 0, F.col("value")).alias("seconds"))


@query("log_latest_snapshot", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def log_latest_snapshot(spark, d):
    return telemetry.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"]).drop("ts")


@query("retrieval_metrics", f"WITH {REQ_SQL}, t AS (SELECT *, NOT cache_hit AND retrieval_status IN ('success', 'empty', 'error') AS tried FROM req) SELECT count(*) FILTER (WHERE tried) AS attempts, count(*) FILTER (WHERE tried AND retrieval_status <> 'error') AS completed, count(*) FILTER (WHERE tried AND retrieval_status <> 'error' AND documents > 0) AS hits, round(count(*) FILTER (WHERE tried AND retrieval_status <> 'error' AND documents > 0) / CAST(count(*) FILTER (WHERE tried AND retrieval_status <> 'error') AS DOUBLE), 6) AS hit_rate, count(*) FILTER (WHERE tried AND retrieval_status = 'error') AS failed, round(avg(seconds) FILTER (WHERE tried AND seconds >= 0), 6) AS retrieval_seconds, round(avg(seconds) FILTER (WHERE tried AND seconds >= 0 AND status <> 'view'), 6) AS response_seconds FROM t")
def retrieval_metrics(spark, d):
    r = requests(spark, d).withColumn("status", F.when(F.col("status") == "view", "retrieved").otherwise(F.col("status")))
    return telemetry.retrieval_metrics(r.withColumn("retrieval_seconds", F.col("seconds")).withColumn("response_seconds", F.col("seconds")))


@query("score_histogram", "WITH s AS (SELECT event_type AS model, value / 100 AS score FROM events WHERE value / 100 BETWEEN 0 AND 1), g AS (SELECT model, count(*) AS count, round(avg(score), 6) AS mean, min(score) AS min, max(score) AS max FROM s GROUP BY model), b AS (SELECT model, CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n FROM s GROUP BY 1, 2) SELECT g.*, CAST(r.bin AS INT) AS bin, coalesce(n, 0) AS n FROM g CROSS JOIN (SELECT unnest(range(10)) AS bin) r LEFT JOIN b ON g.model = b.model AND r.bin = b.bin")
def score_histogram(spark, d):
    return telemetry.score_histogram(table(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("value") / 100).alias("score")), ["model"])


@query("tool_summary", "WITH c AS (SELECT CAST(json_extract(props, '$.k') AS INT) % 5 AS tool, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'pending' ELSE 'success' END AS status, value AS seconds FROM events) SELECT tool, count(*) AS started, count(*) FILTER (WHERE status <> 'pending') AS completed, count(*) FILTER (WHERE status = 'success') AS successes, count(*) FILTER (WHERE status = 'error') AS failures, count(*) FILTER (WHERE status = 'pending') AS pending, round(count(*) FILTER (WHERE status = 'success') / CAST(count(*) FILTER (WHERE status <> 'pending') AS DOUBLE), 6) AS success_rate, round(avg(seconds) FILTER (WHERE status <> 'pending'), 6) AS mean_seconds FROM c GROUP BY ROLLUP (tool)")
def tool_summary(spark, d):
    t = F.col("event_type")
    status = F.when(t == "error", "error").when(t == "view", "pending").otherwise("success")
    calls = table(spark, d, "events").select((F.get_json_object("props", "$.k").cast("int") % 5).alias("tool"), status.alias("status"), "value")
    return calls.rollup("tool").agg(*telemetry.call_summary(F.col("status"), F.col("value")))


@query("token_totals", f"WITH {REQ_SQL}, k AS (SELECT user_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id % 50 END AS tokens FROM req) SELECT user_id, CAST(CASE WHEN count(*) = count(tokens) THEN sum(tokens) END AS BIGINT) AS total, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS known_total, count(*) - count(tokens) AS unknown_calls FROM k GROUP BY user_id")
def token_totals(spark, d):
    tokens = F.when(F.col("event_id") % 97 != 0, F.col("event_id") % 50)
    k = table(spark, d, "events").select("user_id", tokens.alias("t"))
    return k.groupBy("user_id").agg(telemetry.known_sum(F.col("t")).alias("total"), F.coalesce(F.sum("t"), F.lit(0)).alias("known_total"), F.count_if(F.col("t").isNull()).alias("unknown_calls"))


@query("log_token_rules", "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_type = 'view' THEN 0 WHEN event_id % 5 <> 0 THEN event_id % 100 END AS input, CASE WHEN event_id % 7 = 0 OR event_type = 'view' THEN 0 WHEN event_id % 3 <> 0 THEN event_id % 40 END AS output, CASE WHEN event_id % 7 = 0 OR event_type = 'view' THEN 0 WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 THEN event_id % 100 + event_id % 40 END AS total, CASE WHEN event_id % 7 = 0 THEN 'cache' WHEN event_type = 'view' THEN 'not_called' WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 THEN 'ollama' ELSE 'unavailable' END AS source FROM events")
def log_token_rules(spark, d):
    i = F.col("event_id")
    rules = telemetry.token_rules(i % 7 == 0, F.col("event_type") != "view", F.when(i % 5 != 0, i % 100), F.when(i % 3 != 0, i % 40))
    return table(spark, d, "events").select("event_id", *rules)


@query("session_stats", f"WITH {REQ_SQL} SELECT user_id, count(*) AS requests, CASE WHEN count(*) = count(seconds) THEN round(sum(seconds), 4) END AS seconds, round(avg(seconds), 4) AS mean_seconds, count(*) FILTER (WHERE status IN ('click', 'purchase')) AS tool_successes, count(*) FILTER (WHERE status = 'error') AS tool_failures, round(count(*) FILTER (WHERE status IN ('click', 'purchase')) / CAST(nullif(count(*) FILTER (WHERE status IN ('click', 'purchase', 'error')), 0) AS DOUBLE), 6) AS tool_rate, count(*) FILTER (WHERE retrieval_status IN ('success', 'empty', 'error')) AS retrieval_count, round(count(*) FILTER (WHERE retrieval_status IN ('success', 'empty') AND documents > 0) / CAST(nullif(count(*) FILTER (WHERE retrieval_status IN ('success', 'empty')), 0) AS DOUBLE), 6) AS retrieval_hit_rate FROM req GROUP BY user_id")
def session_stats(spark, d):
    s, r = F.col("status"), F.col("retrieval_status")
    good, bad = F.count_if(s.isin("click", "purchase")), F.count_if(s == "error")
    back = F.count_if(r.isin("success", "empty"))
    return requests(spark, d).groupBy("user_id").agg(
        F.count("*").alias("requests"),
        F.round(telemetry.known_sum(F.col("seconds")), 4).alias("seconds"),
        F.round(F.avg("seconds"), 4).alias("mean_seconds"),
        good.alias("tool_successes"),
        bad.alias("tool_failures"),
        F.round(telemetry.rate(good, good + bad), 6).alias("tool_rate"),
        F.count_if(r.isin("success", "empty", "error")).alias("retrieval_count"),
        F.round(telemetry.rate(F.count_if(r.isin("success", "empty") & (F.col("documents") > 0)), back), 6).alias("retrieval_hit_rate"),
    )


@query("attempt_usage", "SELECT user_id, CAST(sum(CASE WHEN event_id % 9 <> 0 THEN event_id % 30 END) AS BIGINT) AS tokens, bool_or(event_id % 9 = 0 OR event_type = 'error') AS incomplete FROM events GROUP BY user_id")
def attempt_usage(spark, d):
    i = F.col("event_id")
    tokens, incomplete = telemetry.attempt_usage(F.when(i % 9 != 0, i % 30), F.col("event_type") == "error")
    return table(spark, d, "events").groupBy("user_id").agg(tokens.alias("tokens"), incomplete.alias("incomplete"))


@query("trace_rows", "WITH m AS (SELECT event_id AS call_id, user_id, event_type AS phase FROM events WHERE event_id % 3 <> 0), t AS (SELECT event_id AS call_id, value AS seconds FROM events WHERE event_id % 2 = 0) SELECT coalesce(m.call_id, t.call_id) AS call_id, coalesce(phase, 'tool') AS phase, round(seconds, 3) AS seconds, CASE WHEN t.call_id IS NULL THEN 'no tool' WHEN m.call_id IS NULL THEN 'running' ELSE 'done' END AS status FROM m FULL JOIN t ON m.call_id = t.call_id")
def trace_rows(spark, d):
    e = table(spark, d, "events")
    m = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("phase"))
    t = e.where("event_id % 2 = 0").select(F.col("event_id").alias("call_id"), F.col("value").alias("seconds"), F.lit(True).alias("tool"))
    status = F.when(F.col("tool").isNull(), "no tool").when(F.col("phase").isNull(), "running").otherwise("done")
    return m.join(t, "call_id", "full").select("call_id", F.coalesce("phase", F.lit("tool")).alias("phase"), F.round("seconds", 3).alias("seconds"), status.alias("status"))


@query("repeat_guard", "WITH c AS (SELECT user_id, event_type, event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events) SELECT event_id, seen <= 2 AS allowed FROM c")
def repeat_guard(spark, d):
    w = W.partitionBy("user_id", "event_type").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", (F.count("*").over(w) <= 2).alias("allowed"))


@query("late_results", "SELECT event_id, value <= 20 AS in_time, CASE WHEN value <= 20 THEN event_type ELSE 'timeout' END AS status FROM events")
def late_results(spark, d):
    """A result past its deadline counts as a timeout, whatever it was."""
    in_time, status = telemetry.within_deadline(F.col("value"), F.lit(20), F.col("event_type"))
    return table(spark, d, "events").select("event_id", in_time.alias("in_time"), status.alias("status"))


@query("last_success", "SELECT user_id, max(epoch_us(ts)) FILTER (WHERE event_type = 'click') AS llm, max(epoch_us(ts)) FILTER (WHERE event_type IN ('click', 'view') AND event_id % 7 <> 0) AS vector_database FROM events GROUP BY user_id")
def last_success(spark, d):
    t, at = F.col("event_type"), F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(t == "click", at)).alias("llm"), F.max(F.when(t.isin("click", "view") & (F.col("event_id") % 7 != 0), at)).alias("vector_database"))


@query("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, json_extract(props, '$.missing') IS NULL AS missing FROM events")
def json_extract(spark, d):
    p = F.from_json("props", "k int, missing string")
    return table(spark, d, "events").select("event_id", p["k"].alias("k"), p["missing"].isNull().alias("missing"))


@query("event_day_partition", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1")
def event_day_partition(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
