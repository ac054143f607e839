"""The registered queries opN_<name>: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.substring_dedup import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from skarn.llm.lattice_lm import lattice_scores

    return lattice_scores(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.license_scan import license_scan

    out = license_scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.max_score import max_score

    vectors = _table(spark, sf_dir, "embeddings")
    return max_score(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.common import crc_mod
    from skarn.llm.toxicity import scored, train

    docs = _table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = train(docs.where(~held_out), _table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.common import crc_mod
    from skarn.llm.language_id import identified, train

    docs = _table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identified(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.packing import best_fit_packing

    return best_fit_packing(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.warc_fixity import aged, audit, records

    archive = records(_table(spark, sf_dir, "pages"))
    return audit(archive, aged(archive))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.fingerprints import edited_neighbours

    return edited_neighbours(_table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.centroids import cluster_vectors

    return cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skarn.llm.conversation_repair import damaged, repair

    return repair(damaged(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


#: Byte strings are written as hex, two digits a byte. A byte goes if a repeated window of 200 bytes covers it.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 199)) AS p, h FROM d WHERE length(h) >= 400),
k AS (SELECT doc_id, p, hash(substring(h, 2 * p + 1, 400)) AS x FROM w),
r AS (SELECT doc_id, p FROM k WHERE x IN (SELECT x FROM k GROUP BY x HAVING count(*) > 1)),
i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER v + 200 THEN 0 ELSE 1 END AS new FROM r WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM i),
s AS (SELECT doc_id, island, min(p) AS lo, max(p) + 200 AS hi FROM g GROUP BY doc_id, island),
e AS (SELECT d.doc_id, d.h, coalesce(s.hi, 0) AS start, lead(s.lo) OVER (PARTITION BY d.doc_id ORDER BY s.hi NULLS FIRST) AS nxt, s.lo, s.hi
  FROM d LEFT JOIN (SELECT doc_id, lo, hi FROM s UNION ALL SELECT doc_id, NULL, NULL FROM d) s ON d.doc_id = s.doc_id)
SELECT doc_id, CAST(any_value(length(h)) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(sum(hi - lo), 0) AS BIGINT) AS n_removed, count(lo) AS n_spans,
  sha256(unhex(string_agg(substring(h, CAST(2 * start + 1 AS BIGINT), CAST(2 * (coalesce(nxt, length(h) // 2) - start) AS BIGINT)), '' ORDER BY start))) AS kept_sha256
FROM e GROUP BY doc_id
"""
OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s FROM w),
c AS (SELECT doc_id, len(s) AS n, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id FROM sh),
x AS (SELECT doc_id, n, unnest(s) AS v FROM c WHERE doc_id = class_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS root FROM both_ways UNION SELECT b, root FROM reach JOIN both_ways ON id = a),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(root, class_id) AS component_id, doc_id = coalesce(root, class_id) AS kept, class_id FROM c LEFT JOIN roots ON class_id = id
"""

OP10_SQL = """
WITH b AS (SELECT page_id, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS body, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CAST(floor(page_id / 4096.0) AS BIGINT) AS file, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
  || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM b),
l AS (SELECT file, page_id, strlen(record) AS length, sha256(record) AS digest FROM r)
SELECT file, row_number() OVER w - 1 AS seq, page_id, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length, digest,
  CASE WHEN page_id % 97 = 5 THEN 'corrupt' ELSE 'sound' END AS status, NOT bool_or(page_id % 97 = 5) OVER (PARTITION BY file) AS root_equal
FROM l WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, digest)
"""


#: crc32 by a table of 256 remainders; the pass over messages as a recursion that keeps the least (cost, audit) of each state.
OP13_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(key) + 1), lambda i: ord(key[i]))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code FROM keyed, tab),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded, (VALUES (1), (2)) c(copy) WHERE code <> 0 AND (copy = 1 OR code = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text)) AS pos FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS time, left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair FROM placed),
marked AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN time > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM seen),
counts AS (SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
convs AS (SELECT DISTINCT c.conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM conversations c LEFT JOIN counts k ON c.conv_id IS NOT DISTINCT FROM k.conv_id),
moves(kind, state, initial, onward, given) AS (VALUES ('D', 0, '', 0, ''), ('D', 1, '', 1, ''), ('D', 2, '', 2, ''), ('D', 3, '', 3, ''), ('K', 0, 's', 1, ''), ('K', 0, 'u', 2, ''), ('K', 1, 'u', 2, ''),
  ('K', 2, 'a', 3, ''), ('K', 3, 'u', 2, ''), ('R', 0, '', 2, 'user'), ('R', 1, '', 2, 'user'), ('R', 2, '', 3, 'assistant'), ('R', 3, '', 2, 'user')),
inserts(state, onward, letters, added) AS (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 2, 'I', ['user:']),
  (1, 3, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 2, 'I', ['user:']), (3, 3, 'II', ['user:', 'assistant:'])),
pass(conv_id, pos, state, cost, audit, lines) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM convs
  UNION ALL
  SELECT conv_id, pos, onward, cost, audit, lines FROM (
    SELECT p.conv_id, r.pos, m.onward, p.cost + 5 * length(i.letters) + CASE m.kind WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN m.kind <> 'D' AND r.fault = 3 THEN 5 ELSE 0 END AS cost,
      p.audit || i.letters || m.kind AS audit,
      CASE m.kind WHEN 'D' THEN list_concat(p.lines, i.added) WHEN 'R' THEN list_concat(p.lines, i.added, [m.given || ':' || r.text]) ELSE list_concat(p.lines, i.added, [r.role || ':' || r.text]) END AS lines
    FROM pass p JOIN marked r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = p.pos + 1 JOIN inserts i ON i.state = p.state
    JOIN moves m ON m.state = i.onward AND (m.kind = 'D' OR r.fault NOT IN (1, 2)) AND (m.kind <> 'K' OR m.initial = left(r.role, 1)))
  QUALIFY row_number() OVER (PARTITION BY conv_id, onward ORDER BY cost, audit) = 1),
last AS (SELECT c.*, p.cost + 5 * length(i.letters) AS cost, p.audit || i.letters AS audit, list_concat(p.lines, i.added) AS lines
  FROM convs c JOIN pass p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.pos JOIN inserts i ON i.state = p.state AND i.onward IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY p.cost + 5 * length(i.letters), p.audit || i.letters) = 1)
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256 FROM last
"""


def clustering_sql(k: int = 8, width: int = 64, rounds: int = 10) -> str:
    """Each round as a table of centroids, by plain distances of whole numbers."""
    distance = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    near = lambda r: f"SELECT v.n, v.vec_id, v.q, arg_min(c.cluster, ({distance}, c.cluster)) AS cluster, min({distance}) AS distance FROM v, c{r} c GROUP BY v.n, v.vec_id, v.q"
    steps = [
        f"""a{r} AS MATERIALIZED ({near(r)}),
m{r} AS (SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM (SELECT cluster, unnest(range(1, {width + 1})) AS i, unnest(q) AS x FROM a{r}) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(any_value(g.q), any_value(c.q)) AS q FROM c{r} c LEFT JOIN (SELECT cluster, list(CAST(x AS BIGINT) ORDER BY i) AS q FROM m{r} GROUP BY cluster) g ON c.cluster = g.cluster GROUP BY c.cluster)"""
        for r in range(rounds)
    ]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({1024} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS INT) AS cluster, q FROM v QUALIFY cluster < {k}),
{",\n".join(steps)},
f AS MATERIALIZED ({near(rounds)})
SELECT vec_id, f.cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM f JOIN c{rounds} c ON f.cluster = c.cluster
"""


def license_sql() -> str:
    """The vote in SQL; the templates' runs and the phrases are written out as values."""
    from skarn.llm.license_scan import K, MIN_COVER, PHRASES, SLACK, TEMPLATES, template_words

    grams = [(f"{label}/{n}", label, i, len(w) - K + 1, " ".join(w[i : i + K])) for label, texts in TEMPLATES.items() for n, w in enumerate(map(template_words, texts)) for i in range(len(w) - K + 1)]
    values = ", ".join(f"('{t}', '{label}', {at}, {runs}, '{g}')" for t, label, at, runs, g in grams)
    phrases = " UNION ALL ".join(f"SELECT doc_id, pos, '{label}' AS label FROM each_word WHERE {' AND '.join(f"w[pos + {j + 1}] = '{x}'" for j, x in enumerate(p.split()))}" for p, label in PHRASES.items())
    return f"""
WITH t(template, label, place, runs, g) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
each_word AS (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM d),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS labels FROM ({phrases}) GROUP BY doc_id),
hits AS (SELECT doc_id, template, label, runs, e.pos - t.place AS diagonal, t.place AS a, e.pos FROM each_word e JOIN t ON e.w[e.pos + 1] || ' ' || e.w[e.pos + 2] || ' ' || e.w[e.pos + 3] = g),
votes AS (SELECT DISTINCT doc_id, template, diagonal FROM hits),
bands AS (SELECT v.doc_id, v.template, v.diagonal, h.label, count(DISTINCT h.a) / CAST(h.runs AS DOUBLE) AS cover FROM votes v
  JOIN hits h ON v.doc_id = h.doc_id AND v.template = h.template AND h.diagonal BETWEEN v.diagonal AND v.diagonal + {2 * SLACK} GROUP BY v.doc_id, v.template, v.diagonal, h.label, h.runs),
spans AS (SELECT doc_id, label, cover FROM bands WHERE cover >= {MIN_COVER}),
found AS (SELECT doc_id, list(label) AS labels, max(cover) AS cover FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, f.labels))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(cover, 0.0) END AS score
FROM d LEFT JOIN base b ON d.doc_id = b.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; the others are tested against brute force, round trips or held-out rows."""
    return {"op4_license_scan": license_sql(), "op2_suffix_array_dedup": OP2_SQL, "op5_max_score": OP5_SQL, "op7_minhash_near_dedup": OP7_SQL, "op10_warc_fixity": OP10_SQL, "op12_centroid_clustering": clustering_sql(), "op13_conversation_repair": OP13_SQL}
