"""Names in texts against one pattern a name, and against the driver's own resolver."""

import random
import re

from pyspark.sql import functions as F

from skarn.operators import agent, aliases

KEYS = ["id"]


def found(spark, names, texts, shard=aliases.SHARD):
    held = aliases.aliases(spark.createDataFrame(names, "name string, doc_id string"))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [(r.id, r.start, r.alias, r.doc) for r in aliases.mentions(rows, held, KEYS, shard=shard).orderBy("id", "start", "stop").collect()]


def plain(names, texts):
    ids = {}
    for name, doc in names:
        low = (name or "").strip().lower()
        for alias in {low, low.rsplit(".", 1)[0] or low} - {""}:
            ids.setdefault(alias, set()).add(doc)
    out = []
    for n, text in enumerate(texts):
        low = (text or "").lower()
        spans = {(m.start(), m.start() + len(a), a) for a in ids for m in re.finditer(rf"(?<![a-z0-9])(?={re.escape(a)}(?![a-z0-9]))", low)}
        keep = [x for x in spans if not any(y[0] <= x[0] and x[1] <= y[1] and y[:2] != x[:2] for y in spans)]
        out += [(n, s, a, min(ids[a])) for s, e, a in sorted(keep) if len(ids[a]) == 1]
    return out


def test_mentions_equal_one_pattern_a_name(spark):
    rnd = random.Random(3)
    words = ["ab", "a", "b c", "ü", "c.b", "论文", "a-b"]
    names = [(" ".join(rnd.choices(words, k=rnd.randrange(1, 4))) + rnd.choice(["", ".pdf", ".md"]), f"d{k % 17}") for k in range(40)]
    names += [(".md", "dot"), (" ", "blank"), (None, "null"), ("AB a.pdf", "x"), ("ab a.md", "y")]
    texts = [" ".join(rnd.choices([*words, "ab a", "AB", "a.pdf", "x"], k=rnd.randrange(1, 30))) for _ in range(25)] + ["", None, "ab " * 5000]
    want = plain(names, texts)
    assert found(spark, names, texts) == want and len(want) > 100
    # Names over several automata, some of them empty, give the same; places in one another are resolved over all.
    assert found(spark, names, texts, shard=3) == want
    assert found(spark, [], texts) == []


def test_mentions_agree_with_the_resolver_of_questions(spark):
    names = [("Deep A.pdf", "2"), ("a.md", "1"), ("b.md", "4"), ("b.txt", "3")]
    for q in ("compare Deep A.pdf with b.txt", "what of b?", "a and b.md"):
        assert list(dict.fromkeys(d for *_, d in found(spark, names, [q]))) == agent.named_documents(q, names)
        low = spark.createDataFrame(names, "name string, doc_id string").where(aliases.may_name(q, F.col("name")))
        assert agent.named_documents(q, [tuple(r) for r in low.collect()]) == agent.named_documents(q, names)
