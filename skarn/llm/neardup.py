"""MinHash near-duplicate detection with bottom-k sketches from one hash function.

A document's set is its distinct 5-word shingles. Its sketch is the SKETCH smallest
shingle hashes. Inverted lists of the retained values generate candidate pairs, an
estimate from the union of two sketches filters them, the Jaccard similarity of the full
sets verifies them, and connected components of the links are the groups.

Rare values first: two sets at the threshold share at least need() sketch values but for a
chance below 1e-4, so each sketch lists only its rarest values, one more than it may miss. Values
of common lines then make no lists. Equal sets are one class before anything is paired.
A list is paired with one pivot only, its most typical member; when its members are then still in
several components, those outside its largest are compared with every member, where sizes, shared
shingles (exact, in long lists) and sketches leave a link possible.

Defined results: null, empty or word-less texts have an empty set and stand alone; a null
doc_id stays a row of its own, linked with nothing; rows that repeat a doc_id are one document, by the text with the
largest set (ties: fingerprint, then hash of the text), whatever the order of rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import LOWER, Scratch, binary_buffer, lean, packed_texts, shingle_hashes, small_batches, span_hashes, text_bytes, word_spans
from skarn.llm.components import components

SKETCH = 32
#: Lists longer than this that stay apart get the bound by shared shingles before their members are paired.
CROWD = 64
#: That bound is summed over so many ranges of shingle hashes, which makes it nearly tight.
SLOTS = 32
#: A class of equal sets is joined by broadcast if it has more rows than this and than the HEAVY-th part of all.
HEAVY, HEAVY_ROWS = 4096, 64
_INT64_MIN = np.uint64(1 << 63)


def need(percent: int) -> int:
    """Of full sketches, two sets at the threshold share so many values at least (chance of fewer: below 1e-4)."""
    j = percent / 100
    return max(1, int(SKETCH * j - 4.7 * (SKETCH * j * (1 - j)) ** 0.5))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = binary_buffer(texts)
    data = LOWER[data]
    starts, ends = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    at = np.searchsorted(starts, offsets)
    return [np.unique(shingle_hashes(words[at[i] : at[i + 1]], width)) for i in range(len(offsets) - 1)]


def _signed(values: np.ndarray) -> np.ndarray:
    return (values ^ _INT64_MIN).view(np.int64)


@lean
def _sketches(batches, width: int):
    for b in batches:
        sets = shingle_sets(b.column("text"), width)
        prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        small = [_signed(s[:SKETCH]) for s in sets]
        ends = pa.array(np.cumsum([0, *map(len, small)]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*small, np.zeros(0, np.int64)]), pa.int64()))
        sizes = pa.array([len(s) for s in sets], pa.int64())
        columns = [b.column("doc_id"), b.column("tag"), sizes, pa.array(prints, pa.binary()), lists]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "n", "fp", "sketch"])


def _tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): tag tells the texts of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_bytes()).alias("tag"), text_bytes().alias("text"))


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, tag: of its text, n: size of the set, fp: fingerprint of the set, sketch: its smallest values)."""
    schema = "doc_id long, tag long, n long, fp binary, sketch array<long>"
    return _tagged(docs).mapInArrow(partial(_sketches, width=width), schema)


def _with_class(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """rows (doc_id, n, fp) with class_id and root of their fp; null for empty sets.

    A class with more than one in HEAVY of all rows goes to every task; there are fewer than HEAVY such classes.
    No task then reads much more than its share, however large a class is.
    """
    heavy = F.lit(max(HEAVY_ROWS, total // HEAVY))
    found = classes.select("fp", "m", F.struct("class_id", "root").alias("own"))
    large = F.broadcast(found.where(F.col("m") > heavy).select("fp", F.col("own").alias("large")))
    marked = rows.join(large, "fp", "left")
    done = marked.where("large is not null or n = 0").select("doc_id", "n", F.col("large").alias("own"))
    rest = marked.where("large is null and n > 0").join(found.where(F.col("m") <= heavy), "fp")
    return done.union(rest.select("doc_id", "n", "own")).select("doc_id", "n", "own.*")


@lean
def _shingles(batches, width: int):
    """(doc_id, h): every shingle of every text."""
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
            sets = shingle_sets(pa.array([unpack(z) for z in part.column("z").to_pylist()], pa.binary()), width)
            ids = np.repeat(part.column("doc_id").to_numpy(), [len(s) for s in sets])
            for i in range(0, len(ids), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + (1 << 16)]), pa.array(np.concatenate(sets)[i : i + (1 << 16)].view(np.int64))], ["doc_id", "h"])


@lean
def _verify(batches, width: int, percent: int):
    unpack = zstandard.ZstdDecompressor().decompress
    cache: dict[int, np.ndarray] = {}
    for b in batches:
        for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
            sets = {}
            for side in "ab":
                ids = part.column(side).to_pylist()
                texts = part.column(f"z{side}").to_pylist()
                new = {i: z for i, z in zip(ids, texts) if i not in cache and i not in sets}
                sets |= dict(zip(new, shingle_sets(pa.array([unpack(z) for z in new.values()], pa.binary()), width)))
            pivots = part.column("a").to_pylist()
            known = cache | sets
            ok = []
            for x, y in zip(pivots, part.column("b").to_pylist()):
                s, t = known[x], known[y]
                common = len(np.intersect1d(s, t, assume_unique=True)) if len(s) and len(t) else 0
                ok.append(100 * common >= percent * (len(s) + len(t) - common) and common > 0)
            cache = {pivots[-1]: known[pivots[-1]]}
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _pairs_at_threshold(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the threshold."""
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("z").alias("zb")), "b")
    with_both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), "a")
    return with_both.select("a", "b", "za", "zb").mapInArrow(partial(_verify, width=width, percent=percent), "a long, b long")


def _estimate(a: str, b: str):
    """Share of the union's smallest values that both sketches hold."""
    width = F.greatest(F.lit(1), F.least(F.greatest(F.size(a), F.size(b)), F.lit(SKETCH)))
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, width)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id): groups of documents linked at percent or more."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "neardup")
    sk = scratch.write(sketches(docs, width), "sketches")
    one = sk.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n", "fp", "tag")).alias("s"))
    by_id = scratch.write(one.select("doc_id", "s.n", "s.fp", "s.tag"), "ids")
    least = F.min(F.struct("doc_id", "tag"))
    classes = by_id.where("n > 0").groupBy("fp").agg(least.alias("s"), F.count("*").alias("m"))
    classes = scratch.write(classes.select("fp", "s.*", "m").withColumnRenamed("doc_id", "class_id"), "classes")
    chosen = classes.select(F.col("class_id").alias("doc_id"), "tag")
    reps = sk.join(chosen, ["doc_id", "tag"]).dropDuplicates(["doc_id"])
    reps = scratch.write(reps.select("doc_id", "tag", "n", "sketch"), "reps")

    size = F.size("sketch")
    least = F.when(size >= SKETCH, need(percent)).otherwise(F.greatest(F.lit(1), F.floor(size / 2)))
    values = reps.select("doc_id", "n", (size - least + 1).alias("room"), size.alias("size"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    own = [F.first(c).alias(c) for c in ("n", "room", "size")]
    listed = values.join(shared, "v").groupBy("doc_id").agg(*own, F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    room = F.col("room") - (F.col("size") - F.size("vs"))
    # How typical a text is of the lists it is in: the best pivots are those whose values most others share.
    typical = F.aggregate("vs", F.lit(0.0), lambda t, x: t + F.log(x["df"]))
    rarest = F.transform(F.slice("vs", 1, room), lambda x: x["v"])
    picked = listed.where(room > 0).select("doc_id", "n", typical.alias("typical"), rarest.alias("vs"))
    few = scratch.write(picked.join(reps.select("doc_id", "tag", "sketch"), "doc_id"), "few")
    lists = few.select("doc_id", "n", "typical", F.explode("vs").alias("v"))
    packed = packed_texts(_tagged(docs), ["doc_id", "tag"])
    texts = packed.join(few.select("doc_id", "tag"), ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id"])
    texts = scratch.write(texts.select("doc_id", "z"), "texts")

    def filtered(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the threshold and whose sketches put it within five deviations."""
        side = lambda x: few.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        p = pairs.join(side("b"), "b").join(side("a"), "a")
        sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        return p.where(sizes & (_estimate("sa", "sb") >= percent / 100 - 0.33)).select("a", "b")

    pivots = lists.groupBy("v").agg(F.max(F.struct("typical", (-F.col("doc_id")).alias("id"))).alias("top")).select("v", (-F.col("top.id")).alias("a"))
    stars = lists.join(pivots, "v").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    links = scratch.write(_pairs_at_threshold(filtered(stars), texts, width, percent), "links-1")
    roots = scratch.write(components(links, scratch, "cc1"), "roots-1")

    # Lists whose members are still apart: those outside the largest component meet every member.
    rooted = lists.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "doc_id"))
    parts = rooted.groupBy("v", "root").agg(F.count("*").alias("m")).groupBy("v")
    parts = parts.agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("k"), F.sum("m").alias("long"))
    parts = parts.where("k > 1").select("v", F.col("top.root").alias("top"), "long")
    apart = scratch.write(rooted.join(scratch.write(parts, "parts"), "v"), "apart")
    # In long lists, what a text shares with any other there bounds its similarity with each.
    crowd = apart.where(F.col("long") > CROWD).select("doc_id").distinct()
    held = texts.join(crowd, "doc_id", "left_semi").mapInArrow(partial(_shingles, width=width), "doc_id long, h long")
    held = scratch.write(held, "held")
    twice = held.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").select("h")
    slot = F.pmod("h", F.lit(SLOTS))
    slots = F.array(*(F.count_if(slot == k).cast("int") for k in range(SLOTS))).alias("slots")
    common = held.join(twice, "h").groupBy("doc_id").agg(F.count("*").alias("common"), slots)
    crowded = F.col("long") > CROWD
    apart = apart.join(few.select("doc_id", "sketch", "vs").join(common, "doc_id", "left"), "doc_id")
    apart = apart.withColumn("c", F.when(crowded, F.coalesce("common", F.lit(0))).otherwise(F.col("n")))
    apart = apart.withColumn("slots", F.when(crowded, F.col("slots"))).where(100 * F.col("c") >= percent * F.col("n"))
    apart = scratch.write(apart.select("v", "doc_id", "root", "top", "n", "c", "slots", "vs", "sketch"), "bounded")
    short = {"doc_id": "", "root": "r", "n": "n", "c": "c", "slots": "l", "vs": "v", "sketch": "s"}
    named = lambda side: [F.col(c).alias(f"{k}{side}") for c, k in short.items()]
    x = apart.where("root <> top").select("v", *named("x"))
    y = apart.select("v", (F.col("root") != F.col("top")).alias("too"), *named("y"))
    most = F.least("cx", "cy", "nx", "ny")
    close = (F.col("rx") != F.col("ry")) & (~F.col("too") | (F.col("x") < F.col("y")))
    close = close & (100 * most >= percent * (F.col("nx") + F.col("ny") - most))
    # No pair shares more than the lesser count of shared shingles in each slot of the hashes.
    shared = F.aggregate(F.zip_with("lx", "ly", lambda p, q: F.least(p, q)), F.lit(0), lambda t, m: t + m)
    enough = 100 * shared >= percent * (F.col("nx") + F.col("ny") - shared)
    close = close & F.when(F.col("lx").isNotNull() & F.col("ly").isNotNull(), enough).otherwise(True)
    # A pair is made in the first list that both are in, and in no other.
    close = close & (F.array_intersect("vx", "vy")[0] == x["v"]) & (_estimate("sx", "sy") >= percent / 100 - 0.33)
    rest = x.join(y, (x["v"] == y["v"]) & close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    rest = rest.distinct()
    more = scratch.write(_pairs_at_threshold(rest, texts, width, percent), "links-2")
    roots = components(links.union(more), scratch, "cc2")

    rooted = classes.join(roots.withColumnRenamed("id", "class_id"), "class_id", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "class_id"))
    out = _with_class(by_id.select("doc_id", "n", "fp"), rooted, by_id.count())
    component, own = F.coalesce("root", "doc_id"), F.coalesce("class_id", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), own.alias("class_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    alone = {"doc_id": F.col("doc_id"), "n_shingles": F.col("n"), "component_id": F.col("doc_id"), "class_id": F.col("doc_id"), "kept": F.lit(True)}
    nameless = sk.where("doc_id is null").select(*(c.alias(k) for k, c in alone.items()))
    scratch.drop("few", "texts", "apart", "bounded", "held", "parts", "reps", "links-1", "links-2", "roots-1")
    return out.union(nameless.select(out.columns))
