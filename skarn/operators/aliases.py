"""Names of documents found in texts: every place of every name, of places within one another the longest, and whom it means.

Names are dealt to shards of bounded size. A shard's names make one automaton with failure links, so a text is read once a
shard, however many names that has. Which places lie within others is decided over all shards by a running maximum.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names of one automaton, on average; about 100 bytes each for each letter that they do not share.
SHARD = 1 << 17
#: A name is a whole one if neither neighbour is one of these.
_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_built: dict[str, ahocorasick.Automaton] = {}


def aliases(documents: DataFrame, name: str = "name", doc: str = "doc_id") -> DataFrame:
    """(alias, doc) of documents: lower-cased names, with and without what follows the last dot; doc is null where several share one. Blank names are none."""
    whole = F.lower(F.trim(F.col(name)))
    both = documents.select(F.explode(F.array_distinct(F.array(whole, F.regexp_replace(whole, r"(?<=.)\.[^.]*$", "")))).alias("alias"), F.col(doc).alias("doc"))
    ids = both.where("alias <> ''").groupBy("alias").agg(F.min("doc").alias("doc"), F.max("doc").alias("most"))
    return ids.select("alias", F.when(F.col("doc") == F.col("most"), F.col("doc")).alias("doc"))


def _automaton(number: str, held) -> ahocorasick.Automaton:
    """The automaton of a broadcast list of names; a worker keeps the last one for its next task."""
    if number not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for alias in held.value:
            made.add_word(alias, len(alias))
        made.make_automaton()
        _built[number] = made
    return _built[number]


def _places(batches: Iterator[pa.RecordBatch], number: str, held) -> Iterator[pa.RecordBatch]:
    """(keys, start, stop, alias) of whole names; of those that end at one place, the longest alone, since it encloses the others."""
    made = _automaton(number, held)
    for b in batches:
        row, start, stop, alias = [], [], [], []
        for n, text in enumerate(b.column("_text").to_pylist()):
            last = -1
            for end, size in made.iter(text) if len(made) else ():
                at = end + 1 - size
                if end == last or at and text[at - 1] in _INNER or end + 1 < len(text) and text[end + 1] in _INNER:
                    continue
                last = end
                row.append(n), start.append(at), stop.append(end + 1), alias.append(text[at : end + 1])
        keys = b.drop_columns(["_text"]).take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(alias, pa.string())], [*keys.schema.names, "start", "stop", "alias"])


def mentions(texts: DataFrame, names: DataFrame, keys: list[str], text: str = "text", shard: int = SHARD) -> DataFrame:
    """(keys, start, stop, alias, doc): the names that texts (keys, text) hold, by code points of the lower-cased text, from 0.

    names: alias, doc, as `aliases` gives them. A place within another one's place gives way, even to a name that several documents
    share; those places are left out themselves. Overlapping places stay. The keys tell texts apart; null and empty texts hold nothing.
    """
    spark = texts.sparkSession
    names = names.where("alias <> ''")
    parts = -(-names.count() // shard)
    lowered = texts.select(*keys, F.lower(text).alias("_text")).where("_text <> ''")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema) + ", start int, stop int, alias string"
    found = None
    for part in range(max(parts, 1)):
        few = names.where(F.pmod(F.xxhash64("alias"), F.lit(max(parts, 1))) == part).select("alias")
        held = spark.sparkContext.broadcast([r[0] for r in few.toLocalIterator()])
        places = lowered.mapInArrow(partial(_places, number=uuid.uuid4().hex, held=held), schema)
        found = places if found is None else found.unionByName(places)
    earlier = W.partitionBy(*keys).orderBy("start", F.desc("stop")).rowsBetween(W.unboundedPreceding, -1)
    longest = found.withColumn("_far", F.max("stop").over(earlier)).where("_far is null or _far < stop").drop("_far")
    return longest.join(names.where("doc is not null"), "alias").select(*keys, "start", "stop", "alias", "doc")


def may_name(question: str, name: Column) -> Column:
    """Whether a question may hold a name, with or without its ending: what is left is at most what a question has room for."""
    q, low = F.lit(question.lower()), F.lower(F.trim(name))
    return F.contains(q, low) | F.contains(q, F.regexp_replace(low, r"(?<=.)\.[^.]*$", ""))
