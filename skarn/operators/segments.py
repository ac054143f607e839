"""A lexical index that grows by segments: a load writes the postings of its own texts, a delete writes tombstones.

A segment is immutable: postings (key, n, term, tf, seq) sorted by term in shards of documents, and the terms (term, df) that
it adds. A tombstone segment holds (key, seq) and the terms that it takes away, as negative df. Seq counts the commits; a
tombstone is about the postings of earlier commits, so a key may go and come back. df, N and the length of the corpus
are sums over segments, and a posting counts unless a later tombstone names its key. MERGE segments of one size
class become one, without the dead rows; tombstones that no older segment needs go with them. So there are at most MERGE - 1
segments a class, and each posting is rewritten once a class.

The list of segments is a versioned table: a commit is the rename of its pointer, and what was written before a crash is
not listed. One writer at a time.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators import index
from skarn.operators.lexical import Lexical
from skarn.sources.files import built_once
from skarn.tables import Table

#: Segments of one size class (powers of MERGE in documents) that become one.
MERGE = 8
#: Dead keys that go to every task; more are joined by shuffle.
BROADCAST_KEYS = 1 << 20

_LIST = "segment string, kind string, documents long, length long, first long, seq long"


@dataclass(frozen=True)
class Live(Lexical):
    """The segments of one commit, searched as one index."""

    added: list[str] = field(default_factory=list)
    dead: list[str] = field(default_factory=list)
    keys: int = 0
    schema: str = ""
    keyed: str = ""

    def _read(self, folders: list[str], part: str, schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{s}/{part}" for s in folders))

    def postings(self) -> DataFrame:
        rows = self._read(self.added, "postings", self.schema)
        if not self.dead:
            return rows
        gone = self._read(self.dead, "keys", self.keyed).groupBy(F.col(self.key).alias("_key")).agg(F.max("seq").alias("_seq"))
        gone = F.broadcast(gone) if self.keys <= BROADCAST_KEYS else gone
        return rows.join(gone, (rows[self.key] == gone["_key"]) & (rows["seq"] < gone["_seq"]), "left_anti")

    def _df(self) -> DataFrame:
        return self._read(self.added + self.dead, "terms", "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def raw(self) -> DataFrame:
        return self._df().withColumn("raw", F.log(F.lit(float(self.total)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))

    @cached_property
    def _mean(self) -> float:
        return self.raw().agg(F.avg("raw")).first()[0] or 0.0

    def terms(self) -> DataFrame:
        idf = F.when(F.col("raw") < 0, F.lit(0.25 * self._mean)).otherwise(F.col("raw"))
        return self.raw().select("term", "df", idf.alias("idf"))


class Segments:
    """The list of segments below root. `stamp` is whatever its owner last said that the index stands for."""

    def __init__(self, spark: SparkSession, root: str, key: str, type_: str = "string"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self._postings = f"{key} {type_}, n int, term string, tf long, seq long"
        self._keys = f"{key} {type_}, seq long"
        self.table = Table(spark, f"{self.root}/list", _LIST)
        self._held: tuple[int, Live | None] = (-1, None)

    def _rows(self) -> list[dict]:
        return [r.asDict() for r in self.table.read().collect()]

    def stamp(self) -> str | None:
        return next((r["segment"] for r in self._rows() if r["kind"] == "stamp"), None)

    def _commit(self, rows: list[dict], stamp: str) -> None:
        """The new list; at most a few times MERGE rows."""
        seq = max((r["seq"] for r in rows), default=0)
        rows = [r for r in rows if r["kind"] != "stamp"] + [{"segment": stamp, "kind": "stamp", "documents": 0, "length": 0, "first": 0, "seq": seq}]
        self.table.rewrite(self.spark.createDataFrame(rows, _LIST).coalesce(1))

    def live(self) -> Live:
        """What a search reads. Opened once a commit, since the mean idf is one pass over the terms."""
        version = self.table.version
        if self._held[0] != version:
            rows = self._rows()
            of = lambda kind: [f"{self.root}/{r['segment']}" for r in rows if r["kind"] == kind]
            total, length = (sum(r[c] for r in rows) for c in ("documents", "length"))
            keys = -sum(r["documents"] for r in rows if r["kind"] == "deleted")
            self._held = version, Live(self.spark, self.root, self.key, total, length / max(total, 1), 0.0, of("added"), of("deleted"), keys, self._postings, self._keys)
        return self._held[1]

    # --- commits -------------------------------------------------------------------------------

    def _counted(self, bag: DataFrame) -> DataFrame:
        return index.postings(bag, self.key)

    def _save(self, rows: DataFrame, path: str) -> None:
        rows.sortWithinPartitions("term").write.mode("overwrite").parquet(path)

    def _write(self, postings: DataFrame, seq: int, sign: int = 1) -> dict:
        """One segment of postings (key, n, term, tf); of a tombstone segment only keys and terms stay."""
        name = f"seg-{uuid.uuid4().hex}"
        folder = f"{self.root}/{name}"
        self._save(postings.withColumn("seq", F.lit(seq).cast("long")).select(self.key, "n", "term", "tf", "seq"), f"{folder}/postings")
        held = self.spark.read.schema(self._postings).parquet(f"{folder}/postings")
        facts = held.agg(F.round(F.sum(F.col("tf") / F.col("n"))).cast("long"), F.sum("tf")).first()  # a document's shares tf / n add up to one
        self._save(held.groupBy("term").agg((sign * F.count("*")).alias("df")), f"{folder}/terms")
        if sign < 0:
            held.select(self.key, "seq").distinct().write.parquet(f"{folder}/keys")
        kind = "added" if sign > 0 else "deleted"
        return {"segment": name, "kind": kind, "documents": sign * (facts[0] or 0), "length": sign * (facts[1] or 0), "first": seq, "seq": seq}

    def _append(self, postings: DataFrame, stamp: str, sign: int) -> None:
        rows = self._rows()
        new = self._write(postings, max((r["seq"] for r in rows), default=0) + 1, sign)
        if new["documents"]:
            rows.append(new)
        self._commit(rows, stamp)
        self.merge(stamp)

    def add(self, bag: DataFrame, stamp: str = "") -> None:
        """Postings of bag (key, tokens), whose keys are not in the index. Reads nothing but the bag."""
        self._append(self._counted(bag), stamp, 1)

    def delete(self, bag: DataFrame, stamp: str = "") -> None:
        """Tombstones for bag (key, tokens), rows that are in the index with these tokens. Reads nothing but the bag."""
        self._append(self._counted(bag), stamp, -1)

    def sync(self, bag: DataFrame, stamp: str = "") -> None:
        """Makes the index that of bag, whatever it held: adds keys that it lacks, buries those that bag has not. For a store that was changed from outside or a load that stopped half-way."""
        held = self.live().postings()
        known = held.select(self.key).distinct()
        gone = held.join(bag.select(self.key), self.key, "left_anti").select(self.key, "n", "term", "tf")
        new = bag.join(known, self.key, "left_anti")
        self._append(gone, "", -1)
        self._append(self._counted(new), stamp, 1)

    # --- merges --------------------------------------------------------------------------------

    def merge(self, stamp: str | None = None) -> None:
        """Merges while a size class is full; all at once where most documents are dead or tombstones pile up."""
        stamp = self.stamp() or "" if stamp is None else stamp
        while chosen := self._due(rows := self._rows()):
            names = {r["segment"] for r in chosen}
            rest = [r for r in rows if r["kind"] == "added" and r["segment"] not in names]
            # A tombstone goes when each segment that is older than it is merged now.
            done = [r for r in rows if r["kind"] == "deleted" and all(s["first"] > r["seq"] for s in rest)]
            live = self.live()
            part = Live(self.spark, self.root, self.key, 0, 0, 0, [f"{self.root}/{s}" for s in sorted(names)], live.dead, live.keys, self._postings, self._keys)
            name = f"seg-{uuid.uuid4().hex}"
            self._save(part.postings().repartition(self.key), f"{self.root}/{name}/postings")
            held = [f"{self.root}/{r['segment']}" for r in chosen + done]
            terms = live._read(held, "terms", "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
            self._save(terms.where("df <> 0"), f"{self.root}/{name}/terms")
            total = {c: sum(r[c] for r in chosen + done) for c in ("documents", "length")}
            new = {"segment": name, "kind": "added", "first": min(r["first"] for r in chosen), "seq": max(r["seq"] for r in rows), **total}
            gone = names | {r["segment"] for r in done}
            self._commit([r for r in rows if r["segment"] not in gone] + [new] * (new["documents"] > 0), stamp)
            self._sweep()

    def _due(self, rows: list[dict]) -> list[dict]:
        added = [r for r in rows if r["kind"] == "added"]
        dead = [r for r in rows if r["kind"] == "deleted"]
        if added and (len(dead) >= MERGE or -2 * sum(r["documents"] for r in dead) > sum(r["documents"] for r in added)):
            return added
        classes: dict[int, list[dict]] = {}
        for r in added:
            classes.setdefault(int(math.log(max(r["documents"], 1), MERGE) + 1e-9), []).append(r)
        return next((c for c in classes.values() if len(c) >= MERGE), [])

    def _sweep(self) -> None:
        """Drops folders that neither this list nor the ones kept for readers name."""
        path, fs = self.table._path, self.table._fs
        named = {r["segment"] for r in self._rows()} | self.table.earlier("segment")
        for f in fs.globStatus(path(f"{self.root}/seg-*")) or []:
            if f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)


def grown(spark: SparkSession, path: str, key: str, type_: str) -> Segments:
    """The index of a Parquet table, put together by loads, deletes and loads again; once a session and file state."""

    def make(root: str) -> Segments:
        third = F.pmod(F.xxhash64(key), F.lit(3))
        made, bag = Segments(spark, root, key, type_), index.bags(index.dealt(spark.read.parquet(path).select(key, "text"), key, path), key)
        for part in range(3):
            made.add(bag.where(third == part))
        made.delete(bag.where(third == 1))
        made.add(bag.where(third == 1))
        return made

    return built_once(spark, path, f"segments {key}", make)
