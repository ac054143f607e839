"""WARC fixity audit: Merkle trees over records and ordered offset ranges, compared between replicas.

Each page becomes one WARC response record. Records are ordered within archive files (by
page id, url, html) and a record's range starts where the one before ends. A leaf is the SHA-256
of the record with its range; every FAN neighbours on a level hash to one node of the next, up to one root a
file. Two replicas compare roots; only children of unequal nodes are compared further, down to the
leaves that differ. Nodes of sound subtrees are never looked at below their roots.

Leaves that differ are then aligned by what they hold, within their file: records with one page id and digest are the same
record, `moved` if its range is another one; of the others, those with one page id are a `corrupt` record and what it was;
the rest is in one replica only, `missing` or `extra`. So a record lost in the middle of a file is the one that is
missing, and sound records behind it have moved.

Files take FILE consecutive page ids; records without an id are dealt by their content to as many files as they fill.

Defined results: null urls and htmls count as empty; repeated rows are records of their own; replicas are cut into files
alike if `nameless` is given to both; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skarn.llm.common import Scratch

FILE, FAN = 4096, 16


def records(pages: DataFrame, nameless: int | None = None) -> DataFrame:
    """(file, page_id, record): one WARC record of each page, as bytes. nameless: files for records without an id."""
    if nameless is None:
        nameless = max(1, -(-pages.where("page_id is null").count() // FILE))
    url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "html"))
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), html)
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    file = F.coalesce(F.floor(F.col("page_id") / FILE), -1 - F.pmod(F.xxhash64(url, html), F.lit(nameless)))
    return pages.select(file.cast("long").alias("file"), F.col("page_id").cast("long").alias("page_id"), F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def leaves(archive: DataFrame) -> DataFrame:
    """(file, seq, page_id, start, length, digest, hash): ordered ranges; only digests and lengths are sorted, not the records."""
    short = archive.select("file", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    order = W.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    seq = F.row_number().over(order) - 1
    start = F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = short.withColumn("seq", seq.cast("long")).withColumn("start", start)
    return out.withColumn("hash", F.sha2(F.concat_ws("|", "start", "length", "digest"), 256))


def tree(leaf: DataFrame, height: int, scratch: Scratch) -> list[DataFrame]:
    """Levels of (side, file, node, hash) from the leaves up, for both replicas at once; the last has one node a file."""
    levels = [leaf.select("side", "file", F.col("seq").alias("node"), "hash")]
    for k in range(1, height + 1):
        below = levels[-1].withColumn("child", F.col("node") % FAN).withColumn("node", F.floor(F.col("node") / FAN))
        hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child", "hash"))), lambda x: x["hash"]), "")
        levels.append(scratch.write(below.groupBy("side", "file", "node").agg(F.sha2(hashes, 256).alias("hash")), f"level-{k}"))
    return levels


def unequal(level: DataFrame) -> DataFrame:
    """(file, node) of nodes that the replicas do not share."""
    return level.groupBy("file", "node").agg(F.count("*").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("n < 2 or lo <> hi").select("file", "node")


def audit(replica_a: DataFrame, replica_b: DataFrame) -> DataFrame:
    """Per record range of replica a or b: file, seq, page_id, start, length, digest, status (sound, corrupt, moved, missing, extra), root_equal.

    A row shows the range in replica a, but for extra records.
    """
    scratch = Scratch(replica_a.sparkSession, "fixity")
    leaf = scratch.write(leaves(replica_a).withColumn("side", F.lit(0)).union(leaves(replica_b).withColumn("side", F.lit(1))), "leaves")
    last, height = leaf.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0], 1
    while FAN**height <= last:
        height += 1
    levels = tree(leaf, height, scratch)
    suspects = unequal(levels[-1])
    bad_files = suspects.select("file").distinct().withColumn("bad", F.lit(True))
    for level in levels[-2::-1]:
        # Children of unequal nodes only.
        up = suspects.withColumnRenamed("node", "up")
        suspects = unequal(level.withColumn("up", F.floor(F.col("node") / FAN)).join(up, ["file", "up"], "left_semi"))
    suspects = suspects.withColumnRenamed("node", "seq")
    range_of = ["seq", "page_id", "start", "length", "digest"]
    sound = leaf.where("side = 0").join(suspects, ["file", "seq"], "left_anti").select("file", *range_of, F.lit("sound").alias("status"))
    odd = aligned(scratch.write(leaf.join(suspects, ["file", "seq"], "left_semi").select("side", "file", *range_of), "odd"))
    both = sound.unionByName(odd).join(bad_files, "file", "left")
    return both.select("file", *range_of, "status", F.col("bad").isNull().alias("root_equal"))


def aligned(odd: DataFrame) -> DataFrame:
    """(file, seq, page_id, start, length, digest, status) of leaves (side, file, seq, ...) that have no equal at their place."""
    record = F.struct("seq", "page_id", "start", "length", "digest")

    def matched(rows: DataFrame, *by: str) -> DataFrame:
        """The n-th of either side with the same file, page id and `by` in one row."""
        nth = F.row_number().over(W.partitionBy("side", "file", "page_id", *by).orderBy("seq"))
        at = lambda side: F.max(F.when(F.col("side") == side, record)).alias(f"r{side}")
        return rows.withColumn("nth", nth).groupBy("file", "page_id", *by, "nth").agg(at(0), at(1))

    same = matched(odd, "digest").drop("page_id", "digest", "nth")
    moved = same.where("r0 is not null and r1 is not null").withColumn("status", F.lit("moved"))
    left = [same.where(f"r{1 - k} is null").select(F.lit(k).alias("side"), "file", f"r{k}.*") for k in (0, 1)]
    other = matched(left[0].union(left[1])).drop("page_id", "nth")
    other = other.withColumn("status", F.when(F.col("r1").isNull(), "missing").when(F.col("r0").isNull(), "extra").otherwise("corrupt"))
    return moved.unionByName(other).select("file", F.coalesce("r0", "r1").alias("r"), "status").select("file", "r.*", "status")


def aged(archive: DataFrame, modulus: int = 97) -> DataFrame:
    """A replica in which a byte of every record whose page id is 5 modulo `modulus` has rotted: for drills and tests."""
    rotten = F.coalesce(F.pmod("page_id", F.lit(modulus)) == 5, F.lit(False))
    damaged = F.concat(F.expr("substring(record, 1, octet_length(record) - 5)"), F.lit(b"\x00"), F.expr("substring(record, octet_length(record) - 3)"))
    return archive.withColumn("record", F.when(rotten, damaged).otherwise(F.col("record")))
