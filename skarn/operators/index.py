"""The chunk store: postings and corpus statistics, insert-if-absent, deletes and library status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skarn.functions.text import counted, tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Bytes of a table's files whose rows one task takes.
SHARD = 4 << 20


def bags(chunks: DataFrame, key: str = "chunk_id", normalize: bool = False) -> DataFrame:
    """(key, tokens) of chunks that have tokens. A chunk's tokens stay in its row, so counting within a chunk needs no shuffle."""
    # A filter would go below the tokens and take them apart a second time.
    some = F.filter(F.array(tokens(F.col("text"), normalize)), lambda t: F.size(t) > 0)
    return chunks.select(key, F.explode(some).alias("tokens"))


def postings(bag: DataFrame, key: str) -> DataFrame:
    """(key, n, term, tf) of bag (key, tokens), counted within the row of each."""
    return bag.select(key, F.size("tokens").alias("n"), F.explode(counted(F.col("tokens"))).alias("t")).select(key, "n", "t.term", "t.tf")


def dealt(rows: DataFrame, key: str, path: str) -> DataFrame:
    """Rows of the Parquet table at path dealt by key into shards of about SHARD bytes of its files, so that no task grows with the table."""
    spark = rows.sparkSession
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = files.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(files).getLength()
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-size // SHARD)), key)


def insert_absent(store: DataFrame, new: DataFrame, key: str = "chunk_id", order: str = "seq") -> DataFrame:
    """Rows of new that the store lacks; of rows with one key the last by order."""
    last = new.withColumn("_at", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_at = 1").drop("_at")
    return last.join(store.select(key).distinct(), key, "left_anti")


def delete_documents(store: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The store without all rows of the documents in ids."""
    return store.join(ids.select(key).distinct(), key, "left_anti")


def library_status(indexed: DataFrame, originals: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, chunks, expected, complete, status) over indexed counts, stored originals and manifests.

    manifest: doc_id, expected, complete, readable (false: status error) of this index only.
    """
    both = indexed.join(originals, "doc_id", "full").join(manifest, "doc_id", "left")
    n = F.coalesce("chunks", F.lit(0))
    status = (
        F.when(F.col("readable") == False, "status error")  # noqa: E712
        .when(F.col("expected").isNull(), F.when(n > 0, "unverified").otherwise("not vectorised"))
        .when(F.col("complete") & (F.col("expected") == n), "vectorised")
        .when(n > 0, "partial")
        .otherwise("not vectorised")
    )
    return both.select("doc_id", n.alias("chunks"), "expected", "complete", status.alias("status"))


def corpus_fingerprint(hashes: DataFrame) -> DataFrame:
    """(low, middle, high, n) of a table of hex SHA-256 hashes (h), whatever their order.

    Two bitwise sums of 60 bits and one plain sum of 32, which also tells how often a hash occurs: each task keeps four numbers.
    """
    digits = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("long")
    hexed = lambda c: F.hex(F.bit_xor(c))
    high = F.sum(digits(31, 8).cast("decimal(38,0)")).cast("string")
    return hashes.agg(hexed(digits(1, 15)).alias("low"), hexed(digits(16, 15)).alias("middle"), high.alias("high"), F.count("*").alias("n"))


def combined(a: dict, b: dict, sign: int = 1) -> dict:
    """The fingerprint of a's hashes and b's together, or of a's without b's, which a has: bitwise sums undo themselves."""
    a, b = ({"low": r["low"] or "0", "middle": r["middle"] or "0", "high": r["high"] or "0", "n": r["n"]} for r in (a, b))
    bits = {c: f"{int(a[c], 16) ^ int(b[c], 16):X}" for c in ("low", "middle")}
    return bits | {"high": str(int(a["high"]) + sign * int(b["high"])), "n": a["n"] + sign * b["n"]}


def load_audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(doc_id, expected, actual, ok): counts after a load against what was to be loaded."""
    a = actual.groupBy("doc_id").agg(F.count("*").alias("actual"))
    both = expected.join(a, "doc_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.withColumn("ok", F.col("expected") == F.col("actual"))
