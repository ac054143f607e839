"""A persisted lexical index, so that a search reads the postings of its terms and no text.

Postings (term, key, tf, n) lie in shards of documents, each sorted by term: a search reads, of each
shard, the row groups that may hold its terms, and all postings of one document are in one shard, so its score is
nearly summed before anything is shuffled. No shard depends on how frequent a term is. Beside them
lie the terms (term, df, idf) and the three numbers that concern the whole corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.text import tokens
from skarn.operators.index import B, EPSILON, K1, bags, dealt, postings
from skarn.sources.files import built_once

#: Terms of a search that go to every task; a search with more joins by shuffle.
BROADCAST_TERMS = 1 << 20
#: Terms that are worth a filter of row groups.
_FILTERED = 64


@dataclass(frozen=True)
class Lexical:
    """An index that was built: where it lies and what it says of the whole corpus."""

    spark: SparkSession
    root: str
    key: str
    total: int
    average: float
    mean_idf: float

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/postings")

    def terms(self) -> DataFrame:
        """(term, df, idf): a negative idf is replaced by a quarter of the mean over all terms, negatives included."""
        raw = self.spark.read.parquet(f"{self.root}/terms")
        return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * self.mean_idf)).otherwise(F.col("raw")).alias("idf"))

    def asked(self, queries: DataFrame, normalize: bool = False) -> DataFrame:
        """(query_id, term, qtf) of queries (query_id, text)."""
        terms = queries.select("query_id", F.explode(tokens(F.col("text"), normalize)).alias("term"))
        return terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))

    def scores(self, asked: DataFrame) -> DataFrame:
        """(query_id, key, score) of every document that shares a term with a query; asked: query_id, term, qtf."""
        known = asked.select("term").distinct().limit(BROADCAST_TERMS + 1)
        count = known.count()
        postings, terms = self.postings(), self.terms()
        if count <= _FILTERED:  # so few that files and row groups without them can be left out
            few = [r[0] for r in known.collect()]
            postings, terms = postings.where(F.col("term").isin(few)), terms.where(F.col("term").isin(few))
        weights = asked.join(terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
        hits = postings.join(F.broadcast(weights) if count <= BROADCAST_TERMS else weights, "term")
        tf = F.col("tf")
        part = F.col("weight") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.lit(self.average)))
        return hits.groupBy("query_id", self.key).agg(F.sum(part).alias("score"))


def build(bag: DataFrame, root: str, key: str) -> Lexical:
    """Writes the index of bag (key, tokens) below root, a shard for each of its partitions."""
    spark = bag.sparkSession
    postings(bag, key).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{root}/postings")
    held = spark.read.parquet(f"{root}/postings")
    # A document's shares tf / n add up to one.
    total, length = held.agg(F.round(F.sum(F.col("tf") / F.col("n"))).cast("long"), F.sum("tf")).first()
    total = total or 0
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(float(total)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    # Written before they are sorted: the bounds of the ranges are one more pass over what is sorted.
    raw.write.mode("overwrite").parquet(f"{root}/counts")
    spark.read.parquet(f"{root}/counts").repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{root}/terms")
    mean = spark.read.parquet(f"{root}/terms").agg(F.avg("raw")).first()[0]
    return Lexical(spark, root, key, total, (length or 0) / max(total, 1), mean or 0.0)


def index_of(spark: SparkSession, path: str, key: str) -> Lexical:
    """The index over the texts of a Parquet table, built once a session and again when the table's files change."""
    return built_once(spark, path, f"lexical {key}", lambda root: build(bags(dealt(spark.read.parquet(path).select(key, "text"), key, path), key), root, key))
