"""A corpus pipeline of five stages: toxicity, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import Scratch, spare
from skarn.llm.decontaminate import decontaminated
from skarn.llm.neardup import near_duplicates
from skarn.llm.packing import best_fit_packing
from skarn.llm.queries import tokenizer_path
from skarn.llm.substring_dedup import substring_dedup
from skarn.llm.toxicity import scored, train

#: SQL can express neither the classifier nor the sketches; tests hold stages and operators against plain versions.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not call toxic; null and empty texts are judged as texts
    without features, and rows that repeat share one judgement of their text."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = {c: f"own {c}" for c in ("score", "predicted")}  # columns of these names stay as they came
    kept = scored(docs.withColumnsRenamed(own), model).where("predicted = 0")
    return kept.select([F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of 5-word shingles.

    Rows that repeat an id count as that id's document; of rows with one and the same text with a word (they share an
    id, or have none) one stays, so that the next stage does not take them for passages of each other.
    """
    scratch = Scratch(spark, "copies")
    gone = scratch.write(near_duplicates(docs, percent=80).where("not kept").select("doc_id"), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    tag = spare(docs, "tag")
    short = docs.select("doc_id", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.md5("text")).alias(tag))
    again = short.join(gone, "doc_id", "left_anti").where(F.col(f"`{tag}`").isNotNull()).groupBy(tag).agg(F.count("*").alias("n"))
    again = scratch.write(again.where("n > 1").select(tag), "texts")
    if again.isEmpty():  # neither ids nor texts repeat
        return kept
    kept = kept.withColumn(tag, F.md5("text"))
    once = kept.join(again, tag, "left_semi").dropDuplicates([tag])
    return kept.join(again, tag, "left_anti").select(docs.columns).union(once.select(docs.columns))


def repeated_passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the characters that strings of 200 bytes found elsewhere too cover in full.

    As operator 2 has it, no first copy of such a string stays: a passage that several documents hold leaves them all.
    A null text stays null, with the n_chars that it came with.
    """
    mark = spare(docs, "has text")
    kept, whole = substring_dedup(docs.withColumn(mark, F.col("text").isNotNull())), F.col(f"row.`{mark}`")
    text = F.when(whole, F.col("kept_text"))
    length = F.when(whole, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    changed = {"text": text, "n_chars": length}
    return kept.select([(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within a fifth of its length in edits; null and empty texts hold none."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and the sequence that each goes to; null and empty texts are one token, repeats packed each."""
    return best_fit_packing(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_duplicates_out),
    ("suffix_array_dedup", repeated_passages_out),
    ("benchmark_decontamination", benchmark_leaks_out),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
