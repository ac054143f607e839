"""Texts of a bounded sample of rows, for fits on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.llm.common import text_bytes


def _local(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Rows as a local table; from a list of tuples, Spark would make an RDD, for which each executor starts Python workers of their own."""
    table = pa.table({f.name: pa.array([r[i] for r in rows]) for i, f in enumerate(schema)})
    return spark.createDataFrame(table).select([F.col(f.name).cast(f.dataType) for f in schema])


def sample_texts(docs: DataFrame, kind: T.StructField, chosen: list[tuple], keys: list[str], budget: int) -> list[tuple]:
    """(doc_id, kind, text) for the chosen (doc_id, kind), as many of each kind in their order as `budget` bytes hold.

    docs joins the choice on keys (doc_id, and the kind where docs has it). An id with several texts gives the one
    with the greatest hash, whatever the order of rows; a text larger than what is left of the budget is passed over.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", T.LongType()), kind])
    rows = docs.select(*keys, text_bytes().alias("text")).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumn("tag", F.xxhash64("text"))
    found = rows.join(F.broadcast(_local(spark, chosen, schema)), keys)
    sizes = found.groupBy("doc_id", kind.name).agg(F.max(F.struct("tag", F.octet_length("text").alias("size"))).alias("t"))
    sizes = {(r[0], r[1]): tuple(r["t"]) for r in sizes.collect()}
    left, taken = dict.fromkeys({k for _, k in chosen}, budget), []
    for key in chosen:
        tag, size = sizes.get(tuple(key), (None, None))
        if tag is not None and size <= left[key[1]]:
            left[key[1]] -= size
            taken.append((*key, tag))
    if not taken:
        return []
    wanted = _local(spark, taken, T.StructType([*schema.fields, T.StructField("tag", T.LongType())]))
    texts = rows.join(F.broadcast(wanted), [*keys, "tag"]).dropDuplicates(["doc_id", kind.name])
    return sorted((r[0], r[1], bytes(r[2])) for r in texts.select("doc_id", kind.name, "text").collect())
