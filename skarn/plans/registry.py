"""The registered queries: what each computes in Spark, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under a name, with its oracle."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


#: Tables of whole texts, and how much of them goes to Python at once, whatever the length of a text.
TEXTS, BATCH_BYTES = {"documents", "pages"}, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TEXTS:
        held = spark.conf.get(key := "spark.sql.execution.arrow.maxBytesPerBatch")
        if not held.isdigit() or int(held) > BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
