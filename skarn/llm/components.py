"""Connected components over a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import Scratch, salted_join


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, root) for every id in links (a, b): root is the smallest id reachable.

    Large-star then small-star: every step keeps one link an id, so nothing grows with
    the square of a component; the number of rounds is logarithmic in a component's size.
    Nulls and self-links are ignored; an empty table gives an empty result.
    """
    at = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    k, changed, total = 0, True, 2 * at.count()
    while changed:
        k += 1
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        # The middle of a large star has most of its component's links: they are dealt over many tasks.
        large = salted_join(both, least, ["u"], total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = scratch.write(small.where("u <> v").distinct(), f"{name}-{k}")
        # Both tables hold each link once, so they are equal if no link is in one alone.
        side = at.withColumn("side", F.lit(1)).union(after.withColumn("side", F.lit(-1)))
        changed = not side.groupBy("u", "v").agg(F.sum("side").alias("side")).where("side <> 0").isEmpty()
        scratch.drop(f"{name}-{k - 1}")
        at = after
    roots = at.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(at.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()).groupBy("id").agg(F.min("root").alias("root"))
