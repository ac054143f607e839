"""Spark-native coverage that goes beyond the engine's own operators, on the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skarn.plans.registry import query, table

@query("ext_join_broadcast", "SELECT r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def ext_join_broadcast(spark, d):
    # nation and region have a fixed size of 25 and 5 rows.
    places = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("ext_join_large", "SELECT c_mktsegment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY c_mktsegment")
def ext_join_large(spark, d):
    o = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1995-01-01'").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"))


@query("ext_join_semi_anti", "SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without")
def ext_join_semi_anti(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    has = table(spark, d, "orders").groupBy("o_custkey").agg(F.lit(True).alias("has"))
    return c.join(has, F.col("c_custkey") == F.col("o_custkey"), "left").agg(F.count_if("has").alias("with_orders"), F.count_if(F.col("has").isNull()).alias("without"))


@query("ext_asof", "WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click') SELECT a.event_id, round(b.value, 6) AS last_click FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts")
def ext_asof(spark, d):
    """As-of join in one pass: the last click at or before each purchase, by a window over both."""
    e = table(spark, d, "events").where("event_type in ('purchase', 'click')")
    click = F.when(F.col("event_type") == "click", F.col("value"))
    w = W.partitionBy("user_id").orderBy("ts", F.col("event_type")).rowsBetween(W.unboundedPreceding, 0)
    return e.withColumn("last_click", F.round(F.last(click, ignorenulls=True).over(w), 6)).where("event_type = 'purchase'").select("event_id", "last_click")


@query("ext_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("ext_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("ext_rank_frames", "SELECT o_orderkey, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS dr, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS q, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)")
def ext_rank_frames(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    t = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(t).alias("q"), F.round(F.sum("o_totalprice").over(t.rowsBetween(-2, 0)), 2).alias("last3"), F.lag("o_orderkey").over(t).alias("before"))


@query("ext_setops", "SELECT k, 'both' AS side FROM (SELECT DISTINCT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25) UNION ALL SELECT k, 'unsold' FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem)")
def ext_setops(spark, d):
    sold, p = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, d, "part")
    both = sold.intersect(p.where("p_size > 25").select(F.col("p_partkey").alias("k"))).withColumn("side", F.lit("both"))
    return both.unionAll(p.select(F.col("p_partkey").alias("k")).subtract(sold).withColumn("side", F.lit("unsold")))


@query("ext_approx")
def ext_approx(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"), F.percentile_approx("l_extendedprice", [0.5, 0.95], 10000).alias("prices"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("parts"))
