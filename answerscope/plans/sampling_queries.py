"""Registered queries: samples, shards, splits, resume, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.operators import sampling as B
from answerscope.plans import views as V
from answerscope.plans.registry import query, r6


def _orders(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", "o_totalprice")


@query("subsample", """
SELECT id, o_totalprice FROM (
  SELECT o_orderkey AS id, o_totalprice, row_number() OVER (ORDER BY md5('7:' || o_orderkey)) AS rn, count(*) OVER () AS n FROM orders)
WHERE rn <= n - ceil((1.0::DOUBLE - 0.3::DOUBLE) * n)""")
def _subsample(spark, sf):
    return B.subsample(_orders(spark, sf), 0.3, 7).select("id", "o_totalprice")


@query("stratified_split", """
WITH c AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT *, ceil(sum(n) OVER () * 0.2::DOUBLE) AS test, sum(n) OVER () AS total FROM c),
f AS (SELECT s, floor(n * test / total) AS fl, n * test / total - floor(n * test / total) AS frac, test FROM t),
q AS (SELECT s, fl + CASE WHEN row_number() OVER (ORDER BY frac DESC, s) <= test - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM f),
r AS (SELECT o_orderkey AS id, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey)) AS rn FROM orders)
SELECT id, o_orderstatus, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN q ON r.o_orderstatus = q.s""")
def _split(spark, sf):
    return B.stratified_split(_orders(spark, sf), "o_orderstatus", 0.2, 42).select("id", "o_orderstatus", "split")


@query("row_index", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx FROM events")
def _index(spark, sf):
    return B.row_index(V.table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "row_idx")


@query("shard_assignment", """
SELECT o_orderkey AS id, CAST(least((row_number() OVER (ORDER BY o_orderkey) - 1) // (count(*) OVER () // 4), 3) AS INT) AS shard_id FROM orders""")
def _shards(spark, sf):
    return B.with_shard_id(_orders(spark, sf), 4, ["id"]).select("id", "shard_id")


@query("shard", """
SELECT id, o_totalprice FROM (SELECT o_orderkey AS id, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () // 7 AS size FROM orders)
WHERE i >= 6 * size""")
def _shard(spark, sf):
    """The last of seven shards, which takes the remainder."""
    return B.shard(_orders(spark, sf), 7, 6, ["id"]).select("id", "o_totalprice")


@query("resume", """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice, 2) ELSE round(o_totalprice * 2, 2) END AS value,
       CASE WHEN o_orderstatus = 'F' THEN 'reused' END AS origin FROM orders""")
def _resume(spark, sf):
    """Finished orders stand for finished records; the rest is processed now."""
    o = _orders(spark, sf)
    done = o.filter("o_orderstatus = 'F'").select("id", F.round("o_totalprice", 2).alias("value"), F.lit("reused").alias("origin"))
    return B.resume_union(o, done, lambda work: work.select("id", F.round(F.col("o_totalprice") * 2, 2).alias("value")))


@query("resume_work", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _work(spark, sf):
    o = _orders(spark, sf)
    return B.resume(o, o.filter("o_orderstatus = 'F'"))[0].select("id")


@query("dedup_first", """
SELECT o_custkey, id, o_totalprice FROM (SELECT o_custkey, o_orderkey AS id, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders)
WHERE rn = 1""")
def _dedup(spark, sf):
    return B.dedup_first(_orders(spark, sf).select("o_custkey", "id", "o_totalprice"), "o_custkey", ["o_totalprice", "id"])


@query("max_key_count", "SELECT max(n) AS max_count FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def _max_key(spark, sf):
    return B.max_key_count(_orders(spark, sf), "o_custkey")


@query("filter_ids", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _filter(spark, sf):
    ids = V.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return B.filter_ids(_orders(spark, sf), ids).select("id")


@query("zip_by_id", """
SELECT o_orderkey AS id, o_orderstatus, n, qty FROM orders JOIN (SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 6) AS qty FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _zip(spark, sf):
    evals = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("l_quantity")).alias("qty")
    )
    return B.zip_by_id(_orders(spark, sf).select("id", "o_orderstatus"), evals)


@query("head", "SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def _head(spark, sf):
    """First five samples, the debugging view."""
    ranked = _orders(spark, sf).withColumn("_down", -F.col("o_totalprice"))
    return B.head(ranked, 5, ["_down", "id"]).select("id")
