"""Queries: stateful and sink operators over batches (survey parts B, O); the streaming forms are tested in tests/."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.plans.proxies import Registry
from tallyspark.sources import tables
from tallyspark.streaming import jobs

R = Registry()


@R.add("o19_rate_limit", None)
def rate_limit(t):
    rows = t.events.select("event_id", F.col("user_id").cast("string").alias("user_id"), "ts")
    return jobs.limit_rate(rows, "user_id", "ts", 3, 86_400_000)


@R.add("x_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed(t):
    return jobs.windowed_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])


@R.add("x_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1500000000 THEN 0 ELSE 1 END AS b FROM events), k AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT min(ts) AS start, user_id, count(*) AS n FROM k GROUP BY user_id, s""")
def sessions(t):
    return jobs.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id")


@R.add("b16_cache", "SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS lat, p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS hit FROM part")
def cache(t):
    k = F.col("p_partkey")
    held = t.part.where((k % 3 == 0) | (k % 5 == 0)).select(k.alias("key"), F.when(k % 3 == 0, F.col("p_size").cast("double")).alias("lat"))
    return tables.cached(t.part.select(k.alias("key")), held, "key")


@R.add("b18_sql_dump", "SELECT concat('INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (', n_nationkey, ', ''', n_name, ''', ', n_regionkey, ');') AS value FROM nation")
def dump(t):
    return tables.insert_statements(t.nation, "nation")


@R.add("p01_cache_put", "SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS value FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def put(t):
    k = F.col("c_custkey")
    old = t.customer.where(k % 3 == 0).select(k.alias("key"), F.lit("old").alias("value"))
    return tables.put(old, t.customer.where(k % 2 == 0).select(k.alias("key"), F.lit("new").alias("value")), "key")
