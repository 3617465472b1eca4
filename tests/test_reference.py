"""Registered queries against DuckDB on the smallest tables, and the parts that SQL can't state."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import aggregates as A
from tallyspark.operators import dedupe as D
from tallyspark.operators import joins as J
from tallyspark.operators import lifecycle as S
from tallyspark.plans import registry
from tallyspark.plans.api import Engine, read_only_sql
from tallyspark.plans.proxies import Tables
from tallyspark.sources import tables as T
from tallyspark.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 8)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rel = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = ordered(tuple(plain(x) for x in r) for r in rel.fetchall())
    got = ordered(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_groups_obey_conflicts(spark):
    links = spark.createDataFrame([("a", "b", 90), ("b", "c", 80), ("c", "d", 70)], "a string, b string, strength int")
    banned = spark.createDataFrame([("a", "c")], "a string, b string")
    got = {r["node"]: r["grp"] for r in D.groups(links, banned).collect()}
    assert got["a"] == got["b"] and got["c"] == got["d"] and got["a"] != got["c"]


def test_cadence_compares_with_the_last_departure(spark):
    rows = [("s", t) for t in (0, 100, 200, 1000, 3000)]
    df = spark.createDataFrame(rows, "source_id string, t long").select("source_id", F.timestamp_seconds("t").alias("started_at"))
    r = A.cadence(df).first()
    # 0 opens, 100 is in it, 200 is over 180 s after 0 and opens anew.
    assert (r["cycles"], r["median_gap_s"], r["max_gap_s"]) == (4, 800, 2000)


def test_not_in_with_null_is_empty(spark):
    left, right = spark.range(5), spark.createDataFrame([(1,), (None,)], "x long")
    assert J.not_in(left, right, "id", "x").count() == 0 and J.not_in(left, right.where("x is not null"), "id", "x").count() == 4


def test_list_page_plan_pushes_and_prunes(spark):
    t = Tables(spark, SF)
    plan = t.occ.where("source_id = 's1'").select("id", "price")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "o_totalprice" not in plan and "p_name" not in plan


def test_rate_limit_streams_as_in_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), events)
    query = jobs.limit_rate(stream, "user_id", "ts", 2, 86_400_000).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    got = {r["event_id"]: r["allowed"] for r in spark.sql("select * from limited").collect()}
    want = {r["event_id"]: r["allowed"] for r in jobs.limit_rate(events, "user_id", "ts", 2, 86_400_000).collect()}
    assert got == want and len(got) == events.count()


def test_batches_keep_a_keyed_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "key long, value string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), rows, 1)
    apply = jobs.upsert_into(str(tmp_path / "table"), ["key"], lambda old, new: T.put(old, new, "key"))
    jobs.run_batches(stream, apply, f"t{os.getpid()}").awaitTermination()
    for number in (7, 7):  # a resumed query's batch, and the same again
        apply(spark.createDataFrame([(2, "c"), (3, "d")], "key long, value string"), number)
    assert {(r["key"], r["value"]) for r in jobs.read_keyed(spark, str(tmp_path / "table")).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_formats_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for kind in ("parquet", "orc", "json", "csv"):
        rows.write.format(kind).save(str(tmp_path / kind))
        assert {tuple(r) for r in T.read(spark, kind, str(tmp_path / kind), "k int, v string").collect()} == {(1, "a"), (2, None)}
    with pytest.raises(ValueError):
        T.read(spark, "xls", "x")


def test_listing_source(spark):
    spark.dataSource.register(T.ListingSource)
    assert spark.read.format("listings").option("sources", 3).option("rows", 5).load().count() == 15


def test_only_one_select(spark):
    for text in ("DROP TABLE x", "SELECT 1; SELECT 2", "  update x set y = 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT 1 -- x\n; DROP TABLE t"):
        with pytest.raises(ValueError):
            read_only_sql(spark, text)
    assert read_only_sql(spark, "WITH a AS (SELECT 'x;y' AS v) SELECT v FROM a;").first()["v"] == "x;y"


def test_facade(spark):
    t = Tables(spark, SF)
    e = Engine(t.occ, t.lst, t.state, t.score, t.runs, t.hist)
    assert e.listings(limit=7).count() == 7 and e.listings("u1", sort="priority", limit=5).count() == 5
    assert e.districts(["d1", "zz"]).where("district = 'zz'").first()["n"] == 0
    assert e.price_histogram().count() == 47 and e.stats("u1").first()["total"] == t.lst.count() and e.agencies().count() > 0 and e.sources().count() > 0


def test_upsert_keeps_first_sight(spark):
    schema = "k int, hash string, first_seen string, last_seen string, missing_runs int, lifecycle string"
    old = spark.createDataFrame([(1, "h", "a", "b", 2, "inactive"), (2, "h", "a", "b", 1, "active")], schema)
    new = spark.createDataFrame([(1, "g", "c", "c", 0, "active"), (3, "x", "c", "c", 0, "active")], schema)
    got = {r["k"]: (r["hash"], r["first_seen"], r["last_seen"], r["missing_runs"], r["lifecycle"], r["outcome"]) for r in S.upsert(old, new, ["k"]).collect()}
    assert got == {1: ("g", "a", "c", 0, "active", "updated"), 2: ("h", "a", "b", 1, "active", "absent"), 3: ("x", "c", "c", 0, "active", "inserted")}
