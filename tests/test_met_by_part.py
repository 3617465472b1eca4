"""Occurrences meet by part while they are narrow: one row a group goes on, however the rows lie in the file."""

import glob

import duckdb

from tallyspark.plans import registry


def test_contacts_of_scattered_rows(spark, tmp_path):
    d = str(tmp_path)
    stamp = "timestamp_ntz'1995-01-01' + make_interval(0, 0, 0, cast({} as int))"
    part = "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 101 = 0 THEN NULL ELSE id % 43 END"
    lines = spark.range(0, 3000, 1, 5).selectExpr(
        "id * 17 % 400 AS l_orderkey", "cast(id % 7 as int) AS l_linenumber", f"{part} AS l_partkey", "id * 7 % 11 AS l_suppkey", f"{stamp.format('id % 5')} AS l_shipdate", "cast(id % 900 as double) AS l_extendedprice", "'A' AS l_returnflag", "'F' AS l_linestatus")
    lines.union(lines.limit(50)).repartition(5).write.parquet(f"{d}/lineitem.parquet")
    spark.range(390).selectExpr("id AS o_orderkey", f"{stamp.format('id % 3')} AS o_orderdate").write.parquet(f"{d}/orders.parquet")
    spark.range(41).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "cast(id as int) AS p_size").write.parquet(f"{d}/part.parquet")
    found = registry.QUERIES["e06_contacts"](spark, d)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next((i for i, line in enumerate(plan) if "hashpartitioning(l_partkey" in line), None)
    assert at is not None and not any("concat" in line for line in plan[at:])
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({glob.glob(f'{d}/{t}.parquet/*.parquet')})")
    want = con.execute(registry.ORACLES["e06_contacts"]).fetchall()
    assert len(want) == 41 and sorted(tuple(r) for r in found.collect()) == sorted(want)
