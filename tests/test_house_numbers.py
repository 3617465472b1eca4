from pyspark.sql import functions as F

import __spark_entry__


def test_energy_records_beyond_four_digits(spark, tmp_path):
    spark.range(1, 20_001).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    got = __spark_entry__.queries()["d30_energy_records"](spark, str(tmp_path)).collect()
    assert {r["id"]: r["label"] for r in got} == {k: "ABCDEFG"[k % 7] for k in range(1, 20_001) if k % 5}
