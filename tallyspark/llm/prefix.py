"""Distributed prefix sums: running totals without pulling a key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces into which every key is dealt. A fixed number, so that the order of rows never depends on the cluster.
PIECES = 1024


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, deal: list[str] | None = None, pieces: int = PIECES) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``keys`` that come before this one.

    Rows are ordered by (hash piece of the columns ``deal``, by default those of the order, order columns): a fixed pseudorandom
    order; rows alike in ``deal`` keep together. A hot key is dealt over ``pieces`` tasks; only one row for each key and piece
    is summed along a key. Null keys and order values form groups and sort first like any other value.
    """
    piece = F.pmod(F.xxhash64(*(deal or order)), F.lit(pieces)).cast("int")
    rows = df.withColumn("__piece", piece).withColumn("__value", value)
    nested = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000null")).alias(f"__k{i}") for i, k in enumerate(keys)]
    rows = rows.select("*", *nested)
    names = [f"__k{i}" for i in range(len(keys))]
    parts = rows.groupBy(*names, "__piece").agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(*names).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*names, "__piece", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*names, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    rows = rows.join(parts, [*names, "__piece"])
    return rows.withColumn(out, (F.col("__base") + F.col("__within")).cast("long")).drop(*names, "__piece", "__value", "__within", "__base")
