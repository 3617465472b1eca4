"""Keyed tables, dumps, and a source of landed pages for Spark's Python data source interface."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyspark.functions.rows import latest

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, kind: str, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table of one of the file formats; nothing is inferred where a schema is given."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def cached(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """``rows`` with the cache's values; ``hit`` tells a cached key, negative entries (null values) included."""
    held = cache.withColumn("hit", F.lit(True))
    return rows.join(held, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def put(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The cache after new entries, which win; of several for one key the largest by their columns."""
    return cache.join(new.select(key), key, "left_anti").unionByName(latest(new, [key]))


def sql_literal(c: Column, kind: str) -> Column:
    """A value as an SQL literal."""
    text = c.cast("string")
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text if kind in ("bigint", "int", "double", "float", "smallint") else quoted, F.lit("NULL"))


def insert_statements(rows: DataFrame, table: str) -> DataFrame:
    """One INSERT statement for each row."""
    values = F.concat_ws(", ", *[sql_literal(F.col(c), k) for c, k in rows.dtypes])
    return rows.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(rows.columns)}) VALUES ("), values, F.lit(");")).alias("value"))


class _Source(InputPartition):
    def __init__(self, number: int, rows: int):
        self.number, self.rows = number, rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.sources, self.rows = int(options.get("sources", 4)), int(options.get("rows", 10))

    def partitions(self) -> list[InputPartition]:
        return [_Source(i, self.rows) for i in range(self.sources)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i in range(partition.rows):
            yield f"s{partition.number}", f"ref{i}", f"https://s{partition.number}.example/ad/{i}"


class ListingSource(DataSource):
    """``spark.dataSource.register(ListingSource)``: raw listings, one partition for each source; a real one reads what a collector has landed."""

    @classmethod
    def name(cls) -> str:
        return "listings"

    def schema(self) -> str:
        return "source_id string, source_ref string, url string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
