"""Structured Streaming variants of the stateful parts. Event-time windows are extensions over the batch semantics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyspark.functions.rows import latest
from tallyspark.session import shared_dir


def read_files(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 8) -> DataFrame:
    """Files of a folder as a stream; what a trigger admits is bounded."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts by window and keys; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "25 minutes", late: str = "2 hours") -> DataFrame:
    """Counts by session of each key."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def once(events: DataFrame, at: str, ids: list[str], late: str = "1 day") -> DataFrame:
    """Every alert once, as far back as the watermark reaches."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(ids)


def limit_rate(events: DataFrame, key: str, at: str, limit: int, window_ms: int) -> DataFrame:
    """(key, event_id, allowed): at most ``limit`` events of a key in a window that its first event opens and that starts anew when older than ``window_ms``.

    State is two numbers a key. Batch input gives the same over the ordered rows of each key.
    """
    schema = f"{key} string, event_id long, allowed boolean"
    rows = events.select(F.col(key).cast("string").alias(key), F.col("event_id").cast("long").alias("event_id"), F.unix_millis(F.col(at).cast("timestamp")).alias("ms"))

    def step(state: tuple[int, int] | None, frames: Iterator[pd.DataFrame]) -> tuple[tuple[int, int], pd.DataFrame]:
        start, count = state or (-1, 0)
        out = []
        for k, i, ms in pd.concat(list(frames)).sort_values(["ms", "event_id"])[[key, "event_id", "ms"]].itertuples(index=False):
            if start < 0 or ms - start >= window_ms:
                start, count = int(ms), 0
            count += 1
            out.append((k, i, count <= limit))
        return (start, count), pd.DataFrame(out, columns=[key, "event_id", "allowed"])

    if not events.isStreaming:
        return rows.groupBy(key).applyInPandas(lambda frame: step(None, iter([frame]))[1], schema)

    def stateful(_: Any, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        new, out = step(state.get if state.exists else None, frames)
        state.update(new)
        yield out

    return rows.groupBy(key).applyInPandasWithState(stateful, schema, "start long, n long", "append", "NoTimeout")


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], name: str) -> StreamingQuery:
    """All that is there now, batch by batch, with a checkpoint in the shared folder; ``apply`` has to be idempotent for a batch id."""
    spark = stream.sparkSession
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{shared_dir(spark)}/streams/{name}").trigger(availableNow=True).start()


#: Hash buckets of a keyed table; a batch rewrites only those that its keys fall into.
BUCKETS = 64


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """{bucket: version that holds it} after the last batch, or after the last one before ``before``; at most BUCKETS rows."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(base) if f.getPath().getName().startswith("manifest=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if fs.exists(base) else []
    found = [v for v in found if before is None or v < before]
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/manifest={max(found)}").collect()} if found else {}


def read_keyed(spark: SparkSession, path: str, buckets: dict[int, int] | None = None) -> DataFrame | None:
    """A keyed table as the last batch left it, or only some (bucket, version) of it; None where there is nothing."""
    held = _manifest(spark, path) if buckets is None else buckets
    return spark.read.parquet(*[f"{path}/v={v}/bucket={b}" for b, v in sorted(held.items())]) if held else None


def upsert_into(path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps a keyed table in hash buckets: a batch writes new versions of the buckets it touches, and then a manifest.

    Of a batch's rows with one key the largest by ``order`` (such as the time of the event), then by all columns, counts. A repeated batch starts from the manifest before it, and so
    gives the same; a query that is resumed may begin with any number. ``vacuum`` removes versions that no late manifest names.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, order).persist()  # read for its buckets and for the merge
        try:
            held = _manifest(spark, path, number)
            touched = [r["bucket"] for r in new.select(_bucket(keys).alias("bucket")).distinct().collect()]
            old = read_keyed(spark, path, {b: v for b, v in held.items() if b in touched})
            rows = new if old is None else merge(old, new)
            rows.withColumn("bucket", _bucket(keys)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")
        finally:
            new.unpersist()
        left = {r["bucket"] for r in spark.read.parquet(f"{path}/v={number}").select("bucket").distinct().collect()} if touched else set()
        now = {**{b: v for b, v in held.items() if b not in touched}, **{b: number for b in left}}
        spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest={number}")

    return apply


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes the manifests before the last ``keep``, and the versions that none of those names any more; returns these versions.

    For when no reader still holds an older state, and no batch before the last ``keep`` can come again.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(base)] if fs.exists(base) else []
    manifests, versions = (sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")) for kind in ("manifest", "v"))
    kept = manifests[-keep:]
    used = {v for m in kept for v in _manifest(spark, path, m + 1).values()}
    gone = [v for v in versions if v not in used and kept and v < kept[0]]
    for place in [*(f"v={v}" for v in gone), *(f"manifest={m}" for m in manifests[:-keep])]:
        fs.delete(hadoop.Path(base, place), True)
    return gone
