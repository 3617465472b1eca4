"""SimHash near-duplicates (operator 10): 64-bit fingerprints, pigeonhole blocks, Hamming verification.

Two fingerprints that differ in at most three bits agree in one of four 16-bit blocks. Distinct
fingerprints are dealt by (block, value); a bucket of bounded size is compared as a whole and
returns the edges of a spanning forest of its links, which keeps the components and stays linear. A larger bucket
isn't cut: its members are dealt again, by the same argument on four pieces of the bits not yet used,
until every bucket is small. Bits run out before buckets do, as fingerprints in a bucket are distinct.

Defined results: a null text is an empty one and has fingerprint zero, linked like any other; rows with a null id
take part, and a component has the smallest id that isn't null, or null; repeated rows share their component;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.components import components
from tallyspark.llm.memory import give_back
from tallyspark.session import stage

BLOCKS = 4
#: Distinct fingerprints compared in one task step; larger buckets are dealt again.
BUCKET = 512
FULL = (1 << 64) - 1
#: For each byte value, eight one-byte counters in a word: bit 0 in the first byte.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
STEP = 255


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> bytes:
    """The big-endian XXH64 of every shingle, joined; no words: none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return b""
    whole, digest = b" ".join(parts), xxhash.xxh64_digest
    if len(parts) <= words:
        return digest(whole, seed)
    ends = list(accumulate(parts, lambda at, w: at + 1 + len(w), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends[:-words])]
    return b"".join([digest(whole[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=True)])


def fingerprints(texts: Iterable[str | None], words: int = 3, seed: int = 42) -> np.ndarray:
    """One unsigned fingerprint for each text: a bit is 1 if set in over half of the shingles' hashes."""
    out = []
    for text in texts:
        hashed = shingle_hashes(text, words, seed)
        n = len(hashed) // 8
        if not n:
            out.append(0)
            continue
        lanes = np.frombuffer(hashed, np.uint8).reshape(n, 8)
        counts = np.zeros(64, np.int64)
        for lo in range(0, n, STEP * 64):
            part = SPREAD[lanes[lo : lo + STEP * 64]]
            sums = np.add.reduceat(part, np.arange(0, len(part), STEP), axis=0)
            counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        bits = (counts * 2 > n).astype(np.uint8)
        out.append(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "big"))
    return np.array(out, dtype=np.uint64)


def _fingerprint(batches: Iterable[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = fingerprints((x.as_py() for x in batch.column(1)), words, seed)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])
    give_back()


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Positions joined by a spanning forest of the links among ``fps``: breadth first, a row of distances at a time."""
    left, edges = np.arange(len(fps)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            edges += [(int(at), int(x)) for x in left[near]]
            queue += list(left[near])
            left = left[~near]
    return edges


def _link(batches: Iterable[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        us, vs = [], []
        for bucket in batch.column(0):
            fps = bucket.values.to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in _forest(fps.view(np.uint64), distance):
                us.append(fps[a])
                vs.append(fps[b])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_mask(used: int, pieces: int = BLOCKS) -> list[int]:
    """The masks by which a bucket with the bits ``used`` in common is dealt: ``used`` and each piece of the rest."""
    free = [b for b in range(64) if not used >> b & 1]
    cuts = [round(i * len(free) / pieces) for i in range(pieces + 1)]
    return [used | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo]


def links(spark: SparkSession, fps: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fps`` (fp) at ``distance`` or fewer bits, enough of them to connect all that are linked."""
    if distance >= BLOCKS:
        raise ValueError("four blocks find distances up to 3")
    masks = [0]
    rest = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    found = None
    while True:
        table = {m: split_mask(m) for m in masks}
        masks = sorted({x for xs in table.values() for x in xs})
        pairs = [x for m, xs in table.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in xs]))]
        dealt = rest.select("fp", F.explode(F.create_map(*pairs)[F.col("mask")]).alias("mask")) if len(table) < 64 else rest.join(
            spark.createDataFrame([(_signed(m), [_signed(y) for y in xs]) for m, xs in table.items()], "mask long, next array<long>"), "mask"
        ).select("fp", F.explode("next").alias("mask"))
        dealt = dealt.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = dealt.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
        rows = stage(spark, dealt.join(sizes, ["mask", "value"]), "blocks")
        last = all(bin(m).count("1") >= 55 for m in masks)
        small = rows if last else rows.where(F.col("n") <= bucket)
        lists = small.groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")).select("fps")
        edges = lists.mapInArrow(lambda batches: _link(batches, distance), "u long, v long")
        found = edges if found is None else found.union(edges)
        if last or rows.where(F.col("n") > bucket).isEmpty():
            return found
        rest = rows.where(F.col("n") > bucket).select("fp", "mask").distinct()


def near_duplicates(docs: DataFrame, distance: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: doc_id, fp (signed 64 bits), component_id (the smallest doc_id that links reach)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = stage(spark, rows.mapInArrow(lambda batches: _fingerprint(batches, words, 42), "doc_id long, fp long"), "fingerprints")
    nodes = stage(spark, marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    labels = components(spark, links(spark, nodes.select("fp"), distance))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "label").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_lowest(docs: DataFrame, near: DataFrame) -> DataFrame:
    """``docs`` with one document of each component in ``near`` (doc_id, component_id): the one with the smallest doc_id.

    Rows that share that id are repeated rows, of which one stays. Rows whose component has no id stay.
    """
    gone = near.where("doc_id <> component_id or (doc_id is null and component_id is not null)").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
    twice = near.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__twice")).count().where("count > 1").select("__twice")
    twice = stage(docs.sparkSession, twice, "repeated")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, kept["doc_id"] == twice["__twice"], "left_anti")
    return once.unionByName(kept.join(twice, kept["doc_id"] == twice["__twice"], "left_semi").dropDuplicates(["doc_id"]))


def keep_one(docs: DataFrame, distance: int = 3, words: int = 3) -> DataFrame:
    """``docs`` with one document of each component of near fingerprints."""
    return keep_lowest(docs, near_duplicates(docs, distance, words))
