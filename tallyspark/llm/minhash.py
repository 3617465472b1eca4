"""Near duplicates by similarity: Jaccard of at least 0.8 over five-word shingles, for the pipeline.

SimHash alone can't give this: two texts of similarity 0.8 differ in 10 of 64 bits on average and in up to 20, for which pigeonhole blocks would be three bits
wide. So every distinct text gets 180 minima of its shingles' hashes, in 30 bands of six. Texts that agree in a band are a bucket; two texts of
similarity 0.8 share no bucket once in 9000 times, more similar ones less. Pairs are checked exactly, on the shingles themselves, in two passes
without a limit on buckets: each member against the smallest of its bucket, and then the members of a bucket that are still in different
components against each other. The second pass deals a bucket into chunks of bounded size; a task holds two chunks, counts their common shingles as
products of incidence matrices and returns a spanning forest of their links, so pairs are never rows.

Defined results: a null text is an empty one; texts without words are alike; rows with a null id take part, and a component has the
smallest id that isn't null, or null; repeated rows share their component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.components import components
from tallyspark.llm.memory import give_back
from tallyspark.llm.simhash import keep_lowest, shingle_hashes
from tallyspark.session import stage

BANDS, ROWS = 30, 6
WORDS, SIMILAR = 5, 0.8
#: Shingles hashed at once, which bounds memory for long texts.
STEP = 4096
#: Members and shingles of a bucket's chunk, about; a longer text is a chunk of its own.
CHUNK, HASHES = 1024, 500_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the text's shingles; of a text without words, that of nothing."""
    return np.unique(np.frombuffer(shingle_hashes(text, words) or xxhash.xxh64_digest(b"", 42), ">u8").astype(np.uint64))


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """One key a band: a hash of the minima of ``rows`` permutations of ``hashes``."""
    rng = np.random.default_rng(42)
    mix = rng.integers(0, 1 << 64, (2, bands * rows, 1), dtype=np.uint64)
    mix[1] |= np.uint64(1)
    low = np.full(bands * rows, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(hashes), STEP):
        x = (hashes[None, lo : lo + STEP] ^ mix[0]) * mix[1]
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=1))
    return [xxhash.xxh64_intdigest(part.tobytes(), band) - (1 << 63) for band, part in enumerate(low.reshape(bands, rows))]


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys = [], []
        for text in batch.column(2):
            own = shingles(text.as_py())
            sizes.append(len(own))
            keys.append(band_keys(own))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "size", "keys"])
    give_back()


def _shingled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sets = [shingles(text.as_py()).view(np.int64) for text in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])
    give_back()


def _alike(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (u, v) whose shingles have a Jaccard similarity of ``similar`` at least."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "uv")
    both = F.size(F.array_intersect("su", "sv"))
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", both.alias("both"), (F.size("su") + F.size("sv")).alias("sizes"))
    return joined.where(F.col("both") >= similar * (F.col("sizes") - F.col("both"))).select("u", "v")


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of ``left`` shares with each of ``right``: products of incidence matrices, a few thousand hashes at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)  # sorted, each once
    sides = []
    for sets, flat in ((left, a), (right, b)):
        at = np.minimum(np.searchsorted(shared, flat), max(len(shared) - 1, 0))
        keep = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        sides.append((np.repeat(np.arange(len(sets)), [len(x) for x in sets])[keep], at[keep]))
    for lo in range(0, len(shared), STEP):
        wide = min(STEP, len(shared) - lo)
        parts = []
        for (row, at), n in zip(sides, out.shape, strict=True):
            here = (at >= lo) & (at < lo + wide)
            m = np.zeros((n, wide), np.float32)
            m[row[here], at[here] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _joined(first: list[tuple], second: list[tuple], similar: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between two chunks (node, label, shingles), or within one; nodes of one label count as joined."""
    other = second or first
    overlap = common([x[2] for x in first], [x[2] for x in other])
    sizes = [np.array([len(x[2]) for x in side], np.float32) for side in (first, other)]
    alike = overlap >= similar * (sizes[0][:, None] + sizes[1][None, :] - overlap)
    labels = [np.array([x[1] for x in side]) for side in (first, other)]
    alike &= labels[0][:, None] != labels[1][None, :]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    edges = []
    for i in np.flatnonzero(alike.any(axis=1)):
        mine = labels[0][i]
        near = np.flatnonzero(alike[i])
        for k in near[np.unique(labels[1][near], return_index=True)[1]]:  # one link for each other label
            a, b = find(int(mine)), find(int(labels[1][k]))
            if a != b:
                root[a] = b
                edges.append((first[i][0], other[k][0]))
    return edges


def _compare(batches: Iterable[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell; a cell holds two chunks of a bucket, or one."""
    key, first, second = None, [], []

    def close() -> pa.RecordBatch:
        edges = _joined(first, second, similar) if first and (second or key[1] == key[2]) else []
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        keys, i, j, side, nodes, labels = (batch.column(k).to_pylist() for k in range(6))
        sets = batch.column(6)
        for n in range(batch.num_rows):
            if (own := (keys[n], i[n], j[n])) != key:
                if key is not None:
                    yield close()
                key, first, second = own, [], []
            (first if side[n] else second).append((nodes[n], labels[n], sets[n].values.to_numpy(zero_copy_only=False).copy()))
    if key is not None:
        yield close()
    give_back()


def links(spark: SparkSession, buckets: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Edges (u, v) that connect all similar nodes which share a bucket; ``buckets``: key, node, size."""
    near = lambda a, b: F.least(a, b) >= similar * F.greatest(a, b)
    hubs = buckets.groupBy("key").agg(F.min_by(F.struct("node", "size"), F.struct(F.xxhash64("node"), "node")).alias("hub"))
    first = buckets.join(hubs, "key").where(F.col("node") != F.col("hub.node")).where(near(F.col("size"), F.col("hub.size")))
    first = first.select(F.col("node").alias("u"), F.col("hub.node").alias("v")).distinct()
    edges = stage(spark, _alike(first, sets, similar), "alike")
    labels = components(spark, edges).withColumnRenamed("node", "__node")
    named = buckets.join(labels, buckets["node"] == labels["__node"], "left").select("key", "node", "size", F.coalesce("label", "node").alias("label"))
    # In a bucket of several labels, those of the most frequent one needn't meet each other: they are joined. The others meet all.
    by = named.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    top = by.groupBy("key").agg(F.max_by(F.struct("label", "n", "total"), F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("labels")).where("labels > 1 and n > 2")
    parts = lambda n, total: F.greatest(F.ceil(n / CHUNK), F.ceil(total / HASHES), F.lit(1)).cast("long")
    top = top.select("key", F.col("top.label").alias("most"), parts(F.col("n") - F.col("top.n"), F.col("total") - F.col("top.total")).alias("few"), parts(F.col("top.n"), F.col("top.total")).alias("many"))
    mixed = stage(spark, named.join(top, "key").withColumn("minor", F.col("label") != F.col("most")), "mixed")
    dealt = mixed.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(5)), F.when(F.col("minor"), F.col("few")).otherwise(F.col("many"))))
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda i, j, first: F.struct(i.alias("i"), j.alias("j"), first.alias("first"))
    among = F.transform(up_to(F.col("few")), lambda j: cell(F.least("chunk", j), F.greatest("chunk", j), F.col("chunk") <= j))
    across = F.transform(up_to(F.col("many")), lambda j: cell(F.col("chunk"), -j - 1, F.lit(True)))  # chunks of the most frequent label are counted below zero
    back = F.transform(up_to(F.col("few")), lambda i: cell(i, -F.col("chunk") - 1, F.lit(False)))
    cells = dealt.withColumn("cell", F.explode(F.when(F.col("minor"), F.concat(among, across)).otherwise(back))).select("key", "cell.i", "cell.j", "cell.first", "node", "label")
    held = cells.join(sets, "node").select("key", "i", "j", "first", "node", "label", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return edges.union(held.mapInArrow(lambda batches: _compare(batches, similar), "u long, v long"))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: doc_id, component_id (the smallest doc_id that links of similar texts reach)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    marked = stage(spark, rows.mapInArrow(_sketch, "doc_id long, node long, size int, keys array<long>"), "sketches")
    banded = marked.select("node", "size", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key")
    buckets = stage(spark, banded.join(shared, "key").distinct(), "buckets")
    wanted = buckets.select("node").distinct()
    texts = rows.select("node", "text").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    sets = stage(spark, texts.mapInArrow(_shingled, "node long, shingles array<long>"), "shingles")
    labels = components(spark, links(spark, buckets, sets, similar))
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("low"))
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    return stage(spark, marked.select("doc_id", "node").join(named.join(lowest, "label").select("node", "component_id"), "node").select("doc_id", "component_id"), "near")


def widened(docs: DataFrame, near: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``near_duplicates`` of ``docs`` with the links of ``near`` (doc_id, component_id) as well: doc_id, component_id of the components of both."""
    spark = docs.sparkSession
    mine = near_duplicates(docs, similar)
    other = stage(spark, near.select("doc_id", "component_id"), "fingerprinted")
    labels = components(spark, mine.union(other).toDF("u", "v"))
    unnamed = other.where("doc_id is null and component_id is not null")
    rows = mine.union(unnamed)
    return rows.join(labels, rows["component_id"] == labels["node"], "left").select("doc_id", F.coalesce("label", "component_id").alias("component_id"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one document of each component of similar texts, chosen as ``simhash.keep_one`` does."""
    return keep_lowest(docs, near_duplicates(docs, similar))
