"""Mixing sources to target weights (operator 4).

The words of each source, its documents one after the other, are packed into blocks of fixed length. Output shards
have a fixed number of slots; the counts of the sources in the shards are multinomial draws under the condition that the whole mix meets the
targets to a block, drawn by halving the shards again and again: any range of shards is drawn on its own, by whichever task needs it. The t-th slot of a source holds block p(t mod n) of
its n blocks, p being a pseudorandom permutation of its own; slots and blocks join by (source, block).

Defined results: null text has no words and isn't taken; null sources are one source, the last; documents without words
have target and source sizes but take nothing; an empty table gives no rows; rows with the same id are rows of their
own; ties in the order of documents are rows alike. Reruns agree: order, draws and permutations depend on the seed alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.memory import give_back
from tallyspark.llm.prefix import running_total
from tallyspark.session import stage

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Slots of a source that leave the drawing task as one row.
RUN = 4096


@dataclass(frozen=True)
class Plan:
    """block: words in a block; slots: blocks in an output shard; repeats: times that a source may be used; seed: of draws and permutations."""

    block: int = 64
    slots: int = 1 << 20
    repeats: int = 3
    seed: int = 42


def targets(sizes: list[int], weights: list[float], repeats: int = 3) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``repeats`` times its size; what is cut goes to the others by weight."""
    total = float(sum(sizes))
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(repeats * sizes[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        for i in free:
            out[i] = left * weights[i] / weight
        over = {i for i in free if out[i] > repeats * sizes[i]}
        if not over:
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        free -= over
    return out


def _share(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``n`` slots drawn without replacement come from each source: a hypergeometric draw for each source from what is left."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, k in enumerate(counts.tolist()):
        others = rest - k
        if rest < 10**9:
            got = int(rng.hypergeometric(k, others, n)) if n and k else 0
        else:  # beyond the generator's range the normal limit
            mean = n * (k / rest)
            got = round(rng.normal(mean, math.sqrt(max(0.0, mean * (1 - k / rest) * (rest - n) / (rest - 1)))))
        got = min(max(got, n - others, 0), n, k)
        out[i], n, rest = got, n - got, others
    return out


def draw(quotas: list[int], slots: int, seed: int, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(shard, source, first slot of the source, count) for the shards from ``lo`` to ``hi``: multinomial counts, given that all quotas are met.

    A range of shards is halved and its quotas are shared between the halves with a generator seeded by the range, so each range
    gives the same draw in any task.
    """
    total = sum(quotas)
    shards = -(-total // slots)
    hi = shards if hi is None else min(hi, shards)
    stack = [(0, shards, np.array(quotas, np.int64), np.zeros(len(quotas), np.int64))] if shards else []
    while stack:
        a, b, counts, given = stack.pop()
        if b <= lo or a >= hi:
            continue
        if b - a == 1:
            yield from ((a, int(i), int(given[i]), int(counts[i])) for i in np.flatnonzero(counts))
            continue
        middle = (a + b) // 2
        left = _share(counts, (middle - a) * slots, np.random.default_rng([seed, a, b]))
        stack += [(middle, b, counts - left, given + left), (a, middle, left, given)]


def permute(x: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Each x in [0, n) to its place under a permutation of [0, n): a Feistel network, walked until it falls below n."""
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    keys = seed.astype(np.uint64)
    while len(todo):
        a, b = out[todo] >> half[todo], out[todo] & mask[todo]
        for turn in range(4):
            h = (b ^ (keys[todo] + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((h >> np.uint64(32)) & mask[todo])
        out[todo] = (a << half[todo]) | b
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, text digest and size of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.col("text").cast("string").cast("binary")).alias("digest"),
    )


def mix(docs: DataFrame, plan: Plan | None = None, weights: tuple[float, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, pieces) of the mix.

    documents: doc_id, source, size, digest, source_no, source_size, target, offset (words of the source before it);
    slots: shard, source_no, slot, block: the mix itself, in order;
    pieces: source_no, block, offset, at, words: which words of which document (by source and offset) a block holds.
    The sources, one row each, are what the mix is configured by, and are read by the driver.
    """
    spark, plan = docs.sparkSession, plan or Plan()
    rows = stage(spark, sized(docs), "sizes")
    sums = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    names = sorted((s for s in sums if s is not None)) + ([None] if None in sums else [])
    sizes = [sums[s] for s in names]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], plan.repeats)
    blocks = [math.ceil(w / plan.block) for w in sizes]
    quotas = [min(plan.repeats * n, round(t * n / w)) if w else 0 for t, n, w in zip(aims, blocks, sizes, strict=True)]
    table = spark.createDataFrame([(i, s, w, float(t), n) for i, (s, w, t, n) in enumerate(zip(names, sizes, aims, blocks, strict=True))], "source_no int, name string, source_size long, target double, n_blocks long")
    known = rows.join(table, rows["source"].eqNullSafe(table["name"])).drop("name")
    placed = running_total(known, ["source_no"], ["doc_id", "digest"], F.col("size"), "offset")
    placed = stage(spark, placed, "placed")
    shards = -(-sum(quotas) // plan.slots)

    def drawn_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()  # a range of shards
            found = draw(quotas, plan.slots, plan.seed, ids[0], ids[-1] + 1) if ids else ()
            rows = [(shard, i, first + k, min(RUN, n - k)) for shard, i, first, n in found for k in range(0, n, RUN)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["shard", "source_no", "first", "n"])

    drawn = spark.range(shards).mapInArrow(drawn_in, "shard int, source_no int, first long, n long").repartition("shard", "source_no", "first")
    drawn = drawn.join(F.broadcast(table.select("source_no", "n_blocks")), "source_no")  # one row for each source

    @F.pandas_udf("long")
    def place(x: pd.Series, n: pd.Series, source_no: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n.to_numpy(), seed.to_numpy() * 1_000_003 + source_no.to_numpy()))

    slots = drawn.select("shard", "source_no", "n_blocks", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))
    slots = slots.select("shard", "source_no", "slot", place(F.col("slot") % F.col("n_blocks"), "n_blocks", "source_no", F.lit(plan.seed)).alias("block"))
    size = F.lit(plan.block).cast("long")
    held = placed.where("size > 0").select("source_no", "offset", "size", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.col("size") - 1) / size))).alias("block"))
    start = F.greatest(F.col("offset"), F.col("block") * size)
    pieces = held.select("source_no", "block", "offset", (start - F.col("offset")).alias("at"), (F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * size) - start).alias("words"))
    return placed, slots, pieces


def taken(placed: DataFrame, slots: DataFrame, pieces: DataFrame) -> DataFrame:
    """``placed`` with ``taken``: the words of each document that the mix takes, repeats counted."""
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    got = pieces.join(times, ["source_no", "block"]).groupBy("source_no", "offset").agg(F.sum(F.col("words") * F.col("times")).alias("__taken"))
    return placed.join(got.withColumn("size_ok", F.lit(True)), ["source_no", "offset"], "left").withColumn(
        "taken", F.when(F.col("size") > 0, F.coalesce("__taken", F.lit(0))).otherwise(F.lit(0)).cast("long")
    ).drop("__taken", "size_ok")


def _copies(batches: Iterable[pa.RecordBatch], names: list[str], at: int, count: int | None) -> Iterator[pa.RecordBatch]:
    words = re.compile(WORDS)
    for batch in batches:
        keep, texts = [], []
        for i, (text, plan) in enumerate(zip(batch.column(at), batch.column(len(names)).to_pylist(), strict=True)):
            plan = sorted((p["at"], p["words"], p["times"]) for p in plan or ())
            body = text.as_py()
            spans = None
            for turn in range(1, 1 + max((t for _, _, t in plan), default=0)):
                if all(t >= turn for _, _, t in plan):
                    part = body
                else:
                    spans = spans or [m.span() for m in words.finditer(body)]
                    part = " ".join(body[spans[a][0] : spans[a + n - 1][1]] for a, n, t in plan if t >= turn)
                keep.append(i)
                texts.append(part)
        out = batch.select(names).take(pa.array(keep, pa.int64()))
        cols = [out.column(n) for n in names]
        cols[at] = pa.array(texts, out.schema.field(at).type)
        if count is not None:
            cols[count] = pa.array([len(t) for t in texts], out.schema.field(count).type)
        yield pa.RecordBatch.from_arrays(cols, names)
    give_back()


def apply_mix(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a document once for each time it is taken, with the words taken then.

    A document taken as a whole keeps its text; of a document whose blocks are taken unequally, the last rows hold the words
    of the blocks taken once more, and n_chars follows. Rows alike in id, source and text share one plan.
    """
    plan = plan or Plan()
    placed, slots, pieces = mix(docs, plan)
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    lists = pieces.join(times, ["source_no", "block"], "left").groupBy("source_no", "offset").agg(
        F.collect_list(F.struct("at", "words", F.coalesce(F.col("times"), F.lit(0)).alias("times"))).alias("__plan"))
    full = placed.where("size > 0").join(lists, ["source_no", "offset"])
    full = full.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("digest").alias("__digest"), "__plan").dropDuplicates(["__id", "__source", "__digest"])
    text = F.col("text").cast("string")
    marked = docs.where(F.col("text").isNotNull()).withColumn("__own", F.md5(text.cast("binary")))
    joined = marked.join(full, (F.col("__own") == F.col("__digest")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source")))
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    return joined.select(*names, "__plan").mapInArrow(lambda batches: _copies(batches, names, at, count), docs.schema)
