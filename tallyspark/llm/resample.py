"""Target-distribution importance resampling (operator 11) on hashed runs of words.

One scan of each text (``Ring``) keeps a zlib CRC state for every one of the last n word starts; a new word extends each state by a space and
its bytes, and every state is a run's feature and falls into a bucket. The buckets of a document are written once, two bytes each, and serve both the corpus
counts and the weights. Counts meet by bucket: a partition sends at most one row for each bucket. The gains, one for each bucket, are the only thing that the driver
gathers. Gumbel noise from a document's id turns the highest scores into a draw without replacement.

Ranks are those of a range-partitioned sort: a row's place in its partition, and the sizes of the partitions before it. No score, source or id comes to one task.

Defined results: a null text has no words; documents without features have weight 0; a null id is noted as an empty string in the noise; rows with the same
id are rows of their own, and ties go to the smaller id, then to fewer features; null ids come last; an empty table gives no rows; without target texts all counts
of the target are 0; other columns aren't read.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.session import stage

#: Letters A-Z in lower case; all that is no ASCII letter or digit, and no byte of another letter, becomes a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


@dataclass(frozen=True)
class Features:
    """longest: words in a run at most; buckets: up to 65,536 of them, which bound what the driver gathers."""

    longest: int = 2
    buckets: int = 10_000

    def __post_init__(self) -> None:
        if not (0 < self.buckets <= 65_536 and self.longest > 0):
            raise ValueError("buckets have to fit two bytes, and runs have a word at least")


def words(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8: runs of ASCII letters and digits, in lower case, and of all other letters as they are."""
    return text.translate(_BYTES).split()


def ring(found: Iterable[bytes], features: Features) -> np.ndarray:
    """The buckets of all runs of 1 to ``longest`` consecutive words, in one pass.

    ``states`` are the CRCs of the runs that end here, one for each of the last starts; the oldest drops out when it has become too long.
    """
    keep = features.longest - 1
    out = array("I")
    states: list[int] = []
    for word in found:
        more = b" " + word
        states = [crc32(more, s) for s in states[-keep:]] if keep else []
        states.append(crc32(word))
        out.extend(states)
    return (np.frombuffer(out, np.uint32) % features.buckets).astype(np.uint16)


def _scan(batches: Iterable[pa.RecordBatch], features: Features) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, runs = [], []
        for text in batch.column(1):
            found = words(text.as_py() or b"")
            numbers.append(len(found))
            runs.append(ring(found, features).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), pa.array(runs, pa.binary())], ["doc_id", "n_words", "runs"])


def scan(texts: DataFrame, features: Features, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and runs (the buckets, two bytes each) of every row, from one scan of its text."""
    key = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    rows = texts.select(key.alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(lambda batches: _scan(batches, features), "doc_id long, n_words long, runs binary")


def _count(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for runs in batch.column(0):
            total += np.bincount(np.frombuffer(runs.as_buffer(), np.uint16), minlength=buckets)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], ["bucket", "n"])


def counts(scanned: DataFrame, features: Features) -> np.ndarray:
    """How many features fall into each bucket; a number for each bucket is all that comes to the driver."""
    size = features.buckets
    found = scanned.select("runs").mapInArrow(lambda batches: _count(batches, size), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A feature's gain by its bucket, in thousandths: floor(1000 ln of the smoothed shares' ratio)."""
    s_all, t_all, size = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + size)) / ((s + 1) * (t_all + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for runs in batch.column(2):
                found = np.frombuffer(runs.as_buffer(), np.uint16)
                n.append(len(found))
                weight.append(int(gain[found].sum()) // len(found) if len(found) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, features: Features | None = None, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text)."""
    features = features or Features()
    spark = docs.sparkSession
    scanned = stage(spark, scan(docs, features), "features")
    gain = gains(counts(scanned, features), counts(scan(target, features, None), features))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = scanned.mapInArrow(_weigh(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = stage(spark, weighed.withColumn("score", F.col("weight") + noise), "scores")
    fit = scored.where(F.col("n_words") >= least_words)
    taken = fit.count() * percent // 100
    ranked = ranks(fit, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")])
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= taken, F.col("rank"))).drop("n_words")
    rest = scored.where(F.col("n_words") < least_words).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def ranks(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank``, their place (from 1) in ``order``, by a range-partitioned sort.

    A partition's number and a row's place in it are the two halves of its running id. They are written down, so that a replay can't deal rows anew; the partitions' sizes
    are added up, one row for each of them.
    """
    spark = rows.sparkSession
    dealt = stage(spark, rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("__at", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.withColumn("__part", part).join(F.broadcast(bases), "__part").withColumn("rank", (F.col("__base") + place).cast("long")).drop("__part", "__at", "__base")
