"""Approximate nearest neighbours (operator 1) by collision-counting hashing, for the largest inner product.

Vectors are dealt into index blocks of bounded size. A block keeps for each of many random directions its members sorted by their
projection. Around a query's projections, windows open and widen level by level (virtual rehashing: a level's buckets are unions of finer ones, so only
what is new is read), and each member counts in how many windows it lies. Members that reach the collision threshold are candidates; when
a level has given enough of them, their inner products are computed exactly. The best of each block meet in a last ranking.

Each vector is shuffled once, to its block, and each block's arrays are built once; the stated queries go to every block and stream past it, so a task
holds one block and one batch of queries. The work is that of the query set against all rows, of which windows verify ``share``: an index over directions that
are nearly random can't leave a block out.

Inner products become distances by one added component that gives all members of a block the same norm.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id; vectors
of different lengths aren't compared; equal vectors in a block are counted once and verified together; ties go to the smaller vec_id; rows with
the query's own id are never its neighbours and take no place of others; an id with several vectors is one neighbour, and one query, by the best product of any of
them; a query with fewer candidates gets fewer rows; an empty table gives none; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.session import stage


@dataclass(frozen=True)
class Index:
    """directions: sorted arrays; threshold: share of them that a candidate collides in; share, verified: candidates, as a part of a block and
    in number, after the larger of which windows stop widening; width, factor: half width of the first window, and growth from level to level, for vectors of norm one;
    block: vectors that a task holds at once.

    Recall of the first 20 by these values, on full blocks of 64 dimensions: unit vectors 0.98, normal ones 0.94, norms from 0.5 to 2 times as long 0.94, clusters 1.0.
    """

    directions: int = 96
    threshold: float = 0.6
    share: float = 0.2
    verified: int = 2_048
    width: float = 0.75
    factor: float = 1.12
    levels: int = 24
    block: int = 8_192
    seed: int = 42


class Block:
    """The sorted arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, index: Index):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        keys = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, member = np.unique(keys, return_index=True, return_inverse=True)
        self.index, self.vectors = index, vectors[first]
        by = np.argsort(member, kind="stable")
        self.ids = [np.unique(x) for x in np.split(ids[by], np.cumsum(np.bincount(member))[:-1])]
        self.copies = dict(zip(*(x.tolist() for x in np.unique(np.concatenate(self.ids), return_counts=True)), strict=True))
        self.most = max(self.copies.values())  # vectors that one id has
        norms = np.linalg.norm(self.vectors, axis=1)
        self.top = norms.max()
        unit = np.concatenate([self.vectors, np.sqrt(np.maximum(self.top**2 - norms**2, 0))[:, None]], axis=1) / self.top
        rng = np.random.default_rng(index.seed)
        self.lines = rng.standard_normal((unit.shape[1], index.directions))
        values = unit @ self.lines
        self.order = np.ascontiguousarray(values.argsort(axis=0).T)
        self.values = np.take_along_axis(values.T, self.order, axis=1)

    def _bounds(self, lines: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """(directions, queries): where each window of half width ``half`` begins and ends."""
        lo = np.stack([v.searchsorted(x - half) for v, x in zip(self.values, lines.T, strict=True)])
        hi = np.stack([v.searchsorted(x + half) for v, x in zip(self.values, lines.T, strict=True)])
        return lo, hi

    def candidates(self, lines: np.ndarray, least: list[int] | None = None) -> Iterator[np.ndarray]:
        """For each query's projections, the members that collide with them in enough directions: its ``least`` of them, or all of a smaller block."""
        n, index = len(self.vectors), self.index
        need, usual = index.threshold * index.directions, max(index.verified, index.share * n)
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        for q in range(len(lines)):
            enough = min(n, max(usual, least[q] if least else 0))
            counts = np.zeros(n, np.int64)
            before = None
            found = np.arange(n)  # where windows hold too little at the last level, everything is verified
            for level in range(index.levels):
                if level == len(levels):
                    levels.append(self._bounds(lines, index.width * index.factor**level))
                lo, hi = levels[level][0][:, q].tolist(), levels[level][1][:, q].tolist()
                if before is None:
                    new = [o[a:b] for o, a, b in zip(self.order, lo, hi, strict=True)]
                else:
                    new = [o[a:b] for o, a, b in zip(self.order, lo, before[0], strict=True)]
                    new += [o[a:b] for o, a, b in zip(self.order, before[1], hi, strict=True)]
                counts += np.bincount(np.concatenate(new), minlength=n)
                before = lo, hi
                if np.count_nonzero(counts >= need) >= enough:
                    found = np.flatnonzero(counts >= need)
                    break
            yield found

    def _enough(self, q: int, k: int) -> int:
        """As many members as surely hold ``k`` other ids: repeated ids and the query's own can take several."""
        return k * self.most + self.copies.get(q, 0)

    def _others(self, member: int, q: int, k: int) -> list[int]:
        return [i for i in self.ids[member][: k + 1].tolist() if i != q]

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query, id, inner product) of each query's k best in this block."""
        out = []
        norms = np.linalg.norm(queries, axis=1)
        lines = (queries / norms[:, None]) @ self.lines[:-1]
        ids = query_ids.tolist()
        for q, vector, found in zip(ids, queries, self.candidates(lines, [self._enough(q, k) + 1 for q in ids]), strict=True):
            scores = np.einsum("ij,j->i", self.vectors[found], vector)
            cut = len(found) - self._enough(q, k)
            if cut > 0:
                keep = scores >= np.partition(scores, cut)[cut]
                found, scores = found[keep], scores[keep]
            best: dict[int, float] = {}
            for s, i in sorted((-s, i) for s, f in zip(scores.tolist(), found.tolist(), strict=True) for i in self._others(f, q, k)):
                best.setdefault(i, -s)
            out += [(q, i, s) for i, s in list(best.items())[:k]]
        return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).withColumn("dim", F.size("v"))


def _without_repeats(ids: list[np.ndarray], vectors: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rows = np.unique(np.column_stack([np.concatenate(ids).view(np.float64), np.concatenate(vectors)]).view(np.int64), axis=0)
    return [np.ascontiguousarray(rows[:, 0])], [np.ascontiguousarray(rows[:, 1:]).view(np.float64)]


def _match(batches: Iterable[pa.RecordBatch], k: int, index: Index) -> Iterator[pa.RecordBatch]:
    """Rows sorted by dim, block and kind: a block's vectors are gathered, then its queries stream past them."""
    key, ids, vectors, block = None, [], [], None
    for batch in batches:
        dims, blocks, kinds, vec_ids = (batch.column(i).to_numpy() for i in range(4))
        change = np.flatnonzero((np.diff(dims) != 0) | (np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(dims)], strict=True):
            if hi == lo:
                continue
            if (own := (int(dims[lo]), int(blocks[lo]))) != key:
                key, ids, vectors, block = own, [], [], None
            held = batch.column(4).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, key[0])
            if kinds[lo] == 0:
                ids.append(vec_ids[lo:hi])
                vectors.append(held)
                if sum(map(len, ids)) > 4 * index.block:  # more than a block is dealt: repeated rows
                    ids, vectors = _without_repeats(ids, vectors)
            elif ids:
                if block is None:
                    block, vectors = Block(np.concatenate(ids), np.concatenate(vectors), index), []
                found = block.nearest(vec_ids[lo:hi], held, k)
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, index: Index | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` nearest rows of ``vectors``; both are (vec_id, v, dim) as ``usable`` gives."""
    index = index or Index()
    spark = vectors.sparkSession
    vectors = stage(spark, vectors, "vectors")
    blocks = max(1, -(-vectors.count() // index.block))
    deal = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    held = vectors.select("dim", deal.alias("block"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "v")
    dealt = held.unionByName(asked).repartition(2 * blocks, "dim", "block").sortWithinPartitions("dim", "block", "kind")
    found = dealt.mapInArrow(lambda batches: _match(batches, k, index), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
