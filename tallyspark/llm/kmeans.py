"""Centroid clustering (operator 13): exact integer k-means with ball-tree filtering.

Every partition turns its own vectors, a batch at a time, into metric trees: a node is a ball with its radius, count and integer sum over a slice of the vectors. The trees are
written once and read in each round; no vector is ever shuffled. A round sends the centroids, of which there are few, down every tree: a centroid that the triangle inequality
puts farther from all of a ball than another is no candidate below it; a ball with one candidate goes to it whole, by its count and sum; leaves compare exact
squared distances in integers. Bounds are floating-point numbers with a margin, so they only ever keep a candidate too many. A partition returns a row for each centroid and component, sums meet
by those, and the driver gets centroids only.

Vectors are arrays of exactly ``dim`` components, none null or not finite; a component x becomes floor(64 x).

Defined results: other vectors take no part; of scaled components beyond 2^27 the nearest bound counts, so that distances stay exact; fewer vectors than centroids give as many centroids;
rows with the same id, or a null id (empty in the hash), are rows of their own, and among those with the same hash the first centroids are those smallest by components; ties of distance go to the smaller
number; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import stage

_BOUND = 1 << 27
_TREE = "vec_id array<bigint>, vectors binary, lo binary, hi binary, below binary, radius binary, sums binary"
#: Bounds are widened by this part of the numbers that they come from.
_MARGIN = 1e-9


@dataclass(frozen=True)
class Trees:
    """leaf: vectors in a leaf at most; size: vectors in a tree at most; scale: what components are multiplied by; dim: their number."""

    leaf: int = 32
    size: int = 4_096
    scale: float = 64.0
    dim: int = 64


def integers(vectors: DataFrame, trees: Trees, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q) of the vectors that take part, q in integers."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == trees.dim))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bounded = F.transform("v", lambda x: F.floor(F.greatest(F.lit(float(-_BOUND)), F.least(F.lit(float(_BOUND)), x * trees.scale))).cast("long"))
    return rows.where(fine).select("vec_id", bounded.alias("q"))


class Tree:
    """Vectors in the order of the leaves, and each node's slice, first child (the second lies behind it; 0 for a leaf), radius and sum."""

    def __init__(self, vectors: np.ndarray, lo: np.ndarray, hi: np.ndarray, below: np.ndarray, radius: np.ndarray, sums: np.ndarray):
        self.vectors, self.lo, self.hi, self.below, self.radius, self.sums = vectors, lo, hi, below, radius, sums

    @classmethod
    def build(cls, vectors: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
        """The tree, and the order into which it puts the vectors."""
        order = np.arange(len(vectors))
        lo, hi, below, radius, sums = [0], [len(vectors)], [0], [0.0], []
        node = 0
        while node < len(lo):
            own = order[lo[node]:hi[node]]
            held = vectors[own]
            sums.append(held.sum(axis=0))
            apart = held - sums[-1] / len(held)
            far = np.einsum("ij,ij->i", apart, apart)
            radius[node] = float(np.sqrt(far.max())) * (1 + _MARGIN)
            # A ball of equal vectors stays a leaf of any size. Else the half nearer to the vector farthest from the centre parts from the other.
            if len(own) > leaf and (held != held[0]).any():
                away = held - held[far.argmax()]
                near = np.einsum("ij,ij->i", away, away).argsort(kind="stable")
                order[lo[node]:hi[node]] = own[near]
                mid = lo[node] + len(own) // 2
                below[node] = len(lo)
                lo += [lo[node], mid]
                hi += [mid, hi[node]]
                below += [0, 0]
                radius += [0.0, 0.0]
            node += 1
        return cls(vectors[order], np.array(lo), np.array(hi), np.array(below), np.array(radius), np.array(sums)), order

    def walk(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int | np.ndarray, np.ndarray | None]]:
        """(from, to, centroid, sum) for each ball that goes whole, and (from, to, centroids of its vectors, None) for each leaf."""
        counts = (self.hi - self.lo)[:, None]
        centres = self.sums / counts
        reach = np.sqrt(((centres[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2))
        slack = self.radius[:, None] + (reach + np.abs(centres).max(axis=1, keepdims=True)) * _MARGIN
        nearest, farthest = reach - slack, reach + slack
        todo = [(0, np.arange(len(centroids)))]
        while todo:
            node, left = todo.pop()
            left = left[nearest[node, left] <= farthest[node, left].min()]
            a, b = int(self.lo[node]), int(self.hi[node])
            if len(left) == 1:
                yield a, b, int(left[0]), self.sums[node]
            elif self.below[node]:
                todo += [(int(self.below[node]) + 1, left), (int(self.below[node]), left)]
            else:
                held = self.vectors[a:b]
                yield a, b, left[np.stack([_squares(held, centroids[c]) for c in left]).argmin(axis=0)], None


def _squares(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart)


def _plant(batches: Iterable[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("vec_id", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("vectors", "lo", "hi", "below", "radius", "sums"))])
    for whole in batches:
        for at in range(0, len(whole), trees.size):
            batch = whole.slice(at, trees.size)
            vectors = batch.column(1).flatten().to_numpy().reshape(len(batch), trees.dim)
            tree, order = Tree.build(vectors, trees.leaf)
            ids = batch.column(0).take(pa.array(order))
            parts = [tree.vectors.astype(np.int32), tree.lo.astype(np.int32), tree.hi.astype(np.int32), tree.below.astype(np.int32), tree.radius, tree.sums]
            row = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in parts)]
            yield pa.RecordBatch.from_arrays(row, schema=schema)


def _read(batch: pa.RecordBatch, row: int, dim: int) -> Tree:
    def part(i: int, kind: type) -> np.ndarray:
        return np.frombuffer(batch.column(i)[row].as_buffer(), kind)

    return Tree(part(1, np.int32).astype(np.int64).reshape(-1, dim), part(2, np.int32), part(3, np.int32), part(4, np.int32), part(5, np.float64), part(6, np.int64).reshape(-1, dim))


def _total(centroids: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k, dim = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for row in range(len(batch)):
                tree = _read(batch, row, dim)
                for a, b, to, total in tree.walk(centroids):
                    if total is not None:
                        counts[to] += b - a
                        sums[to] += total
                    else:
                        counts += np.bincount(to, minlength=k)
                        np.add.at(sums, to, tree.vectors[a:b])
        seen = np.flatnonzero(counts)
        cluster, component = np.repeat(seen, dim), np.tile(np.arange(dim), len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(component.astype(np.int32)), pa.array(counts[cluster]), pa.array(sums[seen].ravel())], ["cluster", "component", "n", "total"])

    return run


def _assign(centroids: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                tree = _read(batch, row, centroids.shape[1])
                cluster = np.empty(len(tree.vectors), np.int32)
                for a, b, to, _ in tree.walk(centroids):
                    cluster[a:b] = to
                ids = batch.column(0).slice(row, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(_squares(tree.vectors, centroids[cluster]))], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, trees: Trees | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    trees = trees or Trees()
    spark = vectors.sparkSession
    rows = integers(vectors, trees)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    now = [list(r["q"]) for r in first]
    planted = stage(spark, rows.mapInArrow(lambda batches: _plant(batches, trees), _TREE), "trees")
    for _ in range(rounds if now else 0):
        found = planted.mapInArrow(_total(np.array(now, np.int64)), "cluster int, component int, n long, total long").groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        for r in found.collect():  # a row for each centroid and component
            now[r["cluster"]][r["component"]] = int(r["total"]) // r["n"]
    centroids = np.array(now, np.int64).reshape(len(now), trees.dim)
    assigned = stage(spark, planted.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    marks = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for c, d in inertia.items()]
    of = spark.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 16, rounds: int = 3, seed: int = 1, dim: int = 64) -> str:
    """The same by comparing all vectors with all centroids, in DuckDB's SQL."""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings "
        f"WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM kept ORDER BY h, q LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"a{n} AS MATERIALIZED (SELECT i, vec_id, q, c, d FROM (SELECT i, vec_id, k.q, c, list_sum(list_transform(range(1, {dim + 1}), lambda j: (k.q[j] - m.q[j]) * (k.q[j] - m.q[j]))) AS d FROM kept k CROSS JOIN c{n} m) "
            "QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, c) = 1)"
        )
        if n < rounds:
            parts.append(
                f"c{n + 1} AS MATERIALIZED (SELECT m.c, coalesce(g.q, m.q) AS q FROM c{n} m LEFT JOIN (SELECT c, list(f ORDER BY j) AS q FROM (SELECT c, j, (s - ((s % n) + n) % n) // n AS f "
                f"FROM (SELECT c, j, CAST(sum(q[j]) AS BIGINT) AS s, count(*) AS n FROM a{n} CROSS JOIN (SELECT unnest(range(1, {dim + 1})) AS j) GROUP BY c, j)) GROUP BY c) g USING (c))"
            )
    return (
        "WITH " + ", ".join(parts) + f" SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(m.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} m ON a.c = m.c"
    )
