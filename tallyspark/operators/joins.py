"""Joins that Spark has no single operator for: as-of, range, spatial, point in polygon, names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.functions import listing as L

#: Rows of one value that meet as one piece, and the least number of tasks that make pairs.
PIECE, SPREAD = 4096, 96


def overlay(listings: DataFrame, state: DataFrame, score: DataFrame, user: str) -> DataFrame:
    """Listings with one user's state and score, null where there is none."""
    own = lambda df: df.where(F.col("user_id") == user).drop("user_id").withColumnRenamed("listing_id", "id")
    return listings.join(own(state), "id", "left").join(own(score), "id", "left")


def as_of(events: DataFrame, runs: DataFrame, key: str, event_id: str, at: str, run_id: str = "id", start: str = "started_at", end: str = "finished_at", grain: int = 3600) -> DataFrame:
    """(event_id, run): the first run of the key that holds the event's moment, else the latest that began before, else null.

    Holding is an equi-join on time buckets of ``grain`` seconds, which a run enters as often as it lasts; the latest start
    is a running last value over both sides in one order. No key's pairs are made.
    """
    bucket = lambda c: F.floor(F.unix_seconds(c) / grain)
    seen = events.select(F.col(key).alias("k"), F.col(at).alias("t"), F.col(event_id).alias("e"))
    began = runs.select(F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("f"), F.col(run_id).alias("r"))
    spread = began.withColumn("b", F.explode(F.sequence(bucket(F.col("s")), bucket(F.greatest("s", "f")))))
    held = seen.withColumn("b", bucket(F.col("t"))).join(spread, ["k", "b"]).where("s <= t and t <= f").groupBy("e").agg(F.min_by("r", F.struct("s", "r")).alias("held"))
    both = began.select("k", F.col("s").alias("t"), F.lit(0).alias("side"), "r", F.lit(None).cast(seen.schema["e"].dataType).alias("e"))
    both = both.unionByName(seen.select("k", "t", F.lit(1).alias("side"), F.lit(None).cast(began.schema["r"].dataType).alias("r"), "e"))
    past = Window.partitionBy("k").orderBy("t", "side", "r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = both.withColumn("last", F.last("r", ignorenulls=True).over(past)).where("side = 1").select("e", "last")
    return last.join(held, "e", "left").select(F.col("e").alias(event_id), F.coalesce("held", "last").alias("run"))


def _met(left: DataFrame, right: DataFrame, pairs: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """Rows of both sides whose values ``a`` and ``b`` are one of ``pairs``, each pair of different values once: equi-joins, without another condition.

    What a pair costs is thus paid for values and not for their copies. A value's rows on the left are dealt into pieces of some ``PIECE`` rows,
    each of which the right side enters, so that a value with very many rows is no single task and no more than a piece is held.
    """
    sizes = left.groupBy(*a).agg(F.ceil(F.count("*") / PIECE).alias("__n"))
    dealt = left.join(sizes, a).withColumn("__p", F.pmod(F.xxhash64(*left.columns), F.col("__n"))).drop("__n")
    reached = right.join(pairs.join(sizes, a), b).withColumn("__p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n")
    # As many tasks as given, since a few bytes of rows can make very many pairs.
    n = max(SPREAD, 8 * left.sparkSession.sparkContext.defaultParallelism)
    return reached.repartition(n, *a, "__p").join(dealt.repartition(n, *a, "__p"), [*a, "__p"])


def in_range(left: DataFrame, right: DataFrame, a: str, b: str, absolute: float, ratio: float, keys: list[str]) -> DataFrame:
    """Pairs with equal keys whose numbers differ by at most ``absolute`` or ``ratio`` of the larger: an equi-join on logarithmic buckets.

    Buckets are as wide as the tolerance: ``absolute`` for small numbers, a constant ratio for large ones. Two numbers in tolerance thus lie in the same or in
    neighbouring buckets; the right side enters its neighbours too, at the change of scale those of both scales, and the exact condition is checked.
    Different numbers meet so, each once; their rows follow by equality.
    """
    width = F.log(F.lit(1 / (1 - ratio)))
    turn = absolute / ratio
    linear = lambda x: F.concat(F.lit("a"), F.floor(x / absolute).cast("string"))
    scaled = lambda x: F.concat(F.lit("r"), F.floor(F.log(x) / width).cast("string"))
    bucket = lambda x: F.when(x < turn, linear(x)).otherwise(scaled(x))
    x = F.col(b)
    close = F.abs(x - turn) <= 2 * absolute / (1 - ratio)
    points = [bucket(p) for p in (x, F.greatest(x - absolute, F.lit(0.0)), x + absolute, x * (1 - ratio), x / (1 - ratio))]
    points += [F.when(close, linear(F.lit(turn))), F.when(close, linear(F.lit(turn * (1 - 1e-9)))), F.when(close, scaled(F.lit(turn * (1 + 1e-9))))]
    l = left.select(*keys, a).distinct().withColumn("__b", bucket(F.col(a)))
    r = right.select(*keys, b).distinct().withColumn("__b", F.explode(F.array_distinct(F.array_compact(F.array(*points)))))
    pairs = l.join(r, [*keys, "__b"]).where(L.within(F.col(a), F.col(b), absolute, ratio)).drop("__b")
    others = [c for df in (left, right) for c in df.columns if c not in keys]
    return _met(left, right, pairs, [*keys, a], [*keys, b]).select(*keys, *others)


def near(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Pairs of (id, lat, lon) and (id2, lat2, lon2) at most ``km`` apart: an equi-join on a grid with the neighbouring cells.

    Bands of latitude are a little higher than ``km``. Each band has its own cells of longitude, wide enough at the highest latitude that
    a pair with one end in it can reach, and closed around the globe; near a pole a band is one cell. A place on the right enters
    the cells of three bands, so every pair of places meets exactly once; their rows follow by equality.
    """
    size = math.degrees(km / 6371) * 1.01
    band = lambda lat: F.floor(lat / size)
    top = lambda b: F.greatest(F.abs(b * size), F.abs((b + 1) * size)) + size
    reach = lambda b: F.lit(math.sin(km / 2 / 6371)) / F.cos(F.radians(top(b)))
    wide = lambda b: F.when((top(b) >= 90) | (reach(b) >= 1), F.lit(360.0)).otherwise(F.degrees(2 * F.asin(F.least(F.abs(reach(b)), F.lit(1.0)))) * 1.01)
    cells = lambda b: F.greatest(F.floor(360 / wide(b)), F.lit(1))
    cell = lambda lon, n: F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) * n / 360), n - 1)
    l = left.select("lat", "lon").distinct().withColumn("__y", band(F.col("lat"))).withColumn("__x", cell(F.col("lon"), cells(F.col("__y"))))
    r = right.select("lat2", "lon2").distinct().withColumn("__y", F.explode(F.sequence(band(F.col("lat2")) - 1, band(F.col("lat2")) + 1))).withColumn("__n", cells(F.col("__y")))
    around = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.pmod(cell(F.col("lon2"), F.col("__n")) + d, F.col("__n")))
    r = r.withColumn("__x", F.explode(F.array_distinct(around))).drop("__n")
    pairs = l.join(r, ["__y", "__x"]).drop("__y", "__x").withColumn("km", L.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where(F.col("km") <= km)
    return _met(left, right, pairs, ["lat", "lon"], ["lat2", "lon2"]).select(*left.columns, *right.columns, "km")


def one_edit_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: int = 6) -> DataFrame:
    """Pairs whose words, of ``least`` letters or more, are at most one edit apart: an equi-join on the words with one letter left out, or none.

    Two words one edit apart always share such a form; a word has one for each of its letters, so nothing grows with the number of words.
    """
    def forms(c: str) -> Column:
        x = F.col(c)
        cut = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        return F.explode(F.array_distinct(F.concat(F.array(x), cut)))

    l, r = (df.where(F.length(c) >= least).withColumn("__form", forms(c)) for df, c in ((left, a), (right, b)))
    return l.join(r, "__form").where(F.levenshtein(F.col(a), F.col(b)) <= 1).drop("__form").distinct()


def inside_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd ray test of a point against a closed ring."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + F.when(hit, 1).otherwise(0)
    return crossings % 2 == 1


def district_at(x: Column, y: Column, shapes: dict[str, list[list[list[tuple[float, float]]]]]) -> Column:
    """The only shape that holds a point, else null; a shape is polygons of an outer ring and holes."""
    names = []
    for name, polygons in shapes.items():
        held = F.lit(False)
        for outer, *holes in polygons:
            part = inside_ring(x, y, outer)
            for hole in holes:
                part = part & ~inside_ring(x, y, hole)
            held = held | part
        names.append(F.when(held, F.lit(name)))
    found = F.array_compact(F.array(*names))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def not_in(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """SQL's NOT IN: empty when the right side has a null; null keys are never kept unless the right side is empty."""
    return left.sparkSession.sql(f"SELECT * FROM {{l}} WHERE {key} NOT IN (SELECT {other} FROM {{r}})", l=left, r=right)


def latest(rows: DataFrame, key: str, at: str, tie: str, n: int = 1) -> DataFrame:
    """The latest ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
