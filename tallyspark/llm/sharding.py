"""Sharding (operator 7) by balanced label propagation, under the law ``rows``: counts at most one apart.

Documents start in the shard of their hash. Documents with equal texts are linked. The linked documents
of a group in a shard form cells, small against a shard's quota; in every round a group's cells vote, and cells elsewhere
ask to move to the shard with the most votes among those with room. Requests are
granted in a fixed order while the quota lasts. Documents without links fill the quotas at the end, exactly. Groups move
as aggregated cells. The size of a group of over a ``HEAVY``-th of all rows, of which there are fewer than ``HEAVY``, is broadcast to its documents, so no
hot group meets in one task; links are pairs of equal texts and are never written out.

Defined results: null text has no bytes, counts as equal to the empty text, and has crc32 0; null ids are placed like
others; rows with the same id are rows of their own; ties go to the smaller shard; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.prefix import running_total
from tallyspark.session import stage, unstage

#: Cells of a hot group in a shard are at most about this part of a quota.
GRAIN = 64
#: Groups over this part of all rows are heavy.
HEAVY = 4096


def _by_shard(values: dict[int, int], shard: Column) -> Column:
    """A value for each shard, of which there are few, as an expression."""
    pairs = [x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(v).cast("long"))]
    return F.coalesce(F.create_map(*pairs)[shard], F.lit(0).cast("long"))


def _loads(df: DataFrame, value: Column, shards: int) -> dict[int, int]:
    found = {r["shard"]: int(r["n"]) for r in df.groupBy("shard").agg(F.sum(value).alias("n")).collect()}
    return {s: found.get(s, 0) for s in range(shards)}


def propagate(cells: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """``cells`` (grp, sub, home, n, shard) with shards moved towards the other cells of their group, within ``quotas``.

    It ends when nothing moves: what moves goes where its group has as many rows or more, so the sum of squares of a group's rows by shard grows with every move, and has a bound.
    """
    spark = cells.sparkSession
    cells = held = stage(spark, cells, "cells")
    while True:
        loads = _loads(cells, F.col("n"), len(quotas))
        room = {s: max(0, quotas[s] - loads[s]) for s in quotas}
        votes = cells.groupBy("grp", "shard").agg(F.sum("n").alias("votes"), F.max("n").alias("largest"))
        # A shard is open to a group while the largest of its cells fits: so the first that asks is granted, and a shard that is almost full isn't asked for ever.
        here = F.collect_list(F.struct("votes", (-F.col("shard")).alias("low"), _by_shard(room, F.col("shard")).alias("room"), "largest"))
        best = F.array_max(F.filter("here", lambda v: v["room"] >= F.array_max(F.transform("here", lambda w: w["largest"]))))
        aims = votes.groupBy("grp").agg(here.alias("here")).select("grp", best.alias("best")).where("best is not null").select("grp", (-F.col("best.low")).alias("aim"), F.col("best.votes").alias("aim_votes"))
        votes = votes.drop("largest")
        asked = cells.join(votes, ["grp", "shard"]).join(aims, "grp").where((F.col("aim") != F.col("shard")) & (F.col("aim_votes") >= F.col("votes")))
        asked = running_total(asked.select("grp", "sub", "home", "n", "aim"), ["aim"], ["grp", "sub", "home"], F.col("n"), "ahead", ["grp"])
        moves = asked.where(F.col("ahead") + F.col("n") <= _by_shard(room, F.col("aim"))).select("grp", "sub", "home", "aim")
        cells = cells.join(moves, ["grp", "sub", "home"], "left").select("grp", "sub", "home", "n", F.coalesce("aim", "shard").alias("shard"), F.col("aim").isNotNull().alias("moved"))
        last, cells = held, stage(spark, cells, "cells")
        held = cells
        unstage(spark, last)
        moved = cells.where("moved").agg(F.sum("n")).first()[0]
        cells = cells.drop("moved")
        if not moved:
            break
    return cells


def _settle(rows: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """Moves exactly the surplus of every shard, documents without links first, into the shards that lack rows."""
    shards = len(quotas)
    loads = _loads(rows, F.lit(1), shards)
    free = _loads(rows, F.when(F.col("linked"), 0).otherwise(1), shards)
    over = {s: max(0, loads[s] - quotas[s]) for s in quotas}
    if not sum(over.values()):
        return rows
    base, at = {}, 0
    for s in range(shards):
        base[s] = at
        at += over[s]
    ranked = running_total(rows, ["shard", "linked"], ["doc_id", "grp", "copy"], F.lit(1), "rank")
    rank = F.col("rank") + F.when(F.col("linked"), _by_shard(free, F.col("shard"))).otherwise(F.lit(0))
    pool = _by_shard(base, F.col("shard")) + rank
    to, at = F.lit(None).cast("int"), 0
    for s in range(shards):
        need = max(0, quotas[s] - loads[s])
        to = F.when((pool >= at) & (pool < at + need), F.lit(s)).otherwise(to)
        at += need
    moving = rank < _by_shard(over, F.col("shard"))
    return ranked.withColumn("shard", F.when(moving, to).otherwise(F.col("shard"))).drop("rank")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row's doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("grp"),
    )
    rows = stage(spark, rows.withColumn("at", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    # Rows alike in id and text, where they are more than a HEAVY-th of all, are told apart by their place, so that they needn't keep together; there are fewer than HEAVY such kinds.
    alike = rows.groupBy("doc_id", "grp").agg(F.count("*").alias("n")).where(F.col("n") > max(total / HEAVY, GRAIN)).select(F.col("doc_id").alias("same_id"), F.col("grp").alias("same_grp"))
    rows = rows.join(F.broadcast(alike), F.col("doc_id").eqNullSafe(F.col("same_id")) & (F.col("grp") == F.col("same_grp")), "left")
    rows = rows.withColumn("copy", F.when(F.col("same_grp").isNotNull(), F.col("at")).otherwise(F.lit(0))).drop("at", "same_id", "same_grp")
    rows = rows.withColumn("home", F.pmod(F.xxhash64("doc_id", "grp", "copy"), F.lit(shards)).cast("int"))
    quotas = {s: total // shards + (s < total % shards) for s in range(shards)}
    groups = rows.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1")
    grain = max(1, total // shards // GRAIN)
    groups = stage(spark, groups, "groups")
    heavy = F.broadcast(groups.where(F.col("members") > total / HEAVY))
    hot = rows.join(heavy, "grp")
    cold = rows.join(heavy.select("grp"), "grp", "left_anti").join(groups.where(F.col("members") <= total / HEAVY), "grp", "left")
    linked = hot.unionByName(cold).withColumn("linked", F.col("members").isNotNull())
    linked = linked.withColumn("sub", F.when(F.col("linked"), F.pmod(F.xxhash64("doc_id", "copy", F.lit(7)), F.ceil(F.col("members") / F.lit(grain * shards)))).otherwise(F.lit(0)).cast("int")).drop("members")
    linked = stage(spark, linked, "linked")
    cells = linked.where("linked").groupBy("grp", "sub", "home").agg(F.count("*").alias("n")).withColumn("shard", F.col("home"))
    cells = propagate(cells, quotas).select("grp", "sub", "home", "shard")
    placed = linked.join(cells, ["grp", "sub", "home"], "left").withColumn("shard", F.coalesce("shard", "home")).drop("sub", "home")
    settled = _settle(stage(spark, placed, "placed"), quotas)
    out = running_total(stage(spark, settled, "settled"), ["shard"], ["doc_id", "grp", "copy"], F.lit(1), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
