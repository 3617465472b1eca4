"""Aggregations: totals, survival, roll-ups, histograms, coverage, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.functions import listing as L
from tallyspark.functions import text as T
from tallyspark.session import stage


def count_if(c: Column) -> Column:
    """Rows for which a condition holds; no rows: 0."""
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def totals(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row of conditional counts."""
    return rows.agg(*[count_if(c).alias(k) for k, c in conditions.items()])


def _attach(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``few``, by keys of which some may be null."""
    renamed = few.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in few.columns if c not in keys])
    return rows.join(renamed, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]).drop(*[f"__k_{k}" for k in keys])


def survival(rows: DataFrame, days: str = "days", ended: str = "ended", keys: tuple[str, ...] = ()) -> DataFrame:
    """Kaplan-Meier: for each time with an end (keys, day, at_risk, deaths, share, horizon); the horizon is the longest life seen.

    Lifetimes are counted by time first. Times are then sorted over ranges; each range gives one row of totals, along which the numbers at risk and the
    shares are carried, so that neither fractions of days nor a long curve meet in one task.
    """
    spark = rows.sparkSession
    fine = rows.where(F.col(days).isNotNull() & ~F.isnan(days) & (F.col(days) >= 0) & (F.col(days) < float("inf")))
    daily = fine.groupBy(*keys, F.col(days).alias("day")).agg(F.count("*").alias("n"), count_if(F.col(ended)).alias("deaths"))
    daily = stage(spark, daily.repartitionByRange("day").withColumn("__part", F.spark_partition_id()), "lives")
    part = [*keys, "__part"]
    after = Window.partitionBy(*keys).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = daily.groupBy(*part).agg(F.sum("n").alias("__n"), F.max("day").alias("__last"))
    totals = totals.withColumn("__later", F.coalesce(F.sum("__n").over(after), F.lit(0))).withColumn("horizon", F.max("__last").over(Window.partitionBy(*keys))).drop("__n", "__last")
    both = _attach(daily, totals, part)
    rest = Window.partitionBy(*part).orderBy(F.desc("day"))
    risk = both.withColumn("at_risk", F.sum("n").over(rest) + F.col("__later")).where("deaths > 0").withColumn("__kept", 1 - F.col("deaths") / F.col("at_risk"))
    within = risk.withColumn("__share", F.product("__kept").over(Window.partitionBy(*part).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = risk.groupBy(*part).agg(F.product("__kept").alias("__all")).withColumn("__before", F.coalesce(F.product("__all").over(before), F.lit(1.0))).drop("__all")
    out = _attach(within, carried, part)
    return out.select(*keys, "day", "at_risk", "deaths", (F.col("__before") * F.col("__share")).alias("share"), "horizon")


def share_alive(curve: DataFrame, at: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``at`` (keys, t) with ``share``: the curve's step at t; 1 before its first end, null past its horizon or without a curve.

    A key's curve becomes one sorted array of its ends, which each t searches; times asked for are few, as those of a report.
    """
    steps = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "share"))).alias("__steps"), F.max("horizon").alias("__horizon"))
    both = at.join(steps, list(keys), "left") if keys else at.join(F.broadcast(steps))  # one row
    last = F.element_at(F.filter("__steps", lambda s: s["day"] <= F.col("t")), -1)["share"]
    known = F.col("__steps").isNotNull() & (F.col("t") <= F.col("__horizon"))
    reached = F.exists("__steps", lambda s: s["day"] <= F.col("t"))
    return both.withColumn("share", F.when(known & reached, last).when(known, F.lit(1.0))).drop("__steps", "__horizon")


def median_survival(curve: DataFrame) -> DataFrame:
    """The first day on which at most half are left."""
    return curve.where("share <= 0.5").agg(F.min("day").alias("median"))


def lifetimes(occurrences: DataFrame, stock: int = 15) -> DataFrame:
    """(source_id, days, ended) of occurrences that weren't there from the start: not of the source's first day, nor of a batch over ``stock``."""
    day = F.to_date("first_seen")
    first = F.min(day).over(Window.partitionBy("source_id"))
    batch = F.count("*").over(Window.partitionBy("source_id", "first_seen"))
    rows = occurrences.withColumn("__first", first).withColumn("__batch", batch).where((day > F.col("__first")) & (F.col("__batch") <= stock))
    days = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 86_400e6
    return rows.select("source_id", days.alias("days"), (F.col("lifecycle") == "inactive").alias("ended"))


def spellings(rows: DataFrame, name: str = "agency") -> DataFrame:
    """(key, name): the most frequent spelling of each folded name, upper-case ones last, then the smaller."""
    counted = rows.where(F.col(name).isNotNull()).groupBy(T.agency_key(F.col(name)).alias("key"), F.col(name).alias("name")).agg(F.count("*").alias("n"))
    upper = F.when(F.col("name") == F.upper("name"), 1).otherwise(0)
    return counted.groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), upper, F.col("name"))).alias("name"))


def agencies(rows: DataFrame) -> DataFrame:
    """Agencies: name, listings, sources as a sorted list, last sight.

    Rows are combined by spelling and source first, so that a spelling's key is worked out once and not for each row; the spellings, staged as they are read twice, then give the listings their keys.
    """
    named = rows.where(F.col("agency").isNotNull())
    seen = named.groupBy("agency", "source_id").agg(F.count("*").alias("n"), F.max("last_seen").alias("last_seen"))
    spelled = seen.groupBy("agency").agg(F.sum("n").alias("n"), F.collect_list("source_id").alias("s"), F.max("last_seen").alias("last_seen"))
    spelled = stage(rows.sparkSession, spelled.withColumn("key", T.agency_key(F.col("agency"))), "spellings")
    upper = F.when(F.col("agency") == F.upper("agency"), 1).otherwise(0)
    sources = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))), ",")
    sums = spelled.groupBy("key").agg(F.min_by("agency", F.struct(-F.col("n"), upper, F.col("agency"))).alias("name"), sources.alias("sources"), F.max("last_seen").alias("last_seen"))
    listings = named.select("agency", "group_id").join(spelled.select("agency", "key"), "agency").groupBy("key").agg(F.count_distinct("group_id").alias("listings"))
    return sums.join(listings, "key").select("key", "name", "listings", "sources", "last_seen")


def histogram(rows: DataFrame, column: str, low: int, high: int, step: int) -> DataFrame:
    """(bucket, n): counts by steps from low to high, values beyond them in the first and last bucket, empty ones kept."""
    b = F.least(F.greatest((F.floor((F.col(column) - low) / step) * step + low).cast("int"), F.lit(low)), F.lit(high))
    counts = rows.where(F.col(column).isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    spine = rows.sparkSession.range(low, high + 1, step).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def with_zeroes(spine: DataFrame, counts: DataFrame, key: str, value: str) -> DataFrame:
    """Every key of the spine with its count, or zero."""
    return spine.join(counts, key, "left").select(key, F.coalesce(value, F.lit(0)).cast("long").alias(value))


def fill_matrix(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Known values for each key and field, and rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *[F.count(f).alias(f"n_{f}") for f in fields])


def vanish_rates(rows: DataFrame, since: Column, confirmed: int = 3, batch: int = 3) -> DataFrame:
    """(source_id, retired, vanished): retired after ``confirmed`` missed runs; vanished if also seen once, in a small batch of new ones."""
    fresh = rows.where(F.col("first_seen") >= since).withColumn("batch", F.count("*").over(Window.partitionBy("source_id", "first_seen")))
    retired = F.col("missing_runs") >= confirmed
    return fresh.groupBy("source_id").agg(count_if(retired).alias("retired"), count_if(retired & (F.col("first_seen") == F.col("last_seen")) & (F.col("batch") < batch)).alias("vanished"))


def vanishing(rates: DataFrame, evidence: int = 8, share: float = 0.15, most: int = 3) -> DataFrame:
    """The sources where most listings vanish, three at most."""
    part = F.col("vanished") / F.col("retired")
    return rates.where((F.col("retired") >= evidence) & (part >= share)).withColumn("share", part).orderBy(F.desc("share"), "source_id").limit(most)


def spend(runs: DataFrame, found: DataFrame) -> DataFrame:
    """For each source: passes, requests, discoveries, requests for a discovery (none: null), passes and requests that found nothing.

    ``found`` is (run): the run that each discovery is attributed to.
    """
    hits = found.where("run is not null").groupBy(F.col("run").alias("id")).agg(F.count("*").alias("hits"))
    with_hits = runs.join(hits, "id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    idle = F.col("hits") == 0
    out = with_hits.groupBy("source_id").agg(F.count("*").alias("passes"), F.sum("request_count").cast("long").alias("requests"), F.sum("hits").cast("long").alias("discoveries"), count_if(idle).alias("sterile_passes"), F.coalesce(F.sum(F.when(idle, F.col("request_count"))), F.lit(0)).cast("long").alias("sterile_requests"))
    return out.withColumn("cost", F.when(F.col("discoveries") > 0, F.col("requests") / F.col("discoveries")))


def spend_by(spends: DataFrame, group: Column) -> DataFrame:
    return spends.groupBy(group.alias("grp")).agg(*[F.sum(c).cast("long").alias(c) for c in ("passes", "requests", "discoveries")])


def cadence(starts: DataFrame, key: str = "source_id", at: str = "started_at", gap_s: int = 180, hole_s: int = 1500) -> DataFrame:
    """(key, cycles, median_gap_s, max_gap_s, hole_share) of each key's cycles.

    A start opens a cycle when it is later than the cycle's own first start by ``gap_s``: a fold over the ordered starts, not a session of neighbours. The
    median is the lower one.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        times = sorted(rows[at].astype("int64") // 10**rows_unit(rows[at]))
        heads: list[int] = []
        for t in times:
            if not heads or t - heads[-1] > gap_s:
                heads.append(int(t))
        gaps = sorted(b - a for a, b in zip(heads, heads[1:], strict=False))
        n = len(gaps)
        return pd.DataFrame([(rows[key].iloc[0], len(heads), gaps[(n - 1) // 2] if n else None, gaps[-1] if n else None, sum(g > hole_s for g in gaps) / n if n else None)], columns=[key, "cycles", "median_gap_s", "max_gap_s", "hole_share"])

    def rows_unit(column: pd.Series) -> int:
        return {"ns": 9, "us": 6, "ms": 3, "s": 0}[column.dtype.unit if hasattr(column.dtype, "unit") else str(column.dtype).split("[")[1].split(",")[0].rstrip("]")]

    return starts.select(key, at).groupBy(key).applyInPandas(fold, f"{key} string, cycles long, median_gap_s long, max_gap_s long, hole_share double")


def service(intervals: DataFrame, cycles: int, most: int) -> DataFrame:
    """How much of the demand a day's cycles can serve."""
    demand = F.sum(1440 / F.col("interval_min"))
    return intervals.agg(demand.alias("demand"), F.lit(cycles * most).alias("capacity"), F.least(F.lit(1.0), cycles * most / demand).alias("served"))


def observations(runs: DataFrame, last: int = 3) -> tuple[DataFrame, DataFrame]:
    """New listings by source and day, and the last stop reasons of each source, latest first."""
    daily = runs.groupBy("source_id", F.to_date("started_at").alias("day")).agg(F.sum("new_count").cast("long").alias("n"))
    w = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("id"))
    ranked = runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= last)
    reasons = ranked.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "stop_reason"))), lambda x: x["stop_reason"]), ",").alias("reasons"))
    return daily, reasons


def silent(daily: DataFrame, today: Column, recent: int = 3, before: int = 10, least_days: int = 4, threshold: float = 5) -> DataFrame:
    """Sources whose last observed days brought nothing while the days before brought enough."""
    age = F.date_diff(today, F.col("day"))
    new, old = (age >= 0) & (age < recent), (age >= recent) & (age < recent + before)
    out = daily.groupBy("source_id").agg(count_if(new).alias("days"), F.coalesce(F.sum(F.when(new, F.col("n"))), F.lit(0)).alias("fresh"), count_if(old).alias("old_days"), F.coalesce(F.median(F.when(old, F.col("n"))), F.lit(0.0)).alias("usual"))
    return out.where((F.col("days") >= 2) & (F.col("fresh") == 0) & (F.col("old_days") >= least_days) & (F.col("usual") * 3 >= threshold)).select("source_id", "usual")


def interrupted(reasons: DataFrame, broken: tuple[str, ...] = ("error", "blocked"), n: int = 3) -> DataFrame:
    parts = F.split("reasons", ",")
    return reasons.where((F.size(parts) == n) & F.forall(parts, lambda r: r.isin(*broken))).select("source_id")


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, weight: float = 0.3) -> DataFrame:
    """(key, average): an exponential mean in order, rounded to two decimals at every step, from zero."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v")))), lambda x: x["v"])
    return rows.groupBy(key).agg(F.aggregate(ordered, F.lit(0.0), lambda a, v: L.half_up((a * (1 - weight) + v * weight) * 100) / 100).alias("average"))


def grid(rows: DataFrame, x: Column, y: Column, cell: float) -> DataFrame:
    """(cx, cy, n, x, y): points by square cells, with their means."""
    return rows.select(F.floor(x / cell).alias("cx"), F.floor(y / cell).alias("cy"), x.alias("px"), y.alias("py")).groupBy("cx", "cy").agg(F.count("*").alias("n"), F.avg("px").alias("x"), F.avg("py").alias("y"))


def affinity(rows: DataFrame, features: Column, weight: Column, least: int = 2) -> DataFrame:
    """(id, affinity): the positive feature weights that a listing shares with those acted upon, in hundredths of the best; with too few liked ones, 0."""
    held = rows.select("id", F.explode(F.array_distinct(features)).alias("feature"), weight.alias("w"))
    weights = held.groupBy("feature").agg(F.sum("w").alias("total"))
    sums = held.select("id", "feature").join(weights, "feature").groupBy("id").agg(F.sum(F.greatest("total", F.lit(0))).alias("s"))
    liked = rows.agg(count_if(weight > 0).alias("liked"))
    top = sums.agg(F.max("s").alias("top"))
    return sums.withColumn("liked", liked.scalar()).withColumn("top", top.scalar()).select("id", F.when((F.col("liked") >= least) & (F.col("top") > 0), F.col("s") / F.col("top")).otherwise(0.0).alias("affinity"))


def signature(columns: dict[str, DataFrame], text: str) -> DataFrame:
    """A short digest of the latest changes of some tables and the query's text."""
    first, *rest = [df.agg(F.max(c).alias("m")) for c, df in columns.items()]
    values = [first, *rest]
    parts = [F.coalesce(v.scalar().cast("string"), F.lit("-")) for v in values]
    return first.sparkSession.range(1).select(F.substring(F.sha2(F.concat_ws("|", *parts, F.lit(text)), 256), 1, 32).alias("etag"))


def faded_fields(observed: DataFrame, least_older: int = 10, least_recent: int = 5, usual: float = 0.8) -> DataFrame:
    """Fields that a source used to fill and no longer does. ``observed``: source_id, field, older, older_filled, recent, recent_filled."""
    told = (F.col("older") >= least_older) & (F.col("recent") >= least_recent)
    return observed.where(told & (F.col("older_filled") / F.col("older") >= usual) & (F.col("recent_filled") == 0)).select("source_id", "field", L.half_up(F.col("older_filled") / F.col("older") * 100).cast("int").alias("before_pct"))


def field_fill(rows: DataFrame, fields: list[str], since: Column) -> DataFrame:
    """source_id, field, older, older_filled, recent, recent_filled: how often fields were known before and from ``since``; one row a field."""
    recent = F.col("first_seen") >= since
    counts = [c for f in fields for c in (count_if(~recent & F.col(f).isNotNull()).alias(f"{f}_o"), count_if(recent & F.col(f).isNotNull()).alias(f"{f}_r"))]
    out = rows.groupBy("source_id").agg(count_if(~recent).alias("older"), count_if(recent).alias("recent"), *counts)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_o").alias("older_filled"), F.col(f"{f}_r").alias("recent_filled")) for f in fields])
    return out.select("source_id", "older", "recent", F.inline(each)).select("source_id", "field", "older", "older_filled", "recent", "recent_filled")


def active_stock(rows: DataFrame) -> DataFrame:
    """(source_id, active): living occurrences of each source."""
    return rows.groupBy("source_id").agg(count_if(F.col("lifecycle") == "active").alias("active"))


def agency_detail(listings: DataFrame, occurrences: DataFrame, name: str, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(listings of the agency, latest first, at most 200; its contacts: the largest known telephone and address of mail)."""
    own = occurrences.where(T.agency_key(F.col("agency")) == T.agency_key(F.lit(name)))
    rows = listings.join(own.select(F.col("group_id").alias("id")).distinct(), "id", "left_semi").orderBy(F.desc("last_seen"), "id").limit(most)
    return rows, own.agg(F.max("phone").alias("phone"), F.max("email").alias("email"))


def alerts_per_token(rows: DataFrame) -> DataFrame:
    """(token, n): relayed advertisements for each recipient's token in a batch."""
    return rows.where(F.col("token").isNotNull()).groupBy("token").agg(F.count("*").alias("n"))


def budget_report(runs: DataFrame, found: DataFrame, since: Column, cycles: int, most: int) -> DataFrame:
    """Spend, cadence and served share of each source's runs since a moment."""
    recent = runs.where(F.col("started_at") >= since)
    spent, paced = spend(recent, found), cadence(recent)
    out = spent.join(paced, "source_id", "left")
    demand = out.agg(F.sum(F.when(F.col("median_gap_s") > 0, 86_400 / F.col("median_gap_s"))).alias("demand"))
    return out.withColumn("served", F.least(F.lit(1.0), cycles * most / demand.scalar()))


def trailing(rows: DataFrame, key: str, at: str, seconds: int) -> Column:
    """Rows of the key in the seconds before this one, itself included."""
    return F.count("*").over(Window.partitionBy(key).orderBy(F.unix_seconds(at)).rangeBetween(-seconds, 0))
