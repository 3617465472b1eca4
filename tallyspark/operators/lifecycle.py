"""Change history, upserts, and the states of occurrences and sources over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.functions import listing as L


def content_hash(columns: list[str]) -> Column:
    """A digest of business fields; timestamps are left out by the caller."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def change(old: Column | None, new: Column, known: Column) -> Column:
    """baseline, price-drop, price-rise or null for a price seen after another."""
    return F.when(~known, "baseline").when(new < old, "price-drop").when(~new.eqNullSafe(old), "price-rise")


def history(rows: DataFrame, key: str, at: str, tie: str, price: str = "price", area: str | None = None) -> DataFrame:
    """One row for every change of a key: change, old and new price; several changes at once are ``multiple``."""
    w = Window.partitionBy(key).orderBy(at, tie)
    seen = rows.withColumn("__n", F.row_number().over(w)).withColumn("old_price", F.lag(price).over(w))
    first = F.col("__n") == 1
    parts = [F.when(first, "baseline").otherwise(change(F.col("old_price"), F.col(price), F.lit(True)))]
    if area:
        seen = seen.withColumn("old_area", F.lag(area).over(w))
        parts.append(F.when(~first & ~F.col(area).eqNullSafe(F.col("old_area")), "area"))
    kinds = F.array_compact(F.array(*parts))
    seen = seen.withColumn("change", F.when(F.size(kinds) > 1, "multiple").otherwise(F.get(kinds, F.lit(0))))
    return seen.where("change is not null").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], hash_col: str = "hash") -> DataFrame:
    """The table after a batch: unseen keys inserted, equal ones touched (last_seen, no missing runs, active), changed ones overwritten but for first_seen.

    ``outcome`` tells inserted, updated, unchanged or absent.
    """
    names = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*names).alias("o"))
    n = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("n"))
    both = o.join(n, keys, "full_outer")
    has_o, has_n = F.col("o").isNotNull(), F.col("n").isNotNull()
    outcome = F.when(~has_o, "inserted").when(~has_n, "absent").when(F.col(f"o.{hash_col}").eqNullSafe(F.col(f"n.{hash_col}")), "unchanged").otherwise("updated")
    def value(c: str) -> Column:
        if c == "first_seen":
            return F.coalesce(F.col("o.first_seen"), F.col("n.first_seen"))
        if c == "missing_runs":
            return F.when(has_n, F.lit(0)).otherwise(F.col("o.missing_runs"))
        if c == "lifecycle":
            return F.when(has_n, F.lit("active")).otherwise(F.col("o.lifecycle"))
        if c == "last_seen":
            return F.when(has_n, F.col("n.last_seen")).otherwise(F.col("o.last_seen"))
        return F.when(F.col("outcome").isin("inserted", "updated"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.withColumn("outcome", outcome).select(*keys, *[value(c).alias(c) for c in names], "outcome")


def mark_missing(rows: DataFrame, seen: DataFrame, key: str, possibly: int = 2, gone: int = 3) -> DataFrame:
    """A missed run more for what wasn't seen; possibly inactive and inactive by the count, never back."""
    marked = rows.join(seen.select(key).distinct().withColumn("__seen", F.lit(True)), key, "left")
    n = F.when(F.col("__seen"), F.col("missing_runs")).otherwise(F.col("missing_runs") + 1)
    state = F.when(F.col("__seen") | (F.col("lifecycle") == "inactive"), F.col("lifecycle")).when(n >= gone, "inactive").when(n >= possibly, "possiblyInactive").otherwise(F.col("lifecycle"))
    return marked.withColumn("lifecycle", state).withColumn("missing_runs", n.cast("int")).drop("__seen")


def expire(rows: DataFrame, now: Column, possibly_days: int = 4, gone_days: int = 10) -> DataFrame:
    """States by age for sources that are read once."""
    age = (F.unix_micros(now) - F.unix_micros("last_seen")) / 86_400e6
    state = F.when(F.col("lifecycle") == "inactive", "inactive").when(age >= gone_days, "inactive").when(age >= possibly_days, "possiblyInactive").otherwise(F.col("lifecycle"))
    return rows.withColumn("lifecycle", state)


def unfounded(known: Column, seen: Column, reason: Column) -> Column:
    """Why a run says nothing about what it didn't see, or null."""
    return F.when(reason.isin("error", "blocked", "cooldown", "tooManyErrors", "notModified", "timeout", "budget", "aborted"), "stopped").when((seen == 0) & (known > 0), "empty").when((known >= 10) & (seen * 2 < known), "collapse")


def withdrawn_trusted(gone: Column, read: Column, reason: Column) -> Column:
    """Whether 404s of a run are believed: it ended well, and not over half of three or more details are gone."""
    return (reason == "completed") & ~((read >= 3) & (gone * 2 > read))


def effective_interval(base: Column, average: Column, errors: Column, most: int = 1440, active: float = 3.0) -> Column:
    """Minutes between runs: shorter for lively sources, three times as long for dormant ones, doubled by each error."""
    lively = F.when(average > 0, base / (1 + average / active)).otherwise(base * 3)
    return F.least(F.greatest(F.when(errors > 0, lively * F.pow(F.lit(2.0), errors)).otherwise(lively), F.lit(5.0)), F.lit(float(most)))


def decide(now: Column, enabled: Column, health: Column, cooldown: Column, last_run: Column, interval: Column) -> Column:
    """Why a source runs or doesn't."""
    waited = (F.unix_micros(now) - F.unix_micros(last_run)) / 60e6
    return F.when(~enabled, "disabled").when(health == "blocked", "blocked").when(cooldown > now, "cooldown").when(last_run.isNull(), "never-run").when(waited >= interval, "due").otherwise("waiting")


def plan_run(rows: DataFrame, most: int = 85) -> DataFrame:
    """Due sources in order: starving ones by how overdue they are, then vanishing, priority, and the longest unrun; the first ``most`` are selected."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("overdue") >= 4, 0).otherwise(1), F.when(F.col("overdue") >= 4, -F.col("overdue")).otherwise(0.0), F.desc("vanishing"), F.desc("priority"), F.col("last_run").asc_nulls_first(), F.col("source_id"))
    return rows.where("decision in ('due', 'never-run')").withColumn("place", F.row_number().over(w)).withColumn("selected", F.col("place") <= most)


def inherit(state: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Users' marks of absorbed listings (old_id, new_id) merged into those of the survivors: flags by the largest, tracking by the latest kind that isn't new, dates by the first."""
    moved = state.join(absorbed.withColumnRenamed("old_id", "listing_id"), "listing_id", "left").withColumn("listing_id", F.coalesce("new_id", "listing_id"))
    real = F.when(~F.col("tracking").isin("new", "none"), F.col("tracking"))
    return moved.groupBy("user_id", "listing_id").agg(F.max("favorite").alias("favorite"), F.max("archived").alias("archived"), F.coalesce(F.max(real), F.lit("new")).alias("tracking"), F.min("notified_at").alias("notified_at"))


def absorb(orphans: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(old_id, new_id): orphans (id, occurrence_id) whose occurrences all belong to one living group."""
    to = orphans.join(occurrences.select(F.col("id").alias("occurrence_id"), "group_id"), "occurrence_id").groupBy(F.col("id").alias("old_id")).agg(F.collect_set("group_id").alias("g"))
    return to.where("size(g) = 1").select("old_id", F.get("g", F.lit(0)).alias("new_id"))


def patch(state: DataFrame, changes: DataFrame, first: tuple[str, ...] = ("notified_at",), last: tuple[str, ...] = ("favorite", "archived", "tracking")) -> DataFrame:
    """Marks after a sparse patch of known keys: some keep their first value, others take the last one given."""
    keys = ["user_id", "listing_id"]
    both = state.join(changes.select(*keys, F.struct(*first, *last).alias("p")), keys, "full_outer")
    return both.select(*keys, *[F.coalesce(F.col(c), F.col(f"p.{c}")).alias(c) for c in first], *[F.coalesce(F.col(f"p.{c}"), F.col(c)).alias(c) for c in last])


def contact_log(sends: DataFrame) -> DataFrame:
    """Contacts with how many came before for the user and listing."""
    w = Window.partitionBy("user_id", "listing_id").orderBy("sent_at", "id")
    return sends.withColumn("follow_up_index", (F.row_number().over(w) - 1).cast("int"))


def incidents(alerts: DataFrame, hours: int = 24) -> DataFrame:
    """Alerts (key, at) that aren't repeats: later than the key's last alert by more than ``hours``."""
    w = Window.partitionBy("key").orderBy("at", "id")
    gap = (F.unix_micros("at") - F.unix_micros(F.lag("at").over(w))) / 3_600e6
    return alerts.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") > hours)).drop("__gap")


def prune(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return rows.where(F.unix_micros(at) >= F.unix_micros(now) - days * 86_400_000_000)


def collection_due(at: Column) -> Column:
    """Whether the collector runs: outside 01 to 05 h in Paris always, inside at minute 7 only."""
    local = F.from_utc_timestamp(at, "Europe/Paris")
    return ~F.hour(local).between(1, 4) | (F.minute(local) == 7)


def rent_lost(rows: DataFrame, key: str) -> DataFrame:
    """Keys of five listings or more of which none has a rent."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count("price").alias("priced")).where("n >= 5 and priced = 0").select(key)


def ema_step(previous: Column, latest: Column) -> Column:
    return L.half_up((previous * 0.7 + latest * 0.3) * 100) / 100
