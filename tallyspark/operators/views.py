"""What a client shows of listings: selections, orders, details."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.json import members, rebuilt

#: Points of priority that the nearest listings of a user's taste gain.
AFFINITY_BOOST = 15


@dataclass(frozen=True)
class Selection:
    """Sources by name: ``only`` these, or all ``except`` these."""

    mode: str = "except"
    ids: frozenset[str] = frozenset()

    def restricts(self) -> bool:
        return self.mode == "only" or bool(self.ids)

    def allows(self, source: Column) -> Column:
        named = source.isin(*sorted(self.ids)) if self.ids else F.lit(False)
        return named if self.mode == "only" else ~named

    def with_sources(self, ids: tuple[str, ...], included: bool) -> Selection:
        """The selection after some sources are switched on or off."""
        listed = included if self.mode == "only" else not included
        return Selection(self.mode, self.ids | set(ids) if listed else self.ids - set(ids))


def archive_reason(rented: Column, lifecycle: Column, status: Column, archived: Column) -> Column:
    """Why a listing is out of the way: let, offline, full, or put away by the user; else null."""
    return F.when(rented, "rented").when(lifecycle == "inactive", "offline").when(status == "full", "applicationsFull").when(archived, "user")


def states(rows: DataFrame) -> DataFrame:
    """``rows`` (rented, lifecycle, application_status, archived) with reason, unavailable, uncertain and by_source."""
    reason = archive_reason(F.col("rented"), F.col("lifecycle"), F.col("application_status"), F.col("archived"))
    out = rows.withColumn("reason", reason)
    told = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumn("unavailable", told(F.col("reason").isin("rented", "offline"))).withColumn("uncertain", told(F.col("lifecycle") == "possiblyInactive")).withColumn("by_source", told(F.col("reason") != "user"))


def shown(rows: DataFrame, sources: Selection | None = None, hide_uncertain: bool = False, new_only: bool = False, eligible_only: bool = False) -> DataFrame:
    """Listings (sources array, lifecycle, viewed, verdict) that a client's filters leave; filters that aren't set leave all."""
    sources = sources or Selection()
    keep = F.lit(True)
    if sources.restricts():
        keep = keep & F.exists("sources", sources.allows)
    if hide_uncertain:
        keep = keep & ~F.coalesce(F.col("lifecycle") == "possiblyInactive", F.lit(False))
    if new_only:
        keep = keep & ~F.coalesce(F.col("viewed"), F.lit(False))
    if eligible_only:
        keep = keep & F.coalesce(F.col("verdict").isin("eligible", "unknown"), F.lit(True))
    return rows.where(keep)


def by_affinity(rows: DataFrame) -> DataFrame:
    """Listings by priority raised by affinity (0 to 1), the smaller id first where that is equal."""
    return rows.orderBy(F.desc(F.col("priority") + F.coalesce("affinity", F.lit(0.0)) * AFFINITY_BOOST), "id")


def by_recency(rows: DataFrame) -> DataFrame:
    """The last published first, or the last seen first where that isn't known; then by priority."""
    return rows.orderBy(F.coalesce("published", "first_seen").desc_nulls_last(), F.desc("priority"), "id")


def activity(events: DataFrame, most: int) -> DataFrame:
    """The latest events (at, id)."""
    return events.orderBy(F.desc("at"), "id").limit(most)


def detail(listings: DataFrame, absorbed: DataFrame, contacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The listings of ``wanted`` (asked), or those that took them in (old_id, new_id), with the history of contacts (listing_id, at, channel), latest first."""
    to = wanted.join(absorbed.select(F.col("old_id").alias("asked"), "new_id"), "asked", "left").select("asked", F.coalesce("new_id", "asked").alias("id"))
    log = contacts.groupBy(F.col("listing_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("at", "channel")), asc=False).alias("contacts"))
    return to.join(listings, "id").join(log, "id", "left").withColumn("contacts", F.coalesce("contacts", F.array().cast("array<struct<at:timestamp,channel:string>>")))


def as_json(rows: DataFrame, columns: list[str], over: Iterable[str] = ()) -> DataFrame:
    """(id, json): a listing's payload, all values with their types, in front of the table's ``columns``; only columns named in ``over``, a reader's own, go before what the payload says.

    The id is a text and instants are ISO texts; a broken payload counts as empty; keys are in order of their names.
    """
    kinds = dict(rows.dtypes)

    def value(c: str) -> Column:
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if kinds[c] == "timestamp" else F.col(c).cast("string") if c == "id" else F.col(c)
        return F.coalesce(text.cast("variant"), F.parse_json(F.lit("null")))

    def own(names: list[str]) -> Column:
        return F.create_map(*[x for c in names for x in (F.lit(c), value(c))]) if names else F.create_map().cast("map<string,variant>")

    first = [c for c in columns if c in set(over)]
    held = F.map_filter(F.coalesce(members(F.col("payload")), F.create_map().cast("map<string,variant>")), lambda k, _: ~k.isin(*first) if first else F.lit(True))
    rest = own([c for c in columns if c not in set(over)])
    marked = rows.select("id", held.alias("held"), rest.alias("rest"), own(first).alias("first"))
    left = F.map_filter("rest", lambda k, _: ~F.map_contains_key("held", k))
    return marked.select("id", rebuilt(F.map_concat("held", left, "first")).alias("json"))
