"""Predicates of the listing queries (unknown values have a policy of their own in each)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import listing as L
from tallyspark.functions import text as T


def every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass(frozen=True)
class Traits:
    """What a list filter asks of a dwelling; None doesn't ask."""

    exclude_flat_share: bool = False
    exclude_student: bool = False
    exclude_top_floor: bool = False
    landlord: str | None = None
    furnished: bool | None = None
    max_commute: float | None = None
    available_by: str | None = None
    districts: tuple[str, ...] = ()
    include_unknown_district: bool = True


def traits(t: Traits) -> Column:
    """Unknown values pass, but for districts when told otherwise."""
    c, parts = F.col, []
    for on, name in ((t.exclude_flat_share, "flat_share"), (t.exclude_student, "student"), (t.exclude_top_floor, "top_floor")):
        if on:
            parts.append(~F.coalesce(c(name), F.lit(False)))
    if t.landlord == "private":
        parts.append(F.coalesce(c("landlord_kind"), F.lit("")) != "agency")
    elif t.landlord == "agency":
        parts.append(c("landlord_kind").eqNullSafe(F.lit("agency")))
    if t.furnished is not None:
        parts.append(F.coalesce(c("furnished"), F.lit(t.furnished)) == t.furnished if t.furnished else ~F.coalesce(c("furnished"), F.lit(False)))
    if t.max_commute is not None:
        parts.append(c("commute").isNull() | (c("commute") <= t.max_commute))
    if t.available_by is not None:
        parts.append(c("available_at").isNull() | (c("available_at") < F.date_add(F.lit(t.available_by).cast("date"), 1)))
    if t.districts:
        inside = c("district").isin(*t.districts)
        parts.append(F.coalesce(inside, F.lit(t.include_unknown_district)))
    return every(parts)


def open_to_applications() -> Column:
    return F.coalesce(F.get_json_object("payload", "$.applicationStatus"), F.lit("")) != "full"


def catalogue(cities: tuple[str, ...]) -> Column:
    """Dwellings on offer in the cities: not inactive, and no parking or business premises."""
    return (F.col("lifecycle") != "inactive") & ~F.col("property_type").isin("parking", "commercial") & F.col("city").isin(*cities)


def available() -> Column:
    return (F.col("lifecycle") != "inactive") & ~F.col("rented")


def archive_reason(full: Column, archived: Column) -> Column:
    """Why a listing is archived, by precedence."""
    return F.when(F.col("rented"), "rented").when(F.col("lifecycle") == "inactive", "offline").when(full, "applicationsFull").when(archived, "user")


def of_sources(listings: DataFrame, occurrences: DataFrame, only: tuple[str, ...] = (), never: tuple[str, ...] = ()) -> DataFrame:
    """Listings with an occurrence of some sources, or with none of others; no sources: no filter."""
    if only:
        listings = listings.join(occurrences.where(F.col("source_id").isin(*only)).select(F.col("group_id").alias("id")), "id", "left_semi")
    if never:
        listings = listings.join(occurrences.where(F.col("source_id").isin(*never)).select(F.col("group_id").alias("id")), "id", "left_anti")
    return listings


@dataclass(frozen=True)
class Bounds:
    max_price: float
    min_area: float
    min_rooms: int
    max_commute: float
    cities: tuple[str, ...] = field(default=())

    def widened(self) -> Bounds:
        """Price 5 % up, area 5 % or 1 down, a room less but one, commute 10 % or 5 minutes up."""
        return Bounds(self.max_price * 1.05, self.min_area - max(self.min_area * 0.05, 1.0), max(1, self.min_rooms - 1), self.max_commute + min(5.0, self.max_commute * 0.1), self.cities)


def near_match(b: Bounds) -> Column:
    """Within the widened bounds and beyond at least one of the asked ones; an unknown price never is, unknown area and rooms may be."""
    w, c = b.widened(), F.col
    beyond = (c("price") > b.max_price) | F.coalesce(c("area") < b.min_area, F.lit(False)) | F.coalesce(c("rooms") < b.min_rooms, F.lit(False)) | F.coalesce(c("commute") > b.max_commute, F.lit(False))
    inside = (c("price") <= w.max_price) & (c("area").isNull() | (c("area") >= w.min_area)) & (c("rooms").isNull() | (c("rooms") >= w.min_rooms)) & (c("commute").isNull() | (c("commute") <= w.max_commute))
    return inside & beyond & F.lower("city").isin(*b.cities)


def overshoot(b: Bounds) -> Column:
    """What is exceeded, in words."""
    c = F.col
    return F.concat_ws(" · ", F.when(c("price") > b.max_price, F.concat(F.lit("+"), L.half_up(c("price") - b.max_price).cast("string"), F.lit(" €"))), F.when(c("area") < b.min_area, F.concat(F.lit("-"), L.half_up(b.min_area - c("area")).cast("string"), F.lit(" m²"))), F.when(c("rooms") < b.min_rooms, F.lit("rooms")))


def quick(max_rent: float | None = None, min_rent: float | None = None, min_area: float | None = None, max_area: float | None = None, min_rooms: int | None = None, types: tuple[str, ...] = ()) -> Column:
    """Quick filters: minima and rents reject the unknown, the largest area keeps it."""
    c, parts = F.col, []
    if max_rent is not None:
        parts.append(F.coalesce(L.rent_for_budget(c("price"), c("charges"), c("charges_included")) <= max_rent, F.lit(False)))
    for name, low in (("price", min_rent), ("area", min_area), ("rooms", min_rooms)):
        if low is not None:
            parts.append(F.coalesce(c(name) >= low, F.lit(False)))
    if max_area is not None:
        parts.append(F.coalesce(c("area") <= max_area, F.lit(True)))
    if types:
        parts.append(c("property_type").isin(*types))
    return every(parts)


def matches_text(haystack: Column, query: str) -> Column:
    """Every word of the query is part of the folded text."""
    return F.forall(F.filter(F.split(T.fold(F.lit(query)), " "), lambda w: w != ""), lambda w: F.contains(T.fold(haystack), w))


def suggestions(rows: DataFrame, kinds: dict[str, str], part: str, limit: int = 6) -> DataFrame:
    """The most frequent folded values of some columns that hold a part and aren't it: kind, value, n."""
    every_kind = [rows.select(F.lit(k).alias("kind"), T.fold(F.col(c)).alias("value")) for k, c in kinds.items()]
    all_ = reduce(DataFrame.unionAll, every_kind).where((F.col("value") != "") & F.contains("value", F.lit(part)) & (F.col("value") != part))
    return all_.groupBy("kind", "value").agg(F.count("*").alias("n")).orderBy("kind", F.desc("n"), "value").limit(limit)


SORTS = {
    "priority": lambda: [F.col("priority").desc_nulls_last(), F.coalesce("published", "first_seen").desc(), F.col("id")],
    "recent": lambda: [F.coalesce("published", "first_seen").desc_nulls_last(), F.col("id")],
    "price": lambda: [F.col("price").asc_nulls_last(), F.col("id")],
    "closest": lambda: [F.col("commute").asc_nulls_last(), F.col("id")],
    "area": lambda: [F.col("area").desc_nulls_last(), F.col("id")],
}


def page(rows: DataFrame, sort: str = "recent", limit: int = 30, offset: int = 0) -> DataFrame:
    """One page: a top-k, so nothing but each task's first rows moves."""
    return rows.orderBy(*SORTS[sort]()).offset(offset).limit(max(1, min(500, limit)))


def may_notify(frequency: str, last: Column, now: Column) -> Column:
    """Whether a user's notification is due; never sent is due."""
    hours = {"each-run": 0, "hourly": 1, "daily": 24}[frequency]
    return last.isNull() | (F.unix_micros(now) - F.unix_micros(last) >= hours * 3_600_000_000)


def auto_contact(min_match: int = 70, max_risk: int = 40, hourly: int = 3, daily: int = 10) -> Column:
    """The first veto of the chain, or null for a go-ahead; needs enabled, contacted, match, risk, sent_hour and sent_day."""
    c = F.col
    return F.when(~c("enabled"), "disabled").when(c("contacted"), "contacted").when(c("match") < min_match, "match").when(c("risk") >= max_risk, "risk").when(c("sent_hour") >= hourly, "hourly").when(c("sent_day") >= daily, "daily")
