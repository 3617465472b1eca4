"""Column functions on listing fields: rents, caps, travel, ages and the like. Unknown stays null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
FEE_CAP_PER_SQM = 13.09
REFERENCE_RENT = 20.43
REFERENCE_SMALL = 22.74
REFERENCE_LARGE = 19.73
ENERGY_LIMITS = (70, 110, 180, 250, 330, 420)
GAS_LIMITS = (6, 11, 30, 50, 70, 100)
DETOUR = 1.3
SPEEDS = {"walk": 4.5, "bike": 15.0, "car": 30.0}


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def clamp_score(x: Column) -> Column:
    """A whole score from 0 to 100; not-a-number is 0."""
    return F.when(F.isnan(x.cast("double")), F.lit(0)).otherwise(F.least(F.greatest(half_up(x), F.lit(0)), F.lit(100))).cast("int")


def rent_all_in(price: Column, charges: Column, included: Column) -> Column:
    """Rent with charges: as published if they are included, with charges added if they aren't and are known, else unknown."""
    return F.when(included, price).when(~included & charges.isNotNull(), price + charges)


def rent_excluding(price: Column, charges: Column, included: Column) -> Column:
    """Rent without charges, if that can be told."""
    return F.when(~included, price).when(included & (charges < price), price - charges)


def rent_for_budget(price: Column, charges: Column, included: Column) -> Column:
    return F.coalesce(rent_all_in(price, charges, included), price)


def tenant_fee_cap(area: Column) -> Column:
    """The fees that a tenant may be asked, to the cent, halves up."""
    return half_up(area * FEE_CAP_PER_SQM * 100) / 100


def deposit_cap(rent: Column, furnished: Column) -> Column:
    """Two rents when furnished, one otherwise; unknown furnishing takes the wider cap."""
    return rent * F.when(furnished == F.lit(False), 1).otherwise(2)


def over_cap(amount: Column, cap: Column) -> Column:
    """Whether an amount exceeds a cap by more than 1 or 2 %."""
    return amount > cap + F.greatest(F.lit(1.0), cap * 0.02)


def reference_rent(rooms: Column) -> Column:
    return F.when(rooms.isNull(), REFERENCE_RENT).when(rooms <= 2, REFERENCE_SMALL).otherwise(REFERENCE_LARGE)


def _grade(x: Column, limits: tuple[int, ...]) -> Column:
    out = F.lit(len(limits))
    for i in range(len(limits) - 1, -1, -1):
        out = F.when(x <= limits[i], i).otherwise(out)
    return out


def energy_label(kwh: Column, gas: Column) -> Column:
    """The worse of the two scales, A to G."""
    return F.substring(F.lit("ABCDEFG"), F.greatest(_grade(kwh, ENERGY_LIMITS), _grade(gas, GAS_LIMITS)) + 1, F.lit(1))


def label_or_null(x: Column) -> Column:
    return F.when(x.rlike("^[A-G]$"), x)


def travel_minutes(km: Column, mode: str) -> Column:
    """Minutes for a straight distance with a detour; transit is at most walking and at most 25 minutes and 50 km/h."""
    road = km * DETOUR
    if mode == "transit":
        return half_up(F.least(road / SPEEDS["walk"] * 60, 25 + road / 50 * 60))
    return half_up(road / SPEEDS[mode] * 60)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two places; unknown where one is, as ``least`` would pass over it."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(h.isNotNull(), 2 * 6371 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def within(a: Column, b: Column, absolute: float, ratio: float) -> Column:
    """Whether two numbers differ by at most an absolute or a relative tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), ratio * F.greatest(a, b))


def effort_penalty(income: Column, rent: Column) -> Column:
    ratio = income / rent
    return F.when(ratio.isNull() | (ratio >= 3), 0).when(ratio >= 2.5, 6).when(ratio >= 2, 14).otherwise(22)


def age_minutes(published: Column, first_seen: Column, now: Column) -> Column:
    """Minutes since publication, or since the first sight."""
    return (F.unix_micros(now) - F.unix_micros(F.coalesce(published, first_seen))) / 60e6


def elapsed(minutes: Column) -> Column:
    """A short text for an age."""
    unit = lambda x, name: F.concat(F.floor(x).cast("string"), F.lit(name))
    return (
        F.when(minutes < 1, F.lit("now")).when(minutes < 60, unit(minutes, " min")).when(minutes < 2880, unit(minutes / 60, " h"))
        .when(minutes < 20160, unit(minutes / 1440, " d")).when(minutes < 86400, unit(minutes / 10080, " w")).otherwise(unit(minutes / 43200, " mo"))
    )


def rent_text(price: Column) -> Column:
    """A rent with a decimal comma, without decimals when whole."""
    return F.when(price == F.floor(price), F.floor(price).cast("string")).otherwise(F.replace(F.format_string("%.2f", price), F.lit("."), F.lit(",")))


def spec_key(price: Column, area: Column, city: Column, rooms: Column) -> Column:
    """rounded price | rounded area | city | rooms or ?; null where one of the first three is."""
    ok = price.isNotNull() & area.isNotNull() & city.isNotNull()
    return F.when(ok, F.concat_ws("|", half_up(price).cast("string"), half_up(area).cast("string"), F.lower(city), F.coalesce(rooms.cast("string"), F.lit("?"))))


def loose_key(price: Column, area: Column, rooms: Column) -> Column:
    """Rounded rent and area, and rooms; without a place."""
    return F.when(price.isNotNull() & area.isNotNull(), F.concat_ws("|", half_up(price).cast("long"), half_up(area).cast("long"), F.coalesce(rooms.cast("string"), F.lit("?"))))


def strict_greatest(*cols: Column) -> Column:
    """The largest, or null if any is null."""
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.greatest(*cols))
