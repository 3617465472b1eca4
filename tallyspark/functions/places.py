"""Column functions on portals, photos, places' keys and stored labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import text as T


def stale_features(stored: Column, x: Column, names: dict[str, str]) -> Column:
    """Stored labels that a text's patterns could give but no longer do."""
    return F.filter(F.array_except(stored, T.features(x, names)), lambda f: f.isin(*names))


def portal(x: Column, labels: dict[str, str]) -> Column:
    """The name of the portal whose host an address has: the first of ``labels`` whose domain the host is or ends in; else null."""
    host = F.lower(F.regexp_extract(x, r"^[a-zA-Z]+://([^/?#:]+)", 1))
    return F.coalesce(*[F.when((host == d) | F.endswith(host, F.lit(f".{d}")), F.lit(name)) for d, name in labels.items()])


def photo_origin(x: Column, proxy: str) -> Column:
    """The address behind a resizing proxy. ``proxy`` matches (scheme, host, URL-safe base64 of the path); what doesn't decode to a path stays."""
    scheme, host, code = (F.regexp_extract(x, proxy, i) for i in (1, 2, 3))
    plain = F.translate(code, "-_", "+/")
    path = F.try_to_binary(F.rpad(plain, F.ceil(F.length(plain) / 4) * 4, F.lit("=")), F.lit("base64"))
    text = F.decode(path, "UTF-8")
    return F.when((host != "") & F.coalesce(F.startswith(text, F.lit("/")), F.lit(False)), F.concat(F.when(scheme != "", scheme).otherwise("https"), F.lit("://"), host, text)).otherwise(x)


def geocode_key(address: Column, city: Column) -> Column:
    """The key under which a place is kept."""
    parts = F.filter(F.array(address, city), lambda p: F.coalesce(F.trim(p) != "", F.lit(False)))
    return F.concat(F.lit("v3 "), F.lower(F.regexp_replace(F.trim(F.array_join(parts, " ")), r"\s+", " ")))


def reverse_key(lat: Column, lon: Column) -> Column:
    return F.format_string("rev1 %.5f,%.5f", lat.cast("double"), lon.cast("double"))
