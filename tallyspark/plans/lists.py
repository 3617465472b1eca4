"""Queries: projections, filters, joins, sets, sorts (survey parts A, B, C, D, H, I, Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import listing as L
from tallyspark.operators import filters as P
from tallyspark.operators import joins as J
from tallyspark.plans.proxies import Registry
from tallyspark.session import stage

R = Registry()
ASKED = P.Bounds(900.0, 40.0, 3, 40.0, ("city1", "city2", "city3", "city4"))
SHAPES = {
    "west": [[[(7.1, 43.6), (7.25, 43.6), (7.25, 43.8), (7.1, 43.8)], [(7.15, 43.65), (7.2, 43.65), (7.2, 43.7), (7.15, 43.7)]]],
    "east": [[[(7.22, 43.6), (7.4, 43.6), (7.4, 43.8), (7.22, 43.8)]]],
}


@R.add("list_page", """
SELECT l.id, price, city, coalesce(s.priority, -1) AS priority, coalesce(st.tracking, 'none') AS tracking
FROM lst l LEFT JOIN (SELECT * FROM state WHERE user_id = 'u1') st ON st.listing_id = l.id LEFT JOIN (SELECT * FROM score WHERE user_id = 'u1') s ON s.listing_id = l.id
WHERE lifecycle <> 'inactive' AND property_type NOT IN ('parking', 'commercial') AND city IN ('city0', 'city1', 'city2', 'city3') AND coalesce(flat_share, false) = false AND coalesce(student, false) = false AND (commute IS NULL OR commute <= 60)
  AND coalesce(archived, 0) = 0
ORDER BY s.priority DESC NULLS LAST, coalesce(published, first_seen) DESC, l.id LIMIT 30 OFFSET 5""")
def list_page(t):
    rows = J.overlay(t.lst, t.state, t.score, "u1")
    wanted = P.catalogue(("city0", "city1", "city2", "city3")) & P.traits(P.Traits(exclude_flat_share=True, exclude_student=True, max_commute=60)) & (F.coalesce("archived", F.lit(0)) == 0)
    return P.page(rows.where(wanted), "priority", 30, 5).select("id", "price", "city", F.coalesce("priority", F.lit(-1)).alias("priority"), F.coalesce("tracking", F.lit("none")).alias("tracking"))


@R.add("c01_traits", """
SELECT id FROM lst WHERE coalesce(flat_share, false) = false AND coalesce(top_floor, false) = false AND coalesce(landlord_kind, '') <> 'agency' AND coalesce(furnished, false) = false
 AND (available_at IS NULL OR available_at < TIMESTAMP '1998-01-02 00:00:00') AND district IN ('d1', 'd2')
UNION ALL SELECT -id FROM lst WHERE landlord_kind = 'agency' AND coalesce(furnished, true) AND coalesce(district IN ('d1', 'd2'), true)""")
def traits(t):
    a = t.lst.where(P.traits(P.Traits(exclude_flat_share=True, exclude_top_floor=True, landlord="private", furnished=False, available_by="1998-01-01", districts=("d1", "d2"), include_unknown_district=False)))
    b = t.lst.where(P.traits(P.Traits(landlord="agency", furnished=True, districts=("d1", "d2"))))
    return a.select("id").union(b.select((-F.col("id")).alias("id")))


@R.add("c02_open_applications", "SELECT id FROM lst WHERE coalesce(json_extract_string(payload, '$.applicationStatus'), '') <> 'full'")
def open_applications(t):
    return t.lst.where(P.open_to_applications()).select("id")


@R.add("c03_sources", """
SELECT id FROM lst WHERE EXISTS (SELECT 1 FROM occ WHERE group_id = lst.id AND source_id IN ('s1', 's2', 's3')) AND NOT EXISTS (SELECT 1 FROM occ WHERE group_id = lst.id AND source_id IN ('s4', 's5'))""")
def of_sources(t):
    return P.of_sources(t.lst, t.occ, ("s1", "s2", "s3"), ("s4", "s5")).select("id")


@R.add("c08_rents", """
SELECT id, CASE WHEN charges_included THEN price WHEN NOT charges_included AND charges IS NOT NULL THEN price + charges END AS all_in,
 CASE WHEN NOT charges_included THEN price WHEN charges_included AND charges < price THEN price - charges END AS bare,
 coalesce(CASE WHEN charges_included THEN price WHEN NOT charges_included AND charges IS NOT NULL THEN price + charges END, price) AS budget, price + CASE WHEN charges_included = false THEN coalesce(charges, 0) ELSE 0 END AS budget_list FROM lst""")
def rents(t):
    c = (F.col("price"), F.col("charges"), F.col("charges_included"))
    return t.lst.select("id", L.rent_all_in(*c).alias("all_in"), L.rent_excluding(*c).alias("bare"), L.rent_for_budget(*c).alias("budget"), (c[0] + F.when(c[2] == F.lit(False), F.coalesce(c[1], F.lit(0))).otherwise(0)).alias("budget_list"))


@R.add("c09_catalogue", "SELECT id, (lifecycle <> 'inactive' AND NOT rented) AS free FROM lst WHERE lifecycle <> 'inactive' AND property_type NOT IN ('parking', 'commercial') AND city IN ('city1', 'city2')")
def catalogue(t):
    return t.lst.where(P.catalogue(("city1", "city2"))).select("id", P.available().alias("free"))


@R.add("c11_archive_reason", """
SELECT l.id, CASE WHEN rented THEN 'rented' WHEN lifecycle = 'inactive' THEN 'offline' WHEN json_extract_string(payload, '$.applicationStatus') = 'full' THEN 'applicationsFull' WHEN archived = 1 THEN 'user' END AS reason
FROM lst l LEFT JOIN (SELECT * FROM state WHERE user_id = 'u2') s ON s.listing_id = l.id""")
def archive_reason(t):
    rows = J.overlay(t.lst, t.state, t.score, "u2")
    return rows.select("id", P.archive_reason(~P.open_to_applications(), F.col("archived") == 1).alias("reason"))


@R.add("c12_version_guard", """
SELECT l.id, CASE WHEN (CASE WHEN s.listing_id % 2 = 0 THEN s.priority END) IS NOT DISTINCT FROM (CASE WHEN l.id % 4 = 0 THEN s.priority END) THEN 'cached' ELSE 'fresh' END AS origin
FROM lst l JOIN (SELECT * FROM score WHERE user_id = 'u1') s ON s.listing_id = l.id""")
def version_guard(t):
    rows = t.lst.join(t.score.where("user_id = 'u1'"), F.col("id") == F.col("listing_id"))
    held, now = F.when(F.col("listing_id") % 2 == 0, F.col("priority")), F.when(F.col("id") % 4 == 0, F.col("priority"))
    return rows.select("id", F.when(held.eqNullSafe(now), "cached").otherwise("fresh").alias("origin"))


@R.add("c15_photo_cap", """SELECT page_id, len(list_slice(string_split(url, '/'), 1, 3)) AS n, list_slice(string_split(url, '/'), 1, 3)[3] AS third FROM pages""")
def photo_cap(t):
    kept = F.slice(F.split("url", "/"), 1, 3)
    return t.pages.select("page_id", F.size(kept).cast("long").alias("n"), F.get(kept, F.lit(2)).alias("third"))


_W = ASKED.widened()


@R.add("c16_near_match", f"""
SELECT id, array_to_string(list_filter([CASE WHEN price > {ASKED.max_price} THEN concat('+', CAST(floor(price - {ASKED.max_price} + 0.5) AS BIGINT), ' €') END, CASE WHEN area < {ASKED.min_area} THEN concat('-', CAST(floor({ASKED.min_area} - area + 0.5) AS BIGINT), ' m²') END, CASE WHEN rooms < {ASKED.min_rooms} THEN 'rooms' END], lambda x: x IS NOT NULL), ' · ') AS beyond
FROM lst WHERE price <= {_W.max_price!r} AND (area IS NULL OR area >= {_W.min_area!r}) AND (rooms IS NULL OR rooms >= {_W.min_rooms}) AND (commute IS NULL OR commute <= {_W.max_commute!r})
 AND (price > {ASKED.max_price} OR coalesce(area < {ASKED.min_area}, false) OR coalesce(rooms < {ASKED.min_rooms}, false) OR coalesce(commute > {ASKED.max_commute}, false)) AND lower(city) IN ('city1', 'city2', 'city3', 'city4')""")
def near_match(t):
    return t.lst.where(P.near_match(ASKED)).select("id", P.overshoot(ASKED).alias("beyond"))


@R.add("c20_quick", """
SELECT id FROM lst WHERE coalesce(coalesce(CASE WHEN charges_included THEN price WHEN NOT charges_included AND charges IS NOT NULL THEN price + charges END, price) <= 1000, false) AND coalesce(area >= 30, false) AND coalesce(rooms >= 2, false) AND coalesce(area <= 100, true) AND property_type IN ('apartment', 'house')""")
def quick(t):
    return t.lst.where(P.quick(max_rent=1000, min_area=30, max_area=100, min_rooms=2, types=("apartment", "house"))).select("id")


@R.add("c21_search", """
SELECT doc_id FROM documents WHERE list_bool_and([contains(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')), w) FOR w IN ['que', 'de']])""")
def search(t):
    return t.documents.where(P.matches_text(F.col("text"), "Qué de")).select("doc_id")


@R.add("c22_suggestions", """
SELECT kind, value, n FROM (SELECT 'name' AS kind, value, count(*) AS n FROM (SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY value
UNION ALL SELECT 'segment', value, count(*) FROM (SELECT lower(c_mktsegment) AS value FROM customer) GROUP BY value) WHERE contains(value, 'i') AND value <> 'i' ORDER BY kind, n DESC, value LIMIT 6""")
def suggestions(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return P.suggestions(rows, {"name": "n_name", "segment": "c_mktsegment"}, "i")


@R.add("c25_awaits_contact", "SELECT user_id, listing_id FROM state WHERE tracking IN ('new', 'toContact')")
def awaits(t):
    return t.state.where(F.col("tracking").isin("new", "toContact")).select("user_id", "listing_id")


@R.add("c26_cadence_gate", """
SELECT user_id, listing_id, notified_at IS NULL OR epoch_us(TIMESTAMP '1996-01-01 12:00:00') - epoch_us(notified_at) >= 86400000000 AS daily, notified_at IS NULL OR epoch_us(TIMESTAMP '1996-01-01 12:00:00') - epoch_us(notified_at) >= 3600000000 AS hourly FROM state""")
def cadence_gate(t):
    now = F.lit("1996-01-01 12:00:00").cast("timestamp")
    return t.state.select("user_id", "listing_id", P.may_notify("daily", F.col("notified_at"), now).alias("daily"), P.may_notify("hourly", F.col("notified_at"), now).alias("hourly"))


@R.add("c27_auto_contact", """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'disabled' WHEN event_type = 'purchase' THEN 'contacted' WHEN event_id % 100 < 20 THEN 'match' WHEN value >= 90 THEN 'risk' WHEN h >= 2 THEN 'hourly' WHEN d >= 4 THEN 'daily' END AS veto FROM (
 SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) - 1 AS h, count(*) OVER (PARTITION BY user_id ORDER BY epoch_s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) - 1 AS d FROM (SELECT *, epoch_us(ts) // 1000000 AS epoch_s FROM events))""")
def auto_contact(t):
    from tallyspark.operators.aggregates import trailing

    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("sent_hour", trailing(t.events, "user_id", "ts", 3600) - 1).withColumn("sent_day", trailing(t.events, "user_id", "ts", 86400) - 1)
    rows = rows.withColumns({"enabled": F.col("event_id") % 11 != 0, "contacted": F.col("event_type") == "purchase", "match": F.col("event_id") % 100, "risk": F.col("value")})
    return rows.select("event_id", P.auto_contact(20, 90, 2, 4).alias("veto"))


@R.add("d14_overlay", """
SELECT l.id, s.matches, s.priority, st.favorite, st.archived, st.tracking FROM lst l LEFT JOIN state st ON st.listing_id = l.id AND st.user_id = 'u0' LEFT JOIN score s ON s.listing_id = l.id AND s.user_id = 'u0'""")
def overlay(t):
    return J.overlay(t.lst, t.state, t.score, "u0").select("id", "matches", "priority", "favorite", "archived", "tracking")


@R.add("d15_pending", """
SELECT l.id, s.priority FROM lst l JOIN score s ON s.listing_id = l.id AND s.user_id = 'u1' LEFT JOIN state st ON st.listing_id = l.id AND st.user_id = 'u1'
WHERE s.matches = 1 AND st.notified_at IS NULL AND coalesce(st.archived, 0) = 0 AND lifecycle = 'active' AND NOT rented AND s.priority >= 30 AND coalesce(json_extract_string(payload, '$.applicationStatus'), '') <> 'full'""")
def pending(t):
    rows = J.overlay(t.lst, t.state, t.score, "u1").where("matches = 1 and notified_at is null and coalesce(archived, 0) = 0 and lifecycle = 'active' and not rented and priority >= 30")
    return rows.where(P.open_to_applications()).select("id", "priority")


@R.add("d16_updated", """
SELECT id FROM lst WHERE id IN (SELECT group_id FROM occ WHERE CAST(source_ref AS BIGINT) IN (SELECT occurrence_id FROM hist WHERE change IN ('price-drop', 'price-rise')))""")
def updated(t):
    changed = t.hist.where(F.col("change").isin("price-drop", "price-rise")).select("occurrence_id")
    hit = t.occ.join(changed, t.occ["source_ref"].cast("long") == changed["occurrence_id"], "left_semi")
    return t.lst.join(hit.select(F.col("group_id").alias("id")), "id", "left_semi").select("id")


@R.add("d17_mark_rented", """SELECT id, rented OR id IN (SELECT group_id FROM occ WHERE source_id = 's3' AND CAST(source_ref AS BIGINT) % 5 = 0 AND group_id IS NOT NULL) AS rented FROM lst""")
def mark_rented(t):
    hit = t.occ.where("source_id = 's3' and cast(source_ref as bigint) % 5 = 0 and group_id is not null").select(F.col("group_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    return t.lst.join(hit, "id", "left").select("id", (F.col("rented") | F.coalesce("hit", F.lit(False))).alias("rented"))


@R.add("d18_departed", "SELECT id FROM lst WHERE NOT EXISTS (SELECT 1 FROM occ WHERE group_id = lst.id AND lifecycle <> 'inactive' AND source_id <> 's1')")
def departed(t):
    alive = t.occ.where("lifecycle <> 'inactive' and source_id <> 's1'").select(F.col("group_id").alias("id"))
    return t.lst.join(alive, "id", "left_anti").select("id")


@R.add("d19_not_in_null", """
SELECT 'with null' AS kind, count(*) AS n FROM lst WHERE id NOT IN (SELECT group_id FROM occ WHERE source_id = 's2')
UNION ALL SELECT 'guarded', count(*) FROM lst WHERE id NOT IN (SELECT group_id FROM occ WHERE source_id = 's2' AND group_id IS NOT NULL)""")
def not_in_null(t):
    side = t.occ.where("source_id = 's2'").select("group_id")
    ids = t.lst.select("id")
    count = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("with null", J.not_in(ids, side, "id", "group_id")).union(count("guarded", J.not_in(ids, side.where("group_id is not null"), "id", "group_id")))


@R.add("d20_relayed", """
SELECT a.id FROM (SELECT id, concat(source_id, ':', source_ref, ':x') AS ref FROM occ) a WHERE EXISTS (SELECT 1 FROM occ o WHERE o.source_id = split_part(a.ref, ':', 1) AND concat(o.source_ref, ':x') = substr(a.ref, strpos(a.ref, ':') + 1) AND o.lifecycle = 'inactive')""")
def relayed(t):
    ref = F.concat_ws(":", "source_id", "source_ref", F.lit("x"))
    parts = F.split(ref, ":", 2)
    rows = t.occ.select("id", F.get(parts, F.lit(0)).alias("s"), F.get(parts, F.lit(1)).alias("r"))
    gone = t.occ.where("lifecycle = 'inactive'").select(F.col("source_id").alias("s"), F.concat_ws(":", "source_ref", F.lit("x")).alias("r"))
    return rows.join(gone, ["s", "r"], "left_semi").select("id")


@R.add("d22_latest_run", """
SELECT source_id, id, stop_reason FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS k FROM runs) WHERE k = 1""")
def latest_run(t):
    return J.latest(t.runs, "source_id", "started_at", "id").select("source_id", "id", "stop_reason")


@R.add("d23_groupwise_max", "SELECT r.source_id, r.id, r.started_at FROM runs r JOIN (SELECT source_id, max(started_at) AS m FROM runs GROUP BY source_id) x ON r.source_id = x.source_id AND r.started_at = x.m")
def groupwise_max(t):
    from pyspark.sql import Window

    w = Window.partitionBy("source_id").orderBy(F.desc("started_at"))
    return t.runs.withColumn("k", F.rank().over(w)).where("k = 1").select("source_id", "id", "started_at")


@R.add("d24_as_of", """
WITH e AS (SELECT event_id, concat('s', CAST(user_id % 20 AS STRING)) AS source_id, ts FROM events WHERE event_type = 'purchase'),
held AS (SELECT event_id, arg_min(r.id, (r.started_at, r.id)) AS run FROM e JOIN runs r ON r.source_id = e.source_id AND r.started_at <= e.ts AND e.ts <= r.finished_at GROUP BY event_id),
past AS (SELECT event_id, arg_max(r.id, (r.started_at, r.id)) AS run FROM e JOIN runs r ON r.source_id = e.source_id AND r.started_at <= e.ts GROUP BY event_id)
SELECT e.event_id, coalesce(held.run, past.run) AS run FROM e LEFT JOIN held USING (event_id) LEFT JOIN past USING (event_id)""")
def as_of(t):
    found = t.events.where("event_type = 'purchase'").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("source_id"))
    return J.as_of(found, t.runs, "source_id", "event_id", "ts")


@R.add("d06_range_join", """
SELECT a.id AS id, b.id AS id2 FROM lst a JOIN lst b ON a.city = b.city AND a.rooms = b.rooms AND a.id < b.id WHERE abs(a.price - b.price) <= greatest(30, 0.06 * greatest(a.price, b.price))""")
def range_join(t):
    a = stage(t.spark, t.lst.where("price > 0").select("id", "city", "rooms", "price"), "prices")
    b = a.withColumnsRenamed({"id": "id2", "price": "price2"})
    return J.in_range(a, b, "price", "price2", 30, 0.06, ["city", "rooms"]).where("id < id2").select("id", "id2")


_KM = "2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@R.add("d07_near", f"SELECT a.id AS id, b.id AS id2, round({_KM}, 6) AS km FROM lst a JOIN lst b ON a.id < b.id WHERE {_KM} <= 0.5")
def near(t):
    a = stage(t.spark, t.lst.where("lat is not null").select("id", "lat", "lon"), "places")
    b = a.withColumnsRenamed({"id": "id2", "lat": "lat2", "lon": "lon2"})
    return J.near(a, b, 0.5).where("id < id2").select("id", "id2", F.round("km", 6).alias("km"))


@R.add("d32_point_in_polygon", """
SELECT id, CASE WHEN w AND NOT e THEN 'west' WHEN e AND NOT w THEN 'east' END AS district FROM (SELECT id,
 (lon >= 7.1 AND lon < 7.25 AND lat >= 43.6 AND lat < 43.8) AND NOT (lon >= 7.15 AND lon < 7.2 AND lat >= 43.65 AND lat < 43.7) AS w, (lon >= 7.22 AND lon < 7.4 AND lat >= 43.6 AND lat < 43.8) AS e FROM lst WHERE lat IS NOT NULL)""")
def polygon(t):
    return t.lst.where("lat is not null").select("id", J.district_at(F.col("lon"), F.col("lat"), SHAPES).alias("district"))


@R.add("h01_sorts", """
SELECT 'price' AS kind, id FROM (SELECT id FROM lst ORDER BY price ASC NULLS LAST, id LIMIT 20) UNION ALL SELECT 'closest', id FROM (SELECT id FROM lst ORDER BY commute ASC NULLS LAST, id LIMIT 20)
UNION ALL SELECT 'area', id FROM (SELECT id FROM lst ORDER BY area DESC NULLS LAST, id LIMIT 20) UNION ALL SELECT 'recent', id FROM (SELECT id FROM lst ORDER BY coalesce(published, first_seen) DESC NULLS LAST, id LIMIT 20 OFFSET 10)""")
def sorts(t):
    part = lambda k, o=0: P.page(t.lst, k, 20, o).select(F.lit(k).alias("kind"), "id")
    return part("price").union(part("closest")).union(part("area")).union(part("recent", 10))


@R.add("h05_alerts", """
SELECT user_id, listing_id, greatest(coalesce(notified_at, TIMESTAMP '1970-01-01'), coalesce(available_at, TIMESTAMP '1970-01-01')) AS latest FROM state JOIN lst ON listing_id = id ORDER BY latest DESC, user_id, listing_id LIMIT 200""")
def alerts(t):
    never = F.lit("1970-01-01").cast("timestamp")
    rows = t.state.join(t.lst, F.col("listing_id") == F.col("id"))
    return rows.select("user_id", "listing_id", F.greatest(F.coalesce("notified_at", never), F.coalesce("available_at", never)).alias("latest")).orderBy(F.desc("latest"), "user_id", "listing_id").limit(200)


@R.add("i01_changed_ids", "SELECT DISTINCT occurrence_id FROM hist WHERE change = 'price-drop' AND changed_at >= TIMESTAMP '2024-01-20'")
def changed_ids(t):
    return t.hist.where((F.col("change") == "price-drop") & (F.col("changed_at") >= F.lit("2024-01-20").cast("timestamp"))).select("occurrence_id").distinct()


@R.add("i03_saved_searches", """SELECT count(*) AS n FROM (SELECT id FROM lst WHERE price <= 700 UNION SELECT id FROM lst WHERE area >= 80 UNION SELECT id FROM lst WHERE city = 'city3')""")
def saved(t):
    ids = lambda c: t.lst.where(c).select("id")
    return ids("price <= 700").union(ids("area >= 80")).union(ids("city = 'city3'")).distinct().agg(F.count("*").alias("n"))


@R.add("i04_known_minus_stale", """
SELECT id FROM occ WHERE source_id = 's7' AND id NOT IN (SELECT id FROM (SELECT id FROM occ WHERE source_id = 's7' AND (price IS NULL OR area IS NULL) ORDER BY last_seen, id LIMIT 5)) AND id NOT IN (SELECT id FROM (SELECT id FROM occ WHERE source_id = 's7' AND last_seen < TIMESTAMP '1997-01-01' ORDER BY last_seen, id LIMIT 2))""")
def known(t):
    own = t.occ.where("source_id = 's7'")
    oldest = lambda df, n: df.orderBy("last_seen", "id").limit(n).select("id")
    out = own.join(oldest(own.where("price is null or area is null"), 5), "id", "left_anti")
    return out.join(oldest(own.where("last_seen < timestamp '1997-01-01'"), 2), "id", "left_anti").select("id")


@R.add("i06_new_ids", "SELECT id FROM lst WHERE lifecycle = 'active' EXCEPT SELECT listing_id FROM state WHERE notified_at IS NOT NULL")
def new_ids(t):
    seen = t.state.where("notified_at is not null").select(F.col("listing_id").alias("id"))
    return t.lst.where("lifecycle = 'active'").select("id").join(seen, "id", "left_anti")


@R.add("q08_absorbed", """
SELECT l.id AS old_id, coalesce(g.group_id, l.id) AS now_id FROM lst l LEFT JOIN (SELECT CAST(source_ref AS BIGINT) AS ref, min(group_id) AS group_id FROM occ GROUP BY source_ref) g ON g.ref = l.id""")
def absorbed(t):
    to = t.occ.groupBy(F.col("source_ref").cast("long").alias("id")).agg(F.min("group_id").alias("group_id"))
    return t.lst.select("id").join(to, "id", "left").select(F.col("id").alias("old_id"), F.coalesce("group_id", "id").alias("now_id"))


@R.add("q28_readonly_sql", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def readonly(t):
    from tallyspark.plans.api import read_only_sql

    return read_only_sql(t.spark, "SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey", nation=t.nation)
