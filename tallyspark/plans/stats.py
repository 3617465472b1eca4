"""Queries: duplicates, merging, aggregations, windows, scores, lifecycle (survey parts B, D, E, F, G, M, O)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions import listing as L
from tallyspark.functions import text as T
from tallyspark.operators import aggregates as A
from tallyspark.operators import dedupe as D
from tallyspark.operators import lifecycle as S
from tallyspark.operators import merge as M
from tallyspark.operators import scoring as C
from tallyspark.plans.proxies import Registry
from tallyspark.session import stage

R = Registry()
NOW = "1998-12-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


_FOLD = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS = "list_filter(string_split(coalesce(" + _FOLD + ", ''), ' '), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"
_GENERIC = ", ".join(f"'{w}'" for w in D.GENERIC_TITLE_WORDS)
_URL = "concat(regexp_replace(split_part(split_part(url, '//', 2), '/', 1), '^www\\.', ''), lower(concat('/Ad/', split_part(split_part(url, '/Ad/', 2), '?', 1))), '?a=1&b=', split_part(split_part(url, '&b=', 2), '&', 1))"
_KIND = "avenue|av|boulevard|bd|rue|place|chemin|impasse|allee|promenade|quai|route|montee|traverse|square|passage|corniche"
_PREP = f"""
base AS (SELECT DISTINCT ON (id) * FROM occ WHERE group_id IS NOT NULL AND lifecycle = 'active'),
feat AS (SELECT id, source_id, phone, email, price, area, rooms, city, postal_code, lat, lon, agency, {_URL} AS page, {_FOLD.format('address')} AS address, {_FOLD.format('district')} AS district,
 nullif(regexp_extract({_FOLD.format('address')}, '^([0-9]+)( ?bis)?', 1), '') || CASE WHEN {_FOLD.format('address')} LIKE '% bis rue %' THEN 'bis' ELSE '' END AS house, regexp_replace({_FOLD.format('address')}, '^([0-9]+ (bis )?)?rue ', '') AS street,
 list_filter([lower(reference), CASE WHEN description LIKE '% ref AB%' THEN lower(regexp_extract(description, ' ref (AB[0-9]+)', 1)) END], lambda x: x IS NOT NULL) AS published, CASE WHEN length(source_ref) >= 4 THEN source_ref END AS ref,
 list_transform(coalesce(image_urls, []), lambda u: regexp_extract(u, '^https://([^?]*)', 1)) AS photos,
 list_filter(list_transform(coalesce(image_urls, []), lambda u: regexp_replace(regexp_extract(u, '([^/?]*)([?].*)?$', 1), '[.]jpg$', '')), lambda x: length(x) >= 12) AS names,
 {_TOKENS.format("title")} AS words, coalesce(title LIKE '%...', false) AS cut, list_distinct({_TOKENS.format("title")}) AS tt, list_distinct({_TOKENS.format("description")}) AS dt, coalesce(length(description), 0) AS described FROM base),
pk AS (SELECT DISTINCT id, source_id, unnest(list_concat(photos, names)) AS key FROM feat),
stock AS (SELECT DISTINCT key FROM pk GROUP BY key, source_id HAVING count(*) >= 3),
worn AS (SELECT id, list(key) AS catalog FROM pk JOIN stock USING (key) GROUP BY id),
bad AS (SELECT page FROM feat GROUP BY page HAVING count(*) > 3 AND count(DISTINCT concat(coalesce(CAST(price AS STRING), '?'), '|', coalesce(CAST(area AS STRING), '?'))) > 1),
dup AS (SELECT f.* EXCLUDE (words), CASE WHEN cut THEN words[1:len(words) - 1] ELSE words END AS words, coalesce(catalog, []) AS catalog, bad.page IS NOT NULL AS generic, CASE WHEN ref IS NULL THEN published ELSE list_append(published, ref) END AS refs FROM feat f LEFT JOIN worn USING (id) LEFT JOIN bad USING (page))"""
_KEYS = f"""{_PREP},
k AS (SELECT DISTINCT id, key FROM (SELECT id, unnest(list_concat(list_concat(list_transform(refs, lambda x: concat('ref:', x)), list_transform(list_concat(photos, names), lambda x: concat('photo:', x))),
 [CASE WHEN phone IS NOT NULL THEN concat('phone:', phone) END, CASE WHEN email IS NOT NULL THEN concat('email:', email) END, CASE WHEN NOT generic THEN concat('url:', page) END,
 CASE WHEN area IS NOT NULL THEN concat('area:', c, ':', ab) END, CASE WHEN area IS NOT NULL THEN concat('area:', c, ':', ab - 1) END, CASE WHEN price IS NOT NULL THEN concat('price:', c, ':', pb) END, CASE WHEN price IS NOT NULL THEN concat('price:', c, ':', pb - 1) END,
 CASE WHEN area IS NOT NULL AND price IS NOT NULL THEN concat('pa:', pb, ':', ab) END, CASE WHEN area IS NOT NULL AND price IS NOT NULL THEN concat('pa:', pb, ':', ab - 1) END, CASE WHEN area IS NOT NULL AND price IS NOT NULL THEN concat('pa:', pb - 1, ':', ab) END, CASE WHEN area IS NOT NULL AND price IS NOT NULL THEN concat('pa:', pb - 1, ':', ab - 1) END])) AS key
 FROM (SELECT *, coalesce(city, postal_code, '?') AS c, CAST(floor(area / 5 + 0.5) AS BIGINT) AS ab, CAST(floor(price / 50 + 0.5) AS BIGINT) AS pb FROM dup)) WHERE key IS NOT NULL),
good AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 200),
pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN good USING (key) JOIN k y USING (key) WHERE x.id < y.id)"""
_JACCARD = "CASE WHEN len(l.{0}) = 0 OR len(r.{0}) = 0 THEN 0.0 ELSE len(list_intersect(l.{0}, r.{0}))::DOUBLE / len(list_distinct(list_concat(l.{0}, r.{0}))) END"
_VERDICT = f"""
sides AS (SELECT p.a, p.b, l.source_id <> r.source_id AS other, l.city <> r.city AS city, abs(l.area - r.area) <= greatest(2, 0.05 * greatest(l.area, r.area)) AS near_area, abs(l.price - r.price) <= greatest(30, 0.06 * greatest(l.price, r.price)) AS near_price,
 l.rooms <> r.rooms AS rooms, CASE WHEN l.lat IS NOT NULL AND r.lat IS NOT NULL THEN 2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - l.lon) / 2), 2)))) END AS km, abs(l.price - r.price) > 0.5 AS diff_price, abs(l.area - r.area) >= 0.005 AS diff_area, l.postal_code <> r.postal_code AS diff_post,
 l.phone = r.phone AS phone, l.email = r.email AS email, abs(l.area - r.area) < 0.005 AS exact, l.agency = r.agency AS agency, l.page = r.page AND NOT l.generic AS page, l.price = r.price AS same_price,
 len(list_intersect(list_intersect(l.refs, r.refs), list_concat(l.published, r.published))) > 0 AS ref, len(list_intersect(l.photos, r.photos)) AS common, len(list_filter(list_intersect(l.photos, r.photos), lambda x: NOT list_contains(l.catalog, x))) AS own,
 len(list_filter(list_intersect(l.names, r.names), lambda x: NOT list_contains(l.catalog, x))) AS named, len(l.photos) AS nl, len(r.photos) AS nr,
 CASE WHEN l.address IS NULL OR r.address IS NULL THEN 'none' WHEN l.address = r.address THEN CASE WHEN l.house IS NULL THEN 'bare' ELSE 'numbered' END WHEN NOT (starts_with(l.street, r.street) OR starts_with(r.street, l.street)) THEN 'none'
  WHEN l.house IS NOT NULL AND r.house IS NOT NULL THEN CASE WHEN l.house = r.house THEN 'numbered' ELSE 'none' END ELSE 'street' END AS street,
 l.district = r.district AS district, coalesce(list_contains(r.tt, l.district), false) OR coalesce(list_contains(l.tt, r.district), false) AS in_title, {_JACCARD.format('tt')} AS tj, {_JACCARD.format('dt')} AS dj, least(l.described, r.described) AS described,
 CASE WHEN len(l.words) <= len(r.words) THEN l.words ELSE r.words END AS sw, CASE WHEN len(l.words) <= len(r.words) THEN r.words ELSE l.words END AS lw, CASE WHEN len(l.words) <= len(r.words) THEN l.cut ELSE r.cut END AS cut
 FROM pairs p JOIN dup l ON l.id = p.a JOIN dup r ON r.id = p.b),
seen AS (SELECT *, CASE WHEN nl = 0 OR nr = 0 THEN 'none' WHEN NOT other THEN CASE WHEN own > 0 AND common = nl AND common = nr AND common >= 2 THEN 'identical' ELSE 'none' END WHEN own >= 1 OR named >= 2 THEN 'shared' WHEN common >= 1 OR named >= 1 THEN 'partial' ELSE 'none' END AS photos,
 len(sw) >= 4 AND len(list_filter(sw, lambda w: w NOT IN ({_GENERIC}))) >= 2 AND len(list_filter(sw, lambda w: NOT list_contains(lw, w))) = 0 AND (cut OR len(list_distinct(sw)) = len(list_distinct(lw))) AS same_title FROM sides),
pts AS (SELECT a, b, relay, described, CASE WHEN city THEN 'city' WHEN NOT near_area THEN 'area' WHEN NOT near_price AND photos <> 'shared' THEN 'price' WHEN rooms THEN 'rooms' WHEN km > 0.5 THEN 'far' END AS blocker,
 CASE WHEN NOT other THEN CASE WHEN diff_price THEN 'price' WHEN diff_area THEN 'area' WHEN diff_post THEN 'postal' END END AS conflict,
 CASE WHEN near_price THEN 18 ELSE 0 END + CASE WHEN near_area THEN 18 ELSE 0 END + CASE WHEN other AND exact THEN 30 ELSE 0 END + CASE WHEN NOT rooms THEN 6 ELSE 0 END + CASE WHEN NOT diff_post THEN 4 ELSE 0 END AS figures,
 CASE WHEN page THEN 70 ELSE 0 END + CASE photos WHEN 'shared' THEN 70 WHEN 'identical' THEN 45 WHEN 'partial' THEN 8 ELSE 0 END + CASE WHEN other AND phone THEN 40 ELSE 0 END + CASE WHEN other AND email THEN 35 ELSE 0 END + CASE WHEN other AND ref THEN 35 ELSE 0 END
 + CASE WHEN street = 'numbered' OR (street = 'bare' AND other) THEN 30 WHEN street <> 'none' THEN 10 ELSE 0 END + CASE WHEN km <= 0.08 THEN 30 ELSE 0 END + CASE WHEN other AND agency THEN 12 ELSE 0 END + CASE WHEN district THEN 12 WHEN in_title THEN 8 ELSE 0 END
 + CASE WHEN other AND same_title THEN 30 WHEN tj > 0.4 THEN floor(tj * 15 + 0.5) ELSE 0 END + CASE WHEN dj > 0.5 THEN floor(dj * 12 + 0.5) ELSE 0 END + relay AS others
 FROM (SELECT *, CASE WHEN other AND exact AND same_price AND (a_means = source_b OR b_means = source_a) THEN 30 ELSE 0 END AS relay FROM (SELECT seen.*, la.means AS a_means, ra.means AS b_means, l.source_id AS source_a, r.source_id AS source_b FROM seen JOIN dup l ON l.id = a JOIN dup r ON r.id = b LEFT JOIN named la ON la.agency = l.agency LEFT JOIN named ra ON ra.agency = r.agency))),
v AS (SELECT a, b, blocker, conflict, relay, CAST(CASE WHEN blocker IS NULL AND conflict IS NULL THEN figures + others ELSE 0 END AS INT) AS strength, blocker IS NULL AND conflict IS NULL AND figures + others >= 70 AND NOT (others = 0 AND described >= 100) AS duplicate FROM pts)"""
#: The source that an agency's name means: small, here of every fourth agency.
_NAMED = "named AS (SELECT concat('agency ', CAST(s_suppkey AS STRING)) AS agency, concat('s', CAST(s_suppkey AS STRING)) AS means FROM supplier WHERE s_suppkey % 4 = 0)"


def _named(t):
    return t.supplier.where("s_suppkey % 4 = 0").select(F.concat(F.lit("agency "), F.col("s_suppkey").cast("string")).alias("agency"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"))


def _ready(t):
    return stage(t.spark, D.prepared(t.living, agencies=_named(t)), "prepared")  # used three times


def _verdicts(t):
    rows = _ready(t)
    return D.judged(D.candidates(rows, stage(t.spark, D.bucket_marks(rows), "marks"), False), False)


def _links(t):
    return stage(t.spark, _verdicts(t).where("verdict = 'duplicate'").select("a", "b", "relayed"), "links")


@R.add("d01_blocking_pairs", f"WITH {_KEYS} SELECT a, count(*) AS partners, min(b) AS first, max(b) AS last FROM pairs GROUP BY a")
def blocking(t):
    rows = stage(t.spark, D.prepared(t.living, compared=False), "prepared")  # used twice
    return D.candidate_pairs(rows).groupBy("a").agg(F.count("*").alias("partners"), F.min("b").alias("first"), F.max("b").alias("last"))


@R.add("d03_similarity", f"WITH {_NAMED}, {_KEYS}, {_VERDICT} SELECT a, b, strength, least(strength, 100) AS score, CASE WHEN duplicate THEN 'duplicate' ELSE 'ambiguous' END AS verdict FROM v WHERE strength >= 45")
def similarity(t):
    return _verdicts(t).where("verdict <> 'distinct'").select("a", "b", "strength", "score", "verdict")


@R.add("d04_blockers", f"WITH {_NAMED}, {_KEYS}, {_VERDICT} SELECT blocker, conflict, CASE WHEN duplicate THEN 'duplicate' WHEN strength >= 45 THEN 'ambiguous' ELSE 'distinct' END AS verdict, count(*) AS n, sum(strength)::BIGINT AS strength FROM v GROUP BY ALL")
def blockers(t):
    rows = _ready(t)
    marks = stage(t.spark, D.bucket_marks(rows), "marks")
    # Blocked pairs have no points: only the others meet with their texts.
    shut = D.obstacles(rows, marks).where("blocker is not null or conflict is not null").select("blocker", "conflict", F.lit("distinct").alias("verdict"), F.lit(0).alias("strength"))
    free = D.judged(D.candidates(rows, marks, False), False).select("blocker", "conflict", "verdict", "strength")
    return shut.unionByName(free).groupBy("blocker", "conflict", "verdict").agg(F.count("*").alias("n"), F.sum("strength").cast("long").alias("strength"))


@R.add("d11_components", f"""
WITH RECURSIVE {_NAMED}, {_KEYS}, {_VERDICT}, e AS (SELECT a, b FROM v WHERE duplicate UNION SELECT b, a FROM v WHERE duplicate),
reach AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other) SELECT node, min(other) AS label FROM reach GROUP BY node""")
def components(t):
    return D.closure(_links(t).select("a", "b"))


@R.add("d13_dedupe", None)
def dedupe(t):
    return D.dedupe(t.living, agencies=_named(t))


@R.add("d12_contested", f"""
WITH {_NAMED}, {_KEYS}, {_VERDICT}, links AS (SELECT a, b, relay > 0 AND least(strength, 100) - relay < 70 AS relayed FROM v WHERE duplicate),
rivals AS (SELECT x FROM (SELECT a AS x FROM links WHERE relayed UNION ALL SELECT b FROM links WHERE relayed) GROUP BY x HAVING count(*) > 1)
SELECT a, b, relayed FROM links WHERE NOT relayed OR (a NOT IN (SELECT x FROM rivals) AND b NOT IN (SELECT x FROM rivals))""")
def contested(t):
    return D.uncontested(_links(t))


@R.add("e01_merge", """
WITH m AS (SELECT *, (CASE WHEN price IS NULL THEN 0 ELSE 1 END + CASE WHEN charges IS NULL THEN 0 ELSE 1 END + CASE WHEN area IS NULL THEN 0 ELSE 1 END + CASE WHEN rooms IS NULL THEN 0 ELSE 1 END + CASE WHEN city IS NULL THEN 0 ELSE 1 END + CASE WHEN postal_code IS NULL THEN 0 ELSE 1 END + CASE WHEN property_type IS NULL THEN 0 ELSE 1 END + CASE WHEN furnished IS NULL THEN 0 ELSE 1 END + CASE WHEN flat_share IS NULL THEN 0 ELSE 1 END + CASE WHEN lat IS NULL THEN 0 ELSE 1 END + CASE WHEN lon IS NULL THEN 0 ELSE 1 END + CASE WHEN agency IS NULL THEN 0 ELSE 1 END + CASE WHEN phone IS NULL THEN 0 ELSE 2 END + CASE WHEN email IS NULL THEN 0 ELSE 2 END) AS c FROM occ WHERE group_id IS NOT NULL),
best AS (SELECT group_id, arg_min(id, (-c, first_seen, id)) AS best_id FROM m GROUP BY group_id),
o AS (SELECT m.*, CASE WHEN m.id = best_id THEN 0 ELSE 1 END AS no FROM m JOIN best USING (group_id))
SELECT group_id, arg_min(id, (first_seen, id)) AS listing_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, arg_min(price, (no, first_seen, id)) FILTER (price IS NOT NULL) AS price, arg_min(source_id, (no, first_seen, id)) FILTER (price IS NOT NULL) AS price_source,
 arg_min(city, (no, first_seen, id)) FILTER (city IS NOT NULL) AS city, arg_min(phone, (first_seen, id)) FILTER (phone IS NOT NULL) AS phone, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS sources,
 CASE min(CASE lifecycle WHEN 'active' THEN 0 WHEN 'possiblyInactive' THEN 1 ELSE 2 END) WHEN 0 THEN 'active' WHEN 1 THEN 'possiblyInactive' ELSE 'inactive' END AS lifecycle, bool_or(coalesce(flat_share, false)) AS any_flat_share
FROM o GROUP BY group_id""")
def merge(t):
    out = M.merge(t.occ.where("group_id is not null"), ("price", "city"))
    return out.select("group_id", "listing_id", "first_seen", "last_seen", F.col("price.value").alias("price"), F.col("price.source_id").alias("price_source"), F.col("city.value").alias("city"), "phone", F.array_join("sources", ",").alias("sources"), "lifecycle", "any_flat_share")


@R.add("e03_conflicts", """
WITH m AS (SELECT group_id, id, source_id, first_seen, price FROM occ WHERE group_id IS NOT NULL AND price IS NOT NULL), best AS (SELECT group_id, arg_min(price, (first_seen, id)) AS value, arg_min(source_id, (first_seen, id)) AS source_id FROM m GROUP BY group_id)
SELECT b.group_id, count(*) FILTER (m.source_id <> b.source_id AND abs(m.price - b.value) > 0.01) AS conflicts FROM best b JOIN m USING (group_id) GROUP BY b.group_id""")
def conflicts(t):
    rows = t.occ.where("group_id is not null and price is not null").withColumn("best", F.lit(False))
    return rows.groupBy("group_id").agg(M.merge_field("price").alias("f")).select("group_id", F.size("f.conflicts").cast("long").alias("conflicts"))


@R.add("e10_default_positions", """
SELECT source_id, count(*) AS n FROM (SELECT source_id, lat, count(DISTINCT concat(coalesce(CAST(price AS STRING), '?'), '/', coalesce(CAST(area AS STRING), '?'))) OVER (PARTITION BY source_id, round(lat, 5), round(lon, 5)) AS kinds FROM occ) WHERE lat IS NOT NULL AND kinds >= 3 GROUP BY source_id""")
def default_positions(t):
    return D.shared_positions(t.occ, 3).where("default_position").groupBy("source_id").agg(F.count("*").alias("n"))


@R.add("e12_generic_addresses", f"SELECT url_key, count(*) AS n, count(DISTINCT (price, area)) AS kinds FROM (SELECT {_URL} AS url_key, price, area FROM occ) GROUP BY url_key HAVING count(*) > 3 AND count(DISTINCT (price, area)) > 1")
def generic(t):
    return D.generic_addresses(t.occ)


_SPEC = "CASE WHEN price IS NOT NULL AND area IS NOT NULL AND city IS NOT NULL THEN concat(CAST(floor(price + 0.5) AS BIGINT), '|', CAST(floor(area + 0.5) AS BIGINT), '|', lower(city), '|', coalesce(CAST(rooms AS STRING), '?')) END"


@R.add("e14_spec_keys", f"SELECT id, {_SPEC} AS key FROM lst")
def spec_keys(t):
    return t.lst.select("id", L.spec_key(F.col("price"), F.col("area"), F.col("city"), F.col("rooms")).alias("key"))


_LOOSE = "CASE WHEN price IS NOT NULL AND area IS NOT NULL THEN concat(CAST(floor(price + 0.5) AS BIGINT), '|', CAST(floor(area + 0.5) AS BIGINT), '|', coalesce(CAST(rooms AS STRING), '?')) END"
_PENDING = """
SELECT id, min(concat('s', CAST(CAST(substr(source_id, 2) AS BIGINT) % 10 AS STRING))) AS source_id, min(first_seen) AS first_seen, min(price) AS price, min(area) AS area, min(city) AS city, min(rooms) AS rooms, min(CASE WHEN group_id % 3 = 0 THEN group_id ELSE -1 END) AS g FROM occ WHERE group_id % 2 = 0 GROUP BY id"""


@R.add("e13_redundant", f"""
WITH p AS (SELECT *, {_SPEC} AS a, {_LOOSE} AS b FROM ({_PENDING}) x), d AS (SELECT {_SPEC} AS key FROM occ WHERE group_id % 16 = 1 UNION SELECT {_LOOSE} FROM occ WHERE group_id % 16 = 1),
m AS (SELECT id, source_id, EXISTS (SELECT 1 FROM d WHERE key = a OR key = b) OR EXISTS (SELECT 1 FROM p q WHERE q.source_id <> 's9' AND (q.a = p.a OR q.b = p.b)) AS told, CASE WHEN g >= 0 AND source_id <> 's9' AND b IS NOT NULL THEN first_value(id) OVER (PARTITION BY source_id, b, g ORDER BY first_seen, id) END AS first FROM p)
SELECT id, NULL AS of FROM m WHERE CASE WHEN source_id = 's9' THEN NOT told ELSE first IS NULL OR first = id END UNION ALL SELECT id, first FROM m WHERE source_id <> 's9' AND first <> id""")
def redundant(t):
    name = lambda kind: F.concat(F.lit(f"https://img.example/{kind}"), F.lpad(F.col("g").cast("string"), 12, "0"), F.lit(".jpg"))
    images = F.when(F.col("g") >= 0, F.array(name("front"), name("back"))).otherwise(F.array(name("front"), F.lit("https://img.example/x.jpg")))
    pending = t.sql(_PENDING).select("*", F.struct("first_seen", "id").alias("ordinal"), images.alias("image_urls"))
    rows = t.occ.where("group_id % 16 = 1")
    direct = rows.select(F.explode(F.array(L.spec_key(F.col("price"), F.col("area"), F.col("city"), F.col("rooms")), L.loose_key(F.col("price"), F.col("area"), F.col("rooms")))).alias("key"))
    kept, echoes = M.redundant(pending, direct, ("s9",))
    return kept.select("id", F.lit(None).cast("string").alias("of")).union(echoes)


@R.add("f01_totals", "SELECT count(*) AS total, coalesce(sum(CASE WHEN matches = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS matching, coalesce(sum(CASE WHEN lifecycle = 'active' THEN 1 ELSE 0 END), 0)::BIGINT AS active, coalesce(sum(CASE WHEN tracking = 'contacted' THEN 1 ELSE 0 END), 0)::BIGINT AS contacted FROM lst l LEFT JOIN score s ON s.listing_id = l.id AND s.user_id = 'u1' LEFT JOIN state st ON st.listing_id = l.id AND st.user_id = 'u1'")
def totals(t):
    from tallyspark.operators.joins import overlay

    return A.totals(overlay(t.lst, t.state, t.score, "u1"), {"total": F.lit(True), "matching": F.col("matches") == 1, "active": F.col("lifecycle") == "active", "contacted": F.col("tracking") == "contacted"})


_LIFE = """life AS (SELECT source_id, CAST(date_diff('day', first_seen, last_seen) AS DOUBLE) AS days, lifecycle = 'inactive' AS ended FROM occ)"""


@R.add("f02_survival", f"""
WITH {_LIFE}, d AS (SELECT days AS day, count(*) AS n, sum(CASE WHEN ended THEN 1 ELSE 0 END) AS deaths FROM life GROUP BY days), r AS (SELECT day, deaths, sum(n) OVER (ORDER BY day DESC) AS at_risk FROM d)
SELECT day, at_risk::BIGINT AS at_risk, deaths::BIGINT AS deaths, round(exp(sum(CASE WHEN deaths = at_risk THEN -1e9 ELSE ln(1 - deaths / at_risk) END) OVER (ORDER BY day)), 9) AS share FROM r WHERE deaths > 0""")
def survival(t):
    days = F.date_diff(F.to_date("last_seen"), F.to_date("first_seen")).cast("double")
    return A.survival(t.occ.select(days.alias("days"), (F.col("lifecycle") == "inactive").alias("ended"))).drop("horizon").withColumn("share", F.round("share", 9))


@R.add("f02_survival_median", f"""
WITH {_LIFE}, d AS (SELECT days AS day, count(*) AS n, sum(CASE WHEN ended THEN 1 ELSE 0 END) AS deaths FROM life GROUP BY days), r AS (SELECT day, deaths, sum(n) OVER (ORDER BY day DESC) AS at_risk FROM d),
s AS (SELECT day, exp(sum(CASE WHEN deaths = at_risk THEN -1e9 ELSE ln(1 - deaths / at_risk) END) OVER (ORDER BY day)) AS share FROM r WHERE deaths > 0) SELECT min(day) AS median FROM s WHERE share <= 0.5""")
def survival_median(t):
    days = F.date_diff(F.to_date("last_seen"), F.to_date("first_seen")).cast("double")
    return A.median_survival(A.survival(t.occ.select(days.alias("days"), (F.col("lifecycle") == "inactive").alias("ended"))))


@R.add("f04_lifetimes", """
SELECT source_id, round((epoch_us(last_seen) - epoch_us(first_seen)) / 86400e6, 6) AS days, lifecycle = 'inactive' AS ended FROM (SELECT *, min(CAST(first_seen AS DATE)) OVER (PARTITION BY source_id) AS f, count(*) OVER (PARTITION BY source_id, first_seen) AS b FROM occ) WHERE CAST(first_seen AS DATE) > f AND b <= 15""")
def lifetimes(t):
    return A.lifetimes(t.occ).withColumn("days", F.round("days", 6))


@R.add("f05_agencies", """
SELECT replace(agency, ' ', '') AS key, min(agency) AS name, count(DISTINCT group_id) AS listings, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS sources, max(last_seen) AS last_seen FROM occ GROUP BY agency""")
def agencies(t):
    return A.agencies(t.occ)


@R.add("f07_districts", "SELECT k.district, count(l.id) AS n FROM (SELECT unnest(['d0', 'd1', 'd2', 'd3', 'd4', 'd5', 'd6', 'd7']) AS district) k LEFT JOIN lst l ON l.district = k.district GROUP BY k.district")
def districts(t):
    counts = t.lst.where("district is not null").groupBy("district").agg(F.count("*").alias("n"))
    spine = t.spark.range(8).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("district"))
    return A.with_zeroes(spine, counts, "district", "n")


@R.add("f08_histogram", "SELECT CAST(b AS INT) AS bucket, count(price) AS n FROM range(200, 2501, 50) r(b) LEFT JOIN lst ON least(greatest(CAST(floor((price - 200) / 50) * 50 + 200 AS INT), 200), 2500) = b GROUP BY b")
def histogram(t):
    return A.histogram(t.lst, "price", 200, 2500, 50)


@R.add("f09_exchanges", "SELECT source_id, count(*) AS n, max(started_at) AS latest, arg_max(stop_reason, (started_at, id)) AS last_reason FROM runs GROUP BY source_id")
def exchanges(t):
    return t.runs.groupBy("source_id").agg(F.count("*").alias("n"), F.max("started_at").alias("latest"), F.max_by("stop_reason", F.struct("started_at", "id")).alias("last_reason"))


@R.add("f10_observations", """
SELECT d.source_id, d.day, d.n, r.reasons FROM (SELECT source_id, CAST(started_at AS DATE) AS day, sum(new_count)::BIGINT AS n FROM runs GROUP BY ALL) d JOIN (SELECT source_id, string_agg(stop_reason, ',' ORDER BY k) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS k FROM runs) WHERE k <= 3 GROUP BY source_id) r USING (source_id)""")
def observations(t):
    daily, reasons = A.observations(t.runs)
    return daily.join(reasons, "source_id")


@R.add("f13_vanish", """
SELECT source_id, sum(CASE WHEN missing_runs >= 3 THEN 1 ELSE 0 END)::BIGINT AS retired, sum(CASE WHEN missing_runs >= 3 AND first_seen = last_seen AND b < 3 THEN 1 ELSE 0 END)::BIGINT AS vanished FROM (SELECT *, count(*) OVER (PARTITION BY source_id, first_seen) AS b FROM occ WHERE first_seen >= TIMESTAMP '1995-01-01') GROUP BY source_id""")
def vanish(t):
    return A.vanish_rates(t.occ, F.lit("1995-01-01").cast("timestamp"))


@R.add("h06_vanishing", """
SELECT source_id, retired, vanished, vanished::DOUBLE / retired AS share FROM (SELECT source_id, count(*) FILTER (missing_runs >= 3) AS retired, count(*) FILTER (missing_runs >= 3 AND lifecycle = 'inactive') AS vanished FROM occ GROUP BY source_id) WHERE retired >= 8 AND vanished::DOUBLE / retired >= 0.15 ORDER BY share DESC, source_id LIMIT 3""")
def vanishing(t):
    rates = t.occ.groupBy("source_id").agg(A.count_if(F.col("missing_runs") >= 3).alias("retired"), A.count_if((F.col("missing_runs") >= 3) & (F.col("lifecycle") == "inactive")).alias("vanished"))
    return A.vanishing(rates)


_FOUND = """e AS (SELECT event_id, concat('s', CAST(user_id % 20 AS STRING)) AS source_id, ts FROM events WHERE event_type = 'purchase'),
att AS (SELECT event_id, coalesce(arg_min(r.id, (r.started_at, r.id)) FILTER (e.ts <= r.finished_at), arg_max(r.id, (r.started_at, r.id))) AS run FROM e JOIN runs r ON r.source_id = e.source_id AND r.started_at <= e.ts GROUP BY event_id)"""


@R.add("f14_spend", f"""
WITH {_FOUND}, h AS (SELECT run AS id, count(*) AS hits FROM att GROUP BY run), j AS (SELECT r.*, coalesce(h.hits, 0) AS hits FROM runs r LEFT JOIN h USING (id))
SELECT source_id, count(*) AS passes, sum(request_count)::BIGINT AS requests, sum(hits)::BIGINT AS discoveries, count(*) FILTER (hits = 0) AS sterile_passes, coalesce(sum(request_count) FILTER (hits = 0), 0)::BIGINT AS sterile_requests, CASE WHEN sum(hits) > 0 THEN sum(request_count)::DOUBLE / sum(hits) END AS cost FROM j GROUP BY source_id""")
def spend(t):
    return A.spend(t.runs, _attributed(t))


def _attributed(t):
    from tallyspark.operators.joins import as_of

    found = t.events.where("event_type = 'purchase'").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("source_id"))
    return as_of(found, t.runs, "source_id", "event_id", "ts")


@R.add("f15_spend_by_group", f"""
WITH {_FOUND}, h AS (SELECT run AS id, count(*) AS hits FROM att GROUP BY run), j AS (SELECT r.*, coalesce(h.hits, 0) AS hits FROM runs r LEFT JOIN h USING (id))
SELECT right(source_id, 1) AS grp, count(*) AS passes, sum(request_count)::BIGINT AS requests, sum(hits)::BIGINT AS discoveries FROM j GROUP BY 1""")
def spend_by_group(t):
    return A.spend_by(A.spend(t.runs, _attributed(t)), F.right("source_id", F.lit(1)))


@R.add("f16_cadence", None)
def cadence(t):
    return A.cadence(t.runs)


@R.add("f17_service", "SELECT sum(1440.0 / (5 + n % 60)) AS demand, 600 AS capacity, least(1.0, 600 / sum(1440.0 / (5 + n % 60))) AS served FROM (SELECT source_id, count(*) AS n FROM runs GROUP BY source_id)")
def service(t):
    n = t.runs.groupBy("source_id").agg(F.count("*").alias("n"))
    return A.service(n.select((5 + F.col("n") % 60).alias("interval_min")), 6, 100)


@R.add("f18_reach", """
WITH h AS (SELECT DISTINCT regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages) SELECT s.domain, count(h.host) AS hosts FROM (SELECT unnest(['example.com', 'example.net', 'example.org']) AS domain) s LEFT JOIN h ON h.host = s.domain OR ends_with(h.host, concat('.', s.domain)) GROUP BY s.domain""")
def reach(t):
    hosts = t.pages.select(F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#:]+)", 1).alias("host")).distinct()
    parts = F.split("host", r"\.")
    suffixes = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))).alias("domain"))
    known = t.spark.createDataFrame([("example.com",), ("example.net",), ("example.org",)], "domain string")
    return known.join(suffixes, "domain", "left").groupBy("domain").agg(F.count("host").alias("hosts"))


@R.add("f19_silent", """
WITH d AS (SELECT source_id, date_diff('day', CAST(started_at AS DATE), DATE '2024-01-31') AS age, sum(CASE WHEN CAST(started_at AS DATE) >= DATE '2024-01-29' AND source_id IN ('s1', 's2', 's5') THEN 0 ELSE new_count END)::BIGINT AS n FROM runs GROUP BY ALL)
SELECT source_id, median(n) FILTER (age BETWEEN 3 AND 12) AS usual FROM d GROUP BY source_id HAVING count(*) FILTER (age BETWEEN 0 AND 2) >= 2 AND sum(n) FILTER (age BETWEEN 0 AND 2) = 0 AND count(*) FILTER (age BETWEEN 3 AND 12) >= 4 AND median(n) FILTER (age BETWEEN 3 AND 12) * 3 >= 5""")
def silent(t):
    quiet = (F.to_date("started_at") >= F.lit("2024-01-29").cast("date")) & F.col("source_id").isin("s1", "s2", "s5")
    daily, _ = A.observations(t.runs.withColumn("new_count", F.when(quiet, 0).otherwise(F.col("new_count"))))
    return A.silent(daily, F.lit("2024-01-31").cast("date"))


@R.add("f20_interrupted", "SELECT source_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS k FROM runs) WHERE k <= 2 GROUP BY source_id HAVING count(*) = 2 AND bool_and(stop_reason IN ('error', 'blocked'))")
def interrupted(t):
    return A.interrupted(A.observations(t.runs, 2)[1], n=2)


@R.add("f22_median", "SELECT source_id, median(request_count) AS median FROM runs GROUP BY source_id")
def median(t):
    return t.runs.groupBy("source_id").agg(F.median("request_count").alias("median"))


@R.add("f23_incidents", "SELECT id FROM (SELECT id, (epoch_us(changed_at) - lag(epoch_us(changed_at)) OVER (PARTITION BY occurrence_id ORDER BY changed_at, id)) / 3600e6 AS gap FROM hist) WHERE gap IS NULL OR gap > 24")
def incidents(t):
    return S.incidents(t.hist.select(F.col("occurrence_id").alias("key"), F.col("changed_at").alias("at"), "id")).select("id")


@R.add("f24_moving_average", """
WITH RECURSIVE r AS (SELECT source_id, new_count, row_number() OVER (PARTITION BY source_id ORDER BY started_at, id) AS k FROM runs), f AS (SELECT source_id, k, floor((0.0::DOUBLE * 0.7::DOUBLE + new_count * 0.3::DOUBLE) * 100 + 0.5) / 100 AS average FROM r WHERE k = 1
UNION ALL SELECT r.source_id, r.k, floor((f.average * 0.7::DOUBLE + r.new_count * 0.3::DOUBLE) * 100 + 0.5) / 100 FROM f JOIN r ON r.source_id = f.source_id AND r.k = f.k + 1) SELECT source_id, arg_max(average, k)::DOUBLE AS average FROM f GROUP BY source_id""")
def moving_average(t):
    return A.moving_average(t.runs, "source_id", ["started_at", "id"], "new_count")


@R.add("f29_fill_matrix", "SELECT source_id, count(*) AS n, count(price) AS n_price, count(area) AS n_area, count(city) AS n_city, count(phone) AS n_phone FROM occ GROUP BY source_id")
def fill_matrix(t):
    return A.fill_matrix(t.occ, "source_id", ["price", "area", "city", "phone"])


@R.add("f36_signature", """
SELECT substr(sha256(concat_ws('|', CAST(strftime((SELECT max(last_seen) FROM occ), '%Y-%m-%d %H:%M:%S') AS STRING), strftime((SELECT max(changed_at) FROM hist), '%Y-%m-%d %H:%M:%S'), 'sort=recent')), 1, 32) AS etag""")
def signature(t):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return A.signature({"m1": t.occ.select(text("last_seen").alias("m1")), "m2": t.hist.select(text("changed_at").alias("m2"))}, "sort=recent")


@R.add("f37_affinity", """
WITH w AS (SELECT l.id, coalesce(CASE WHEN st.favorite = 1 THEN 5 WHEN st.archived = 1 THEN -2 WHEN st.tracking = 'visited' THEN 5 END, 0) AS w, unnest(list_distinct([concat('city:', coalesce(city, '?')), concat('type:', property_type), concat('rooms:', coalesce(CAST(rooms AS STRING), '?'))])) AS f FROM lst l LEFT JOIN state st ON st.listing_id = l.id AND st.user_id = 'u3'),
t AS (SELECT f, sum(w) AS total FROM w GROUP BY f), s AS (SELECT id, sum(greatest(total, 0)) AS s FROM w JOIN t USING (f) GROUP BY id) SELECT id, round(CASE WHEN (SELECT count(DISTINCT id) FROM w WHERE w > 0) >= 2 AND (SELECT max(s) FROM s) > 0 THEN s / (SELECT max(s) FROM s) ELSE 0 END, 9)::DOUBLE AS affinity FROM s""")
def affinity(t):
    from tallyspark.operators.joins import overlay

    rows = overlay(t.lst, t.state, t.score, "u3")
    held = F.array(F.concat(F.lit("city:"), F.coalesce("city", F.lit("?"))), F.concat(F.lit("type:"), F.col("property_type")), F.concat(F.lit("rooms:"), F.coalesce(F.col("rooms").cast("string"), F.lit("?"))))
    weight = F.coalesce(F.when(F.col("favorite") == 1, 5).when(F.col("archived") == 1, -2).when(F.col("tracking") == "visited", 5), F.lit(0))
    return A.affinity(rows, held, weight).withColumn("affinity", F.round(F.col("affinity").cast("double"), 9))


@R.add("f38_grid", "SELECT CAST(floor(embedding[1] / 0.1::DOUBLE) AS BIGINT) AS cx, CAST(floor(embedding[2] / 0.1::DOUBLE) AS BIGINT) AS cy, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y FROM embeddings GROUP BY 1, 2")
def grid(t):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return A.grid(t.embeddings, e(0), e(1), 0.1).select("cx", "cy", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@R.add("f39_daily", "SELECT * FROM (SELECT CAST(started_at AS DATE) AS day, count(*) AS n FROM runs GROUP BY 1 ORDER BY 1 DESC LIMIT 10) ORDER BY day")
def daily(t):
    return t.runs.groupBy(F.to_date("started_at").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(10).orderBy("day")


@R.add("g04_partition_sum", "SELECT id, sum(CASE WHEN stop_reason = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id)::BIGINT AS errors, count(*) OVER (PARTITION BY source_id) AS n FROM runs")
def partition_sum(t):
    w = Window.partitionBy("source_id")
    return t.runs.select("id", F.sum(F.when(F.col("stop_reason") == "error", 1).otherwise(0)).over(w).cast("long").alias("errors"), F.count("*").over(w).alias("n"))


@R.add("g05_total_before_limit", "SELECT id, (SELECT count(*) FROM lst WHERE price < 800) AS total FROM lst WHERE price < 800 ORDER BY price, id LIMIT 10")
def total_before_limit(t):
    rows = t.lst.where("price < 800")
    return rows.orderBy("price", "id").limit(10).withColumn("total", rows.agg(F.count("*")).scalar()).select("id", "total")


@R.add("g06_gaps", "SELECT id, (epoch_us(started_at) - lag(epoch_us(started_at)) OVER (PARTITION BY source_id ORDER BY started_at, id)) / 1e6 AS gap FROM runs")
def gaps(t):
    w = Window.partitionBy("source_id").orderBy("started_at", "id")
    return t.runs.select("id", ((F.unix_micros("started_at") - F.lag(F.unix_micros("started_at")).over(w)) / 1e6).alias("gap"))


@R.add("g09_rolling_quota", "SELECT id, count(*) OVER (PARTITION BY source_id ORDER BY epoch_us(started_at) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM runs")
def rolling(t):
    return t.runs.select("id", A.trailing(t.runs, "source_id", "started_at", 3600).alias("n"))


@R.add("m01_match", """
WITH b AS (SELECT *, coalesce(CASE WHEN charges_included THEN price WHEN NOT charges_included AND charges IS NOT NULL THEN price + charges END, price) AS rent FROM lst),
p AS (SELECT *, CASE WHEN city IN ('city1', 'city2') THEN 30.0 ELSE 0 END + CASE WHEN NOT coalesce(price < 250, false) AND rent <= 900 THEN floor(30 + least(10.0, (900.0::DOUBLE - rent) / 900.0::DOUBLE * 33) + 0.5) ELSE 0 END + CASE WHEN area >= 40 THEN floor(20 + least(10.0, (area - 40) / 2) + 0.5) ELSE 0 END AS total,
 100.0 - (CASE WHEN city IS NULL THEN 30 ELSE 0 END + CASE WHEN rent IS NULL THEN 40 ELSE 0 END + CASE WHEN area IS NULL THEN 30 ELSE 0 END) AS known,
 coalesce(city NOT IN ('city1', 'city2'), false) OR coalesce(price < 250, false) OR coalesce(rent > 900, false) OR coalesce(area < 40, false) OR property_type IN ('parking', 'commercial') OR coalesce(commute > 60, false) AS bad FROM b),
r AS (SELECT *, CASE WHEN known > 0 THEN total::DOUBLE / known::DOUBLE * 100 ELSE 0 END AS raw FROM p)
SELECT id, NOT bad AS matches, CAST(least(greatest(floor(CASE WHEN bad THEN least(raw, 40) ELSE raw END + 0.5), 0), 100) AS INT) AS value, known::DOUBLE / 100 AS confidence FROM r""")
def match(t):
    m = C.match(C.Criteria(cities=("city1", "city2"), max_price=900.0, min_area=40.0))
    return t.lst.select("id", m.alias("m")).select("id", "m.matches", "m.value", "m.confidence")


_AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(coalesce(published, first_seen))) / 60e6"


@R.add("m03_opportunity", f"""
WITH a AS (SELECT *, {_AGE} AS age FROM lst), p AS (SELECT *, CASE WHEN age <= 15 THEN 50 WHEN age <= 60 THEN 45 WHEN age <= 360 THEN 35 WHEN age <= 1440 THEN 25 WHEN age <= 4320 THEN 12 WHEN age <= 10080 THEN 5 ELSE 0 END AS f FROM a)
SELECT id, CAST(least(100, coalesce(CASE WHEN published IS NOT NULL THEN f ELSE floor(f * 0.7 + 0.5) END, 0) + CASE WHEN phone IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 12 ELSE 0 END + CASE WHEN age > 0 AND views / greatest(1.0, age / 60) > 20 THEN 10 ELSE 0 END + CASE WHEN favorites > 5 THEN 5 ELSE 0 END) AS INT) AS value,
 round((3 - least(3, CASE WHEN published IS NULL THEN 1 ELSE 0 END + CASE WHEN phone IS NULL AND email IS NULL THEN 1 ELSE 0 END + CASE WHEN views IS NULL THEN 1 ELSE 0 END + CASE WHEN favorites IS NULL THEN 1 ELSE 0 END)) / 3, 9)::DOUBLE AS confidence FROM p""")
def opportunity(t):
    s = C.opportunity(now(), F.col("id") % 3 == 0)
    return t.lst.select("id", s.alias("s")).select("id", "s.value", F.round("s.confidence", 9).alias("confidence"))


@R.add("m04_visit", f"""
WITH a AS (SELECT *, {_AGE} / 60 AS h FROM lst), p AS (SELECT *, CASE WHEN h <= 1 THEN 25 WHEN h <= 6 THEN 15 WHEN h <= 24 THEN 5 WHEN h > 168 THEN -20 END AS d FROM a)
SELECT id, CAST(least(greatest(40 + coalesce(CASE WHEN published IS NOT NULL THEN d ELSE floor(d * 0.7 + 0.5) END, 0) + CASE WHEN phone IS NOT NULL THEN 20 WHEN email IS NOT NULL THEN 10 ELSE -15 END + CASE WHEN landlord_kind = 'agency' THEN 5 ELSE 0 END, 0), 100) AS INT) AS value FROM p""")
def visit(t):
    return t.lst.select("id", C.visit_probability(now())["value"].alias("value"))


@R.add("m05_risk", """
WITH r AS (SELECT *, price / area / CASE WHEN rooms IS NULL THEN 20.43 WHEN rooms <= 2 THEN 22.74 ELSE 19.73 END AS q FROM lst)
SELECT id, CAST(least(100, CASE WHEN q < 0.4 THEN 40 WHEN q >= 0.4 AND q < 0.6 THEN 20 ELSE 0 END + CASE WHEN area / rooms < 9 THEN 15 ELSE 0 END + CASE WHEN phone IS NULL AND email IS NULL THEN 15 WHEN phone IS NULL THEN 5 ELSE 0 END) AS INT) AS value FROM r""")
def risk(t):
    return t.lst.select("id", C.risk()["value"].alias("value"))


@R.add("m07_priority", """
WITH s AS (SELECT event_id, event_id % 101 AS m, user_id % 101 AS o, event_id * 7 % 101 AS v, event_id * 3 % 60 AS r FROM events), b AS (SELECT *, least(greatest(floor(m * 0.3::DOUBLE + o * 0.35::DOUBLE + v * 0.25::DOUBLE + (100 - r) * 0.1::DOUBLE + 0.5), 0), 100) AS base FROM s), p AS (SELECT event_id, CAST(CASE WHEN r >= 40 THEN least(base, 49) ELSE base END AS INT) AS priority FROM b)
SELECT event_id, priority, CASE WHEN priority >= 58 THEN 'hot' WHEN priority >= 50 THEN 'worth' ELSE 'other' END AS band FROM p""")
def priority(t):
    e = F.col("event_id")
    p = C.priority(e % 101, F.col("user_id") % 101, e * 7 % 101, e * 3 % 60)
    return t.events.select("event_id", p.alias("priority"), C.band(p).alias("band"))


@R.add("m11_for_each_user", "SELECT u.user_id, count(*) AS n, sum(CASE WHEN price <= u.cap THEN 1 ELSE 0 END)::BIGINT AS fitting FROM lst, (SELECT unnest(['a', 'b', 'c']) AS user_id, unnest([500, 800, 1100]) AS cap) u GROUP BY u.user_id")
def for_each_user(t):
    fits = {u: A.count_if(F.col("price") <= cap) for u, cap in (("a", 500), ("b", 800), ("c", 1100))}  # users are scored in one pass over the listings
    one = t.lst.agg(F.count("*").alias("n"), *[c.alias(u) for u, c in fits.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(u).alias("user_id"), F.col("n"), F.col(u).alias("fitting")) for u in fits])).alias("x")).select("x.*")


@R.add("b01_upsert", """
WITH o AS (SELECT DISTINCT ON (p_partkey) p_partkey AS k, p_size AS h, TIMESTAMP '1995-01-01' AS first_seen, TIMESTAMP '1996-01-01' AS last_seen, 2 AS missing_runs, 'possiblyInactive' AS lifecycle FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS h FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.h ELSE o.h END::INT AS hash, CASE WHEN o.k IS NULL THEN TIMESTAMP '1997-01-01' ELSE o.first_seen END AS first_seen, CASE WHEN n.k IS NULL THEN o.last_seen ELSE TIMESTAMP '1997-01-01' END AS last_seen, CASE WHEN n.k IS NULL THEN 2 ELSE 0 END AS missing_runs, CASE WHEN n.k IS NULL THEN 'possiblyInactive' ELSE 'active' END AS lifecycle,
 CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'absent' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS outcome FROM o FULL OUTER JOIN n ON o.k = n.k""")
def upsert(t):
    at = lambda s: F.lit(s).cast("timestamp")
    old = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("hash"), at("1995-01-01").alias("first_seen"), at("1996-01-01").alias("last_seen"), F.lit(2).alias("missing_runs"), F.lit("possiblyInactive").alias("lifecycle"))
    new = t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("hash"), at("1997-01-01").alias("first_seen"), at("1997-01-01").alias("last_seen"), F.lit(0).alias("missing_runs"), F.lit("active").alias("lifecycle"))
    return S.upsert(old, new, ["k"])


@R.add("b02_history", """
WITH s AS (SELECT id, group_id, last_seen, price, area, row_number() OVER w AS n, lag(price) OVER w AS old_price, lag(area) OVER w AS old_area FROM (SELECT DISTINCT id, group_id, last_seen, price, area FROM occ) WHERE group_id IS NOT NULL WINDOW w AS (PARTITION BY group_id ORDER BY last_seen, id)),
c AS (SELECT id, group_id, old_price, price, CASE WHEN n = 1 THEN 'baseline' WHEN price < old_price THEN 'price-drop' WHEN price IS DISTINCT FROM old_price THEN 'price-rise' END AS p, CASE WHEN n > 1 AND area IS DISTINCT FROM old_area THEN 'area' END AS a FROM s)
SELECT id, group_id, old_price, price, CASE WHEN p IS NOT NULL AND a IS NOT NULL THEN 'multiple' ELSE coalesce(p, a) END AS change FROM c WHERE p IS NOT NULL OR a IS NOT NULL""")
def history(t):
    return S.history(t.occ.where("group_id is not null").select("id", "group_id", "last_seen", "price", "area").distinct(), "group_id", "last_seen", "id", "price", "area").select("id", "group_id", "old_price", "price", "change")


@R.add("b04_hash", "SELECT n_nationkey, sha256(concat('{\"n_name\":\"', n_name, '\",\"n_regionkey\":', n_regionkey, '}')) AS hash FROM nation")
def content_hash(t):
    return t.nation.select("n_nationkey", S.content_hash(["n_name", "n_regionkey"]).alias("hash"))


@R.add("b08_inherit", """
WITH m AS (SELECT user_id, CASE WHEN listing_id % 6 = 0 THEN listing_id + 2 ELSE listing_id END AS listing_id, favorite, archived, tracking, notified_at FROM state)
SELECT user_id, listing_id, max(favorite) AS favorite, max(archived) AS archived, coalesce(max(CASE WHEN tracking NOT IN ('new', 'none') THEN tracking END), 'new') AS tracking, min(notified_at) AS notified_at FROM m GROUP BY user_id, listing_id""")
def inherit(t):
    gone = t.part.where("p_partkey % 6 = 0").select(F.col("p_partkey").alias("old_id"), (F.col("p_partkey") + 2).alias("new_id"))
    return S.inherit(t.state, gone)


@R.add("b09_absorb", """
SELECT CAST(source_ref AS BIGINT) AS old_id, min(group_id) AS new_id FROM occ GROUP BY source_ref HAVING count(DISTINCT group_id) = 1""")
def absorb(t):
    orphans = t.occ.select(F.col("source_ref").cast("long").alias("id"), F.col("id").alias("occurrence_id"))
    return S.absorb(orphans, t.occ)


@R.add("b10_orphan_delete", "SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM occ WHERE group_id = p_partkey AND source_id IN ('s1', 's2')) AND p_partkey NOT IN (SELECT listing_id FROM state WHERE favorite = 1)")
def orphans(t):
    ids = t.part.select(F.col("p_partkey").alias("id"))
    return ids.join(t.occ.where("source_id in ('s1', 's2')").select(F.col("group_id").alias("id")), "id", "left_anti").join(t.state.where("favorite = 1").select(F.col("listing_id").alias("id")), "id", "left_anti")


@R.add("b11_patch", """
WITH c AS (SELECT 'u1' AS user_id, p_partkey AS listing_id, CASE WHEN p_partkey % 2 = 0 THEN 1 END AS favorite, CAST(NULL AS INT) AS archived, CASE WHEN p_partkey % 3 = 0 THEN 'visited' END AS tracking, TIMESTAMP '1999-01-01' AS notified_at FROM part)
SELECT coalesce(s.user_id, c.user_id) AS user_id, coalesce(s.listing_id, c.listing_id) AS listing_id, coalesce(s.notified_at, c.notified_at) AS notified_at, coalesce(c.favorite, s.favorite) AS favorite, coalesce(c.archived, s.archived) AS archived, coalesce(c.tracking, s.tracking) AS tracking FROM state s FULL OUTER JOIN c ON c.user_id = s.user_id AND c.listing_id = s.listing_id""")
def patch(t):
    k = F.col("p_partkey")
    given = t.part.select(F.lit("u1").alias("user_id"), k.alias("listing_id"), F.when(k % 2 == 0, 1).alias("favorite"), F.lit(None).cast("int").alias("archived"), F.when(k % 3 == 0, "visited").alias("tracking"), F.lit("1999-01-01").cast("timestamp").alias("notified_at"))
    return S.patch(t.state, given)


@R.add("b13_contact_log", "SELECT event_id AS id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INT) AS follow_up_index FROM events")
def contact_log(t):
    sends = t.events.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("listing_id"), F.col("ts").alias("sent_at"))
    return S.contact_log(sends).select("id", "follow_up_index")


@R.add("b15_daily_snapshot", "SELECT user_id, count(*) AS listings, coalesce(sum(matches), 0)::BIGINT AS matching, max(priority) AS best FROM score GROUP BY user_id")
def daily_snapshot(t):
    return t.score.groupBy("user_id").agg(F.count("*").alias("listings"), F.coalesce(F.sum("matches"), F.lit(0)).cast("long").alias("matching"), F.max("priority").alias("best"))


@R.add("o02_decide", f"""
WITH s AS (SELECT p_partkey AS k, p_partkey % 10 <> 0 AS enabled, CASE WHEN p_partkey % 7 = 0 THEN 'blocked' ELSE 'ok' END AS health, CASE WHEN p_partkey % 4 = 0 THEN TIMESTAMP '1998-12-02' END AS cooldown, CASE WHEN p_partkey % 5 <> 0 THEN TIMESTAMP '1998-11-30 20:00:00' END AS last_run, CASE WHEN p_size > 10 THEN 60.0::DOUBLE / (1 + p_size / 3.0::DOUBLE) ELSE 180 END AS lively, p_partkey % 3 AS errors FROM part),
i AS (SELECT *, least(greatest(CASE WHEN errors > 0 THEN lively * pow(2, errors) ELSE lively END, 5), 1440) AS interval_min FROM s)
SELECT k, round(interval_min, 6) AS interval_min, CASE WHEN NOT enabled THEN 'disabled' WHEN health = 'blocked' THEN 'blocked' WHEN cooldown > TIMESTAMP '{NOW}' THEN 'cooldown' WHEN last_run IS NULL THEN 'never-run' WHEN (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_run)) / 60e6 >= interval_min THEN 'due' ELSE 'waiting' END AS decision FROM i""")
def decide(t):
    k = F.col("p_partkey")
    i = S.effective_interval(F.lit(60.0), F.when(F.col("p_size") > 10, F.col("p_size")).otherwise(0), k % 3)
    at = lambda s: F.lit(s).cast("timestamp")
    d = S.decide(now(), k % 10 != 0, F.when(k % 7 == 0, "blocked").otherwise("ok"), F.when(k % 4 == 0, at("1998-12-02")), F.when(k % 5 != 0, at("1998-11-30 20:00:00")), i)
    return t.part.select(k.alias("k"), F.round(i, 6).alias("interval_min"), d.alias("decision"))


@R.add("h07_plan_run", """
SELECT source_id, row_number() OVER (ORDER BY CASE WHEN overdue >= 4 THEN 0 ELSE 1 END, CASE WHEN overdue >= 4 THEN -overdue ELSE 0 END, vanishing DESC, priority DESC, last_run NULLS FIRST, source_id) AS place FROM (
 SELECT source_id, count(*) % 9::DOUBLE AS overdue, min(id) % 3 = 0 AS vanishing, max(id) % 5 AS priority, min(started_at) AS last_run FROM runs GROUP BY source_id)""")
def plan_run(t):
    rows = t.runs.groupBy("source_id").agg((F.count("*") % 9).cast("double").alias("overdue"), (F.min("id") % 3 == 0).alias("vanishing"), (F.max("id") % 5).alias("priority"), F.min("started_at").alias("last_run"))
    return S.plan_run(rows.withColumn("decision", F.lit("due"))).select("source_id", F.col("place").cast("long").alias("place"))


@R.add("o05_missing", """
SELECT id, missing_runs + CASE WHEN seen THEN 0 ELSE 1 END AS missing_runs, CASE WHEN seen OR lifecycle = 'inactive' THEN lifecycle WHEN missing_runs + 1 >= 3 THEN 'inactive' WHEN missing_runs + 1 >= 2 THEN 'possiblyInactive' ELSE lifecycle END AS lifecycle FROM (SELECT DISTINCT id, missing_runs, lifecycle, CAST(source_ref AS BIGINT) % 4 = 0 AS seen FROM occ)""")
def missing(t):
    rows = t.occ.select("id", "missing_runs", "lifecycle", "source_ref").distinct()
    return S.mark_missing(rows, rows.where("cast(source_ref as bigint) % 4 = 0"), "id").select("id", "missing_runs", "lifecycle")


@R.add("o06_guards", """
SELECT event_id, CASE WHEN r IN ('error', 'blocked') THEN 'stopped' WHEN s = 0 AND k > 0 THEN 'empty' WHEN k >= 10 AND s * 2 < k THEN 'collapse' END AS unfounded, r = 'completed' AND NOT (k >= 3 AND s * 2 > k) AS trusted FROM (SELECT event_id, user_id % 30 AS k, event_id % 20 AS s, CASE event_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'blocked' ELSE 'completed' END AS r FROM events)""")
def guards(t):
    k, s = F.col("user_id") % 30, F.col("event_id") % 20
    r = F.when(F.col("event_id") % 6 == 0, "error").when(F.col("event_id") % 6 == 1, "blocked").otherwise("completed")
    return t.events.select("event_id", S.unfounded(k, s, r).alias("unfounded"), S.withdrawn_trusted(s, k, r).alias("trusted"))


@R.add("o08_expire", f"SELECT id, CASE WHEN lifecycle = 'inactive' OR age >= 300 THEN 'inactive' WHEN age >= 100 THEN 'possiblyInactive' ELSE lifecycle END AS lifecycle FROM (SELECT DISTINCT id, lifecycle, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_seen)) / 86400e6 AS age FROM occ)")
def expire(t):
    return S.expire(t.occ.select("id", "lifecycle", "last_seen").distinct(), now(), 100, 300).select("id", "lifecycle")


@R.add("o12_rent_lost", "SELECT source_id FROM (SELECT source_id, CASE WHEN source_id IN ('s1', 's4') THEN NULL ELSE price END AS price FROM occ) GROUP BY source_id HAVING count(*) >= 5 AND count(price) = 0")
def rent_lost(t):
    rows = t.occ.withColumn("price", F.when(~F.col("source_id").isin("s1", "s4"), F.col("price")))
    return S.rent_lost(rows, "source_id")


@R.add("o15_prune", "SELECT id FROM hist WHERE epoch_us(changed_at) >= epoch_us(TIMESTAMP '2024-01-31') - 10 * 86400000000")
def prune(t):
    return S.prune(t.hist, "changed_at", F.lit("2024-01-31").cast("timestamp"), 10).select("id")


@R.add("o20_hours", "SELECT event_id, NOT (hour(ts + INTERVAL 1 HOUR) BETWEEN 1 AND 4) OR minute(ts) = 7 AS due FROM events")
def hours(t):
    return t.events.select("event_id", S.collection_due(F.col("ts").cast("timestamp")).alias("due"))
