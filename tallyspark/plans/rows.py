"""Queries: collection passes, views, amounts and further scores (survey parts A, B, C, D, E, F, H, J, L, M, O, P, Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import json as Js
from tallyspark.functions import places as X
from tallyspark.functions.rows import latest
from tallyspark.operators import aggregates as A
from tallyspark.operators import dedupe as D
from tallyspark.operators import merge as M
from tallyspark.operators import passes as P
from tallyspark.operators import scoring as C
from tallyspark.operators import views as V
from tallyspark.plans.proxies import Registry
from tallyspark.plans.stats import R as S

R = Registry()
NOW = "1998-12-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


# --- passes -----------------------------------------------------------------------------------------------------------------------------

_SEEN = "seen AS (SELECT DISTINCT source_id, source_ref FROM occ WHERE CAST(source_ref AS BIGINT) % 3 = 0)"


def _some(t, n):
    return t.occ.where(F.col("source_ref").cast("long") % n == 0).select("source_id", "source_ref")


@R.add("o09_confirm_seen", f"""
WITH {_SEEN} SELECT id, source_id, CASE WHEN s.source_id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE last_seen END AS last_seen, CASE WHEN s.source_id IS NOT NULL THEN 0 ELSE missing_runs END AS missing_runs,
 CASE WHEN s.source_id IS NOT NULL THEN 'active' ELSE lifecycle END AS lifecycle FROM occ LEFT JOIN seen s USING (source_id, source_ref)""")
def confirm_seen(t):
    return P.confirm_seen(t.occ, _some(t, 3), now()).select("id", "source_id", "last_seen", "missing_runs", "lifecycle")


@R.add("o10_mark_withdrawn", f"""
WITH {_SEEN} SELECT id, CASE WHEN s.source_id IS NOT NULL AND lifecycle <> 'inactive' THEN greatest(missing_runs, 3) ELSE missing_runs END AS missing_runs, CASE WHEN s.source_id IS NOT NULL THEN 'inactive' ELSE lifecycle END AS lifecycle FROM occ LEFT JOIN seen s USING (source_id, source_ref)""")
def mark_withdrawn(t):
    return P.mark_withdrawn(t.occ, _some(t, 3), 3).select("id", "missing_runs", "lifecycle")


@R.add("a26_known_refs", """
WITH l AS (SELECT * FROM occ WHERE lifecycle <> 'inactive'), a AS (SELECT source_id, source_ref FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY last_seen, source_ref) AS n FROM l WHERE price IS NULL OR property_type = 'unknown' OR image_urls IS NULL) WHERE n <= 5
UNION ALL SELECT source_id, source_ref FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY last_seen, source_ref) AS n FROM l WHERE last_seen < TIMESTAMP '1995-01-01') WHERE n <= 2)
SELECT DISTINCT source_id, source_ref FROM occ o WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.source_id = o.source_id AND a.source_ref = o.source_ref)""")
def known_refs(t):
    lacking = F.col("price").isNull() | (F.col("property_type") == "unknown") | F.col("image_urls").isNull()
    return P.known_refs(t.occ, lacking, "last_seen", F.lit("1995-01-01").cast("timestamp"))


_MOVED = "SELECT CASE WHEN group_id % 40 = 0 THEN concat(source_id, ':', CAST(CAST(source_ref AS BIGINT) + 1 AS STRING)) ELSE id END AS id, source_id, source_ref FROM occ"


@R.add("d21_realign_ids", f"""
WITH m AS ({_MOVED}), a AS (SELECT id, concat(source_id, ':', source_ref) AS aim FROM m), f AS (SELECT aim, min(id) AS first FROM a GROUP BY aim)
SELECT CASE WHEN a.id = f.first AND a.aim NOT IN (SELECT id FROM m) THEN a.aim ELSE a.id END AS id, CAST(count(*) AS BIGINT) AS n FROM a JOIN f ON a.aim = f.aim GROUP BY 1""")
def realign(t):
    return P.realign(t.sql(_MOVED)).groupBy("id").agg(F.count("*").alias("n"))


@R.add("o17_closed_applications", f"""
SELECT s.user_id, s.listing_id, CASE WHEN l.id IS NOT NULL AND s.notified_at IS NOT NULL AND s.listing_id % 3 <> 0 THEN TIMESTAMP '{NOW}' WHEN s.listing_id % 3 = 0 THEN TIMESTAMP '1997-01-01' END AS applications_closed_at
FROM state s LEFT JOIN lst l ON l.id = s.listing_id AND l.payload LIKE '%"applicationStatus":"full"%'""")
def closed(t):
    rows = t.state.withColumn("applications_closed_at", F.when(F.col("listing_id") % 3 == 0, F.lit("1997-01-01").cast("timestamp")))
    return P.note_closed(rows, t.lst, now()).select("user_id", "listing_id", "applications_closed_at")


@R.add("b07_save_scores", """
WITH n AS (SELECT user_id, listing_id, CASE WHEN listing_id % 2 = 0 THEN priority + 1 ELSE priority END AS priority, matches FROM score WHERE listing_id % 5 <> 0 AND listing_id IN (SELECT id FROM lst)), o AS (SELECT user_id, listing_id, priority, matches FROM score WHERE listing_id % 7 <> 0)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.listing_id, n.listing_id) AS listing_id, coalesce(n.priority, o.priority) AS priority, CASE WHEN o.user_id IS NULL THEN 'inserted' WHEN n.user_id IS NULL THEN 'kept' WHEN n.priority = o.priority THEN 'unchanged' ELSE 'updated' END AS outcome FROM o FULL JOIN n ON o.user_id = n.user_id AND o.listing_id = n.listing_id""")
def save_scores(t):
    new = t.score.where("listing_id % 5 <> 0").withColumn("priority", F.when(F.col("listing_id") % 2 == 0, F.col("priority") + 1).otherwise(F.col("priority")))
    return P.save_scores(t.score.where("listing_id % 7 <> 0"), new, t.lst, ["priority", "matches"]).select("user_id", "listing_id", "priority", "outcome")


@R.add("b14_append_runs", "SELECT source_id, count(*) AS n FROM runs GROUP BY source_id")
def append_runs(t):
    return P.append_runs(t.runs.where("id % 2 = 0"), t.runs).groupBy("source_id").agg(F.count("*").alias("n"))


@R.add("a02_registry", "SELECT concat('s', CAST(s_suppkey AS STRING)) AS source_id, s_name AS title FROM supplier WHERE s_nationkey <> 0")
def registry(t):
    named = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"), F.col("s_name").alias("title"), "s_nationkey")
    return P.registry(named.drop("s_nationkey"), named.where("s_nationkey <> 0"))


@R.add("o14_regroup", None)
def regroup(t):
    return P.regroup(t.occ, now(), points=_POINTS)[0].select("id", "match", "opportunity", "visit", "risk", "matches", "priority")


@R.add("o14_regroup_changes", "SELECT count(DISTINCT id) AS n, 0::BIGINT AS differing FROM occ WHERE lifecycle = 'active' AND group_id IS NOT NULL")
def regroup_changes(t):
    rows = latest(t.occ.where("lifecycle = 'active' and group_id is not null"), ["id"], ["last_seen"])
    mark = F.pmod(F.xxhash64("id"), F.lit(50))
    # Before: some occurrences are not there yet, some have other rents, and some will be gone.
    more = rows.where(mark == 2).withColumn("id", F.concat(F.lit("gone:"), "id"))
    old = rows.where(mark != 0).withColumn("price", F.when(mark == 1, F.col("price") + 7).otherwise(F.col("price"))).unionByName(more)
    repaired = D.of_groups(rows, D.grouping(rows, before=D.grouping(old)))
    both = repaired.join(D.dedupe(rows).withColumnRenamed("grp", "whole"), "id")
    return both.agg(F.count("*").alias("n"), F.count(F.when(F.col("grp") != F.col("whole"), 1)).alias("differing"))


# --- merging ----------------------------------------------------------------------------------------------------------------------------

@R.add("e04_anchors", """
WITH m AS (SELECT *, (CASE WHEN price IS NULL THEN 0 ELSE 1 END + CASE WHEN charges IS NULL THEN 0 ELSE 1 END + CASE WHEN area IS NULL THEN 0 ELSE 1 END + CASE WHEN rooms IS NULL THEN 0 ELSE 1 END + CASE WHEN city IS NULL THEN 0 ELSE 1 END + CASE WHEN postal_code IS NULL THEN 0 ELSE 1 END + CASE WHEN property_type IS NULL THEN 0 ELSE 1 END + CASE WHEN furnished IS NULL THEN 0 ELSE 1 END + CASE WHEN flat_share IS NULL THEN 0 ELSE 1 END + CASE WHEN lat IS NULL THEN 0 ELSE 1 END + CASE WHEN lon IS NULL THEN 0 ELSE 1 END + CASE WHEN agency IS NULL THEN 0 ELSE 1 END + CASE WHEN phone IS NULL THEN 0 ELSE 2 END + CASE WHEN email IS NULL THEN 0 ELSE 2 END) AS c,
 CASE WHEN regexp_matches(address, '^[0-9]+ (bis )?rue') THEN 0 WHEN address LIKE 'rue %' THEN 1 ELSE 2 END AS grade FROM occ WHERE group_id IS NOT NULL), o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY -c, first_seen, id) = 1 THEN 0 ELSE 1 END AS no FROM m)
SELECT group_id, arg_min(address, (grade, no, first_seen, id)) FILTER (address IS NOT NULL) AS address, arg_min(flat_share, (CASE WHEN flat_share THEN 0 ELSE 1 END, no, first_seen, id)) FILTER (flat_share IS NOT NULL) AS flat_share FROM o GROUP BY group_id""")
def anchors(t):
    return M.merge(t.occ.where("group_id is not null"), ("address", "flat_share")).select("group_id", F.col("address.value").alias("address"), F.col("flat_share.value").alias("flat_share"))


@R.add("e08_application_status", "SELECT l_partkey AS group_id, CASE WHEN count(*) FILTER (l_linenumber = 1) > 0 THEN 'open' WHEN count(*) FILTER (l_linenumber = 2) > 0 THEN 'full' END AS status FROM lineitem GROUP BY l_partkey")
def status(t):
    told = t.lineitem.select(F.col("l_partkey").alias("group_id"), F.when(F.col("l_linenumber") == 1, "open").when(F.col("l_linenumber") == 2, "full").alias("status"))
    return told.groupBy("group_id").agg(M.application_status(F.col("status")).alias("merged")).withColumnRenamed("merged", "status")


@R.add("e06_contacts", """
SELECT group_id, arg_min(agency, (CASE WHEN agency IS NULL THEN 1 ELSE 0 END, first_seen, id)) AS agency, len(list(DISTINCT phone) FILTER (phone IS NOT NULL)) AS phones, len(list(DISTINCT email) FILTER (email IS NOT NULL)) AS emails, len(list(DISTINCT source_id) FILTER (phone IS NOT NULL OR email IS NOT NULL)) AS providers FROM occ WHERE group_id IS NOT NULL GROUP BY group_id""")
def contacts(t):
    found = t.met.where("group_id is not null").groupBy("group_id").agg(*[c.alias(f"m_{k}") for k, c in M.contacts().items()])
    size = lambda c: F.when(F.size(c) > 0, F.size(c).cast("long"))
    return found.select("group_id", F.col("m_agency").alias("agency"), size("m_phones").alias("phones"), size("m_emails").alias("emails"), size("m_provided_by").alias("providers"))


@R.add("e09_first_requirements", "SELECT l_partkey AS group_id, arg_min(2 + l_linenumber % 3, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) FILTER (l_linenumber > 3) AS rent_multiple FROM lineitem GROUP BY l_partkey")
def first_requirements(t):
    text = F.when(F.col("l_linenumber") > 3, F.concat(F.lit("Revenus de "), (2 + F.col("l_linenumber") % 3).cast("string"), F.lit(" fois le loyer"))).otherwise("bel appartement")
    rows = t.lineitem.select(F.col("l_partkey").alias("group_id"), text.alias("description"), F.col("l_shipdate").alias("first_seen"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("id"))
    return rows.groupBy("group_id").agg(M.first_requirements(F.col("description")).alias("r")).select("group_id", F.col("r.rent_multiple").alias("rent_multiple"))


# --- statistics -------------------------------------------------------------------------------------------------------------------------

_LIFE = "life AS (SELECT source_id, CAST(date_diff('day', first_seen, last_seen) AS DOUBLE) AS days, lifecycle = 'inactive' AS ended FROM occ)"


@R.add("f03_share_alive", f"""
WITH {_LIFE}, d AS (SELECT source_id, days, count(*) AS n, sum(CASE WHEN ended THEN 1 ELSE 0 END) AS deaths FROM life GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY source_id ORDER BY days DESC) AS at_risk, max(days) OVER (PARTITION BY source_id) AS horizon FROM d),
s AS (SELECT source_id, days, horizon, exp(sum(CASE WHEN deaths = at_risk THEN -1e9 ELSE ln(1 - deaths / at_risk) END) OVER (PARTITION BY source_id ORDER BY days)) AS share FROM r WHERE deaths > 0), h AS (SELECT source_id, max(horizon) AS horizon FROM s GROUP BY source_id)
SELECT source_id, t, CASE WHEN t <= horizon THEN round(coalesce((SELECT arg_max(share, days) FROM s WHERE s.source_id = h.source_id AND s.days <= q.t), 1.0), 9) END AS share FROM h, (SELECT unnest([-1.0, 10.0, 30.0, 60.0, 1e6])::DOUBLE AS t) q""")
def share_alive(t):
    days = F.date_diff(F.to_date("last_seen"), F.to_date("first_seen")).cast("double")
    curve = A.survival(t.occ.select("source_id", days.alias("days"), (F.col("lifecycle") == "inactive").alias("ended")), keys=("source_id",))
    at = curve.select("source_id").distinct().select("source_id", F.explode(F.array(*[F.lit(x) for x in (-1.0, 10.0, 30.0, 60.0, 1e6)])).alias("t"))
    return A.share_alive(curve, at, ("source_id",)).withColumn("share", F.round("share", 9))


@R.add("f02_survival_hours", """
WITH life AS (SELECT l_returnflag AS k, (epoch_us(CAST(l_shipdate AS TIMESTAMP)) / 3600e6 % 5000) / 24 AS days, l_linestatus = 'F' AS ended FROM lineitem), d AS (SELECT k, days AS day, count(*) AS n, sum(CASE WHEN ended THEN 1 ELSE 0 END) AS deaths FROM life GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY day DESC) AS at_risk FROM d) SELECT k, round(day, 9) AS day, at_risk::BIGINT AS at_risk, deaths::BIGINT AS deaths, round(exp(sum(CASE WHEN deaths = at_risk THEN -1e9 ELSE ln(1 - deaths / at_risk) END) OVER (PARTITION BY k ORDER BY day)), 9) AS share FROM r WHERE deaths > 0""")
def survival_hours(t):
    hours = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 3600e6 % 5000
    rows = t.lineitem.select(F.col("l_returnflag").alias("k"), (hours / 24).alias("days"), (F.col("l_linestatus") == "F").alias("ended"))
    return A.survival(rows, keys=("k",)).select("k", F.round("day", 9).alias("day"), "at_risk", "deaths", F.round("share", 9).alias("share"))


@R.add("f12_active_stock", "SELECT source_id, sum(CASE WHEN lifecycle = 'active' THEN 1 ELSE 0 END)::BIGINT AS active FROM occ GROUP BY source_id")
def active_stock(t):
    return A.active_stock(t.occ)


_FIELDS = ("phone", "price", "email")


@R.add("f21_faded_fields", f"""
WITH o AS (SELECT source_id, first_seen >= TIMESTAMP '1998-01-01' AS recent, phone, CASE WHEN first_seen < TIMESTAMP '1998-01-01' OR source_id NOT LIKE '%1' THEN price END AS price, email FROM occ),
u AS ({" UNION ALL ".join(f"SELECT source_id, '{f}' AS field, count(*) FILTER (NOT recent) AS older, count({f}) FILTER (NOT recent) AS of_, count(*) FILTER (recent) AS recent, count({f}) FILTER (recent) AS rf FROM o GROUP BY source_id" for f in _FIELDS)})
SELECT source_id, field, CAST(floor(of_::DOUBLE / older * 100 + 0.5) AS INT) AS before_pct FROM u WHERE older >= 10 AND recent >= 5 AND of_::DOUBLE / older >= 0.8 AND rf = 0""")
def faded(t):
    rows = t.occ.withColumn("price", F.when((F.col("first_seen") < F.lit("1998-01-01").cast("timestamp")) | ~F.endswith("source_id", F.lit("1")), F.col("price")))
    return A.faded_fields(A.field_fill(rows, list(_FIELDS), F.lit("1998-01-01").cast("timestamp")))


@R.add("f06_agency_detail", "SELECT id, (SELECT max(phone) FROM occ WHERE agency = 'agency 7') AS phone FROM lst WHERE id IN (SELECT group_id FROM occ WHERE agency = 'agency 7') ORDER BY last_seen DESC, id LIMIT 200")
def agency_detail(t):
    rows, known = A.agency_detail(t.lst, t.occ, "Agency 7")
    return rows.select("id").withColumn("phone", known.select("phone").scalar())


@R.add("f25_alerts_per_token", "SELECT concat('t', CAST(user_id % 50 AS STRING)) AS token, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def alerts_per_token(t):
    return A.alerts_per_token(t.events.select(F.when(F.col("event_type") == "click", F.concat(F.lit("t"), (F.col("user_id") % 50).cast("string"))).alias("token")))


@R.add("f31_budget_report", None)
def budget_report(t):
    found = t.runs.where("id % 4 = 0").select(F.col("id").alias("run"))
    return A.budget_report(t.runs, found, F.lit("2024-01-10").cast("timestamp"), 6, 100)


# --- views ------------------------------------------------------------------------------------------------------------------------------

@R.add("h03_ids_page", "SELECT id FROM lst WHERE lifecycle <> 'inactive' ORDER BY last_seen DESC, id LIMIT 500")
def ids_page(t):
    return t.lst.where("lifecycle <> 'inactive'").orderBy(F.desc("last_seen"), "id").limit(500).select("id")


@R.add("h08_affinity_rank", "SELECT listing_id AS id, row_number() OVER (ORDER BY priority + (listing_id % 5) / 4.0::DOUBLE * 15 DESC, listing_id) AS place FROM score WHERE user_id = 'u1' ORDER BY place LIMIT 50")
def affinity_rank(t):
    rows = t.score.where("user_id = 'u1'").select(F.col("listing_id").alias("id"), "priority", (F.col("listing_id") % 5 / 4).alias("affinity"))
    return V.by_affinity(rows).limit(50).select("id", (F.monotonically_increasing_id() * 0).alias("z")).withColumn("place", F.row_number().over(_one())).select("id", "place")


def _one():
    from pyspark.sql import Window

    return Window.partitionBy("z").orderBy(F.lit(1))


@R.add("h09_recency", "SELECT l.id FROM lst l JOIN score s ON s.listing_id = l.id AND s.user_id = 'u1' ORDER BY coalesce(published, first_seen) DESC, priority DESC, l.id LIMIT 40")
def recency(t):
    own = t.score.where("user_id = 'u1'").select(F.col("listing_id").alias("id"), "priority")
    return V.by_recency(t.lst.join(own, "id")).limit(40).select("id")


@R.add("h10_activity", "SELECT event_id AS id FROM events ORDER BY ts DESC, event_id LIMIT 25")
def activity(t):
    return V.activity(t.events.select(F.col("ts").alias("at"), F.col("event_id").alias("id")), 25).select("id")


@R.add("c23_source_selection", "SELECT group_id AS id FROM occ WHERE group_id IS NOT NULL GROUP BY group_id HAVING bool_or(source_id IN ('s1', 's3'))")
def selection(t):
    chosen = V.Selection("only", frozenset({"s1"})).with_sources(("s3",), True)
    rows = t.occ.where("group_id is not null").groupBy(F.col("group_id").alias("id")).agg(F.collect_set("source_id").alias("sources"))
    return V.shown(rows, chosen).select("id")


@R.add("c24_availability", """
SELECT id, reason, coalesce(reason IN ('rented', 'offline'), false) AS unavailable, lifecycle = 'possiblyInactive' AS uncertain, coalesce(reason <> 'user', false) AS by_source FROM (SELECT id, lifecycle, CASE WHEN rented THEN 'rented' WHEN lifecycle = 'inactive' THEN 'offline' WHEN id % 11 = 0 THEN 'applicationsFull' WHEN id % 4 = 0 THEN 'user' END AS reason FROM lst)""")
def availability(t):
    rows = t.lst.withColumn("application_status", F.get_json_object("payload", "$.applicationStatus")).withColumn("archived", F.col("id") % 4 == 0)
    return V.states(rows).select("id", "reason", "unavailable", "uncertain", "by_source")


@R.add("c19_client_filter", "SELECT id FROM lst WHERE lifecycle <> 'possiblyInactive' AND id % 3 <> 0 AND id % 5 IN (0, 1, 2)")
def client_filter(t):
    verdict = F.when(F.col("id") % 5 == 0, "eligible").when(F.col("id") % 5 == 1, "unknown").when(F.col("id") % 5 != 2, "income")
    rows = t.lst.withColumn("viewed", F.when(F.col("id") % 3 == 0, True)).withColumn("verdict", verdict)
    return V.shown(rows, None, True, True, True).select("id")


@R.add("q07_listing_detail", """
WITH w AS (SELECT p_partkey AS asked, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 1 ELSE p_partkey END AS id FROM part), c AS (SELECT user_id AS id, count(*) AS n, max(ts) AS latest FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT asked, w.id, l.city, coalesce(c.n, 0) AS contacts, CAST(c.latest AS TIMESTAMP) AS latest FROM w JOIN lst l ON l.id = w.id LEFT JOIN c ON c.id = w.id""")
def detail(t):
    k = F.col("p_partkey")
    absorbed = t.part.where(k % 2 == 0).select(k.alias("old_id"), (k + 1).alias("new_id"))
    log = t.events.where("event_type = 'click'").select(F.col("user_id").alias("listing_id"), F.col("ts").cast("timestamp").alias("at"), F.lit("mail").alias("channel"))
    found = V.detail(t.lst, absorbed, log, t.part.select(k.alias("asked")))
    return found.select("asked", "id", "city", F.size("contacts").cast("long").alias("contacts"), F.get("contacts", F.lit(0))["at"].alias("latest"))


@R.add("c13_listing_json", """
SELECT id, '$.city' AS path, CASE WHEN city IS NULL THEN 'null' ELSE concat('"', city, '"') END AS value FROM lst UNION ALL SELECT id, '$.id', CAST(id AS STRING) FROM lst UNION ALL SELECT id, '$.rented', CASE WHEN rented THEN 'true' ELSE 'false' END FROM lst UNION ALL SELECT id, '$.rooms', coalesce(CAST(rooms AS STRING), 'null') FROM lst
UNION ALL SELECT id, '$.imageUrls', '["a","b"]' FROM lst UNION ALL SELECT id, '$.description', '"x"' FROM lst UNION ALL SELECT id, '$.applicationStatus', CASE id % 11 WHEN 0 THEN '"full"' WHEN 1 THEN '"open"' ELSE 'null' END FROM lst
UNION ALL SELECT id, '$.first_seen', concat('"', strftime(first_seen, '%Y-%m-%dT%H:%M:%S'), '.000Z"') FROM lst""")
def listing_json(t):
    made = V.as_json(t.lst, ["id", "city", "rented", "rooms", "first_seen"])
    return Js.entries(made, "json").select("id", F.concat(F.lit("$."), "key").alias("path"), F.when(F.col("type") == "text", F.to_json(F.col("value").cast("variant"))).otherwise(F.coalesce("value", F.lit("null"))).alias("value"))


# --- scores -----------------------------------------------------------------------------------------------------------------------------

_POINTS = [("work", 43.65, 7.2, "transit"), ("school", 43.7, 7.3, "walk")]
_KM = "2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians({0} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({0})) * pow(sin(radians({1} - lon) / 2), 2))))"


@R.add("l18_distances", f"""
SELECT id, round(a, 2) AS work_km, CAST(floor(least(a * 1.3 / 4.5 * 60, 25 + a * 1.3 / 50 * 60) + 0.5) AS INT) AS work_minutes, CAST(floor(b * 1.3 / 4.5 * 60 + 0.5) AS INT) AS school_minutes, coalesce(floor(least(a * 1.3 / 4.5 * 60, 25 + a * 1.3 / 50 * 60) + 0.5) > 40, false) AS late FROM (SELECT id, {_KM.format(43.65, 7.2)} AS a, {_KM.format(43.7, 7.3)} AS b FROM lst)""")
def distances(t):
    d = t.lst.select("id", C.distances(F.col("lat"), F.col("lon"), _POINTS).alias("d"))
    at = lambda i, f: F.get("d", F.lit(i))[f]
    return d.select("id", at(0, "km").alias("work_km"), at(0, "minutes").alias("work_minutes"), at(1, "minutes").alias("school_minutes"), C.exceeds_commute(F.col("d"), 40).alias("late"))


@R.add("l17_converted_minutes", "SELECT p_partkey, CAST(floor(p_size / 60.0::DOUBLE * 15 / 1.3::DOUBLE * 1.3::DOUBLE / 4.5::DOUBLE * 60 + 0.5) AS BIGINT) AS walk, CAST(p_size AS BIGINT) AS same FROM part")
def converted(t):
    return t.part.select("p_partkey", C.converted_minutes(F.col("p_size"), "bike", "walk").cast("long").alias("walk"), C.converted_minutes(F.col("p_size"), "bike", "bike").cast("long").alias("same"))


@R.add("l20_eligibility", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'unknown' WHEN p_size % 5 = 1 AND 1000 + p_size * 20 < 1900 THEN 'income' WHEN p_size % 5 = 2 AND 1000 + p_size * 20 < 2040 THEN 'income' WHEN p_size % 5 = 3 AND p_partkey % 4 IN (1, 2) THEN 'situation' WHEN p_size % 5 = 4 AND p_partkey % 2 = 0 THEN 'guarantee' ELSE 'eligible' END AS verdict FROM part""")
def eligibility(t):
    k, n = F.col("p_partkey"), F.col("p_size")
    kind = n % 5
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    rows = t.part.select("p_partkey", F.when(kind == 1, 2000).alias("min_income"), F.when(kind == 2, 3).alias("rent_multiple"), texts().alias("situations"), (kind == 3).alias("insured"), F.when(kind == 4, texts("visale")).otherwise(texts()).alias("refused"), (1000 + n * 20).alias("income"),
                         F.when(k % 4 == 1, "stage").when(k % 4 == 2, "etudiant").otherwise("cdi").alias("situation"), F.when((kind == 4) & (k % 2 == 0), texts("visale")).otherwise(texts()).alias("guarantors"))
    return rows.select("p_partkey", C.eligibility(F.lit(800.0)).alias("verdict"))


_PART = {k: S.oracles[k] for k in ("m01_match", "m03_opportunity", "m04_visit", "m05_risk")}


@R.add("m09_score_listing", f"""
SELECT id, match, opportunity, visit, risk, matches, CAST(CASE WHEN risk >= 40 THEN least(p, 49) ELSE p END AS INT) AS priority FROM (
 SELECT a.id, a.value AS match, b.value AS opportunity, c.value AS visit, d.value AS risk, a.matches AND NOT coalesce(floor(least(w.a * 1.3 / 4.5 * 60, 25 + w.a * 1.3 / 50 * 60) + 0.5) > 60, false) AS matches,
 greatest(least(floor(a.value * 0.3::DOUBLE + b.value * 0.35::DOUBLE + c.value * 0.25::DOUBLE + (100 - d.value) * 0.1::DOUBLE + 0.5), 100), 0) AS p
 FROM ({_PART["m01_match"]}) a JOIN ({_PART["m03_opportunity"]}) b USING (id) JOIN ({_PART["m04_visit"]}) c USING (id) JOIN ({_PART["m05_risk"]}) d USING (id) JOIN (SELECT id, {_KM.format(43.65, 7.2)} AS a FROM lst) w USING (id))""")
def score_listing(t):
    return C.score_listing(t.lst, now(), C.Criteria(cities=("city1", "city2"), max_price=900.0, min_area=40.0), _POINTS, F.col("id") % 3 == 0).select("id", "match", "opportunity", "visit", "risk", "matches", "priority")


@R.add("p04_reverse_key", "SELECT id, printf('rev1 %.5f,%.5f', lat, lon) AS key FROM lst WHERE lat IS NOT NULL")
def reverse_key(t):
    return t.lst.where("lat is not null").select("id", X.reverse_key(F.col("lat"), F.col("lon")).alias("key"))
