"""Queries: names, records, audits, states (rest of survey parts C to H, J, O, Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import aggregates as A
from tallyspark.operators import joins as J
from tallyspark.operators import merge as M
from tallyspark.operators import names as N
from tallyspark.operators import records as X
from tallyspark.plans.proxies import Registry

R = Registry()


def s(name):
    return F.col(name).cast("string")


def pick(column, *texts):
    return F.get(F.array(*[F.lit(x) for x in texts]), F.col(column).cast("int") % len(texts))


@R.add("d26_resolve_agencies", "SELECT concat('Agence Soleil ', s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN ' Nice Centre' ELSE '' END) AS name, CASE WHEN s_suppkey % 2 = 0 THEN concat('s', s_suppkey) END AS source_id FROM (SELECT 100000 + s_suppkey AS s_suppkey FROM supplier)")
def resolve(t):
    k = s("s_suppkey")
    rows = t.supplier.select((F.col("s_suppkey") + 100_000).alias("s_suppkey")).select("s_suppkey", F.concat(F.lit("Agence Soleil "), k, F.when(F.col("s_suppkey") % 3 == 0, " Nice Centre").otherwise("")).alias("name"))
    handles = rows.where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), k).alias("source_id"), F.concat(F.lit("agence SOLEIL "), k).alias("title"))
    # The word soleil is everyone's, so it tells no one apart.
    return N.resolve(rows, handles)


@R.add("d28_group_agencies", "SELECT concat('Cabinet ', 1000 + s_suppkey % 7, CASE WHEN s_suppkey > 50 THEN ' Immobilier' ELSE '' END) AS name, concat('cabinet', 1000 + s_suppkey % 7) AS grp FROM supplier GROUP BY ALL")
def group_agencies(t):
    k = F.col("s_suppkey")
    return N.group(t.supplier.select(F.concat(F.lit("Cabinet "), (k % 7 + 1000).cast("string"), F.when(k > 50, " Immobilier").otherwise("")).alias("name")))


@R.add("d29_uncovered", "SELECT concat('maison', 100 + n_nationkey) AS grp FROM nation WHERE n_nationkey % 3 <> 0")
def uncovered(t):
    rows = t.nation.select("n_nationkey", F.concat(F.lit("Maison "), (F.col("n_nationkey") + 100).cast("string")).alias("name"))
    known = rows.where("n_nationkey % 3 = 0").select(F.substring("name", 8, 9).alias("title"))
    return N.uncovered(rows, known)


@R.add("d30_energy_records", "SELECT p_partkey AS id, substr('ABCDEFG', p_partkey % 7 + 1, 1) AS label FROM part WHERE p_partkey % 5 <> 0")
def energy_records(t):
    k = F.col("p_partkey")
    # A house number has four digits at most, so every 9,000 parts have a postal code of their own.
    number, post = (k % 9000 + 1).cast("string"), F.lpad(F.floor(k / 9000).cast("string"), 5, "0")
    lst = t.part.select(k.alias("id"), post.alias("postal_code"), F.col("p_size").cast("double").alias("area"), F.concat(number, F.lit(" rue de la Paix")).alias("address"))
    one = t.part.select(post.alias("postal_code"), (F.col("p_size") + 1).cast("double").alias("area"), F.concat(number, F.lit(" Rue de la Paix Nice")).alias("address"), F.substring(F.lit("ABCDEFG"), k.cast("int") % 7 + 1, F.lit(1)).alias("label"), k)
    other = one.where(k % 5 == 0).withColumn("label", F.lit("Z"))
    return X.match_records(lst, one.union(other))


@R.add("d31_replies", "SELECT p_partkey AS mail_id, p_partkey AS id FROM part WHERE p_partkey % 2 = 0")
def replies(t):
    k = F.col("p_partkey")
    lst = t.part.select(k.alias("id"), F.concat(F.lit("ref"), k.cast("string")).alias("reference"), F.lit("agency").alias("agency"), F.lit(700.0).alias("price"))
    mails = t.part.select(k.alias("mail_id"), F.lit("agency").alias("sender_agency"), F.when(k % 2 == 0, F.concat(F.lit("Concernant REF"), k.cast("string"), F.lit(" a 700"))).otherwise("bonjour").alias("body"))
    return X.match_replies(mails, lst)


@R.add("d33_contact_fill", "SELECT id, coalesce(phone, CASE WHEN source_id = 's1' THEN '+33400000000' END) AS phone FROM (SELECT DISTINCT id, source_id, phone FROM occ)")
def contact_fill(t):
    src = t.spark.createDataFrame([("s1", "+33400000000", None)], "source_id string, phone string, email string")
    return X.fill_contacts(t.occ.select("id", "source_id", "phone", "email").distinct(), src).select("id", "phone")


@R.add("d34_best_place", "SELECT p_partkey AS id, concat(p_partkey, ' number') AS place FROM part WHERE p_size >= 10")
def best_place(t):
    k = s("p_partkey")
    options = F.array(F.struct(F.concat(k, F.lit(" street")).alias("place"), F.lit("street").alias("kind"), F.lit(0.9).alias("score"), F.lit(True).alias("same_city")), F.struct(F.concat(k, F.lit(" number")).alias("place"), F.lit("housenumber").alias("kind"), F.lit(0.7).alias("score"), F.lit(True).alias("same_city")), F.struct(F.concat(k, F.lit(" far")).alias("place"), F.lit("housenumber").alias("kind"), F.lit(0.99).alias("score"), F.lit(False).alias("same_city")))
    return X.best_place(t.part.where("p_size >= 10").select(F.col("p_partkey").alias("id"), F.explode(options).alias("o")).select("id", "o.*"), 0.5)


@R.add("d25_detail_coverage", "SELECT source_id, count(*) AS active, count(price) AS priced, coalesce(sum(CASE WHEN last_seen < TIMESTAMP '1996-01-01' THEN 1 ELSE 0 END), 0)::BIGINT AS stale FROM occ WHERE lifecycle = 'active' GROUP BY source_id")
def detail_coverage(t):
    return t.occ.where("lifecycle = 'active'").groupBy("source_id").agg(F.count("*").alias("active"), F.count("price").alias("priced"), A.count_if(F.col("last_seen") < F.lit("1996-01-01").cast("timestamp")).alias("stale"))


@R.add("d35_parser_gaps", "SELECT agency, count(DISTINCT group_id) AS n, min(url) AS example FROM occ o WHERE group_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM occ x WHERE x.group_id = o.group_id AND x.source_id = 's5') GROUP BY agency ORDER BY n DESC, agency LIMIT 25")
def parser_gaps(t):
    rows = t.occ.where("group_id is not null")
    return rows.join(rows.where("source_id = 's5'").select("group_id"), "group_id", "left_anti").groupBy("agency").agg(F.count_distinct("group_id").alias("n"), F.min("url").alias("example")).orderBy(F.desc("n"), "agency").limit(25)


@R.add("e02_primary", "SELECT id, CAST((price IS NOT NULL)::INT + (charges IS NOT NULL)::INT + (area IS NOT NULL)::INT + (rooms IS NOT NULL)::INT + (city IS NOT NULL)::INT + (postal_code IS NOT NULL)::INT + 1 + (furnished IS NOT NULL)::INT + (flat_share IS NOT NULL)::INT + (lat IS NOT NULL)::INT + (lon IS NOT NULL)::INT + 1 + (phone IS NOT NULL)::INT * 2 + (email IS NOT NULL)::INT * 2 AS INT) AS n FROM occ")
def completeness(t):
    return t.occ.select("id", M.completeness().alias("n"))


@R.add("f26_location", "SELECT sum(CASE WHEN lat IS NOT NULL AND city IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS both_known, sum(CASE WHEN lat IS NOT NULL AND city IS NULL THEN 1 ELSE 0 END)::BIGINT AS point, sum(CASE WHEN lat IS NULL AND city IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS named, sum(CASE WHEN lat IS NULL AND city IS NULL THEN 1 ELSE 0 END)::BIGINT AS neither FROM occ")
def location(t):
    at, city = F.col("lat").isNotNull(), F.col("city").isNotNull()
    return A.totals(t.occ, {"both_known": at & city, "point": at & ~city, "named": ~at & city, "neither": ~at & ~city})


@R.add("f28_flat_share_audit", "SELECT flat_share, count(*) AS n, min(id) AS example FROM occ GROUP BY flat_share")
def flat_share_audit(t):
    return t.occ.groupBy("flat_share").agg(F.count("*").alias("n"), F.min("id").alias("example"))


@R.add("f30_ailing", "WITH l AS (SELECT source_id, arg_max(stop_reason, (started_at, id)) AS reason, sum(CASE WHEN stop_reason <> 'completed' THEN 1 ELSE 0 END)::BIGINT AS broken FROM runs GROUP BY source_id) SELECT source_id, reason, broken FROM l WHERE reason <> 'completed'")
def ailing(t):
    rows = t.runs.groupBy("source_id").agg(F.max_by("stop_reason", F.struct("started_at", "id")).alias("reason"), A.count_if(F.col("stop_reason") != "completed").alias("broken"))
    return rows.where("reason <> 'completed'")


@R.add("f32_agency_audit", "SELECT count(DISTINCT agency) AS agencies, count(DISTINCT CASE WHEN lifecycle = 'active' THEN agency END) AS active FROM occ")
def agency_audit(t):
    return t.occ.agg(F.count_distinct("agency").alias("agencies"), F.count_distinct(F.when(F.col("lifecycle") == "active", F.col("agency"))).alias("active"))


@R.add("g01_latest_runs", "SELECT source_id, id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS k FROM runs) WHERE k <= 5")
def latest_runs(t):
    return J.latest(t.runs, "source_id", "started_at", "id", 5).select("source_id", "id", "rank")


@R.add("h11_fresh", "SELECT id FROM lst WHERE coalesce(published, first_seen) >= TIMESTAMP '1998-01-01' ORDER BY coalesce(published, first_seen) DESC, id LIMIT 50")
def fresh(t):
    at = F.coalesce("published", "first_seen")
    return t.lst.where(at >= F.lit("1998-01-01").cast("timestamp")).orderBy(at.desc(), "id").limit(50).select("id")


@R.add("j36_commune", "SELECT n_nationkey, 'saint laurent du var' AS city, '06700' AS postal_code FROM nation")
def commune(t):
    return t.nation.select("n_nationkey", X.commune(F.concat(F.lower("n_name"), F.lit(" à Saint-Laurent-du-Var, 06700")))["city"].alias("city"), X.commune(F.lit("Nice 06700"))["postal_code"].alias("postal_code"))


@R.add("j38_wanted", "SELECT p_partkey, p_partkey % 3 = 0 AS wanted, p_partkey % 3 = 1 AS for_sale FROM part")
def wanted(t):
    title = pick("p_partkey", "Couple recherche un appartement", "Maison à vendre", "Appartement à louer, vente possible")
    return t.part.select("p_partkey", X.wanted(title).alias("wanted"), X.for_sale(title).alias("for_sale"))


@R.add("j39_requirements", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 2000 + p_size END AS min_income, CASE WHEN p_partkey % 2 = 1 THEN 3 END AS rent_multiple, p_partkey % 2 = 1 AS insured, CASE WHEN p_partkey % 2 = 0 THEN 'visale' ELSE 'guarantor' END AS guarantees FROM part")
def requirements(t):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Revenus minimum de "), (F.col("p_size") + 2000).cast("string"), F.lit(" €, Visale acceptée"))).otherwise("Revenus 3 x le loyer, GLI, garant exigé")
    r = X.requirements(text)
    return t.part.select("p_partkey", r["min_income"].alias("min_income"), r["rent_multiple"].alias("rent_multiple"), r["insured"].alias("insured"), F.array_join(r["guarantees"], ",").alias("guarantees"))


@R.add("o04_after_run", "SELECT id, CASE stop_reason WHEN 'blocked' THEN 'blocked' WHEN 'error' THEN 'degraded' ELSE 'ok' END AS health, CASE WHEN stop_reason = 'completed' THEN 0 ELSE CAST(request_count + 1 AS INT) END AS errors, CASE WHEN stop_reason = 'completed' THEN floor((1.5::DOUBLE * 0.7::DOUBLE + new_count * 0.3::DOUBLE) * 100 + 0.5) / 100 ELSE 1.5::DOUBLE END AS average FROM runs")
def after_run(t):
    r = X.state_after_run(F.col("stop_reason"), F.col("request_count"), F.lit(1.5), F.col("new_count"))
    return t.runs.select("id", r["health"].alias("health"), r["errors"].alias("errors"), r["average"].alias("average"))


@R.add("o13_regroup", "SELECT id, new_count > 0 OR epoch_us(TIMESTAMP '2024-01-15') - epoch_us(started_at) >= 1800000000 AS go FROM runs")
def regroup(t):
    return t.runs.select("id", X.should_regroup(F.col("new_count") > 0, F.col("started_at"), F.lit("2024-01-15").cast("timestamp")).alias("go"))


@R.add("o16_alerts", "SELECT id, family FROM (SELECT l.id, CASE WHEN favorite = 1 AND (rented OR lifecycle = 'inactive') THEN 'gone' WHEN favorite = 1 AND json_extract_string(payload, '$.applicationStatus') = 'open' THEN 'reopened' WHEN notified_at IS NULL AND lifecycle = 'active' THEN 'new' END AS family FROM lst l LEFT JOIN state s ON s.listing_id = l.id AND s.user_id = 'u3') WHERE family IS NOT NULL")
def alerts(t):
    return X.alerts(t.lst, t.state, "u3")
