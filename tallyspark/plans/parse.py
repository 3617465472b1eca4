"""Queries: amounts, terms and addresses in texts, raw listings, payloads (survey parts A, J, L, N, P, Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import addresses as A
from tallyspark.functions import grammar as G
from tallyspark.functions import json as Js
from tallyspark.functions import places as X
from tallyspark.functions import text as T
from tallyspark.operators import crawl as K
from tallyspark.operators import cut_words as W
from tallyspark.operators import names as N
from tallyspark.operators import normalize as Z
from tallyspark.operators import records as Rc
from tallyspark.plans.proxies import Registry
from tallyspark.sources import pages as Pg
from tallyspark.sources import payloads as P

R = Registry()
NOW = "1998-12-01 00:00:00"


def _terms(t):
    return t.terms.withColumn("w", G.lex(F.col("text"))).withColumn("a", G.amounts(F.col("w")))


def s(name):
    return F.col(name).cast("string")


# --- amounts and terms ------------------------------------------------------------------------------------------------------------------

_CHARGES = "CASE id % 7 WHEN 0 THEN n + 0.5::DOUBLE WHEN 1 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN CASE WHEN id % 5 <> 0 THEN n::DOUBLE END ELSE n::DOUBLE END"
_DEPOSIT = "CASE CAST(floor(id / 7) AS BIGINT) % 8 WHEN 0 THEN 1100.0::DOUBLE + id % 900 WHEN 1 THEN 300.0::DOUBLE + id % 600 WHEN 3 THEN round(2 * {bare}, 2) WHEN 5 THEN {bare} WHEN 6 THEN 300.0::DOUBLE + id % 600 END"
_FEES = "CASE CAST(floor(id / 56) AS BIGINT) % 7 WHEN 0 THEN 100.0::DOUBLE + id % 200 WHEN 2 THEN 160.0::DOUBLE + id % 200 WHEN 3 THEN 100.0::DOUBLE + id % 200 WHEN 6 THEN 0.0::DOUBLE END"
_PEOPLE = "CASE id % 6 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 3 THEN 3 END"


@R.add("l04_charges", f"SELECT id, {_CHARGES} AS charges FROM terms")
def charges(t):
    return _terms(t).select("id", G.charges_in_text(F.col("w"), F.col("a"), F.col("rent")).alias("charges"))


@R.add("l04_charges_field", """
SELECT id, CASE id % 6 WHEN 0 THEN n::DOUBLE WHEN 1 THEN n::DOUBLE WHEN 2 THEN 1000.0::DOUBLE + n WHEN 4 THEN n::DOUBLE END AS field, CASE id % 4 WHEN 0 THEN n + 0.5::DOUBLE WHEN 1 THEN n::DOUBLE END AS line FROM terms""")
def charges_field(t):
    n, k = s("n"), F.col("id").cast("int")
    field = F.get(F.array(F.concat(n, F.lit(" € / Mois")), F.concat(F.lit("Charges : "), n, F.lit(" €")), F.concat(F.lit("1 0"), n, F.lit(" € par mois")), F.lit("nc"), n, F.lit("9 000 €")), k % 6)
    line = F.get(F.array(F.concat(F.lit("700 € + "), n, F.lit(",50 € de charges")), F.concat(F.lit("Charges: "), n), F.concat(n, F.lit(" € hors taxes")), F.lit("")), k % 4)
    return t.terms.select("id", G.charges_field(field).alias("field"), G.charges(line).alias("line"))


@R.add("l08_deposit", f"SELECT id, CASE WHEN d <= 3 * rent THEN d END AS deposit FROM (SELECT id, rent, {_DEPOSIT.format(bare='bare')} AS d FROM terms) x")
def deposit(t):
    return _terms(t).select("id", G.deposit_in_text(F.col("w"), F.col("a"), F.col("rent"), F.col("bare")).alias("deposit"))


@R.add("l08_deposit_field", "SELECT id, CASE id % 4 WHEN 0 THEN CASE WHEN 1100 + id % 900 <= 3 * rent THEN 1100.0::DOUBLE + id % 900 END WHEN 3 THEN 40.25::DOUBLE + id % 50 END AS deposit, CASE id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN n::DOUBLE END AS fees FROM terms")
def deposit_field(t):
    k = F.col("id").cast("int")
    text = F.get(F.array(F.concat(F.lit("1 "), (F.col("id") % 900 + 100).cast("string"), F.lit(" €")), F.lit("0 €"), F.lit("1 mois de loyer"), F.concat((F.col("id") % 50 + 40).cast("string"), F.lit(",25 eur TTC"))), k % 4)
    fee = F.get(F.array(F.lit("0 €"), s("n"), F.lit("13 €/m²")), k % 3)
    return t.terms.select("id", G.deposit_field(text, F.col("rent")).alias("deposit"), G.fees_field(fee, F.col("rent")).alias("fees"))


@R.add("l08_fees", f"SELECT id, {_FEES} AS fees FROM terms")
def fees(t):
    return _terms(t).select("id", G.fees_in_text(F.col("w"), F.col("a"), F.col("rent")).alias("fees"))


@R.add("j21_max_occupants", f"SELECT id, {_PEOPLE} AS people FROM terms")
def max_occupants(t):
    return _terms(t).select("id", G.max_occupants(F.col("w")).alias("people"))


@R.add("l03_rent_lines", """
SELECT id, CASE WHEN id % 6 = 4 AND id % 8 = 4 THEN NULL ELSE CASE id % 6 WHEN 0 THEN rent WHEN 1 THEN rent WHEN 2 THEN 1100.0::DOUBLE + id % 900 WHEN 4 THEN 900.0::DOUBLE WHEN 5 THEN rent END END AS rent, CASE id % 6 WHEN 0 THEN true WHEN 2 THEN false END AS included, CASE WHEN id % 2 = 0 THEN 30000.0::DOUBLE + n END AS luxury FROM terms""")
def rent_lines(t):
    rows = t.raw.select(F.col("contact_form_url").cast("long").alias("id"), G.rent(F.col("price_text"), F.lit(None).cast("double")).alias("r"))
    grand = t.terms.select("id", G.rent(F.concat(F.lit("30 0"), s("n"), F.lit(" € par mois")), F.when(F.col("id") % 2 == 0, 300.0).otherwise(100.0))["amount"].alias("luxury"))
    return rows.join(grand, "id").select("id", F.col("r.amount").alias("rent"), F.col("r.included").alias("included"), "luxury")


# --- streets and addresses --------------------------------------------------------------------------------------------------------------

_STREET = "CASE p_partkey % 8 WHEN 0 THEN concat(1 + p_size, ' rue de la ', b) WHEN 1 THEN concat('avenue ', b) WHEN 2 THEN concat(1 + p_size, ' bis boulevard ', b) WHEN 6 THEN concat('12-', 13 + p_size, ' quai ', b) END"


@R.add("j25_street_address", f"SELECT p_partkey, {_STREET} AS street FROM (SELECT p_partkey, p_size, replace(p_brand, '#', '') AS b0, concat('Ligne', chr(CAST(65 + p_size % 26 AS INTEGER))) AS b FROM part) x")
def street_address(t):
    n = (F.col("p_size") + 1).cast("string")
    b = F.concat(F.lit("Ligne"), F.chr(F.lit(65) + F.col("p_size") % 26))
    far = F.lit("Appartement lumineux au calme, parquet, double vitrage, cuisine équipée, belle pièce de vie, rangements, digicode, chauffage collectif, ")
    cases = [
        F.concat(F.lit("Bel appartement, "), n, F.lit(" rue de la "), b, F.lit(", Nice")), F.concat(F.lit("T2 meublé. avenue "), b, F.lit(" très bien placé")), F.concat(F.lit("Au "), n, F.lit(" bis boulevard "), b, F.lit(" - STUDIO VIDE")), F.concat(F.lit("proche de la rue "), b),
        F.concat(far, n, F.lit(" rue "), b), F.concat(F.lit("libre 06/2027 boulevard "), b, F.lit(" à deux pas")), F.concat(F.lit("12-"), (F.col("p_size") + 13).cast("string"), F.lit(" quai "), b, F.lit(" 06000")), F.lit("").cast("string"),
    ]
    return t.parts.select("p_partkey", A.street_in_text(F.get(F.array(*cases), F.col("p_partkey").cast("int") % 8)).alias("street"))


@R.add("j35_named_districts", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN b WHEN 1 THEN concat('Mont ', b) WHEN 4 THEN b END AS district FROM (SELECT p_partkey, concat('Ligne', chr(CAST(65 + p_size % 26 AS INTEGER))) AS b FROM part) x")
def named_districts(t):
    b = F.concat(F.lit("Ligne"), F.chr(F.lit(65) + F.col("p_size") % 26))
    texts = [F.concat(F.lit("Studio quartier "), b, F.lit(" meublé")), F.concat(F.lit("secteur du Mont "), b, F.lit(", calme")), F.concat(F.lit("proche du quartier "), b), F.concat(F.lit("quartier Calme, "), b), F.concat(F.lit("Beau T2 (quartier de la "), b, F.lit("). Vue")), F.concat(F.lit("quartier calme "), b)]
    return t.parts.select("p_partkey", A.named_district(F.get(F.array(*texts), F.col("p_partkey").cast("int") % 6)).alias("district"))


@R.add("q05_addresses", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN concat('20 rue ', w) ELSE concat(1 + p_size, ' rue ', w) END AS clean,
 CASE p_partkey % 4 WHEN 0 THEN concat(1 + p_size, ' rue ', w) WHEN 1 THEN concat('rue ', w, ' Nord') WHEN 2 THEN concat(1 + p_size, ' rue ', w) ELSE NULL END AS best FROM (SELECT p_partkey, p_size, concat('Ligne', chr(CAST(65 + p_size % 26 AS INTEGER))) AS w FROM part) x""")
def addresses(t):
    n, k = (F.col("p_size") + 1).cast("string"), F.col("p_partkey").cast("int")
    w = F.concat(F.lit("Ligne"), F.chr(F.lit(65) + F.col("p_size") % 26))
    base = F.concat(n, F.lit(" rue "), w)
    given = F.get(F.array(F.concat(base, F.lit(", 06700 Saint-Laurent-du-Var")), F.concat(base, F.lit(" - Saint Laurent du Var (06700)")), F.concat(F.lit("  "), base, F.lit(" ,")), base, F.concat(F.lit("2024 20 rue "), w)), k % 5)
    stored = F.get(F.array(F.concat(F.lit("rue "), w), F.concat(F.lit("rue "), w, F.lit(" Nord")), F.concat(base, F.lit(" - vue mer")), F.lit("Nice centre")), k % 4)
    found = F.get(F.array(base, F.concat(F.lit("rue "), w), base, F.lit(None).cast("string")), k % 4)
    text = F.lit("libre en janvier 2024 20 rue")
    return t.parts.select("p_partkey", A.clean_address(given, F.lit("Saint-Laurent-du-Var"), F.lit("06700"), text).alias("clean"), A.best_address(stored, found).alias("best"))


# --- raw listings -----------------------------------------------------------------------------------------------------------------------

_KINDS = """CASE WHEN id % 29 = 0 THEN 'noAddress' END AS r1, CASE WHEN id % 31 = 0 THEN 'noReference' END AS r2, CASE WHEN (id % 29 <> 0 AND id % 23 = 0) OR (id % 19 <> 0 AND id % 17 = 0 AND id % 2 = 0) THEN 'forSale' END AS r3,
 CASE WHEN id % 6 = 4 AND id % 8 = 4 THEN 'shortPeriod' END AS r4, CASE WHEN id % 19 = 0 AND id % 5 = 0 THEN 'wanted' END AS r5"""
_RAW_PRICE = "CASE id % 6 WHEN 0 THEN rent WHEN 1 THEN rent WHEN 2 THEN 1100.0::DOUBLE + id % 900 WHEN 4 THEN 900.0::DOUBLE WHEN 5 THEN rent END"


def _parts(t):
    return Z.normalize(t.raw, F.lit(NOW).cast("timestamp"), ("p0",))


@R.add("q02_rejects", f"SELECT id, array_to_string(list_filter([r1, r2, r3, r4, r5], lambda x: x IS NOT NULL), ',') AS reasons FROM (SELECT id, {_KINDS} FROM terms) x WHERE coalesce(r1, r2, r3, r4, r5) IS NOT NULL")
def rejects(t):
    _, rejected = _parts(t)
    return rejected.select(F.col("contact_form_url").cast("long").alias("id"), F.array_join("reasons", ",").alias("reasons"))


@R.add("q01_normalize", f"""
WITH x AS (SELECT *, {_KINDS}, {_RAW_PRICE} AS price FROM terms), y AS (SELECT *, CASE WHEN id % 5 = 0 THEN n::DOUBLE WHEN id % 6 = 1 THEN 55.0::DOUBLE ELSE CASE WHEN id % 17 = 0 AND id % 2 = 0 THEN NULL ELSE {_CHARGES} END END AS charges FROM x WHERE coalesce(r1, r2, r3, r4, r5) IS NULL),
z AS (SELECT *, CASE WHEN id % 6 = 0 THEN true WHEN id % 6 = 2 THEN false END AS included, id % 17 = 0 AND id % 2 = 0 AS mute FROM y), b AS (SELECT *, CASE WHEN included = false THEN price WHEN included AND charges IS NOT NULL THEN greatest(price - charges, 0) END AS bare2 FROM z),
w AS (SELECT *, CASE WHEN id % 9 = 0 THEN 800.0::DOUBLE WHEN mute THEN NULL ELSE {_DEPOSIT.format(bare="bare2")} END AS dep, CASE WHEN mute THEN NULL ELSE {_FEES} END AS fee FROM b)
SELECT concat('p', id % 5, ':', id) AS id, price, charges, included AS charges_included, CASE WHEN dep <= 3 * coalesce(price, 20000) THEN dep END AS deposit, CASE WHEN fee <= 2 * coalesce(price, 20000) THEN fee END AS tenant_fees, 30.5::DOUBLE + id % 60 AS area,
 CAST(CASE WHEN id % 2 = 0 THEN 1 + id % 5 WHEN id % 19 = 0 OR id % 17 = 0 THEN NULL WHEN id % 4 = 1 THEN 1 ELSE 1 + id % 5 END AS INTEGER) AS rooms, CASE WHEN id % 10 = 0 THEN '+33493000001' END AS phone, CASE WHEN id % 3 = 1 THEN concat('Agence ', id % 9) END AS agency, CASE WHEN id % 3 = 1 THEN 'agency' ELSE 'unknown' END AS landlord_kind,
 CASE WHEN mute THEN NULL ELSE {_PEOPLE} END AS max_occupants, CASE WHEN id % 7 < 2 THEN CASE WHEN id % 3 = 0 THEN concat(1 + id % 90, ' rue Pastorelli') WHEN id % 19 <> 0 AND id % 17 <> 0 AND id % 4 = 0 THEN NULL END WHEN id % 3 = 0 THEN concat(1 + id % 90, ' rue Pastorelli') ELSE 'rue Pastorelli' END AS address FROM w""")
def normalize(t):
    accepted, _ = _parts(t)
    return accepted.select("id", "price", "charges", "charges_included", "deposit", "tenant_fees", "area", "rooms", "phone", "agency", "landlord_kind", "max_occupants", "address")


@R.add("q03_rederive", f"""
WITH x AS (SELECT *, {_CHARGES} AS c, {_DEPOSIT.format(bare="rent")} AS d FROM terms), y AS (SELECT id, rent, CASE WHEN id % 2 = 0 THEN 77.0::DOUBLE ELSE c END AS charges, id % 2 = 1 AND c IS NOT NULL AS c1, CASE WHEN id % 4 < 2 THEN 111.0::DOUBLE ELSE CASE WHEN d <= 3 * rent THEN d END END AS deposit, id % 4 >= 2 AND d <= 3 * rent AS d1, {_PEOPLE} AS p FROM x)
SELECT id, charges, deposit, p AS max_occupants, array_to_string(list_filter([CASE WHEN c1 THEN 'charges' END, CASE WHEN d1 THEN 'deposit' END, CASE WHEN p IS NOT NULL THEN 'max_occupants' END], lambda v: v IS NOT NULL), ',') AS changed FROM y""")
def rederive(t):
    raw = t.terms.select(s("id").alias("source_ref"), F.lit("p").alias("source_id"), F.concat(F.lit("https://s.example/"), s("id")).alias("source_url"), F.concat(s("rent"), F.lit(" € HC")).alias("price_text"))
    stored = Z.typed(Z.completed(raw), F.lit(NOW).cast("timestamp"))  # rows without texts, which come later
    k = F.col("source_ref").cast("long")
    stored = stored.drop("description").join(t.terms.select(s("id").alias("source_ref"), F.col("text").alias("description")), "source_ref")
    found = Z.rederive(stored.withColumns({"charges": F.when(k % 2 == 0, 77.0), "deposit": F.when(k % 4 < 2, 111.0)}), F.lit(NOW).cast("timestamp"))
    names = F.filter("changed", lambda c: c.isin("charges", "deposit", "max_occupants"))
    return found.select(k.alias("id"), "charges", "deposit", "max_occupants", F.array_join(names, ",").alias("changed"))


@R.add("f34_wanted_ads", """
SELECT source_id, count(*) AS n, count(*) FILTER (w) AS wanted, CASE WHEN count(*) FILTER (w) > 0 THEN 'cherche un appartement' END AS evidence, min(source_url) FILTER (w) AS example
FROM (SELECT source_id, source_url, id % 19 = 0 AS w FROM (SELECT *, CAST(contact_form_url AS BIGINT) AS id FROM raw) y) x GROUP BY source_id""")
def wanted_ads(t):
    k = F.col("contact_form_url").cast("long")
    # Others that only seem to ask: a noun, and an agency's search.
    title = F.when(k % 19 == 0, F.col("title")).when(k % 2 == 0, F.concat(F.lit("Notre agence recherche un studio "), "title")).otherwise(F.concat("title", F.lit(" votre recherche de logement")))
    return Rc.wanted_report(t.raw.select("source_id", "source_url", title.alias("title"), "description"))


# --- payloads ---------------------------------------------------------------------------------------------------------------------------


@R.add("a09_payload", """
WITH RECURSIVE cells AS (SELECT p_partkey, CAST(p_size % 6 AS BIGINT) AS depth FROM part),
g AS (SELECT p_partkey, depth, depth AS level, concat('{"v":', p_partkey, '}') AS json FROM cells UNION ALL SELECT p_partkey, depth, level - 1, concat('{"child":', json, ',"twin":', json, ',"list":[null,', p_partkey, ',"é"]}') FROM g WHERE level > 0)
SELECT p_partkey, json FROM g WHERE level = 0""")
def payload(t):
    k, depth = s("p_partkey"), F.col("p_size").cast("int") % 6
    # Cell 3i is level i's object, 3i + 1 its list, 3i + 2 a wrapper of the next level's object; the last cells hold the number and the text.
    end = depth * 3
    level = F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < depth), lambda i: F.concat(F.lit('{"child":'), (i * 3 + 3).cast("string"), F.lit(',"twin":'), (i * 3 + 2).cast("string"), F.lit(',"list":'), (i * 3 + 1).cast("string"), F.lit(',"gone":-1},[-1,'), (end + 1).cast("string"), F.lit(","), (end + 2).cast("string"), F.lit('],["Reactive",'), (i * 3 + 3).cast("string"), F.lit("]")))
    flat = F.concat(F.lit("["), F.array_join(F.concat(level, F.array(F.concat(F.lit('{"v":'), (end + 1).cast("string"), F.lit("}")), k, F.lit('"é"'))), ","), F.lit("]"))
    page = F.concat(F.lit('<html><script type="application/json" id="__NUXT_DATA__">'), flat, F.lit("</script></html>"))
    return t.parts.select("p_partkey", P.page_payload(page).alias("json"))


_DOC = """SELECT event_id, concat('{"k":', CAST(event_id % 97 AS STRING), ',"s":"a', CAST(event_id % 5 AS STRING), '","b":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"n":null,"r":', CAST(event_id % 9 AS STRING), '.5,"o":{"x":', CAST(event_id % 7 AS STRING), '},"l":[1,"z"]}') AS doc FROM events"""


@R.add("n03_json_each", f"""
SELECT event_id, key, CASE WHEN type IN ('OBJECT', 'ARRAY') THEN json_extract(doc, concat('$.', key))::VARCHAR ELSE json_extract_string(doc, concat('$.', key)) END AS value, CASE type WHEN 'UBIGINT' THEN 'integer' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN json_extract_string(doc, concat('$.', key)) WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'real' ELSE lower(type) END AS type
FROM (SELECT event_id, doc, key, json_type(doc, concat('$.', key)) AS type FROM (SELECT event_id, doc, unnest(json_keys(doc)) AS key FROM ({_DOC}) a) b) c""")
def json_each(t):
    return Js.entries(t.sql(_DOC), "doc").select("event_id", "key", "value", "type")


@R.add("n03_list_scores", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('{"match":{"reasons":[],"value":', event_id % 100, '},"risk":{"reasons":[],"value":', event_id % 7, '}}') END AS scores, CASE WHEN event_id % 3 <> 2 THEN concat('{"id":', event_id, ',"n":[1,null]}') END AS light FROM events""")
def list_scores(t):
    k = s("event_id")
    body = F.concat(F.lit('{"id":'), k, F.lit(',"description":"x","n":[1,null],"distances":{"a":1},"scores":'))
    full = F.concat(body, F.lit('{"match":{"value":'), (F.col("event_id") % 100).cast("string"), F.lit(',"reasons":["a","b"]},"risk":{"value":'), (F.col("event_id") % 7).cast("string"), F.lit("}}}"))
    doc = F.get(F.array(full, F.concat(body, F.lit("[1]}")), F.lit("{broken")), F.col("event_id").cast("int") % 3)
    return t.events.select("event_id", Js.scores_without_reasons(doc).alias("scores"), Js.list_payload(doc).alias("light"))


@R.add("n07_payload_round_trip", "SELECT id, price, rooms, city, furnished, first_seen, json_extract_string(payload, '$.imageUrls[0]') AS first_image, true AS same FROM lst")
def round_trip(t):
    made = t.lst.select("*", F.to_json(F.struct("price", "rooms", "city", "furnished", "first_seen", F.parse_json("payload").alias("held")), {"ignoreNullFields": "false"}).alias("json"))
    back = made.select("id", "payload", F.from_json("json", "price double, rooms int, city string, furnished boolean, first_seen timestamp, held variant").alias("v"))
    return back.select("id", "v.price", "v.rooms", "v.city", "v.furnished", "v.first_seen", F.expr("variant_get(v.held, '$.imageUrls[0]', 'string')").alias("first_image"), (F.to_json("v.held") == F.to_json(F.parse_json("payload"))).alias("same"))


@R.add("n08_occurrence_ids", "SELECT group_id, array_to_string(list_sort(list(id)), '|') AS ids FROM occ WHERE group_id IS NOT NULL GROUP BY group_id")
def occurrence_ids(t):
    doc = t.occ.where("group_id is not null").groupBy("group_id").agg(F.to_json(F.struct(F.collect_list(F.struct("id", F.col("price").alias("value"))).alias("occurrences"))).alias("doc"))
    mixed = F.replace("doc", F.lit('{"occurrences":['), F.lit('{"occurrences":[{"id":7},{"x":1},'))
    return doc.select("group_id", F.array_join(F.array_sort(Js.occurrence_ids(mixed)), "|").alias("ids"))


# --- crawls and labels ------------------------------------------------------------------------------------------------------------------

_PAGES = """
SELECT CAST(o_custkey AS STRING) AS source_id, concat('l', CAST(o_orderkey % 3 AS STRING)) AS list_url, o_orderkey AS ordinal, o_custkey AS c,
 CASE o_custkey % 8 WHEN 0 THEN 'unchanged' WHEN 2 THEN 'failed' WHEN 3 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'read' END WHEN 4 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'rateLimited' ELSE 'read' END WHEN 5 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'blocked' ELSE 'read' END ELSE 'read' END AS status,
 o_custkey % 8 = 1 AS says_empty, CASE WHEN o_custkey % 16 = 6 THEN 9999 WHEN o_custkey % 8 = 7 THEN 2 END AS announced FROM orders"""
_STUBS = "SELECT CAST(o_custkey AS STRING) AS source_id, CAST(l_partkey AS STRING) AS source_ref, o_orderkey AS ordinal FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 8 NOT IN (0, 1, 2)"
_VERDICT = f"""
pg AS ({_PAGES}), sb AS ({_STUBS}), stop AS (SELECT source_id, min(ordinal) AS halt, arg_min(status, ordinal) AS why FROM pg WHERE status IN ('rateLimited', 'blocked') GROUP BY source_id),
n AS (SELECT p.source_id, count(*) FILTER (status = 'read') AS pages_fetched, count(*) FILTER (status = 'unchanged') AS u, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'read' AND says_empty) AS e, max(announced) FILTER (status = 'read') AS announced, min(why) AS why FROM pg p LEFT JOIN stop s ON s.source_id = p.source_id WHERE halt IS NULL OR ordinal <= halt GROUP BY p.source_id),
l AS (SELECT source_id, count(DISTINCT list_url) AS lists FROM pg GROUP BY source_id), g AS (SELECT b.source_id, count(DISTINCT source_ref) AS collected FROM sb b LEFT JOIN stop s ON s.source_id = b.source_id WHERE halt IS NULL OR ordinal < halt GROUP BY b.source_id),
v AS (SELECT n.source_id, CASE WHEN why IS NOT NULL THEN why WHEN u = lists THEN 'notModified' WHEN coalesce(collected, 0) = 0 AND e = lists THEN 'empty' WHEN coalesce(collected, 0) = 0 AND pages_fetched = 0 THEN 'tooManyErrors' ELSE 'completed' END AS stop_reason, pages_fetched, coalesce(collected, 0) AS collected, announced, f > 0 AS part FROM n JOIN l ON l.source_id = n.source_id LEFT JOIN g ON g.source_id = n.source_id)"""


@R.add("a03_outcomes", f"WITH {_VERDICT} SELECT source_id, stop_reason, pages_fetched, collected, announced, stop_reason = 'completed' AND NOT part AND collected >= coalesce(announced, 0) AS complete FROM v")
def crawl_outcomes(t):
    return K.outcomes(t.sql(_PAGES), t.sql(_STUBS)).drop("partial")


@R.add("a03_references", f"""
WITH {_VERDICT}, d AS (SELECT DISTINCT sb.source_id, source_ref, part, CAST(source_ref AS BIGINT) AS k FROM sb JOIN v ON v.source_id = sb.source_id WHERE stop_reason = 'completed')
SELECT source_id, source_ref, CASE WHEN k % 5 = 0 AND k % 2 = 0 AND NOT part THEN 'withdrawn' WHEN k % 3 = 0 AND k % 7 <> 0 THEN 'rendered' WHEN k % 2 = 0 THEN 'confirmed' ELSE 'skipped' END AS fate FROM d""")
def crawl_references(t):
    stubs = t.sql(_STUBS)
    k = F.col("source_ref").cast("long")
    details = stubs.where(k % 5 == 0).select("source_id", "source_ref", F.lit(True).alias("gone"), F.lit(None).cast("string").alias("price_text")).union(stubs.where(k % 3 == 0).select("source_id", "source_ref", F.lit(False), F.when(k % 7 != 0, "700 €")))
    return K.references(K.outcomes(t.sql(_PAGES), stubs), stubs, details, stubs.where(k % 2 == 0))


@R.add("a15_labels", """
SELECT page_id, concat('Surface=', page_id % 90 + 10, ' m²|Étage=', page_id % 7, '|Loyer=', 500 + page_id, ' €|Dépôt=', page_id, '|Charges=non') AS pairs FROM pages""")
def labels(t):
    k = s("page_id")
    made = F.concat(F.lit("<dl class='x'><dt>Surface :</dt><dd><b>"), (F.col("page_id") % 90 + 10).cast("string"), F.lit(" m&sup2;</b></dd><dd>autre</dd><dt>Étage</dt><dd>"), (F.col("page_id") % 7).cast("string"), F.lit("</dd></dl><table><tr><th>Loyer</th><td>"), (F.col("page_id") + 500).cast("string"),
                    F.lit(" &euro;</td><td>x</td></tr><tr><th>Seul</th></tr></table><script>var a = '<dt>a</dt><dd>b</dd>'</script><ul><li>rien ici</li><li>Dépôt&nbsp;: <i>"), k, F.lit("</i></li><li>Charges: non</li></ul>"), F.coalesce("html", F.lit("")))
    pairs = F.transform(Pg.labelled(made), lambda p: F.concat(p["label"], F.lit("="), p["value"]))
    return t.pages.select("page_id", F.array_join(F.slice(pairs, 1, 5), "|").alias("pairs"))


@R.add("d27_abbreviated", """
SELECT concat('IMMO Dupont ', s_suppkey) AS name, CASE WHEN s_suppkey % 3 <> 0 THEN concat('src-', s_suppkey) END AS source_id FROM supplier""")
def abbreviated(t):
    k = s("s_suppkey")
    handles = t.supplier.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("src-"), k).alias("source_id"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Immobilière Dupont ").otherwise("Immobilier DUPONT "), k).alias("title"))
    return N.resolve(t.supplier.select(F.concat(F.lit("IMMO Dupont "), k).alias("name")), handles)


# --- words ------------------------------------------------------------------------------------------------------------------------------

_CUT = "SELECT id, concat(substr(title, 1, 6 + price_len % 23), CASE WHEN price_len % 2 = 0 THEN '...' ELSE '…' END, ' fin') AS text FROM (SELECT id, title, CAST(length(id) + length(title) AS BIGINT) AS price_len FROM occ WHERE title IS NOT NULL) x"
_WORDS = "SELECT DISTINCT w FROM (SELECT explode(split(lower(concat(p_name, ' ', p_type)), ' ')) AS w FROM part) x"


@R.add("j07_complete_words", f"""
WITH t AS (SELECT DISTINCT text FROM ({_CUT}) x), v AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(concat(p_name, ' ', p_type)), ' ')) AS w FROM part) x),
c AS (SELECT text, regexp_replace(text, '(\\.\\.\\.|…) fin$', '') AS head FROM t), h AS (SELECT text, string_split(trim(regexp_replace(lower(head), '[^a-z0-9]+', ' ', 'g')), ' ') AS p, regexp_extract(lower(head), '[a-z]+$') AS stem FROM c),
m AS (SELECT stem, min(w) AS whole FROM (SELECT DISTINCT stem FROM h WHERE length(stem) >= 4) a JOIN v ON starts_with(w, stem) AND length(w) > length(stem) GROUP BY stem)
SELECT text, concat(array_to_string(CASE WHEN whole IS NULL THEN p ELSE list_concat(p[:len(p) - 1], [whole]) END, ' '), ' fin') AS completed FROM h LEFT JOIN m USING (stem)""")
def complete_words(t):
    rows = t.sql(_CUT).select("text").distinct()
    return W.complete(rows, "text", t.sql(_WORDS), "w", F.col("w")).select("text", "completed")


@R.add("j03_fold_marks", "SELECT p_partkey, concat('ete saint etienne ', CAST(p_size AS STRING), ' prilis zlutoucky a b ', lower(p_name)) AS folded, concat('ligne ', CAST(p_size AS STRING), chr(10), chr(10), 'xé y') AS lines FROM part")
def fold_marks(t):
    marked = F.concat(F.lit("ÉTÉ — Saint-Étienne "), s("p_size"), F.lit(" Příliš žluťoučký a&amp;b "), F.upper("p_name"))
    lines = F.concat(F.lit("  ligne "), s("p_size"), F.lit(" \r\n\r\n\r\n x&eacute;&nbsp; y<br>"))
    return t.parts.select("p_partkey", T.fold(marked).alias("folded"), T.multiline(lines).alias("lines"))


@R.add("j04_multiline_breaks", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[^\S\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS lines
FROM (SELECT doc_id, replace(replace(coalesce(text, ''), '&', '+'), '<', '(') AS t FROM documents) x""")
def multiline(t):
    plain = F.translate(F.coalesce("text", F.lit("")), "&<", "+(")
    return t.documents.select("doc_id", F.md5(T.multiline(plain)).alias("lines"))


@R.add("j06_french_tokens", "SELECT p_partkey, concat('studio meuble centre ', lower(replace(p_name, '-', ' '))) AS words FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: length(w) < 3)) = 0")
def french_tokens(t):
    short = F.filter(F.split("p_name", " "), lambda w: F.length(w) < 3)
    return t.parts.where(F.size(short) == 0).select("p_partkey", F.array_join(T.tokens(F.concat(F.lit("Studio meublé dans le centre avec "), "p_name")), " ").alias("words"))


@R.add("j20_stale_features", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'lift' WHEN 1 THEN 'balcony,lift' ELSE '' END AS stale FROM part")
def stale_features(t):
    text = F.get(F.array(F.concat("p_name", F.lit(" avec balcon")), F.col("p_name"), F.concat(F.lit("balcon et ascenseur "), "p_name")), F.col("p_size").cast("int") % 3)
    stored = F.array(F.lit("balcony"), F.lit("lift"), F.lit("pool"))
    return t.parts.select("p_partkey", F.array_join(X.stale_features(stored, text, {"balcony": r"\bbalcon\b", "lift": r"\bascenseur\b"}), ",").alias("stale"))


# --- places and pages -------------------------------------------------------------------------------------------------------------------


@R.add("j42_portal", r"SELECT page_id, CASE WHEN regexp_matches(h, '(^|\.)example\.net$') THEN 'Net' WHEN regexp_matches(h, '(^|\.)example\.org$') THEN 'Org' END AS portal FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS h FROM pages) x")
def portal(t):
    return t.pages.select("page_id", X.portal(F.col("url"), {"example.net": "Net", "example.org": "Org"}).alias("portal"))


@R.add("j34_photo_origin", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN concat('https://x.example/', p_partkey, '.jpg') ELSE concat('https://media.example/photos/', p_partkey, '.jpg') END AS photo FROM part")
def photo_origin(t):
    path = F.concat(F.lit("/photos/"), s("p_partkey"), F.lit(".jpg"))
    code = F.translate(F.base64(path.cast("binary")), "+/=", "-_")
    url = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("https://x.example/"), s("p_partkey"), F.lit(".jpg"))).otherwise(F.concat(F.lit("https://img.proxy.example/ext/"), F.when(F.col("p_partkey") % 3 == 0, "_https_/").otherwise(""), F.lit("media.example/ab/"), code, F.lit("_r1.jpg")))
    return t.parts.select("p_partkey", X.photo_origin(url, r"^https://img\.proxy\.example/ext/(?:_(https?)_/)?([^/]+)/[0-9a-f]{2}/([A-Za-z0-9_-]+)_r").alias("photo"))


@R.add("p02_geocode_key", "SELECT id, concat('v3 ', lower(CASE WHEN address IS NULL THEN coalesce(city, '') WHEN city IS NULL THEN address ELSE concat(address, ' ', city) END)) AS key FROM (SELECT DISTINCT id, address, city FROM occ) x")
def geocode_key(t):
    return t.occ.select("id", "address", "city").distinct().select("id", X.geocode_key(F.col("address"), F.col("city")).alias("key"))
