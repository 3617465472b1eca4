"""Queries: scalar functions and page reading (survey parts A, J, K, L, N, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import dates as Dt
from tallyspark.functions import json as Js
from tallyspark.functions import listing as L
from tallyspark.functions import text as T
from tallyspark.operators.joins import one_edit_pairs
from tallyspark.plans.proxies import Registry
from tallyspark.sources import pages as S

R = Registry()
NOW = "2026-08-14 12:00:00"
_FOLD = "trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g'))"


def now():
    return F.lit(NOW).cast("timestamp")


def cat(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def s(name):
    return F.col(name).cast("string")


@R.add("j01_entities", "SELECT p_partkey, concat('A&é ', chr(200 + p_size), '² ', chr(8364), chr(128512), '<b>') AS text FROM part")
def entities(t):
    raw = cat("A&amp;&eacute; &#", (F.col("p_size") + 200).cast("string"), ";&sup2; &euro;&#128512;&lt;b&gt;")
    return t.parts.select("p_partkey", T.decode_entities(raw).alias("text"))


@R.add("j02_clean", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def clean(t):
    return t.documents.select("doc_id", T.clean(F.col("text")).alias("text"))


@R.add("j03_fold", f"SELECT doc_id, {_FOLD.format('text')} AS folded, replace({_FOLD.format('text')}, ' ', '-') AS slug FROM documents")
def fold(t):
    return t.documents.select("doc_id", T.fold(F.col("text")).alias("folded"), T.slug(F.col("text")).alias("slug"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@R.add("j06_tokens", f"SELECT doc_id, len(list_filter(string_split({_FOLD.format('text')}, ' '), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))) AS n FROM documents")
def tokens(t):
    return t.documents.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n"))


@R.add("i05_jaccard", """
WITH w AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 9) AS j FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def jaccard(t):
    words = t.benchmark.select("item_id", F.split(F.lower("text"), " ").alias("t"))
    b = words.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return words.join(b, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.round(T.jaccard(F.col("t"), F.col("u")), 9).alias("j"))


@R.add("j04_multiline", "SELECT p_partkey, concat(p_name, chr(10), 'two', chr(10), chr(10), p_brand) AS text FROM part")
def multiline(t):
    return t.parts.select("p_partkey", T.multiline(cat("\n ", F.col("p_name"), " <br/>two  \n\n\n\n ", F.col("p_brand"), "\n")).alias("text"))


@R.add("j08_phone", "SELECT c_custkey, concat('+33', 400000000 + c_custkey) AS a, concat('+33', 400000000 + c_custkey) AS b, concat('+33', 600000000 + c_custkey) AS c, CAST(NULL AS STRING) AS d FROM customer")
def phone(t):
    n = F.lpad(s("c_custkey"), 8, "0")
    return t.customer.select("c_custkey", T.phone(cat("04 ", n)).alias("a"), T.phone(cat("+33 4", n)).alias("b"), T.phone(cat("0033 6.", n)).alias("c"), T.phone(cat("12", n)).alias("d"))


@R.add("j09_email_postal", "SELECT c_custkey, concat('a', c_custkey, '@mail.example') AS email, lpad(CAST(c_custkey AS STRING), 5, '0') AS postal, concat('Tel [phone] mail [email] token=[secret] for ', c_custkey) AS safe FROM customer")
def email(t):
    k = s("c_custkey")
    line = cat("Tel 06 12 34 56 78 mail A", k, "@Mail.Example token=abc", k, " for ", k)
    return t.customer.select("c_custkey", T.email(line).alias("email"), T.postal_code(cat("ville ", F.lpad(k, 5, "0"), " x")).alias("postal"), T.redact(line).alias("safe"))


@R.add("j11_property_type", """
SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'studio' WHEN 1 THEN 'apartment' WHEN 2 THEN 'house' WHEN 3 THEN 'parking' WHEN 4 THEN 'commercial' WHEN 5 THEN 'room' WHEN 6 THEN 'unknown' ELSE 'other' END AS kind FROM part""")
def property_type(t):
    titles = ["Beau Stûdio", "Appartement T2", "Maison de ville", "Box fermé, parking", "Local commercial", "Chambre chez l'habitant", " ", "Bien rare"]
    title = F.get(F.array(*[F.lit(x) for x in titles]), F.col("p_size") % 8)
    return t.parts.select("p_partkey", T.property_type(title).alias("kind"))


@R.add("j12_flags", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS furnished, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS shared, p_partkey % 4 = 0 AS top, p_size % 5 = 0 AS student, p_size % 2 = 0 AS short FROM part""")
def flags(t):
    pick = lambda n, m, *xs: F.get(F.array(*[F.lit(x) for x in xs]), F.col(n) % m)
    return t.parts.select(
        "p_partkey", T.furnished(pick("p_size", 3, "Loué meublé", "Non meublé", "bel appartement")).alias("furnished"), T.flat_share(pick("p_partkey", 3, "En colocation", "Colocation possible", "seul")).alias("shared"),
        T.top_floor(F.when(F.col("p_partkey") % 4 == 0, "Au dernier étage").otherwise("premier etage")).alias("top"), T.student_only(F.when(F.col("p_size") % 5 == 0, "Réservé aux étudiants").otherwise("tous")).alias("student"),
        T.short_lease(F.when(F.col("p_size") % 2 == 0, "bail de 9 mois").otherwise("bail de 3 ans")).alias("short"))


@R.add("j17_energy_label", "SELECT p_partkey, substr('ABCDEFG', p_size % 7 + 1, 1) AS dpe, substr('ABCDEFG', p_partkey % 7 + 1, 1) AS ges, substr('ABCDEFG', greatest(CASE WHEN p_size * 9 <= 70 THEN 1 WHEN p_size * 9 <= 110 THEN 2 WHEN p_size * 9 <= 180 THEN 3 WHEN p_size * 9 <= 250 THEN 4 WHEN p_size * 9 <= 330 THEN 5 WHEN p_size * 9 <= 420 THEN 6 ELSE 7 END, CASE WHEN p_size <= 6 THEN 1 WHEN p_size <= 11 THEN 2 WHEN p_size <= 30 THEN 3 ELSE 4 END), 1) AS worst FROM part")
def energy(t):
    letter = lambda c: F.substring(F.lit("ABCDEFG"), F.col(c).cast("int") % 7 + 1, F.lit(1))
    return t.parts.select("p_partkey", T.energy(cat("classe dpe : ", letter("p_size"), " x")).alias("dpe"), T.energy(cat("GES : ", letter("p_partkey")), "ges").alias("ges"), L.energy_label(F.col("p_size") * 9, F.col("p_size")).alias("worst"))


@R.add("j19_features", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'balcony' END, CASE WHEN p_size % 3 = 0 THEN 'lift' END], lambda x: x IS NOT NULL), ',') AS features FROM part")
def features(t):
    text = cat("Logement", F.when(F.col("p_size") % 2 == 0, " avec balcon").otherwise(""), F.when(F.col("p_size") % 3 == 0, " et Ascenseur").otherwise(""))
    return t.parts.select("p_partkey", F.array_join(T.features(text, {"balcony": r"\bbalcon\b", "lift": r"\bascenseur\b"}), ",").alias("features"))


@R.add("j23_references", "SELECT p_partkey, concat('ab ', 1000 + p_partkey) AS refs FROM part")
def references(t):
    return t.parts.select("p_partkey", F.array_join(T.references(cat("Réf : ab-", (F.col("p_partkey") + 1000).cast("string"), ", ref. 2024, réf ABCDE")), ",").alias("refs"))


@R.add("j26_addresses", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS grade, CASE WHEN p_size % 3 = 0 THEN concat(p_size, 'bis') END AS number, true AS same FROM part WHERE p_size > 0")
def addresses(t):
    n = s("p_size")
    a = F.when(F.col("p_size") % 3 == 0, cat(n, " bis rue de la Paix")).when(F.col("p_size") % 3 == 1, F.lit("Avenue Foch")).otherwise(F.lit("Nice centre"))
    return t.parts.where("p_size > 0").select("p_partkey", T.address_grade(a).alias("grade"), T.house_number(a).alias("number"), T.same_street(cat(n, " rue de la Paix"), F.lit("rue de la paix 06000")).alias("same"))


@R.add("j31_url_key", r"""
SELECT page_id, concat(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\.', ''), regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '/+$', ''), CASE WHEN len(q) > 0 THEN concat('?', array_to_string(list_sort(q), '&')) ELSE '' END) AS key
FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT LIKE 'utm\_%' ESCAPE '\') AS q FROM pages)""")
def url_key(t):
    return t.pages.select("page_id", T.url_key(F.col("url")).alias("key"))


@R.add("j32_photo_name", "SELECT p_partkey, concat('img', lpad(CAST(p_partkey AS STRING), 12, '0')) AS a, CAST(NULL AS STRING) AS b FROM part")
def photo_name(t):
    return t.parts.select("p_partkey", T.photo_name(cat("https://x.example/a/IMG", F.lpad(s("p_partkey"), 12, "0"), ".JPG?w=1")).alias("a"), T.photo_name(F.lit("https://x.example/photo.jpg")).alias("b"))


@R.add("j35_district", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Saint-Roch' WHEN 1 THEN 'Port' END AS district FROM part")
def district(t):
    text = F.get(F.array(F.lit("quartier St Roch, Nice"), F.lit("vue sur le PORT"), F.lit("ailleurs")), F.col("p_size") % 3)
    return t.parts.select("p_partkey", T.district(text, {"Saint-Roch": "saint roch", "Port": "port"}).alias("district"))


@R.add("j41_agency_key", "SELECT s_suppkey, concat('agence', s_suppkey, 'immo') AS key, concat('Agence ', s_suppkey, ' Immobilier') AS title FROM supplier")
def agency_key(t):
    name = cat("AGENCE ", s("s_suppkey"), " immobilier")
    return t.supplier.select("s_suppkey", T.agency_key(name).alias("key"), T.title_case(name).alias("title"))


@R.add("j44_mail", "SELECT event_id, 'Bonjour' AS own, CASE event_id % 4 WHEN 0 THEN 'rented' WHEN 1 THEN 'visitScheduled' WHEN 2 THEN 'contacted' ELSE 'rejected' END AS intention FROM events")
def mail(t):
    i = F.col("event_id").cast("int") % 4
    body = F.get(F.array(F.lit("Il est déjà loué"), F.lit("Visite confirmée le 3"), F.lit("Reçu"), F.lit("dossier pas retenu")), i)
    return t.events.select("event_id", T.unquote(cat("Bonjour\n> ", F.col("event_type"), "\n> fin")).alias("own"), T.intention(F.lit("Re: annonce"), body, F.lit(True)).alias("intention"))


@R.add("p03_one_edit", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE length(a.n_name) >= 6 AND length(b.n_name) >= 6 AND levenshtein(a.n_name, b.n_name) <= 1")
def one_edit(t):
    a, b = t.nation.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("ka")), t.nation.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("kb"))
    return one_edit_pairs(a, b, "a", "b").where("ka < kb").select("a", "b")


@R.add("p03_one_edit_brands", "WITH w AS (SELECT DISTINCT p_brand AS w FROM part) SELECT a.w AS x, b.w AS y FROM w a JOIN w b ON a.w < b.w WHERE levenshtein(a.w, b.w) <= 1")
def one_edit_brands(t):
    w = t.parts.select(F.col("p_brand").alias("x")).distinct()
    return one_edit_pairs(w, w.toDF("y"), "x", "y").where("x < y")


@R.add("k01_published", f"""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN TIMESTAMP '{NOW}' WHEN 1 THEN TIMESTAMP '{NOW}' - INTERVAL 1 DAY WHEN 2 THEN TIMESTAMP '{NOW}' - to_hours(CAST(event_id % 20 AS INT)) WHEN 3 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 4 THEN date_trunc('second', ts) END AS published FROM events""")
def published(t):
    e = F.col("event_id")
    text = F.when(e % 6 == 0, "Publiée aujourd'hui").when(e % 6 == 1, "hier à 9h").when(e % 6 == 2, cat("il y a ", (e % 20).cast("string"), " heures")).when(e % 6 == 3, F.date_format("ts", "dd/MM/yyyy")).when(e % 6 == 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("le 31/02/2024")
    return t.events.select("event_id", Dt.published_at(text, now()).alias("published"))


@R.add("k02_available", f"""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN TIMESTAMP '{NOW}' WHEN 1 THEN TIMESTAMP '2026-09-01' WHEN 2 THEN TIMESTAMP '2027-03-15' ELSE TIMESTAMP '2026-12-31' END AS available FROM events""")
def available(t):
    text = F.get(F.array(F.lit("Disponible immédiatement"), F.lit("à partir du 1er septembre"), F.lit("mi-mars"), F.lit("fin décembre 2026")), F.col("event_id").cast("int") % 4)
    return t.events.select("event_id", Dt.available_at(text, now()).alias("available"))


@R.add("k03_available_in_text", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN DATE '2026-10-05' WHEN 1 THEN DATE '2026-11-01' END AS day FROM events")
def available_in_text(t):
    text = F.get(F.array(F.lit("Libre jusqu'au 3 mai. Disponible le 5 octobre !"), F.lit("libre en novembre"), F.lit("rien")), F.col("event_id").cast("int") % 3)
    return t.events.select("event_id", Dt.availability_in_text(text, now()).alias("day"))


@R.add("k06_ages", """
SELECT event_id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN concat(CAST(floor(m) AS BIGINT), ' min') WHEN m < 2880 THEN concat(CAST(floor(m / 60) AS BIGINT), ' h') WHEN m < 20160 THEN concat(CAST(floor(m / 1440) AS BIGINT), ' d') WHEN m < 86400 THEN concat(CAST(floor(m / 10080) AS BIGINT), ' w') ELSE concat(CAST(floor(m / 43200) AS BIGINT), ' mo') END AS elapsed
FROM (SELECT event_id, (epoch_us(TIMESTAMP '2024-04-15') - epoch_us(ts)) / 60e6 AS m FROM events)""")
def ages(t):
    m = L.age_minutes(F.lit(None).cast("timestamp"), F.col("ts").cast("timestamp"), F.lit("2024-04-15").cast("timestamp"))
    return t.events.select("event_id", L.elapsed(m).alias("elapsed"))


@R.add("k08_weekday", "SELECT event_id, d + CAST(CASE dayofweek(d) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS INT) + INTERVAL 510 MINUTE AS at_time, CAST(CAST(ts AS DATE) + 7 AS STRING) AS later FROM (SELECT event_id, ts, CAST(ts AS DATE) + 1 AS d FROM events)")
def weekday(t):
    return t.events.select("event_id", Dt.next_weekday(F.col("ts").cast("timestamp"), 8, 30).alias("at_time"), Dt.add_days(F.date_format("ts", "yyyy-MM-dd"), 7).alias("later"))


@R.add("l01_french_numbers", "SELECT p_partkey, p_retailprice AS a, 1000.0::DOUBLE + p_size AS b, 1000000.0::DOUBLE + p_size AS c, CAST(NULL AS DOUBLE) AS d FROM part")
def french_numbers(t):
    price = F.format_number("p_retailprice", 2)
    fr = F.replace(F.replace(price, F.lit(","), F.lit(" ")), F.lit("."), F.lit(","))
    n = F.lpad(s("p_size"), 3, "0")
    return t.parts.select("p_partkey", T.number(fr).alias("a"), T.number(cat("1.", n)).alias("b"), T.number(cat("1,000,", n)).alias("c"), T.number(F.lit("x1")).alias("d"))


@R.add("l03_rent", "SELECT p_partkey, 500.0::DOUBLE + p_size AS amount, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS included, CAST(NULL AS DOUBLE) AS weekly FROM part")
def rent(t):
    end = F.get(F.array(F.lit(" € charges comprises"), F.lit(" € HC"), F.lit(" €")), F.col("p_size") % 3)
    r = T.rent(cat("Loyer ", (F.col("p_size") + 500).cast("string"), end))
    return t.parts.select("p_partkey", r["amount"].alias("amount"), r["charges_included"].alias("included"), T.rent(F.lit("300 € par semaine"))["amount"].alias("weekly"))


@R.add("l05_sizes", "SELECT p_partkey, CASE WHEN p_size >= 5 THEN p_size + 0.5::DOUBLE END AS area, p_size % 6 + 1 AS rooms, 1 AS studio, p_size % 4 AS bedrooms FROM part")
def sizes(t):
    n = s("p_size")
    return t.parts.select("p_partkey", T.area(cat("Surface ", n, ",5 m²")).alias("area"), T.rooms(cat("appartement ", (F.col("p_size") % 6 + 1).cast("string"), " pièces")).alias("rooms"), T.rooms(F.lit("joli studio")).alias("studio"), T.bedrooms(cat((F.col("p_size") % 4).cast("string"), " chambres")).alias("bedrooms"))


@R.add("l13_caps", """
SELECT id, floor(area * 13.09::DOUBLE * 100 + 0.5) / 100 AS fee_cap, price * CASE WHEN furnished = false THEN 1 ELSE 2 END AS deposit_cap, CASE WHEN rooms IS NULL THEN 20.43 WHEN rooms <= 2 THEN 22.74 ELSE 19.73 END::DOUBLE AS reference, charges * 20 > area * 13.09::DOUBLE + greatest(1.0, area * 13.09::DOUBLE * 0.02::DOUBLE) AS over FROM lst""")
def caps(t):
    c = F.col
    return t.lst.select("id", L.tenant_fee_cap(c("area")).alias("fee_cap"), L.deposit_cap(c("price"), c("furnished")).alias("deposit_cap"), L.reference_rent(c("rooms")).alias("reference"), L.over_cap(c("charges") * 20, c("area") * 13.09).alias("over"))


@R.add("l16_travel", "SELECT p_partkey, floor(p_size * 1.3::DOUBLE / 4.5::DOUBLE * 60 + 0.5)::BIGINT AS walk, floor(p_size * 1.3::DOUBLE / 30 * 60 + 0.5)::BIGINT AS car, floor(least(p_size * 1.3::DOUBLE / 4.5::DOUBLE * 60, 25 + p_size * 1.3::DOUBLE / 50 * 60) + 0.5)::BIGINT AS transit, CASE WHEN p_retailprice / 500 >= 3 THEN 0 WHEN p_retailprice / 500 >= 2.5 THEN 6 WHEN p_retailprice / 500 >= 2 THEN 14 ELSE 22 END AS effort FROM part")
def travel(t):
    km = F.col("p_size")
    return t.parts.select("p_partkey", L.travel_minutes(km, "walk").alias("walk"), L.travel_minutes(km, "car").alias("car"), L.travel_minutes(km, "transit").alias("transit"), L.effort_penalty(F.col("p_retailprice"), F.lit(500)).alias("effort"))


@R.add("l15_clamp", "SELECT event_id, CAST(least(greatest(floor(value - 50 + 0.5), 0), 100) AS INT) AS score, replace(CASE WHEN round(value, 1) = floor(round(value, 1)) THEN CAST(CAST(floor(round(value, 1)) AS BIGINT) AS STRING) ELSE printf('%.2f', round(value, 1)) END, '.', ',') AS text FROM events")
def clamp(t):
    return t.events.select("event_id", L.clamp_score(F.col("value") - 50).alias("score"), L.rent_text(F.round("value", 1)).alias("text"))


@R.add("n01_json", """
SELECT id, json_extract_string(payload, '$.id') AS own, json_array_length(payload, '$.imageUrls')::BIGINT AS images, coalesce(json_array_length(payload, '$.none'), 0)::BIGINT AS none, true AS valid, false AS broken, json_extract_string(payload, '$.imageUrls[1]') AS second FROM lst""")
def json(t):
    p = F.col("payload")
    return t.lst.select("id", F.get_json_object(p, "$.id").alias("own"), Js.length_or_zero(p, "$.imageUrls").alias("images"), Js.length_or_zero(p, "$.none").alias("none"), Js.valid(p).alias("valid"), Js.valid(F.substring(p, 1, 9)).alias("broken"), F.get(Js.strings(p, "$.imageUrls"), F.lit(1)).alias("second"))


@R.add("n04_json_remove", "SELECT event_id, CAST(json_extract(props, '$.k') AS STRING) AS k, false AS has_description FROM events")
def json_remove(t):
    with_text = F.concat(F.lit('{"description":"x","scores":"y",'), F.expr("substring(props, 2)"))
    kept = Js.list_payload(with_text)
    return t.events.select("event_id", F.get_json_object(kept, "$.k").alias("k"), F.contains(kept, F.lit("description")).alias("has_description"))


@R.add("n11_field_map", "SELECT p_partkey, p_brand AS value FROM part")
def field_map(t):
    m = F.create_map(F.lit("Etage"), F.lit("3"), F.lit("Marque du bien"), F.col("p_brand"), F.lit("Autre marque"), F.lit(""))
    return t.parts.select("p_partkey", Js.field_matching(m, "(?i)marque").alias("value"))


@R.add("n12_distinct_join", "SELECT group_id, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS sources FROM occ WHERE group_id IS NOT NULL GROUP BY group_id")
def distinct_join(t):
    return t.occ.where("group_id is not null").groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"))


@R.add("n13_strict_greatest", "SELECT id, CASE WHEN price IS NULL OR charges IS NULL THEN NULL ELSE greatest(price, charges) END AS top FROM lst")
def strict(t):
    return t.lst.select("id", L.strict_greatest(F.col("price"), F.col("charges")).alias("top"))


@R.add("a06_json_ld", "SELECT page_id, concat('p', page_id) AS name, CASE WHEN page_id % 2 = 0 THEN 43.5::DOUBLE END AS lat, 2::BIGINT AS nodes FROM pages")
def json_ld(t):
    i = s("page_id")
    doc = F.concat(F.col("html"), F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":["Apartment"],"name":"p'), i, F.lit('","geo":{"latitude":'), F.when(F.col("page_id") % 2 == 0, "43.5").otherwise("0"), F.lit(',"longitude":"7"}}]}</script><script type="application/ld+json">{broken</script>'))
    nodes = S.json_ld(doc)
    rows = t.pages.select("page_id", nodes.alias("nodes"))
    node = S.node_of_type(F.col("nodes"), ["apartment"])
    return rows.select("page_id", F.get_json_object(node, "$.name").alias("name"), S.geo(node)["lat"].alias("lat"), F.size("nodes").cast("long").alias("nodes"))


@R.add("a10_sitemap", "SELECT page_id, url AS newest, 2::BIGINT AS n FROM pages")
def sitemap(t):
    xml = F.concat(F.lit("<urlset><url><loc>old</loc></url><url><loc><![CDATA["), F.col("url"), F.lit("]]></loc><lastmod>2024-01-02</lastmod></url></urlset>"))
    entries = S.sitemap(xml)
    return t.pages.select("page_id", F.get(S.newest_first(entries), F.lit(0)).alias("newest"), F.size(entries).cast("long").alias("n"))


@R.add("a12_announced", "SELECT page_id, (page_id % 50 + 2)::INT AS total, CASE WHEN page_id % 50 + 2 <= 10 THEN 'full' ELSE 'short' END AS coverage FROM pages")
def announced(t):
    n = F.col("page_id") % 50 + 2
    total = S.announced_total(F.concat(F.lit("<h1>"), n.cast("string"), F.lit(" annonces</h1><p>"), n.cast("string"), F.lit(" résultats, 20 annonces par page</p>")))
    return t.pages.select("page_id", total.alias("total"), S.coverage(total, F.lit(10)).alias("coverage"))


@R.add("a14_html_text", "SELECT page_id, concat('Title', chr(10), chr(10), 'é & ', page_id, chr(10), 'end') AS text FROM pages")
def html_text(t):
    doc = F.concat(F.lit("<style>p{}</style><h1>Title</h1><!-- x --><p>&eacute; &amp;  <b>"), s("page_id"), F.lit("</b><br>end</p>"))
    return t.pages.select("page_id", S.to_text(doc).alias("text"))


@R.add("a28_charset", "SELECT doc_id, text AS utf8, 'é' AS latin FROM documents")
def charset(t):
    return t.documents.select("doc_id", S.decode(F.col("text").cast("binary")).alias("utf8"), S.decode(F.unhex(F.lit("E9"))).alias("latin"))


@R.add("a29_robots", r"""
WITH u AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages) SELECT host, path, CASE WHEN path LIKE '/en/%' THEN path LIKE '/en/1%' ELSE true END AS allowed FROM u""")
def robots(t):
    urls = t.pages.select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path")).distinct()
    hosts = urls.select("host").distinct()
    rules = hosts.select("host", F.explode(F.array(F.struct(F.lit("/en/").alias("pattern"), F.lit(False).alias("allow")), F.struct(F.lit("/en/1*").alias("pattern"), F.lit(True).alias("allow")))).alias("r")).select("host", "r.*")
    return S.robots_allowed(urls, rules)


@R.add("a04_drafts", "SELECT p_partkey AS ref, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 <> 0 THEN 'detail' ELSE p_name END AS title, p_size AS area, CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'a' END AS extra FROM part")
def drafts(t):
    k = F.col("p_partkey")
    listed = t.parts.select(k.alias("ref"), F.col("p_name").alias("title"), F.col("p_size").alias("area"), F.create_map(F.lit("x"), F.lit("a")).alias("extra"))
    draft = t.parts.where(k % 2 == 0).select(k.alias("ref"), F.when(k % 4 != 0, "detail").alias("title"), F.create_map(F.lit("x"), F.lit("b")).alias("extra"))
    return S.apply_drafts(listed, draft, ["ref"]).select("ref", "title", "area", F.col("extra")["x"].alias("extra"))
