"""Amounts, terms, addresses, references, payloads, cut words and raw listings on phrases and against plain loops."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import addresses as A
from tallyspark.functions import grammar as G
from tallyspark.functions import json as J
from tallyspark.functions import places as X
from tallyspark.functions import text as T
from tallyspark.operators import cut_words as W
from tallyspark.operators import merge as M
from tallyspark.operators import normalize as Z
from tallyspark.operators import records as R
from tallyspark.operators import views as V
from tallyspark.sources import payloads as P


def given(spark, column, cases):
    """What ``column`` gives for the phrases of ``cases`` against what is right."""
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, phrase string")
    got = {r["i"]: r["v"] for r in rows.select("i", column(F.col("phrase")).alias("v")).collect()}
    assert [(x, got[i]) for i, (x, _) in enumerate(cases)] == list(cases)


def read(rule, *args):
    return lambda x: T.let(G.lex(x), lambda w: T.let(G.amounts(w), lambda a: rule(w, a, *[F.lit(v) for v in args])))


def test_charges(spark):
    given(spark, G.charges, [("700 € + 50 € de charges", 50.0), ("Charges : 82,50 €", 82.5), ("Loyer 700 €", None), ("dont 1 200 € charges", 1200.0), ("charges: 9000", None), ("120 € charges comprises", 120.0), ("", None), (None, None), ("75€ charges", 75.0)])
    given(spark, G.charges_field, [("82 € / Mois", 82.0), ("1 782 €", 1782.0), ("45,5 € par mois", 45.5), ("nc", None), ("Charges : 30 €", 30.0), ("5000 €", None), ("60", 60.0), ("60 et 70", None)])
    given(spark, read(G.charges_in_text, 800.0), [
        ("Loyer 700 €, charges : 45 €", 45.0), ("hors charges : 675 €", None), ("provision sur charges 55,50 € par mois", 55.5), ("700 € dont 30 € de charges", 30.0), ("charges (eau, chauffage) = 90 euros", 90.0), ("charges : 850 €", None), ("charges 45 €", None),
        ("charges : 45", None), ("30 € par mois de charges", 30.0), ("loyer 700 € charges comprises", None)])


def test_deposits_and_fees(spark):
    given(spark, read(G.deposit_in_text, 800.0, 750.0), [
        ("Dépôt de garantie : 1 500 €", 1500.0), ("depot de garantie de 750,50 euros", 750.5), ("Caution 800€", 800.0), ("Caution solidaire demandée", None), ("dépôt de garantie : un mois de loyer", 750.0), ("Dépôt de garantie 2 mois", 1500.0), ("dépôt de garantie : 640.", 640.0),
        ("dépôt de garantie : deux mois charges comprises", None), ("Dépôt de garantie : 9 000 €", None), ("loyer 800 €", None), ("", None), ("Dépôt de garantie (à la signature) : 900 €", 900.0), ("caution 2 mois soit 1 480 €", 1480.0), ("2 mois de loyer pour caution", 1500.0), ("dépôt de garantie : 13 €/m2", None),
        ("Dépôt de garantie : 4 mois de loyer", None), ("dépôt de garantie : 1 mois. Honoraires : 574 €", 750.0)])
    given(spark, lambda x: G.deposit_field(x, F.lit(800.0)), [("1 600 €", 1600.0), ("800", 800.0), ("0 €", None), ("9999 €", None), ("voir agence", None), ("790,25 eur", 790.25)])
    given(spark, lambda x: G.fees_field(x, F.lit(800.0)), [("0 €", 0.0), ("300 € TTC", 300.0), ("2000", None)])
    given(spark, read(G.fees_in_text, 800.0), [
        ("Honoraires : 300 €", 300.0), ("Honoraires à la charge du bailleur : 500 €", None), ("honoraires locataire 250 € honoraires d'état des lieux 60 €", 310.0), ("Honoraires : 300 € dont honoraires d'état des lieux 60 €", 300.0), ("Honoraires : 0 €", 0.0), ("Honoraires : 5000 €", None), ("sans frais", None),
        ("honoraires d'état des lieux 60 €", None), ("Honoraires. Loyer 700 €", None), ("honoraires propriétaire 400 €, honoraires : 200 €", 200.0)])
    given(spark, lambda x: G.max_occupants(G.lex(x)), [("4 personnes", 4), ("2/3 personnes", 3), ("6 couchages", 6), ("idéal pour 3 colocataires", 3), ("2 locataires au total", 2), ("1 locataire par chambre", None), ("90 personnes", None), ("studio", None), ("", None)])


def test_wanted_ads(spark):
    given(spark, lambda x: R.wanted_evidence(x, F.lit(None).cast("string")), [
        ("Couple recherche un petit appartement", "recherche un petit appartement"), ("Notre agence recherche un studio", None), ("la recherche de logement", None), ("Je suis à la recherche d'un studio calme", "recherche d un studio"), ("Flat wanted in June", "flat wanted"), ("I am looking for a room", "for a room"),
        ("If you are looking for a flat", None), ("studio à louer", None), ("", None), (None, None), ("cherche", None), ("nous cherchons colocation", "cherchons colocation")])


def test_long_texts_of_lexemes(spark):
    text = "honoraires : 300 € " + "mot 12,5 m2 " * 40_000 + "dépôt de garantie : 600 €"
    given(spark, read(G.deposit_in_text, 800.0, 750.0), [(text, 600.0)])
    given(spark, read(G.fees_in_text, 800.0), [(text, 300.0)])


def test_streets(spark):
    given(spark, A.street_in_text, [
        ("Bel appartement, 12 rue de la Paix, Nice", "12 rue de la Paix"), ("situé au 5 bis avenue des Lilas. Calme", "5 bis avenue des Lilas"), ("22-24 Boulevard Carnot 06000", "22-24 Boulevard Carnot"), ("3 allée des Mimosas Superbe studio meublé", "3 allée des Mimosas"),
        ("proche de la rue Barla", None), ("disponible 06/2027 Boulevard Pasteur", None), ("", None), (None, None), ("x" * 130 + " 4 rue Verdi", None), ("T2, rue Verdi, calme", "rue Verdi"), ("avenue Foch très bien placé", "avenue Foch"), ("libre janvier 2027 rue Verdi", None), ("rue 12", None)])
    given(spark, lambda x: A.clean_address(x, F.lit("Nice"), F.lit("06000"), F.lit("dès mars 2025 12 rue")), [("12 rue Verdi, 06000 Nice", "12 rue Verdi"), ("12 rue de Nice", "12 rue de Nice"), ("2025 12 rue Verdi", "12 rue Verdi"), ("Nice", "Nice"), (" , ", None), (None, None), ("12 rue Verdi (Nice)", "12 rue Verdi")])


def test_references(spark):
    given(spark, lambda x: F.array_join(T.references(x), ","), [
        ("Réf : AB-1234, et réf. 2024", "ab 1234"), ("référence de l’annonce : x99-12.", "x99 12"), ("ref n°77123 Réf 77123", "77123"), ("préférence A1234", ""), ("Réf", ""), ("", ""), ("réf ABCDE", ""), ("Référence du bien #VT88_1/2 beau", "vt88 1 2"), ("refs: 1234", "")])


def test_portals_photos_keys(spark):
    given(spark, lambda x: X.portal(x, {"portal-a.example": "Portal A", "b.example": "B"}), [("https://www.portal-a.example/x", "Portal A"), ("https://b.example/", "B"), ("https://ab.example/", None), ("no address", None)])
    proxy = r"^https://img\.proxy\.example/ext/(?:_(https?)_/)?([^/]+)/[0-9a-f]{2}/([A-Za-z0-9_-]+)_r"
    kept = "https://img.proxy.example/ext/_https_/media.agency.example/ab/cGhvdG9z_r"
    given(spark, lambda x: X.photo_origin(x, proxy), [("https://img.proxy.example/ext/_https_/media.agency.example/ab/L3Bob3Rvcy8xLmpwZw_r1.jpg", "https://media.agency.example/photos/1.jpg"), (kept, kept), ("https://x.example/1.jpg", "https://x.example/1.jpg")])
    given(spark, lambda x: X.geocode_key(x, F.lit("Nice")), [("12  Rue de la Paix ", "v3 12 rue de la paix nice"), ("", "v3 nice"), ("A", "v3 a nice")])
    given(spark, T.fold, [("Straße", "stra e"), ("été", "ete"), ("a&amp;b", "a b"), ("", "")])
    given(spark, T.multiline, [("a<br>b<BR />c", "a\nb\nc"), ("  a \r\n\r\n\r\n b\rc ", "a\n\nb\nc"), ("x&eacute;&nbsp; y", "xé y"), ("", "")])


# --- raw listings --------------------------------------------------------------------------------------------------------------------------


def test_every_raw_row_is_accepted_or_rejected_once(spark):
    rng = random.Random(3)
    pick = lambda *xs: rng.choice(xs)
    rows = [(pick("a", "b", None), pick("1", " ", None, "x"), pick("https://s/1", "", None, "https://s/vente/2"), pick("Studio", "Maison à vendre", "Cherche studio", None), pick(None, "", "loyer 700 €", "viager"), pick(None, "700 € CC", "50 €/nuit", "90 € la semaine")) for _ in range(300)]
    raw = spark.createDataFrame(rows, "source_id string, source_ref string, source_url string, title string, description string, price_text string")
    accepted, rejected = Z.normalize(raw, F.lit("2026-08-14 12:00:00").cast("timestamp"), ("a",))
    assert accepted.count() + rejected.count() == 300 and rejected.where("size(reasons) = 0").count() == 0
    got = {tuple(r)[:6]: set(r["reasons"]) for r in rejected.collect()}
    for r in rows:
        why = set()
        why |= {"noAddress"} if not r[2] else set()
        why |= {"noReference"} if not (r[1] or "").strip() else set()
        text = f"{r[3]} {r[4]}"
        why |= {"forSale"} if r[2] and "vente" in r[2] or any(w in text for w in ("à vendre", "viager")) and "loyer" not in text else set()
        why |= {"shortPeriod"} if r[5] in ("50 €/nuit", "90 € la semaine") else set()
        why |= {"wanted"} if r[0] == "a" and r[3] == "Cherche studio" else set()
        assert got.get(r, set()) == why, r
    empty, none = Z.normalize(raw.where("false"), F.current_timestamp())
    assert empty.count() == none.count() == 0


def test_one_listing_whole(spark):
    raw = spark.createDataFrame([("s", " 7 ", "https://s/a-louer/7", "T2 meublé Nice", "12 rue Verdi. Charges : 40 €. Dépôt de garantie : un mois. Classe énergie DPE : C. 2 personnes", "700 € HC", "45,5 m2", "Verdi, Nice", "Nice", "04 93 00 00 01", {"reference": "R-1", "flatShare": "false"}, ["http://i/1.jpg", "x"], float("nan"))],
                                "source_id string, source_ref string, source_url string, title string, description string, price_text string, area_text string, address_text string, city_text string, phone_text string, extra map<string,string>, image_urls array<string>, latitude double")
    r = Z.normalize(raw, F.lit("2026-08-14 12:00:00").cast("timestamp"))[0].first()
    want = {"id": "s:7", "price": 700.0, "charges": 40.0, "charges_included": False, "deposit": 700.0, "area": 45.5, "rooms": 2, "furnished": True, "flat_share": False, "dpe": "C", "max_occupants": 2, "address": "12 rue Verdi", "city": "nice", "phone": "+33493000001", "reference": "R-1", "image_urls": ["http://i/1.jpg"], "latitude": None, "property_type": "apartment"}
    assert {k: r[k] for k in want} == want


def test_rederive_keeps_what_is_known(spark):
    now = F.lit("2026-08-14 12:00:00").cast("timestamp")
    raw = spark.createDataFrame([("s", "7", "https://s/7", "Studio", "700 € HC", {"reference": "45700"}, "45 m2"), ("s", "8", "https://s/8", "Studio", "700 € HC", None, None)], "source_id string, source_ref string, source_url string, title string, price_text string, extra map<string,string>, area_text string")
    stored = Z.normalize(raw, now)[0]
    text = "Bail de 9 mois, charges : 40 €, caution 650 €, 3 personnes, réf : ZX-4411. 4 rue Verdi"
    again = Z.rederive(stored.withColumn("description", F.lit(text)).withColumn("charges", F.lit(22.0)), now)
    got = {r["source_ref"]: r for r in again.collect()}
    a = got["7"]
    assert a["charges"] == 22.0 and a["deposit"] == 650.0 and a["max_occupants"] == 3 and a["reference"] == "zx 4411" and a["features"] == ["short lease"] and set(a["changed"]) == {"deposit", "max_occupants", "reference", "features", "address"}
    settled = Z.rederive(again.drop("changed"), now).collect()
    assert all(r["changed"] == [] for r in settled)  # a second pass finds nothing


# --- payloads ------------------------------------------------------------------------------------------------------------------------------


def test_payloads():
    h = lambda v: json.loads(x) if (x := P.hydrate(json.dumps(v))) is not None else None
    assert h([{"a": 1, "b": 2, "c": -1, "d": -2, "e": -3}, "x", [3, -1, -4], 7]) == {"a": "x", "b": [7, None, None], "d": None, "e": None}
    assert h([["Reactive", 1], {"k": 2}, ["Set", 3, 3], 5]) == {"k": [5, 5]}
    assert h([["Map", 1, 2, 3, 2], "name", 9, 4]) == {"name": 9} and h([["null", "k", 1], True]) == {"k": True} and h([["Date", "2026-01-01"]]) == "2026-01-01" and h([["BigInt", 4]]) is None
    assert h([{"self": 0, "x": 1}, [0, 2], "z"]) == {"self": None, "x": [None, "z"]} and h([{"far": 99, "odd": "x", "t": True}]) == {}
    assert P.hydrate(None) is P.hydrate("") is P.hydrate("{") is P.hydrate("{}") is P.hydrate("[]") is None
    deep = [[i + 1] for i in range(20_000)] + ["end"]
    assert P.hydrate(json.dumps(deep)) == "[" * 20_000 + '"end"' + "]" * 20_000
    twice = [[i + 1, i + 1] for i in range(60)] + ["end"]
    assert P.hydrate(json.dumps(twice)) is None and P.hydrate(json.dumps(twice[-5:][:0] + [[i + 1, i + 1] for i in range(4)] + [1])) == json.dumps([[[[1, 1]] * 2] * 2] * 2, separators=(",", ":"))
    assert h([{"__proto__": 1, "a": 1}, 3]) == {"a": 3}


def test_payloads_against_recursion():
    rng = random.Random(5)

    def flatten(v, cells):
        at = len(cells)
        cells.append(None)
        if isinstance(v, dict):
            cells[at] = {k: flatten(x, cells) for k, x in v.items()}
        elif isinstance(v, list):
            cells[at] = [flatten(x, cells) for x in v]
        else:
            cells[at] = v
        return at

    def some(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice([1, 2.5, "é\n", True, None, ""])
        return [some(depth - 1) for _ in range(rng.randrange(4))] if rng.random() < 0.5 else {f"k{i}": some(depth - 1) for i in range(rng.randrange(4))}

    for _ in range(300):
        v, cells = some(6), []
        flatten(v, cells)
        assert json.loads(P.hydrate(json.dumps(cells))) == v


def test_json_members(spark):
    rows = spark.createDataFrame([(1, '{"b":[1,2],"a":"x","n":null,"t":true,"r":1.5}'), (2, '["q",{"z":1}]'), (3, "{broken"), (4, None), (5, "{}"), (6, "7")], "id int, doc string")
    got = sorted(tuple(r) for r in J.entries(rows, "doc").select("id", F.coalesce("key", F.lit("")), F.coalesce("value", F.lit("?")), "type").collect())
    assert got == sorted([(1, "a", "x", "text"), (1, "b", "[1,2]", "array"), (1, "n", "?", "null"), (1, "r", "1.5", "real"), (1, "t", "true", "true"), (2, "", "q", "text"), (2, "", '{"z":1}', "object")])
    given(spark, lambda x: J.with_key(x, "k", F.lit("[1]")), [('{"k":2,"a":1}', '{"a":1,"k":[1]}'), ("[]", None), ("{", None)])
    given(spark, lambda x: J.without_keys(x, "k"), [('{"k":2,"a":[1,"2"]}', '{"a":[1,"2"]}'), ("[1]", None)])
    given(spark, lambda x: F.array_join(J.occurrence_ids(x), ","), [('{"occurrences":[{"id":"a"},{"id":3},{},{"id":"b"}]}', "a,b"), ('{"occurrences":5}', ""), ("{", ""), (None, "")])


def test_listing_json_keeps_types(spark):
    rows = spark.createDataFrame([(1, "x", 2.5, None, '{"city":"p","imageUrls":["a"],"n":3,"own":1}'), (2, "y", 1.0, True, "{broken"), (3, None, None, False, None)], "id long, city string, price double, rented boolean, payload string")
    got = {r["id"]: json.loads(r["json"]) for r in V.as_json(rows, ["id", "city", "price", "rented"], over=["rented"]).collect()}
    assert got[1] == {"id": "1", "city": "p", "price": 2.5, "rented": None, "imageUrls": ["a"], "n": 3, "own": 1} and got[2] == {"id": "2", "city": "y", "price": 1.0, "rented": True} and got[3] == {"id": "3", "city": None, "price": None, "rented": False}


# --- notifications, words ------------------------------------------------------------------------------------------------------------------


def test_redundant_notifications(spark):
    g = ["https://i.example/a/facade-2026-0001.jpg", "https://i.example/a/facade-2026-0002.jpg"]
    rows = [
        ("direct", "a", 5, 700.0, 30.0, "nice", 2, g), ("echo", "a", 9, 700.0, 30.0, "nice", 2, g[::-1] + g), ("relayed", "mail", 1, 700.0, 30.0, "cannes", 2, []), ("known", "mail", 2, 900.0, 40.0, "nice", None, []), ("new", "mail", 3, 901.0, 40.0, "nice", None, []),
        ("hidden", "b", 4, 900.0, 40.0, "nice", None, g), ("other source", "c", 6, 700.0, 30.0, "nice", 2, g), ("one photo", "a", 7, 700.0, 30.0, "nice", 2, g[:1]), ("unnamed", "a", 8, 700.0, 30.0, "nice", 2, ["https://i.example/1.jpg", *g]), ("no figures", "mail", 10, None, None, None, None, []),
    ]
    pending = spark.createDataFrame(rows, "id string, source_id string, ordinal int, price double, area double, city string, rooms int, image_urls array<string>")
    kept, echoes = M.redundant(pending, spark.createDataFrame([("900|40|?",)], "key string"), ("mail",))
    assert {r["id"] for r in kept.collect()} == {"direct", "new", "hidden", "other source", "one photo", "unnamed", "no figures"}
    assert [tuple(r) for r in echoes.collect()] == [("echo", "direct")]


def test_cut_words_equal_a_loop(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words)[: rng.randrange(1, 9)] + rng.choice(["", "...", "…", "..", "."]) for _ in range(rng.randrange(5))) for _ in range(200)] + [None, "", "Élég... été…"]
    vocabulary = words + ["elegant"]
    rows = spark.createDataFrame([(t, 1) for t in texts + texts[:20]], "t string, k int")
    table = spark.createDataFrame(list(enumerate(vocabulary)), "n int, w string")
    got = {r["t"]: r["completed"] for r in W.complete(rows, "t", table, "w", F.col("n")).collect()}
    import re

    fold = lambda s: re.sub("[^a-z0-9]+", " ", s.lower().translate(str.maketrans("é", "e"))).strip()
    for t in texts:
        def full(m):
            stem = fold(m[1])
            return (next((v for v in vocabulary if len(v) > len(stem) and v.startswith(stem)), m[1]) if len(stem) >= 4 else m[1]) + " "
        assert got[t] == fold(re.sub(r"([^\W\d_]+)(?:\.{2,}|…)", full, t or "")), t
    assert W.complete(rows, "t", table, "w", F.col("n")).count() == len(texts) + 20
