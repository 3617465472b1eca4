"""Operators against plain loops, and the parts that the driver's tables don't reach: high latitudes, odd signs, every signal of a pair."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.rows import latest
from tallyspark.operators import aggregates as A
from tallyspark.operators import crawl as K
from tallyspark.operators import dedupe as D
from tallyspark.operators import joins as J
from tallyspark.operators import passes as P
from tallyspark.operators import views as V
from tallyspark.sources import pages as Pg
from tallyspark.sources import tables as T
from tallyspark.streaming import jobs
from tallyspark.session import clear_stages, shared_dir, stage, unstage


def km_between(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize(("lat", "lon", "spread"), [(0.0, 0.0, 0.02), (69.6, 18.9, 0.05), (78.2, 15.6, 0.1), (-17.0, 179.999, 0.02), (89.995, 0.0, 180.0), (-89.9, 170.0, 20.0)])
def test_near_finds_all_pairs_anywhere(spark, lat, lon, spread):
    rng = random.Random(4)
    points = [(i, min(90.0, max(-90.0, lat + rng.uniform(-0.01, 0.01))), (lon + rng.uniform(-spread, spread) + 180) % 360 - 180) for i in range(120)]
    left = spark.createDataFrame(points, "id long, lat double, lon double")
    right = spark.createDataFrame(points, "id2 long, lat2 double, lon2 double")
    got = [(r["id"], r["id2"]) for r in J.near(left, right, 0.5).collect()]
    want = {(a[0], b[0]) for a, b in itertools.product(points, points) if km_between(a[1:], b[1:]) <= 0.5}
    assert len(got) == len(set(got)) and set(got) == want


BASE = {"source_id": "a", "source_ref": "r1", "url": "https://a.example/1", "phone": None, "email": None, "price": 800.0, "area": 30.0, "rooms": 2, "city": "nice", "postal_code": "06000", "lat": None, "lon": None, "agency": None, "reference": None, "title": None, "description": None, "address": None, "district": None, "image_urls": None}
KINDS = {"price": "double", "area": "double", "rooms": "int", "lat": "double", "lon": "double", "image_urls": "array<string>"}
LONG = "un logement calme et clair pres du port avec balcon et vue degagee sur la colline, refait a neuf et bien place pour les transports du quartier"


def occurrences(spark, *rows):
    names = list(BASE)
    full = [[f"{i}", *[{**BASE, "source_ref": f"r{i}", "url": f"https://{i}.example/{i}", **r}[n] for n in names]] for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "id string, " + ", ".join(f"{n} {KINDS.get(n, 'string')}" for n in names))


def verdict(spark, a, b, **options):
    rows = D.prepared(occurrences(spark, a, b), **options)
    return D.verdicts(rows.sparkSession.createDataFrame([("0", "1")], "a string, b string"), rows).first()


OTHER = {"source_id": "b"}


def test_signals_of_pairs(spark):
    figures = 18 + 18 + 6 + 4
    cases = [
        ({}, OTHER, figures, "ambiguous"),
        ({"phone": "1"}, {**OTHER, "phone": "1"}, figures + 40, "duplicate"),
        ({"phone": "1"}, {"phone": "1"}, figures, "ambiguous"),  # one source's own number tells nothing
        ({"reference": "A-77"}, {**OTHER, "description": "Référence de l’annonce : A-77"}, figures, "ambiguous"),  # too short to tell in a text
        ({"reference": "AB-7712"}, {**OTHER, "description": "Référence de l'annonce : ab-7712."}, figures + 35, "duplicate"),
        ({"address": "12 rue Barla"}, {**OTHER, "address": "12, rue Barla"}, figures + 30, "duplicate"),
        ({"address": "rue Barla"}, {"address": "rue Barla"}, figures + 10, "ambiguous"),  # within one source a street is no address
        ({"address": "12 rue Barla"}, {**OTHER, "address": "14 rue Barla"}, figures, "ambiguous"),
        ({"district": "Gambetta"}, {**OTHER, "title": "Studio Gambetta"}, figures + 8, "ambiguous"),
        ({"agency": "Agence Été"}, {**OTHER, "agency": "agence ete"}, figures + 12, "ambiguous"),
        ({"agency": "A"}, {"agency": "A"}, figures, "ambiguous"),
        ({"title": "NICE - STUDIO 21m2 - PROMENADE DES ANGLAIS"}, {**OTHER, "title": "Nice studio 21m2 promenade des anglais"}, figures + 30, "duplicate"),
        ({"title": "Nice vide 38m2 saint roch marceau ..."}, {**OTHER, "title": "Nice vide 38m2 saint roch marceau terrasse cave"}, figures + 30, "duplicate"),
        ({"area": 22.81}, {**OTHER, "area": 22.81}, figures + 30, "duplicate"),
        ({"area": 22.81, "description": LONG}, {**OTHER, "area": 22.81, "description": LONG[::-1]}, figures + 30, "ambiguous"),  # figures alone between two texts
        ({"image_urls": ["https://x.example/photo-20260916-1.jpg?t=1"]}, {**OTHER, "image_urls": ["https://x.example/photo-20260916-1.jpg?t=2"], "price": 1200.0}, 70 + 18 + 6 + 4, "duplicate"),  # a photo proves the pair, whatever the rent
        ({}, {**OTHER, "price": 1200.0}, 0, "distinct"), ({}, {**OTHER, "rooms": 3}, 0, "distinct"), ({}, {**OTHER, "city": "paris"}, 0, "distinct"), ({}, {"price": 801.0}, 0, "distinct"),
        ({"lat": 43.7, "lon": 7.2}, {**OTHER, "lat": 43.7001, "lon": 7.2001}, figures + 30, "duplicate"), ({"lat": 43.7, "lon": 7.2}, {**OTHER, "lat": 43.71, "lon": 7.2}, 0, "distinct"),
    ]
    rows = D.prepared(occurrences(spark, *[x for a, b, _, _ in cases for x in (a, b)]))  # all pairs at once: each has a page and a number of its own
    pairs = spark.createDataFrame([(str(2 * i), str(2 * i + 1)) for i in range(len(cases))], "a string, b string")
    got = {int(r["a"]) // 2: r for r in D.verdicts(pairs, rows).collect()}
    for i, (a, b, strength, word) in enumerate(cases):
        assert (got[i]["strength"], got[i]["verdict"]) == (strength, word), (a, b, got[i])


def test_areas_written_with_fewer_decimals(spark):
    rows = spark.createDataFrame([(22.0, 22.81), (23.0, 22.81), (26.2, 26.15), (26.1, 26.15), (22.0, 23.0), (22.81, 22.82), (20.0, 20.0)], "a double, b double")
    assert [r[0] for r in rows.select(D.same_area(F.col("a"), F.col("b"))).collect()] == [True, True, True, True, False, False, True]


def test_relayed_agencies_and_rivals(spark):
    agencies = spark.createDataFrame([("Alliance", "b")], "agency string, source_id string")
    r = verdict(spark, {"agency": "Alliance"}, OTHER, agencies=agencies)
    assert r["strength"] == 46 + 30 and r["verdict"] == "duplicate" and r["relayed"]
    links = spark.createDataFrame([("x", "y", True), ("x", "z", True), ("u", "v", True), ("y", "w", False)], "a string, b string, relayed boolean")
    assert {(r["a"], r["b"]) for r in D.uncontested(links).collect()} == {("u", "v"), ("y", "w")}


def test_catalogue_photos_and_generic_pages(spark):
    stock = ["https://x.example/facade-2026-0001.jpg"]
    rows = occurrences(spark, *[{"image_urls": stock, "price": 700.0 + 100 * i, "url": "https://x.example/home"} for i in range(4)], {**OTHER, "image_urls": stock, "price": 700.0, "url": "https://x.example/home"})
    got = {r["id"]: r for r in D.prepared(rows).collect()}
    assert all(set(r["catalog"]) == {"x.example/facade-2026-0001.jpg", "facade-2026-0001"} and r["generic"] for r in got.values())
    pair = D.verdicts(spark.createDataFrame([("0", "4")], "a string, b string"), D.prepared(rows)).first()
    assert pair["signals"]["image"] == 8 and pair["signals"]["url"] == 0


def test_dedupe_equals_a_plain_union(spark):
    rng = random.Random(8)
    rows = [{"source_id": rng.choice("abc"), "phone": rng.choice([None, "1", "2", "3"]), "price": float(rng.choice([700, 720, 800])), "area": rng.choice([22.81, 30.0, 31.0]), "rooms": rng.choice([1, 2, None]), "agency": rng.choice([None, "A", "B"])} for _ in range(40)]
    table = occurrences(spark, *rows)
    ready = D.prepared(table)
    pairs = spark.createDataFrame([(str(a), str(b)) if str(a) < str(b) else (str(b), str(a)) for a, b in itertools.combinations(range(40), 2)], "a string, b string")
    seen = {(r["a"], r["b"]): r for r in D.verdicts(pairs, ready).collect()}
    bucketed = {(r["a"], r["b"]) for r in D.candidate_pairs(ready).collect()}
    root = {str(i): {str(i)} for i in range(40)}
    clash = {k for k, r in seen.items() if r["conflict"]}
    for (a, b), r in sorted(seen.items(), key=lambda x: (-x[1]["strength"], x[0])):
        if r["verdict"] == "duplicate" and (a, b) in bucketed and root[a] is not root[b] and not any(tuple(sorted((x, y))) in clash for x in root[a] for y in root[b]):
            both = root[a] | root[b]
            for x in both:
                root[x] = both
    assert {r["id"]: r["grp"] for r in D.dedupe(table).collect()} == {i: min(g) for i, g in root.items()}


def test_survival_by_hours_and_shares(spark):
    rng = random.Random(3)
    lives = [(rng.choice("xy"), round(rng.uniform(0, 3), 2), rng.random() < 0.6) for _ in range(300)] + [("z", 1.0, True)]
    curve = A.survival(spark.createDataFrame(lives, "k string, days double, ended boolean"), keys=("k",))
    got = {(r["k"], r["day"]): (r["at_risk"], r["deaths"], round(r["share"], 9)) for r in curve.collect()}
    want = {}
    for k in "xyz":
        share = 1.0
        for day in sorted({d for key, d, e in lives if key == k and e}):
            risk = sum(key == k and d >= day for key, d, _ in lives)
            deaths = sum(key == k and d == day and e for key, d, e in lives)
            share *= 1 - deaths / risk
            want[k, day] = (risk, deaths, round(share, 9))
    assert got == want
    asked = spark.createDataFrame([("z", 0.5), ("z", 1.0), ("z", 1.5), ("none", 1.0)], "k string, t double")
    assert {(r["k"], r["t"]): r["share"] for r in A.share_alive(curve, asked, ("k",)).collect()} == {("z", 0.5): 1.0, ("z", 1.0): 0.0, ("z", 1.5): None, ("none", 1.0): None}


def test_withdrawn_pages_take_their_relays_along(spark):
    rows = spark.createDataFrame([("p", "1", 0, "active"), ("mail", "p:1", 5, "active"), ("mail", "p:2", 0, "active"), ("p", "3", 1, "inactive")], "source_id string, source_ref string, missing_runs int, lifecycle string")
    gone = spark.createDataFrame([("p", "1"), ("p", "3")], "source_id string, source_ref string")
    got = {(r["source_id"], r["source_ref"]): (r["missing_runs"], r["lifecycle"]) for r in P.mark_withdrawn(rows, gone, 3, ("p", "mail")).collect()}
    assert got == {("p", "1"): (3, "inactive"), ("mail", "p:1"): (5, "inactive"), ("mail", "p:2"): (0, "active"), ("p", "3"): (1, "inactive")}


def test_registry_refuses_two_descriptions(spark):
    with pytest.raises(ValueError):
        P.registry(spark.createDataFrame([("a", 1), ("a", 2)], "source_id string, x int"))


def test_selections(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["a", "c"])], "id int, sources array<string>")
    ids = lambda s: {r["id"] for r in V.shown(rows, s).collect()}
    assert ids(V.Selection()) == {1, 2, 3} and ids(V.Selection("only")) == set() and ids(V.Selection("except", frozenset("a"))) == {2, 3} and ids(V.Selection("only", frozenset("a")).with_sources(("b",), True)) == {1, 2, 3}


def test_stages_can_be_removed(spark):
    import os

    df = stage(spark, spark.range(3), "x")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and df.count() == 3
    unstage(spark, df)
    assert not os.path.exists(path)
    other = stage(spark.newSession(), spark.range(3), "y")  # another session of the same application
    own = os.path.dirname(os.path.dirname(other.inputFiles()[0].removeprefix("file://")))
    assert own.startswith(shared_dir(spark).removeprefix("file://")) and os.path.exists(own)
    clear_stages(spark)
    assert not os.path.exists(own)


def test_grouping_repaired_by_changes_equals_a_whole_one(spark):
    rng = random.Random(11)
    photo = lambda: [f"https://x.example/photo-2026{rng.randrange(12):08d}.jpg"]
    def some():
        return {"source_id": rng.choice("abc"), "phone": rng.choice([None, "1", "2", "3", "4"]), "price": float(rng.choice([700, 720, 800])), "area": rng.choice([22.81, 30.0, 31.0]), "rooms": rng.choice([1, 2, None]), "agency": rng.choice([None, "A", "B"]), "image_urls": rng.choice([None, photo()])}

    now = [some() for _ in range(50)]
    table = occurrences(spark, *now)
    state = D.grouping(table)
    for _ in range(2):
        for i in rng.sample(range(len(now)), 6):
            now[i] = some()
        now += [some() for _ in range(4)]
        gone = set(rng.sample(range(len(now)), 8))
        table = occurrences(spark, *now).where(~F.col("id").isin(*map(str, gone)))
        state = D.grouping(table, before=state)
        got = {r["id"]: r["grp"] for r in D.of_groups(table, state).collect()}
        assert got == {r["id"]: r["grp"] for r in D.dedupe(table).collect()}
    same = D.grouping(table, before=state)
    assert {tuple(r) for r in same.links.collect()} == {tuple(r) for r in state.links.collect()} and {tuple(r) for r in same.groups.collect()} == {tuple(r) for r in state.groups.collect()}


def test_one_row_of_several(spark):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 5, "c"), (1, 4, "z"), (2, None, None), (None, 1, "n")], "k int, at int, v string")
    for shape in (rows, rows.repartition(3, "v"), rows.orderBy(F.desc("v"))):
        assert {tuple(r) for r in latest(shape, ["k"], ["at"]).collect()} == {(1, 5, "c"), (2, None, None), (None, 1, "n")}
    held = rows.withColumn("m", F.create_map(F.lit("a"), F.col("at")))
    assert {(r["k"], r["v"], r["m"]["a"]) for r in latest(held, ["k"], ["at"]).where("k = 1").collect()} == {(1, "c", 5)}


def test_realigned_ids_stay_different(spark):
    rows = spark.createDataFrame([("x", "s", "1"), ("y", "s", "1"), ("s:2", "t", "9"), ("z", "s", "2"), ("q", "s", "3")], "id string, source_id string, source_ref string")
    assert {(r["id"], r["source_ref"]) for r in P.realign(rows).collect()} == {("s:1", "1"), ("y", "1"), ("t:9", "9"), ("z", "2"), ("s:3", "3")}


def test_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "t")
    apply = jobs.upsert_into(path, ["key"], lambda old, new: T.put(old, new, "key"), ["at"])
    for n in range(4):
        apply(spark.createDataFrame([(1, n, "a"), (1, n + 5, "b"), (n, 0, "c")], "key long, at int, value string"), n)
    before = {tuple(r) for r in jobs.read_keyed(spark, path).collect()}
    gone = jobs.vacuum(spark, path, 2)
    assert gone and {tuple(r) for r in jobs.read_keyed(spark, path).collect()} == before and (1, 8, "b") in before
    assert jobs.vacuum(spark, path, 2) == [] and jobs.vacuum(spark, str(tmp_path / "none")) == []


def test_outcome_lattice(spark):
    pages = spark.createDataFrame([("a", "l", 1, "read", False, 3), ("b", "l", 1, "unchanged", False, None), ("c", "l", 1, "read", True, None), ("d", "l", 1, "failed", False, None), ("e", "l", 1, "read", False, None), ("e", "m", 2, "blocked", False, None), ("e", "m", 3, "rateLimited", False, None), ("f", "l", 1, "read", False, None), ("f", "m", 2, "failed", False, None)], "source_id string, list_url string, ordinal int, status string, says_empty boolean, announced int")
    stubs = spark.createDataFrame([("a", "1", 1), ("a", "2", 1), ("e", "1", 1), ("e", "2", 3), ("f", "1", 1), ("f", "2", 1)], "source_id string, source_ref string, ordinal int")
    got = K.outcomes(pages, stubs)
    assert {r["source_id"]: (r["stop_reason"], r["collected"], r["complete"]) for r in got.collect()} == {"a": ("completed", 2, False), "b": ("notModified", 0, False), "c": ("empty", 0, False), "d": ("tooManyErrors", 0, False), "e": ("blocked", 1, False), "f": ("completed", 2, False)}
    details = spark.createDataFrame([("a", "1", True, None), ("f", "1", True, "5 €"), ("f", "2", False, None)], "source_id string, source_ref string, gone boolean, price_text string")
    assert {(r["source_id"], r["source_ref"]): r["fate"] for r in K.references(got, stubs, details, stubs).collect()} == {("a", "1"): "withdrawn", ("a", "2"): "confirmed", ("f", "1"): "rendered", ("f", "2"): "confirmed"}


def test_labels_of_a_page(spark):
    page = "<ul><li>Prix : 1 : 2</li><li>rien</li></ul><DL><dt>A</dt><dt>B:</dt><dd>x<br>y</dd></DL><table><tr><th>C</th><td>1</td><td>2</td></tr></table><!-- <dt>q</dt><dd>q</dd> -->"
    got = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(Pg.labelled(F.col("h")).alias("p")).collect()
    assert [tuple(x) for x in got[0]["p"]] == [("Prix", "1 : 2"), ("B", "x y"), ("C", "1")] and not got[1]["p"] and not got[2]["p"]
