"""More of the training-data operators: shapes of vectors, pages of other make, draws, chunks and added spans against plain loops."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import ann, html, langid, minhash, mixing, pii, secrets, sharding, tokens


def shapes(n=4096, d=64):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, d))
    return {"unit": x / np.linalg.norm(x, axis=1)[:, None], "normal": x, "norms": x * rng.uniform(0.5, 2, n)[:, None], "clusters": rng.standard_normal((50, d))[rng.integers(0, 50, n)] + 0.5 * rng.standard_normal((n, d))}


@pytest.mark.parametrize("shape", ["unit", "normal", "norms", "clusters"])
def test_default_index_finds_nine_of_ten(shape):
    v = shapes()[shape]
    queries = np.arange(0, len(v), 60)
    found = {}
    for q, i, s in ann.Block(np.arange(len(v)), v, ann.Index()).nearest(queries, v[queries], 20):
        assert s == pytest.approx(float(v[q] @ v[i]))
        found.setdefault(q, set()).add(i)
    hits = 0
    for q in queries.tolist():
        scores = v @ v[q]
        scores[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    assert hits / (20 * len(queries)) >= 0.9


def test_search_over_many_blocks_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], "extra") for i in range(300)] + [(7, [9.0] * 8, "again")]
    u = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"))
    got = {}
    for r in ann.search(u, u.where("vec_id % 20 = 0"), 20, ann.Index(block=64)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 300, 20))
    for q, found in got.items():
        vector = np.array(rows[q][1])
        best = sorted(((-float(np.dot(np.array(v), vector)), i) for i, v, _ in rows if i != q))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and sum(i in {b for _, b in best} for _, i, _ in found) >= 18


@pytest.fixture(scope="module")
def labeller():
    model = html.Labeller()
    model.w = html.train()
    return model


PAGES = [
    ("""<html><body><div class="site-top"><a href="/">Le Journal</a> <a href="/abo">Abonnement</a></div><ul class="rubriques"><li><a href=1>Politique</a><li><a href=2>Culture</a><li><a href=3>Sport</a></ul>
     <div class="billet"><h1>La gare rouvre ses portes</h1><p>Après trois ans de travaux, la gare centrale accueille de nouveau les voyageurs.</p><p>Le maire a salué un chantier <em>exemplaire</em>, malgré les retards.</p></div>
     <div class="commentaires"><p>Super article, merci !</p></div><footer><p>Mentions légales</p></footer></body></html>""",
     "La gare rouvre ses portes Après trois ans de travaux, la gare centrale accueille de nouveau les voyageurs. Le maire a salué un chantier exemplaire, malgré les retards."),
    ("<body><table><tr><td><a href=/a>Home</a></td><td><a href=/b>Products</a></td></tr></table><main><b><i><u><em><strong><small><sub><sup><span>Opening words stay open.<p>Second paragraph of the story goes on for a while.</p></main><form action=/s><label>Search</label><input></form></body>",
     "Opening words stay open. Second paragraph of the story goes on for a while."),
    ("""<html><head><title>x</title></head><body><header><nav><a href=/>Start</a> <a href=/x>Blog</a></nav></header><div id="wrap"><div class="post-body"><h2>Notes on baking</h2><p>Flour, water and salt are all you need.</p><ul><li>Mix for ten minutes.</li><li>Let it rest over night.</li></ul><p>Then bake it hot.</p></div></div>
     <div class="legal">Copyright 2020 Baker</div></body></html>""",
     "Notes on baking Flour, water and salt are all you need. Mix for ten minutes. Let it rest over night. Then bake it hot."),
]


@pytest.mark.parametrize("page", range(len(PAGES)))
def test_pages_of_other_make(labeller, page):
    source, want = PAGES[page]
    found = html.blocks(source)
    keep = html.label(labeller, [found])[0]
    assert " ".join(b.text for b, ok in zip(found, keep, strict=True) if ok) == want


def test_broken_markup():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts("<p>one<div/>two</div><p>three") == ["one", "two", "three"]
    assert texts('<p>before</p><a href="x>after</a> rest') == ["before", "after rest"]
    assert texts("<b>" * 5000 + "deep" + "</i>" * 5000 + "<p>next") == ["deep", "next"]
    many = html.blocks(f'<div class="{" ".join("abcdefghij"[i] * 3 for i in range(10))} zz yy xx ww">text</div>')[0].path
    assert len([m for m in many if m.startswith("class.")]) == 14


def test_extract_edge_rows(spark):
    schema = "page_id long, url string, html string, text string"
    weights = html.Labeller().w
    assert html.extract(spark.createDataFrame([], schema), weights).collect() == []
    rows = html.extract(spark.createDataFrame([(1, "u", "<p>a", "x"), (1, "u", "<p>a", "x"), (None, None, None, None)], schema), weights).collect()
    assert len(rows) == 3 and rows[0] == rows[1] and rows[2]["n_chars"] == 0


@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\t\r,.aZé1'-…日😀 \u0085")), max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_the_tokenizer(texts):
    encoder = tokens.Encoder(tokens.default_vocabulary(), keep=20)
    ids, lengths = encoder.encode(texts)
    ends = np.cumsum(lengths)
    for t, a, b in zip(texts, ends - lengths, ends, strict=True):
        assert ids[a:b].tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, tokens.END]


def test_draws_meet_quotas_in_any_task():
    quotas, slots = [1000, 37, 0, 5], 64
    whole = list(mixing.draw(quotas, slots, 3))
    assert whole == [r for lo in range(0, 17, 5) for r in mixing.draw(quotas, slots, 3, lo, lo + 5)]
    given = Counter()
    for shard, source, first, n in whole:
        assert first == given[source] and n > 0
        given[source] += n
    assert [given[i] for i in range(4)] == quotas
    sizes = Counter()
    for shard, _, _, n in whole:
        sizes[shard] += n
    assert [sizes[s] for s in range(17)] == [64] * 16 + [sum(quotas) - 16 * 64]


def test_draws_are_hypergeometric():
    got = [next(n for s, i, _, n in mixing.draw([300, 700], 100, seed) if s == 0 and i == 0) for seed in range(400)]
    assert np.mean(got) == pytest.approx(30, abs=0.7) and np.std(got) == pytest.approx((100 * 0.3 * 0.7 * 900 / 999) ** 0.5, rel=0.15)
    huge = list(mixing.draw([4 * 10**9, 10**9], 10**9, 1))
    assert sum(n for _, i, _, n in huge if i == 0) == 4 * 10**9 and all(0.79e9 < n < 0.81e9 for _, i, _, n in huge if i == 0)


def test_mixing_equals_a_plain_packing(spark):
    rng = random.Random(6)
    rows = [(i if i % 9 else None, rng.choice(["a", "b", None]), " ".join("w" for _ in range(rng.choice([0, 1, 5, 90, 300])))) for i in range(60)]
    plan = mixing.Plan(block=16, slots=50)
    placed, slots, pieces = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), plan)
    out = mixing.taken(placed, slots, pieces).collect()
    used = Counter((r["source_no"], r["block"]) for r in slots.collect())
    assert max(used.values()) <= plan.repeats
    for r in out:
        words = range(r["offset"], r["offset"] + r["size"])
        assert r["taken"] == sum(used[r["source_no"], w // plan.block] for w in words) and r["taken"] <= 3 * r["size"]
    for no in {r["source_no"] for r in out}:
        mine = [r for r in out if r["source_no"] == no]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2 * plan.block * plan.repeats
        spans = sorted((r["offset"], r["size"]) for r in mine if r["size"])
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(spans)) and (not spans or spans[0][0] == 0)


def test_chunks_find_what_all_pairs_find():
    rng = random.Random(5)
    base = [set(rng.sample(range(10**6), 60)) for _ in range(3)]
    sets = []
    for i in range(70):
        s = set(rng.choice(base))
        for x in rng.sample(sorted(s), rng.randint(0, 8)):
            s.remove(x)
            s.add(rng.randrange(10**6, 2 * 10**6))
        sets.append(s)
    rows = [(i, i // 2, np.array(sorted(s), np.int64)) for i, s in enumerate(sets)]

    def parts(edges):
        root = list(range(len(rows)))
        for a, b in [*edges, *((i, i ^ 1) for i in range(len(rows)))]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        return root

    want = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    chunks = [rows[:25], rows[25:50], rows[50:]]
    got = [e for i, a in enumerate(chunks) for j, b in enumerate(chunks[i:], i) for e in minhash._joined(a, b if j > i else [], 0.8)]
    assert parts(got) == parts(want) and all((min(e), max(e)) in set(want) for e in got) and len(got) < len(rows) * 3


def test_large_buckets_are_dealt(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        t = list(words)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(minhash, "CHUNK", 7)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == one


def test_added_spans_are_judged(spark):
    texts = [f"mail me at user{i}@mail.example.com or call +1 (555) 010-{1000 + i}" for i in range(40)] + [f"order 10{i}-555-0199 invoice release page {i}" for i in range(10)]
    texts += ["contact joe (at) site (dot) com for mail", "please call phone 212-555-0199 mobile"]
    got = {r["doc_id"]: r["spans"] for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[50] == "email:8:31" and got[51] == "phone:18:30" and all(not got[i] for i in range(40, 50))


def test_added_spans_give_way_to_base_spans(spark):
    rows = [(1, "email", True, 0, 10, True), (1, "email", False, 5, 15, False), (1, "email", False, 10, 20, False), (1, "phone", False, 0, 10, False), (1, "email", False, 40, 50, False), (1, "email", True, 45, 60, True), (2, "email", False, 0, 10, False)]
    df = spark.createDataFrame(rows, "row long, kind string, base boolean, start long, end long, valid boolean")
    assert sorted((r["row"], r["kind"], r["start"]) for r in pii._apart(df).collect()) == [(1, "email", 0), (1, "email", 10), (1, "email", 45), (1, "phone", 0), (2, "email", 0)]


def test_random_keys_are_found_whatever_stands_before():
    rng = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rule = secrets.EntropyRule()
    for before in ("", "/", "key ", "https://hooks.example.com/services/", "1.5."):
        keys = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(200)]
        found = sum(any(k == "entropy" for _, _, k in secrets.spans_of(f"x {before}{key} y", rule)) for key in keys)
        assert found >= 190, before
    assert not secrets.spans_of("see v1.5.2-rc1.build20240916.snapshot and https://docs.example.com/guides/getting-started/index.html", rule)


def test_many_runs_beside_many_base_spans():
    text = " ".join(f"token=abcdef{i} {'q1W2e3R4t5Y6u7I8o9P0'}{i}" for i in range(3000))
    spans = secrets.spans_of(text, secrets.EntropyRule())
    assert sum(k == "assign" for _, _, k in spans) == 3000 and all(re.match("token|q1W2", text[s:e]) for s, e, _ in spans)


def test_languages_with_scripts_of_their_own():
    texts = {"ru": "съешь же ещё этих мягких французских булок да выпей чаю " * 20, "el": "ξεσκεπάζω την ψυχοφθόρα βδελυγμία με μεγάλη χαρά σήμερα " * 20, "en": "the quick brown fox jumps over the lazy dog again and again " * 20, "ja": "いろはにほへとちりぬるを わかよたれそつねならむ " * 20}
    parser = langid.CrossParser({k: langid.normalise(t) for k, t in texts.items()}, 250)
    for k, t in texts.items():
        assert parser.predict([t[10:60]])[0][0] == k
    assert parser.predict(["한국어 문장입니다"])[0][2] > 8


def test_shards_cut_fewer_links_than_hashes(spark):
    rng = random.Random(2)
    rows = [(i, f"text {rng.randrange(60)}") for i in range(300)] + [(1000 + i, "hot") for i in range(150)] + [(2000 + i, f"own {i}") for i in range(900)] + [(None, None), (None, "text 1")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    groups = {}
    for r in got:
        groups.setdefault((r["text_crc32"], r["size"]), []).append(r["shard"])
    pairs = sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
    kept = sum(n * (n - 1) // 2 for g in groups.values() for n in Counter(g).values())
    assert len(got) == len(rows) and kept / pairs > 0.5  # chance keeps an eighth
