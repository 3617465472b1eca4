"""Texts and keys are worked out once for what differs, not for each row or each use."""

from pyspark.sql import functions as F

from tallyspark.operators import aggregates as A
from tallyspark.operators import merge as M
from tallyspark.operators import passes as P


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pending_notifications_are_read_from_a_stage(spark):
    rows = [("a", "s1", 1, 700.0, 30.0, "nice", 2, ["https://i.example/a/facade-2026-0001.jpg", "https://i.example/a/facade-2026-0002.jpg"])]
    pending = spark.createDataFrame(rows + [("b", *rows[0][1:2], 2, *rows[0][3:])], "id string, source_id string, ordinal int, price double, area double, city string, rooms int, image_urls array<string>")
    kept, echoes = M.redundant(pending, spark.createDataFrame([], "key string"), ("mail",))
    assert not any(f in plan(kept) + plan(echoes) for f in ("regexp", "sha2"))
    assert [r["id"] for r in kept.collect()] == ["a"] and [tuple(r) for r in echoes.collect()] == [("b", "a")]


def test_requirements_are_read_once_for_a_text(spark):
    texts = ["Revenus de 3 fois le loyer", "revenus mensuels de 2400 euros, garantie loyers impayés", "Visale acceptée, pas de garant", "bel appartement", None, "fois le loyer"]
    rows = spark.createDataFrame([(g, i, g, t) for i, (g, t) in enumerate([(0, texts[3]), (0, texts[0]), (0, texts[1]), (1, texts[1]), (2, texts[2]), (3, None), (3, texts[3]), (4, texts[5])])], "group_id int, first_seen int, id int, description string")
    found = rows.groupBy("group_id").agg(M.first_requirements(F.col("description")).alias("r"))
    assert plan(found).count("translate(lower(") == 1
    got = {r["group_id"]: r["r"] and tuple(r["r"]) for r in found.collect()}
    assert got == {0: (None, 3, False, []), 1: (2400, None, True, []), 2: (None, None, False, ["visale"]), 3: None, 4: None}


def test_agency_keys_are_worked_out_for_spellings(spark):
    rows = spark.createDataFrame([("Agence A", 1, "s1", 5), ("AGENCE A", 1, "s2", 7), ("Agence A", 2, None, 6), ("Agence A", None, "s1", 1), ("B", None, "s3", 2), (None, 9, "s4", 9)], "agency string, group_id int, source_id string, last_seen int")
    found = A.agencies(rows)
    assert "translate" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {("agencea", "Agence A", 2, "s1,s2", 7), ("b", "B", 0, "s3", 2)}


def test_realigned_rows_go_to_their_aim_once(spark):
    rows = spark.createDataFrame([("x", "s", "1"), ("y", "s", "1"), ("s:2", "t", "9"), ("z", "s", "2"), ("t:9", "t", "9"), (None, "u", "1")], "id string, source_id string, source_ref string")
    found = P.realign(rows)
    assert "Join" not in plan(found)
    assert sorted((str(r["id"]), r["source_ref"]) for r in found.collect()) == [("None", "1"), ("s:1", "1"), ("s:2", "9"), ("t:9", "9"), ("y", "1"), ("z", "2")]
