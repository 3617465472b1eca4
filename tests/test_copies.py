"""Copies of one value: what a pair costs is paid for different values, and a value's rows are dealt into pieces."""

import itertools

from tallyspark.operators import joins as J


def aggregated(df):
    """Whether both sides of the join with the exact condition are distinct values."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Join Inner" in line and ("ASIN" in line or "abs(" in line))
    return sum("Aggregate" in line for line in lines[at:]) >= 2


def test_near_measures_places_once(spark, monkeypatch):
    monkeypatch.setattr(J, "PIECE", 3)
    rows = [(i, 43.6 + i % 4 / 250, 7.1) for i in range(40)]
    left, right = spark.createDataFrame(rows, "id long, lat double, lon double"), spark.createDataFrame(rows, "id2 long, lat2 double, lon2 double")
    found = J.near(left, right, 0.5)
    assert aggregated(found)
    got = [(r["id"], r["id2"]) for r in found.collect()]
    assert sorted(got) == [(a, b) for a, b in itertools.product(range(40), repeat=2) if abs(a % 4 - b % 4) <= 1]


def test_in_range_compares_numbers_once(spark, monkeypatch):
    monkeypatch.setattr(J, "PIECE", 3)
    rows = [(i, i % 2, 700.0 + 40 * (i % 3)) for i in range(40)]
    left, right = spark.createDataFrame(rows, "id long, k int, x double"), spark.createDataFrame(rows, "id2 long, k int, y double")
    found = J.in_range(left, right, "x", "y", 30, 0.06, ["k"])
    assert aggregated(found)
    want = [(a[0], b[0]) for a, b in itertools.product(rows, rows) if a[1] == b[1] and abs(a[2] - b[2]) <= max(30, 0.06 * max(a[2], b[2]))]
    assert sorted((r["id"], r["id2"]) for r in found.collect()) == sorted(want)
