"""References are dealt into parts of a given number and meet in one exchange, whatever their tables' sizes."""

from tallyspark.operators import crawl as K


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tables(spark):
    pages = spark.createDataFrame([("a", "l1", 1, "read", False, 2), ("a", "l2", 2, "failed", False, None), ("b", "l1", 1, "read", False, None), ("b", "l1", 5, "blocked", False, None), ("b", "l2", 6, "read", False, 9), ("c", None, 1, "read", True, None), (None, "l1", 1, "read", False, None)], "source_id string, list_url string, ordinal int, status string, says_empty boolean, announced int")
    stubs = spark.createDataFrame([("a", "1", 1), ("a", "1", 2), ("a", "2", 2), ("a", None, 2), ("b", "1", 6), ("b", "1", 4), ("b", "2", 6), (None, "1", 1)], "source_id string, source_ref string, ordinal int")
    return pages, stubs


def test_outcomes_deal_references(spark):
    found = K.outcomes(*tables(spark))
    assert "RepartitionByExpression [source_id#" in plan(found) and f", {K.PARTS}" in plan(found)
    got = {r["source_id"]: tuple(r)[1:] for r in found.collect()}
    assert got == {"a": ("completed", 1, 2, 2, False, True), "b": ("blocked", 1, 1, None, False, False), "c": ("notModified", 1, 0, None, False, False)}


def test_references_meet_in_one_exchange(spark):
    pages, stubs = tables(spark)
    details = spark.createDataFrame([("a", "1", True, None), ("a", "2", False, "700"), ("a", None, True, "1")], "source_id string, source_ref string, gone boolean, price_text string")
    verdicts = spark.createDataFrame([("a", "completed", False)], "source_id string, stop_reason string, partial boolean")
    found = K.references(verdicts, stubs, details, stubs)
    assert plan(found).count("Join") == 1 and f", {K.PARTS}" in plan(found)
    assert {(r["source_ref"], r["fate"]) for r in found.collect()} == {("1", "withdrawn"), ("2", "rendered"), (None, "skipped")}
