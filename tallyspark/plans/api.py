"""The engine's facade: what a client may ask, as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import aggregates as A
from tallyspark.operators import filters as P
from tallyspark.operators import joins as J

READ_ONLY = re.compile(r"^\s*(?:select|with)\s", re.I)
#: Strings, quoted names and comments, in which nothing is a statement's end.
QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
#: What a WITH may lead to besides a SELECT.
WRITES = re.compile(r"\b(?:insert|update|delete|merge|drop|alter|create|truncate|replace\s+table)\b", re.I)


def read_only_sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """One SELECT, also behind WITH, over given tables; anything else is refused."""
    bare = QUOTED.sub(" ", text).strip().removesuffix(";")
    if not READ_ONLY.match(bare) or ";" in bare or (bare[:4].lower() == "with" and WRITES.search(bare)):
        raise ValueError("only one SELECT statement is allowed")
    return spark.sql(text.strip().removesuffix(";"), **tables)


class Engine:
    """Reads over occurrences, listings, state, scores, runs and history."""

    def __init__(self, occurrences: DataFrame, listings: DataFrame, state: DataFrame, scores: DataFrame, runs: DataFrame, history: DataFrame):
        self.occurrences, self.all_listings, self.state, self.scores, self.runs, self.history = occurrences, listings, state, scores, runs, history

    def listings(self, user: str | None = None, traits: P.Traits | None = None, sort: str = "recent", limit: int = 30, offset: int = 0) -> DataFrame:
        """A page of listings; without a user there are no priorities, so such sorts fall back to the newest."""
        rows = self.all_listings.where(P.available() & P.traits(traits or P.Traits()))
        if user is None:
            return P.page(rows, "recent" if sort in ("priority", "closest") else sort, limit, offset)
        return P.page(J.overlay(rows, self.state, self.scores, user), sort, limit, offset)

    def listing_ids(self, traits: P.Traits | None = None, limit: int = 500) -> DataFrame:
        """A page of ids, 500 unless said otherwise."""
        return self.listings(None, traits, limit=limit).select("id")

    def listing(self, listing_id: int) -> DataFrame:
        return self.all_listings.where(F.col("id") == listing_id)

    def districts(self, known: list[str]) -> DataFrame:
        counts = self.all_listings.where("district is not null").groupBy("district").agg(F.count("*").alias("n"))
        return A.with_zeroes(self.all_listings.sparkSession.createDataFrame([(d,) for d in known], "district string"), counts, "district", "n")

    def price_histogram(self) -> DataFrame:
        return A.histogram(self.all_listings, "price", 200, 2500, 50)

    def agencies(self) -> DataFrame:
        return A.agencies(self.occurrences)

    def sources(self) -> DataFrame:
        return J.latest(self.runs, "source_id", "started_at", "id")

    def stats(self, user: str) -> DataFrame:
        rows = J.overlay(self.all_listings, self.state, self.scores, user)
        return A.totals(rows, {"total": F.lit(True), "matching": F.col("matches") == 1, "contacted": F.col("tracking") == "contacted"})
