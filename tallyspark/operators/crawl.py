"""What a crawl of lists and details came to, from landed tables: a verdict for each source, and what became of each reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that references are dealt into before they are told apart: a number that is given stays, and up to 200 parts are written without being sorted in memory.
PARTS = 192
#: Answers that end a source's crawl.
REFUSALS = ("rateLimited", "blocked")


def outcomes(pages: DataFrame, stubs: DataFrame) -> DataFrame:
    """(source_id, stop_reason, pages_fetched, collected, announced, complete) of every source with a page.

    ``pages``: source_id, list_url, ordinal, status (read, unchanged, failed, rateLimited or blocked), says_empty, announced; ``stubs``: source_id, source_ref, ordinal (of the page that it stands on).
    A refusal ends the crawl, and what lies behind it counts no more. Then a source is notModified if every list is, empty if every list was read and says so, tooManyErrors if no page was read, else
    completed; ``complete``: no list failed and all that is announced was found, so that what is missing is gone. Sources meet as counts, with map-side combining.
    """
    refused = pages.where(F.col("status").isin(*REFUSALS)).groupBy("source_id").agg(F.min(F.struct("ordinal", "status")).alias("stop"))
    seen = F.col("stop").isNull() | (F.col("ordinal") <= F.col("stop.ordinal"))
    is_ = lambda s: F.count(F.when(seen & (F.col("status") == s), 1))
    empty = F.count(F.when(seen & (F.col("status") == "read") & F.col("says_empty"), 1))
    counts = {"pages_fetched": is_("read"), "unchanged": is_("unchanged"), "failed": is_("failed"), "empty": empty}
    each = pages.join(refused, "source_id", "left").groupBy("source_id", "list_url").agg(*[c.alias(k) for k, c in counts.items()], F.count(F.when(seen, 1)).alias("seen"), F.max(F.when(seen & (F.col("status") == "read"), F.col("announced"))).alias("announced"), F.min("stop.status").alias("refusal"))
    told = each.groupBy("source_id").agg(*[F.sum(k).alias(k) for k in [*counts, "seen"]], F.max("announced").alias("announced"), F.min("refusal").alias("refusal"), F.count("list_url").alias("lists")).where("seen > 0 and source_id is not null").drop("seen")
    # A reference stands on the first page that names it; each is dealt out by itself, so that a task holds few of them however many there are.
    first = stubs.repartition(PARTS, "source_id", "source_ref").groupBy("source_id", "source_ref").agg(F.min("ordinal").alias("ordinal"))
    reached = first.join(refused, "source_id", "left").where(F.col("stop").isNull() | (F.col("ordinal") < F.col("stop.ordinal")))
    found = reached.groupBy("source_id").agg(F.count("source_ref").alias("collected"))
    both = told.join(found, "source_id", "left").withColumn("collected", F.coalesce("collected", F.lit(0).cast("long")))
    reason = (
        F.when(F.col("refusal").isNotNull(), F.col("refusal")).when(F.col("unchanged") == F.col("lists"), "notModified").when((F.col("collected") == 0) & (F.col("empty") == F.col("lists")), "empty")
        .when((F.col("collected") == 0) & (F.col("pages_fetched") == 0), "tooManyErrors").otherwise("completed")
    )
    complete = (F.col("stop_reason") == "completed") & (F.col("failed") == 0) & (F.col("collected") >= F.coalesce("announced", F.lit(0)))
    return both.withColumn("stop_reason", reason).select("source_id", "stop_reason", "pages_fetched", "collected", "announced", complete.alias("complete"), (F.col("failed") > 0).alias("partial"))


def references(verdicts: DataFrame, stubs: DataFrame, details: DataFrame, known: DataFrame) -> DataFrame:
    """(source_id, source_ref, fate) of the stubs of completed sources: rendered, withdrawn, confirmed or skipped.

    ``details``: source_id, source_ref, gone, price_text; ``known``: source_id, source_ref. A detail that is gone withdraws a known reference, but not where a list failed; one with a rent is rendered;
    any other known reference is confirmed, so that it isn't taken for missing.
    """
    done = verdicts.where("stop_reason = 'completed'").select("source_id", "partial")
    keys = ["source_id", "source_ref"]
    none, yes = F.lit(False), F.lit(True)
    marks = lambda df, **told: df.select(*keys, *[F.coalesce(told.get(c, none), none).alias(c) for c in ("stub", "known", "gone", "priced")])
    named = F.col("source_ref").isNotNull()
    met = marks(stubs, stub=yes).union(marks(known.where(named), known=yes)).union(marks(details.where(named), gone=F.col("gone"), priced=F.col("price_text").isNotNull()))
    each = met.repartition(PARTS, *keys).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("stub", "known", "gone", "priced")]).where("stub")
    rows = each.join(done, "source_id")
    gone = F.col("gone") & F.col("known") & ~F.col("partial")
    fate = F.when(gone, "withdrawn").when(F.col("priced"), "rendered").when(F.col("known"), "confirmed").otherwise("skipped")
    return rows.select(*keys, fate.alias("fate"))
