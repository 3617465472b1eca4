"""Agency names: resolving them to sources, grouping spellings, coverage. Containment is an equi-join on substrings, so no names are crossed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as T

# Words that say nothing about which agency it is, and the shortest telling keys.
COMMON = ("agence", "agency", "immobilier", "immo", "immobiliere", "groupe", "the", "les", "des")
CONTAINED, WORD = 8, 6


def name_tokens(x: Column) -> Column:
    """Folded words of three letters or more that tell agencies apart."""
    return F.filter(F.split(T.fold(x), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*COMMON))


def lengths_of(keys: DataFrame, least: int = CONTAINED) -> list[int]:
    """The different lengths, from ``least`` on, of keys: as many as a name has letters at most, however many names there are."""
    return sorted(r["n"] for r in keys.select(F.length("key").alias("n")).where(F.col("n") >= least).distinct().collect())


def substrings(key: Column, lengths: list[int]) -> Column:
    """All different parts of a key that are as long as some known key is."""
    parts = lambda n: F.when(F.length(key) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(1))), lambda at: F.substring(key, at, F.lit(n))))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*[parts(n) for n in lengths])))) if lengths else F.array().cast("array<string>")


def squished(x: Column) -> Column:
    """A name's letters and digits alone."""
    return F.replace(T.fold(x), F.lit(" "), F.lit(""))


def resolve(names: DataFrame, handles: DataFrame) -> DataFrame:
    """(name, source_id): the source that a name means. ``handles`` is (source_id, title), a row for each name of a source.

    The first rule that finds one source alone: the same letters; one name within the other, of eight letters or more (several sources: null, no weaker rule is asked); the only word of a source's id; the same name
    with the trade's word abbreviated. All are equal joins.
    """
    keyed = handles.select("source_id", squished(F.col("title")).alias("key"), T.agency_key(F.col("title")).alias("short"), name_tokens(F.regexp_replace("source_id", "-", " ")).alias("words"))
    keys = keyed.select("source_id", "key").where(F.length("key") >= 4).distinct()
    words = keyed.where((F.size("words") == 1) & (F.length(F.get("words", F.lit(0))) >= WORD)).select("source_id", F.get("words", F.lit(0)).alias("word")).distinct()
    words = words.groupBy("word").agg(F.min("source_id").alias("source_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    shorts = keyed.where(F.length("short") >= WORD).select("source_id", "short").distinct()
    rows = names.select("name").distinct().withColumn("key", squished(F.col("name"))).where("key <> ''")
    found = lambda df, out: df.groupBy("name").agg(F.count_distinct("source_id").alias("n"), F.min("source_id").alias("s")).select("name", F.when(F.col("n") == 1, F.col("s")).alias(out), F.col("n").alias(f"n_{out}"))
    exact = found(rows.join(keys, "key"), "s1")
    inside = rows.select("name", F.explode(substrings(F.col("key"), lengths_of(keys))).alias("key")).join(keys, "key").select("name", "source_id")
    held = keys.select("source_id", F.explode(substrings(F.col("key"), lengths_of(rows))).alias("key")).join(rows, "key").select("name", "source_id")
    near = found(inside.union(held), "s2")
    word = found(rows.withColumn("word", F.explode(name_tokens(F.col("name")))).join(words, "word"), "s3")
    short = found(rows.withColumn("short", T.agency_key(F.col("name"))).join(shorts, "short"), "s4")
    all_names = names.select("name").distinct()
    for more in (exact, near, word, short):
        all_names = all_names.join(more, "name", "left")
    undecided = F.coalesce("n_s2", F.lit(0)) > 1
    return all_names.select("name", F.coalesce("s1", "s2", F.when(~undecided, F.coalesce("s3", "s4"))).alias("source_id"))


def group(names: DataFrame) -> DataFrame:
    """(name, grp): names by key; the shortest key of eight characters or more that a key contains takes it in, one level deep."""
    keyed = names.select("name", T.agency_key(F.col("name")).alias("key")).distinct()
    keys = keyed.select("key").distinct()
    parts = keys.withColumn("part", F.explode(substrings(F.col("key"), lengths_of(keys))))
    into = parts.join(keys.select(F.col("key").alias("part")), "part").groupBy("key").agg(F.min_by("part", F.struct(F.length("part"), F.col("part"))).alias("grp"))
    return keyed.join(into, "key", "left").select("name", F.coalesce("grp", "key").alias("grp"))


def uncovered(names: DataFrame, known: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Groups of names that no known source covers; ``known`` is (title), ``ignored`` (name): names that are left out on purpose.

    A name is covered by a known key that equals it, lies in it or that it lies in (eight letters or more), by a word of a known title, or by having no telling
    word at all.
    """
    titles = known.select(T.agency_key(F.col("title")).alias("key")).where("key <> ''").distinct()
    tokens = known.select(F.explode(name_tokens(F.col("title"))).alias("token")).distinct()
    rows = group(names).withColumn("tokens", name_tokens(F.col("name"))).withColumn("key", T.agency_key(F.col("name")))
    keys = rows.select("key").distinct()
    inside = rows.select("grp", F.explode(substrings(F.col("key"), lengths_of(titles))).alias("key")).join(titles, "key", "left_semi").select("grp")
    around = titles.select(F.explode(substrings(F.col("key"), lengths_of(keys))).alias("key")).distinct()
    hits = [rows.where("size(tokens) = 0").select("grp"), rows.select("grp", F.explode("tokens").alias("token")).join(tokens, "token", "left_semi").select("grp"), rows.join(titles, "key", "left_semi").select("grp"), inside, rows.join(around, "key", "left_semi").select("grp")]
    if ignored is not None:
        hits.append(rows.join(ignored.select(T.agency_key(F.col("name")).alias("key")).distinct(), "key", "left_semi").select("grp"))
    hit = hits[0]
    for more in hits[1:]:
        hit = hit.unionByName(more)
    return rows.select("grp").distinct().join(hit, "grp", "left_anti")
