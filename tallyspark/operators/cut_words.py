"""Words that a preview cuts off, completed from a vocabulary table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as T

#: Letters that a cut word needs at least, so that it isn't ambiguous.
LEAST = 4
_CUT = "\u0001"
#: Different texts are few bytes and much work: so many tasks share them at least.
PIECES = 96


def _pieces(x: Column) -> Column:
    """The words of a text, folded; a cut one keeps a mark at its end."""
    marked = F.regexp_replace(T.clean(x), r"(\p{L}+)(?:\.{2,}|…)", f" $1{_CUT} ")
    return F.filter(F.transform(F.split(marked, " "), lambda w: F.concat(T.fold(F.replace(w, F.lit(_CUT), F.lit(""))), F.when(F.endswith(w, F.lit(_CUT)), _CUT).otherwise(""))), lambda w: ~w.isin("", _CUT))


def heads(vocabulary: DataFrame, word: str, order: Column, least: int = LEAST) -> DataFrame:
    """(stem, full): for every start of ``least`` letters or more of a word, the first word in ``order`` that goes on behind it.

    The table grows with the vocabulary's letters, and a stem's words meet as one minimum, so that looking a stem up is an equal join, whatever its length.
    """
    words = vocabulary.select(F.col(word).alias("full"), order.alias("o")).where(F.length("full") > least)
    starts = words.select("full", "o", F.explode(F.sequence(F.lit(least), F.length("full") - 1)).alias("n"))
    return starts.groupBy(F.substring("full", F.lit(1), F.col("n")).alias("stem")).agg(F.min_by("full", F.struct("o", "full")).alias("full"))


def complete(rows: DataFrame, column: str, vocabulary: DataFrame, word: str, order: Column, out: str = "completed", least: int = LEAST) -> DataFrame:
    """``rows`` with ``out``: the folded text with cut words completed, those that no word of the vocabulary continues as they stand; null counts as empty.

    Only different texts with a cut word are taken apart, and only different stems looked up; rows come back by their text, so they need no id and may repeat.
    """
    pieces = rows.select(F.coalesce(column, F.lit("")).alias("__text")).where(F.regexp_like("__text", F.lit(r"\.\.|…"))).distinct().repartition(PIECES, "__text")
    # The outer form: the plain one is given a filter on its array, which is worked out anew for each of the filter's terms.
    single = pieces.select("__text", F.posexplode_outer(_pieces(F.col("__text"))).alias("pos", "w")).where("pos is not null").withColumn("stem", F.replace("w", F.lit(_CUT), F.lit("")))
    asked = F.endswith("w", F.lit(_CUT)) & (F.length("stem") >= least)
    found = single.withColumn("look", F.when(asked, F.col("stem"))).join(heads(vocabulary, word, order, least).withColumnRenamed("stem", "look"), "look", "left")
    joined = found.groupBy("__text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("full", "stem").alias("v")))), lambda p: p["v"]), " ").alias("__done"))
    back = rows.withColumn("__text", F.coalesce(column, F.lit(""))).join(joined, "__text", "left")
    return back.withColumn(out, F.coalesce("__done", T.fold(F.col(column)))).drop("__text", "__done")
