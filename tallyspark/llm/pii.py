"""Personal data (operator 3) by weak supervision, with DataFrame functions only.

Exact formats give the base spans, which always stay. Looser formats (national phone numbers, spelled-out addresses) give further
candidates. Five labelers vote on every candidate, base or not: format, gazetteer, shape, checksum and context. Expectation
maximisation over the counts of vote patterns estimates for each kind how often there is personal data and how reliable
each labeler is. The posteriors train a naive-Bayes span classifier on hashed features of the span and its
surroundings, and candidates it accepts are added.

Places are counted in code points. They come from the pieces between matches: a match starts after the summed
lengths of the pieces and matches before it, a running sum within one document. Patterns are possessive, so that they take linear time and
constant stack on any text.

Defined results: a null text is an empty one; texts without candidates have no spans; rows are independent, so ties and repeated rows need
nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.session import stage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
# The base formats. A run is entered at its start only, or where the last match ended.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser formats by the kind that they may be.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{{2,}}+",
    "phone": r"(?<![0-9+.)-])(?<!\+[0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: A text without this can't match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LOOSE_NEEDS = {"email": r"(?:\(dot\)|\[dot\]|\x20dot\x20)", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
# The gazetteers.
DOMAINS = "com|org|net|edu|gov|info|biz|io|co|eu|uk|de|fr|es|it|nl|ch|at|be|ca|us|au|jp|br|in"
CALLING_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|92"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65"
CUES = {
    "email": "e-?mail|mail|contact|write|schreib|courriel|correo",
    "ip": "\\bip\\b|address|host|server|client|login|adresse",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|cell|fax|anruf|appel|llam",
}
AGAINST = "version|isbn|issn|order|invoice|release|page|chapter|build|serial"
LABELERS = 5
CONTEXT = 32
ROUNDS = 25
BUCKETS = 256
ACCEPT = 0.9


def _pieces(text: Column, pattern: str, kind: str, base: bool, needs: str) -> Column:
    """Matches of ``pattern`` in order, each with the length of the text before it since the last match, and its surroundings."""
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    rows = F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            F.lit(base).alias("base"),
            i.alias("nth"),
            F.char_length(F.get(parts, i)).alias("gap"),
            F.char_length(m).alias("length"),
            m.alias("value"),
            F.right(F.get(parts, i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(parts, i + 1), F.lit(CONTEXT)).alias("after"),
        ),
    )
    return F.when(text.rlike(needs), rows)


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, found): every row with its candidates, or null; the texts themselves are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sets = [_pieces(F.col("text"), BASE[k], k, True, NEEDS[k]) for k in KINDS] + [_pieces(F.col("text"), LOOSE[k], k, False, LOOSE_NEEDS[k]) for k in LOOSE]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = F.flatten(F.filter(F.array(*sets), lambda x: x.isNotNull()))
    any_ = F.col("text").rlike("[0-9@]") | F.col("text").rlike(LOOSE_NEEDS["email"])
    found = F.when(any_, found)
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(F.size(found) > 0, found).alias("found"))


def _luhn(digits: Column) -> Column:
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), 0), lambda d, i: (d.cast("int") * (i % 2 + 1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def spans(found: DataFrame) -> DataFrame:
    """One row for each candidate: place, value, surroundings and ``valid``, whether a base match holds its kind's condition."""
    rows = found.where("found is not null").select("row", F.explode("found").alias("c")).select("row", "c.*")
    before = Window.partitionBy("row", "kind", "base").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", (F.coalesce(F.sum(F.col("gap") + F.col("length")).over(before), F.lit(0)) + F.col("gap")).cast("long"))
    rows = rows.withColumn("end", F.col("start") + F.col("length")).withColumn("digits", F.regexp_replace("value", "[^0-9]", ""))
    n = F.length("digits")
    octet = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    luhn = F.coalesce(F.when((n >= 12) & (n <= 19), _luhn(F.col("digits"))), F.lit(False))
    valid = (
        F.when(F.col("kind") == "ip", F.col("value").rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(F.col("kind") == "card", luhn)
        .when(F.col("kind") == "phone", (n >= 9) & (n <= 15))
        .otherwise(F.lit(True))
    )
    return rows.withColumn("luhn", luhn).withColumn("valid", F.col("base") & valid).drop("gap", "length", "nth")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def votes(rows: DataFrame) -> DataFrame:
    """Adds ``votes``: 1, 0 or -1 (abstains) from each labeler."""
    kind, value, digits = F.col("kind"), F.col("value"), F.col("digits")
    around = F.lower(F.concat_ws(" ", "before", "after"))
    one_of = lambda table: F.coalesce(*[F.when(kind == k, v) for k, v in table.items()], F.lit(False))
    known = one_of({
        "email": F.lower(value).rlike(rf"(?:\.|dot[\])]?\x20?)(?:{DOMAINS})$"),
        "ip": ~value.rlike(r"^(?:0+|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\."),
        "card": digits.rlike(f"^(?:{ISSUERS})"),
        "phone": F.when(F.col("base"), digits.rlike(f"^(?:{CALLING_CODES})")).otherwise(digits.rlike("^[2-9]")),
    })
    shaped = one_of({
        "email": value.rlike(r"^.{2,64}(?:@|at).{4,}$") & ~value.rlike(r"\.\."),
        "ip": ~value.rlike(r"(?:^|\.)0[0-9]"),
        "card": value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$"),
        "phone": F.length("digits").between(9, 15) & ~value.rlike(r"[.\x20-]{3,}"),
    })
    cued = one_of({k: around.rlike(v) for k, v in CUES.items()})
    never = F.lit(False)
    return rows.withColumn("votes", F.array(
        _vote(F.col("valid"), F.col("base") & ~F.col("valid")),
        _vote(known, ~known),
        _vote(shaped, ~shaped),
        _vote((kind == "card") & F.col("luhn"), (kind == "card") & ~F.col("luhn")),
        _vote(cued, around.rlike(AGAINST) | never),
    ))


def _posterior(votes_: str, model: str) -> str:
    """SQL for the probability of personal data given votes and a model struct (pi, a, b)."""
    side = lambda rates, prior: f"aggregate(sequence(0, {LABELERS - 1}), {prior}, (p, j) -> p * CASE {votes_}[j] WHEN 1 THEN {model}.{rates}[j] WHEN 0 THEN 1 - {model}.{rates}[j] ELSE 1D END)"
    yes, no = side("a", f"{model}.pi"), side("b", f"(1 - {model}.pi)")
    return f"({yes}) / (({yes}) + ({no}))"


def reliabilities(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, model): expectation maximisation over the counts of vote patterns, of which a kind has at most 3 ** 5.

    model is a struct of pi, the share of personal data, and for each labeler the rates a and b of voting yes on
    personal data and on the rest, one pseudo-count smoothed.
    """
    patterns = voted.groupBy("kind", "votes").agg(F.count("*").alias("n"))
    kinds = patterns.groupBy("kind").agg(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("pats"))
    total = "aggregate(w, 0D, (t, x) -> t + {})"
    rate = lambda q: "transform(sequence(0, {0}), j -> ({1} + 1) / ({2} + 2))".format(
        LABELERS - 1, total.format(f"CASE WHEN x.votes[j] = 1 THEN x.n * {q} ELSE 0D END"), total.format(f"CASE WHEN x.votes[j] >= 0 THEN x.n * {q} ELSE 0D END"))
    new = f"named_struct('pi', ({total.format('x.n * x.q')} + 1) / ({total.format('x.n')} + 2), 'a', {rate('x.q')}, 'b', {rate('(1 - x.q)')})"
    weigh = f"transform(pats, x -> named_struct('votes', x.votes, 'n', x.n, 'q', {_posterior('x.votes', 'm')}))"
    start = f"named_struct('pi', 0.5D, 'a', array_repeat(0.8D, {LABELERS}), 'b', array_repeat(0.3D, {LABELERS}))"
    step = f"aggregate(array({weigh}), m, (old, w) -> {new})"
    return kinds.select("kind", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (m, r) -> {step})").alias("model"))


def features(voted: DataFrame) -> DataFrame:
    """Adds ``features``: hashed buckets of the votes, the length, the neighbours and the words around, for each kind."""
    last, first = F.right("before", F.lit(1)), F.left("after", F.lit(1))
    kind_of = lambda c: F.when(c == "", "edge").when(c.rlike(r"\s"), "space").when(c.rlike(r"\p{L}"), "letter").when(c.rlike(r"\p{N}"), "digit").otherwise(c)
    names = [F.concat(F.lit(f"vote{j}="), F.get("votes", F.lit(j)).cast("string")) for j in range(LABELERS)]
    names += [F.concat(F.lit("length="), F.least(F.char_length("value") / 4, F.lit(12)).cast("int").cast("string"))]
    names += [F.concat(F.lit("left="), kind_of(last)), F.concat(F.lit("right="), kind_of(first)), F.concat(F.lit("base="), F.col("base").cast("string"))]
    names += [F.concat(F.lit("word="), F.regexp_extract(F.lower("before"), r"(\p{L}+)[^\p{L}]*$", 1))]
    return voted.withColumn("features", F.transform(F.array(*names), lambda x: F.pmod(F.xxhash64("kind", x), F.lit(BUCKETS)).cast("int")))


def classify(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``score``, the trained classifier's probability, to the candidates ``rows``."""
    voted = features(votes(rows))
    spark = rows.sparkSession
    models = stage(spark, reliabilities(voted, rounds), "models")  # a row for each kind
    soft = voted.join(F.broadcast(models), "kind").withColumn("q", F.expr(_posterior("votes", "model"))).drop("model")
    weights = soft.select("q", F.explode("features").alias("bucket")).groupBy("bucket").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no"))
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("yes", "no")))).alias("w"))  # a row of at most BUCKETS entries
    sums = soft.agg(F.struct(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).alias("t"))
    table, sums = stage(spark, table, "weights"), stage(spark, sums, "sums")
    scored = soft.withColumn("t", sums.scalar()).withColumn("w", table.scalar())
    odds = "aggregate(features, log((t.yes + 1) / (t.no + 1)), (o, f) -> o + log((w[f].yes + 1) / (t.yes + 2)) - log((w[f].no + 1) / (t.no + 2)))"
    return scored.withColumn("score", F.expr(f"1 / (1 + exp(-({odds})))")).drop("t", "w", "q", "votes", "features")


def _apart(rows: DataFrame) -> DataFrame:
    """``rows`` without added spans that overlap a base span of their kind: the last base end before and the next base start, along each document's spans."""
    order = Window.partitionBy("row", "kind").orderBy("start", "end")
    ended = F.max(F.when(F.col("valid"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(F.col("valid"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    marked = rows.withColumn("__hit", F.coalesce(ended > F.col("start"), F.lit(False)) | F.coalesce(begins < F.col("end"), F.lit(False)))
    return marked.where(F.col("valid") | ~F.col("__hit")).drop("__hit")


def _base_of(kind: str):
    return lambda x: x["base"] & (x["kind"] == kind)


def detect(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """For every row of ``docs``: doc_id, the number of spans of each base kind, a digest of the base spans, all spans as text.

    Spans are ordered by start, then kind. Added spans have their kind's name; they never overlap a base span of it.
    """
    found = stage(docs.sparkSession, candidates(docs), "candidates")
    rows = stage(docs.sparkSession, spans(found), "spans")
    scored = _apart(classify(rows).where(F.col("valid") | (~F.col("base") & (F.col("score") >= accept))))
    no = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    one = F.struct(F.col("start"), no.alias("no"), F.col("end"), F.col("kind"), F.col("valid").alias("base"))
    lists = scored.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("all"))
    name = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    hit = found.where("found is not null").select("row", "doc_id").join(lists, "row", "left")
    counted = hit.select(
        "doc_id",
        *[F.coalesce(F.size(F.filter("all", _base_of(k))), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(name(F.filter("all", lambda x: x["base"])), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(name(F.col("all")), F.lit("")).alias("spans"),
    )
    none = found.where("found is null").select("doc_id", *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.lit("").cast("binary"), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return counted.unionByName(none)
