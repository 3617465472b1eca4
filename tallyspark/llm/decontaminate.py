"""Benchmark decontamination (operator 5) by template canonicalisation, with DataFrame functions only.

Words are runs of letters and digits. Each becomes a typed template word: a number, a capitalised word (a name, or the start of
a sentence), a unit behind a number, a number with its unit, or else itself in lower case. Windows of five template
words of the documents meet those of the benchmark in a hash join. A matched window tells how the benchmark's slots are
filled in the document; along one alignment a slot value must always be filled with the same value, or the alignment doesn't
count. A document is contaminated by an item if consistent alignments cover at least 0.8 of the item's windows.

Defined results: null texts have no words; documents or items of fewer than five words have no window and match
nothing, as a passage that short stands in any text; windows of placeholders alone say nothing and are left out; a window that an item repeats counts once; rows with the
same doc_id are taken together, null ids too; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import stage

WINDOW = 5
SHARE = 0.8
#: Bytes of benchmark windows, as measured, up to which they are broadcast; beyond it, the join shuffles.
BROADCAST_BYTES = 64_000_000
# Units that are recognised behind a number.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "lb", "oz", "ml", "l", "s", "sec", "min", "h", "hours", "minutes", "days", "weeks", "months", "years", "miles", "meters", "metres", "feet", "inches", "dollars", "euros", "cents", "percent", "degrees")
NUMBER, NAME, UNIT, QUANTITY = "0", "1", "2", "3"
WORD = r"[\p{L}\p{N}]+"
_UNIT = "(?:" + "|".join(UNITS) + ")"


def template_text(text: Column) -> Column:
    """``text`` with every word of a type replaced by the type's digit, and the rest in lower case; words keep their places.

    Every number is replaced first, so a lone digit 1, 2 or 3 can only be a placeholder.
    """
    end = r"(?![\p{L}\p{N}])"
    numbers = F.regexp_replace(text, r"(?<![\p{L}\p{N}])\p{N}+" + end, NUMBER)
    glued = F.regexp_replace(numbers, r"(?<![\p{L}\p{N}])\p{N}+" + _UNIT + end, QUANTITY)
    units = F.regexp_replace(glued, r"(?<![\p{L}\p{N}])0([^\p{L}\p{N}]+)" + _UNIT + end, "0$1" + UNIT)
    typed = F.when(text.rlike(r"\p{N}"), units).otherwise(text)
    return F.lower(F.regexp_replace(typed, r"\p{Lu}(?<![\p{L}\p{N}].)\p{Ll}+" + end, NAME))


def _windows(df: DataFrame, key: str, raw: bool) -> DataFrame:
    """(key, at, h, slots): every informative window with its hash; slots are the raw words of its placeholders, else null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("key"), F.regexp_extract_all(text, F.lit(WORD), 0).alias("raw"), F.regexp_extract_all(template_text(text), F.lit(WORD), 0).alias("typed"))
    rows = rows.where(F.size("typed") >= WINDOW)
    rows = rows.select("key", "raw", "typed", F.explode(F.sequence(F.lit(0), F.size("typed") - WINDOW)).alias("at"))
    words = [F.get("typed", F.col("at") + k) for k in range(WINDOW)]
    slot = [w.isin(NUMBER, NAME, UNIT, QUANTITY) for w in words]
    informative = ~slot[0]
    for s in slot[1:]:
        informative = informative | ~s
    rows = rows.where(informative).select("key", "at", F.xxhash64(*words).alias("h"), *(["raw", "typed"] if raw else []))
    return rows


def _slots(raw: str, typed: str, at: str) -> Column:
    """For each of the window's words: the raw word if its template is a placeholder, else null."""
    return F.array(*[F.when(F.get(typed, F.col(at) + k).isin(NUMBER, NAME, UNIT, QUANTITY), F.get(raw, F.col(at) + k)) for k in range(WINDOW)])


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Contaminated documents: doc_id, item_id, windows (of the item), matched, coverage."""
    items = _windows(benchmark, "item_id", True)
    items = items.select(F.col("key").alias("item_id"), F.col("at").alias("item_at"), "h", _slots("raw", "typed", "at").alias("item_slots"))
    items = items.groupBy("item_id", "h").agg(F.min(F.struct("item_at", "item_slots")).alias("first")).select("item_id", "h", "first.*")
    items = stage(docs.sparkSession, items, "items")  # read three times below
    sizes = items.groupBy("item_id").agg(F.count("*").alias("windows"))
    # A row's numbers and its array's headers, and its words twice, as the JVM may keep them.
    weight = F.sum(F.lit(120) + 2 * F.octet_length(F.concat_ws("", "item_slots")))
    small = (items.agg(weight.cast("long").alias("bytes")).first()["bytes"] or 0) <= broadcast_bytes
    side = F.broadcast(items) if small else items
    found = _windows(docs, "doc_id", True)
    if not small:  # texts don't travel with windows: slots are cut out before the shuffle
        found = found.select("key", "at", "h", _slots("raw", "typed", "at").alias("doc_slots"))
        hits = found.join(side, "h")
    else:
        hits = found.join(side, "h").withColumn("doc_slots", _slots("raw", "typed", "at"))
    hits = hits.select(F.col("key").alias("doc_id"), "item_id", "h", (F.col("at") - F.col("item_at")).alias("shift"), F.arrays_zip("item_slots", "doc_slots").alias("slots"))
    hits = stage(docs.sparkSession, hits, "hits")  # read twice below; the texts are scanned once
    # One row for each window and filling; an alignment's fillings of one slot value must agree.
    filled = hits.select("doc_id", "item_id", "shift", F.explode("slots").alias("s")).where("s.item_slots is not null")
    clash = filled.groupBy("doc_id", "item_id", "shift", "s.item_slots").agg(F.min("s.doc_slots").alias("lo"), F.max("s.doc_slots").alias("hi")).where("lo <> hi")
    clash = clash.select("doc_id", "item_id", "shift").distinct()
    windows = hits.select("doc_id", "item_id", "shift", "h").distinct()
    keys = [windows[c].eqNullSafe(clash[c]) for c in ("doc_id", "item_id", "shift")]
    sound = windows.join(clash, keys[0] & keys[1] & keys[2], "left_anti")
    covered = sound.groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("matched"))
    joined = covered.join(sizes.withColumnRenamed("item_id", "__item"), F.col("item_id").eqNullSafe(F.col("__item"))).drop("__item")
    return joined.withColumn("coverage", F.col("matched") / F.col("windows")).where(F.col("coverage") >= share).select("doc_id", "item_id", "windows", "matched", "coverage")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` without contaminated documents."""
    bad = matches(docs, benchmark, share).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__bad"]), "left_anti")


def oracle() -> str:
    """The same in DuckDB SQL, word by word instead of by text patterns."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    unit = "|".join(UNITS)

    def side(table: str, key: str) -> str:
        return f"""
      SELECT key, i AS pos, raw[i:i+4] AS rw, t[i:i+4] AS tw FROM (
        SELECT key, raw, t, unnest(range(1, len(t) - 3)) AS i FROM (
          SELECT key, raw, list_transform(range(1, len(raw) + 1), lambda i: CASE
            WHEN regexp_full_match(raw[i], '\\p{{N}}+') THEN '0'
            WHEN regexp_full_match(raw[i], '\\p{{N}}+({unit})') THEN '3'
            WHEN i > 1 AND regexp_full_match(raw[i-1], '\\p{{N}}+') AND raw[i] IN ({units}) THEN '2'
            WHEN regexp_full_match(raw[i], '\\p{{Lu}}\\p{{Ll}}+') THEN '1'
            ELSE lower(raw[i]) END) AS t
          FROM (SELECT {key} AS key, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+') AS raw FROM {table})))
      WHERE len(list_filter(t[i:i+4], lambda w: w NOT IN ('0', '1', '2', '3'))) > 0"""

    return f"""
    WITH b0 AS ({side("benchmark", "item_id")}),
    b AS (SELECT key AS item_id, tw, min(pos) AS pos, arg_min(rw, pos) AS rw FROM b0 GROUP BY ALL),
    n AS (SELECT item_id, count(*) AS windows FROM b GROUP BY item_id),
    d AS ({side("documents", "doc_id")}),
    hits AS (SELECT d.key AS doc_id, b.item_id, d.tw, d.pos - b.pos AS shift, b.rw AS brw, d.rw AS drw FROM d JOIN b ON d.tw = b.tw),
    filled AS (SELECT doc_id, item_id, shift, brw[k] AS bs, drw[k] AS ds FROM hits, (SELECT unnest(range(1, 6)) AS k) WHERE tw[k] IN ('0', '1', '2', '3')),
    clash AS (SELECT DISTINCT doc_id, item_id, shift FROM filled GROUP BY doc_id, item_id, shift, bs HAVING count(DISTINCT ds) > 1),
    sound AS (SELECT DISTINCT doc_id, item_id, tw FROM hits h WHERE NOT EXISTS (SELECT 1 FROM clash c WHERE c.doc_id = h.doc_id AND c.item_id = h.item_id AND c.shift = h.shift)),
    covered AS (SELECT doc_id, item_id, count(*) AS matched FROM sound GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, windows, matched, matched::DOUBLE / windows AS coverage FROM covered JOIN n USING (item_id) WHERE matched::DOUBLE / windows >= {SHARE}"""
