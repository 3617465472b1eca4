"""Reading landed pages: JSON-LD, sitemaps, text, labels, robots rules, charsets; and the scan and draft logic around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.functions import text as T

BLOCKS = "address|article|aside|blockquote|dd|div|dl|dt|h[1-6]|li|ol|p|section|table|td|tr|ul"


def json_ld(html: Column) -> Column:
    """The JSON texts of all ld+json scripts; those that don't parse are left out, an @graph or an array counts by its members."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"), 1)
    def members(x: Column) -> Column:
        graph = F.coalesce(F.get_json_object(x, "$['@graph']"), F.when(F.trim(x).startswith("["), x))
        return F.when(graph.isNotNull(), F.transform(F.from_json(graph, "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array(x))
    return F.flatten(F.transform(F.filter(found, lambda x: F.try_parse_json(x).isNotNull()), members))


def node_of_type(nodes: Column, types: list[str]) -> Column:
    """The first node whose type, or first type, is one of ``types`` in lower case."""
    kind = lambda n: F.lower(F.coalesce(F.get_json_object(n, "$['@type'][0]"), F.get_json_object(n, "$['@type']")))
    return F.get(F.filter(nodes, lambda n: F.coalesce(kind(n), F.lit("")).isin(*types)), F.lit(0))


def geo(node: Column) -> Column:
    """Latitude and longitude; zero and what is no number are missing."""
    part = lambda p: F.nullif(F.get_json_object(node, p).try_cast("double"), F.lit(0.0))
    return F.struct(part("$.geo.latitude").alias("lat"), part("$.geo.longitude").alias("lon"))


def sitemap(xml: Column) -> Column:
    """(loc, lastmod) of every url block."""
    tag = lambda x, name: F.nullif(F.trim(F.regexp_extract(x, rf"(?is)<{name}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)), F.lit(""))
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), 1), lambda x: F.struct(tag(x, "loc").alias("loc"), tag(x, "lastmod").alias("lastmod")))


def newest_first(entries: Column) -> Column:
    """Locations by lastmod, latest first, unknown ones last."""
    keyed = F.transform(entries, lambda e: F.struct(F.coalesce(e["lastmod"], F.lit("")).alias("m"), e["loc"].alias("l")))
    return F.transform(F.reverse(F.array_sort(keyed)), lambda e: e["l"])


def to_text(html: Column) -> Column:
    """Text with line breaks at br and block tags, then cleaned line by line."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "")
    x = F.regexp_replace(x, rf"(?i)<br\s*/?>|</?(?:{BLOCKS})\b[^>]*>", "\n")
    return T.multiline(T.decode_entities(F.regexp_replace(x, "<[^>]*>", "")))


def after_label(x: Column, label: str, value: str) -> Column:
    """What follows a label."""
    return T.first_match(x, rf"(?i)(?:{label})\s*:?\s*({value})", 1)


def labelled(html: Column) -> Column:
    """array<{label, value}>: a page's labels with their values in page order: dt and dd, th and td side by side, and list items of the form "label : value"; both without tags.

    The page becomes its cells in order, each knowing its place, and a label takes the next cell if that is a value of its kind.
    """
    body = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", "")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<(?:dt|dd|th|td|li)\b[^>]*>.*?(?=</?(?:dt|dd|th|td|li|tr|dl|ul|ol|table)\b)"), 0)
    cells = F.transform(found, lambda c: F.struct(F.lower(F.regexp_extract(c, r"^<(\w+)", 1)).alias("kind"), T.clean(F.regexp_replace(c, "<[^>]*>", " ")).alias("text")))

    def pairs(held: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            after = F.get(held, i + 1)
            fits = ((c["kind"] == "dt") & (after["kind"] == "dd")) | ((c["kind"] == "th") & (after["kind"] == "td"))
            colon = F.regexp_extract(c["text"], r"^([^:]{1,60}?)\s*:\s*(.+)$", 1)
            item = (c["kind"] == "li") & (colon != "")
            name = F.regexp_replace(c["text"], r"\s*:\s*$", "")
            return F.when(item, F.struct(colon.alias("label"), F.regexp_extract(c["text"], r"^[^:]{1,60}?\s*:\s*(.+)$", 1).alias("value"))).when(F.coalesce(fits, F.lit(False)) & (name != ""), F.struct(name.alias("label"), after["text"].alias("value")))

        return F.filter(F.transform(held, one), lambda p: p.isNotNull())

    return T.let(cells, pairs)


def announced_total(html: Column, most: int = 2000) -> Column:
    """The number of listings that a page announces, if it announces exactly one."""
    found = F.regexp_extract_all(T.fold(F.regexp_replace(html, "<[^>]*>", " ")), F.lit(r"\b(\d{1,5}) (?:annonces?|biens?|resultats?|logements?)\b(?! par (?:page|an))"), 1)
    kinds = F.array_distinct(F.filter(F.transform(found, lambda n: n.cast("int")), lambda n: n <= most))
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))


def coverage(announced: Column, collected: Column) -> Column:
    return F.when(announced.isNull(), "unknown").when(collected >= announced, "full").otherwise("short")


def decode(x: Column) -> Column:
    """UTF-8 where that is what the bytes are, else Latin-1."""
    return F.when(F.is_valid_utf8(x.cast("string")), x.cast("string")).otherwise(F.decode(x, "ISO-8859-1"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path) with ``allowed``: the longest matching rule of ``rules`` (host, pattern, allow) wins, allowing ones on a tie; no rule allows."""
    escaped = F.regexp_replace("pattern", r"([.+?()\[\]{}|^\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(escaped, r"\*", ".*"))
    ready = rules.withColumn("__re", regex).withColumn("__len", F.length("pattern"))
    best = urls.join(ready, "host").where(F.regexp_like("path", F.col("__re"))).groupBy("host", "path").agg(F.max(F.struct("__len", "allow")).alias("b"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, F.coalesce("b.allow", F.lit(True)).alias("allowed"))


def apply_drafts(listed: DataFrame, drafts: DataFrame, keys: list[str]) -> DataFrame:
    """Values of a list page overridden by known ones of the detail page; maps ``extra`` are united, the detail's first."""
    names = [c for c in listed.columns if c not in keys]
    both = listed.join(drafts.select(*keys, F.struct(*[c for c in drafts.columns if c not in keys]).alias("__d")), keys, "left")
    def value(c: str) -> Column:
        if c not in drafts.columns:
            return F.col(c)
        if c == "extra":
            a, b = F.coalesce("extra", F.create_map().cast("map<string,string>")), F.coalesce(F.col("__d.extra"), F.create_map().cast("map<string,string>"))
            return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
        return F.coalesce(F.col(f"__d.{c}"), F.col(c))
    return both.select(*keys, *[value(c).alias(c) for c in names])


def known_territory(found: Column, known: Column) -> Column:
    """Whether a scan may stop: eight in ten are known, or nothing was found."""
    return F.when(found == 0, F.lit(True)).otherwise(known / found >= 0.8)


def visit_order(rows: DataFrame, budget: int) -> DataFrame:
    """Details to read: new without memory, without memory, stale, the rest; within a budget."""
    w = Window.partitionBy("source_id").orderBy(F.when(~F.col("known") & ~F.col("fresh"), 0).when(~F.col("remembered"), 1).when(F.col("stale"), 2).otherwise(3), "ref")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= budget)
