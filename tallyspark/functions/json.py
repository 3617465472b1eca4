"""JSON and nested values, with their types (VARIANT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAP = "map<string,variant>"


def length_or_zero(x: Column, path: str) -> Column:
    return F.coalesce(F.json_array_length(F.get_json_object(x, path)), F.lit(0)).cast("long")


def is_object(v: Column) -> Column:
    """Whether a variant is an object; null for no variant."""
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def members(x: Column) -> Column:
    """A JSON object's members as map<string,variant>; null for broken JSON and for what is no object."""
    v = F.try_parse_json(x)
    return F.when(is_object(v), v).cast(_MAP)


def rebuilt(members: Column) -> Column:
    """The JSON of a map<string,variant>; keys in order of their names."""
    return F.to_json(F.to_variant_object(members))


def without_keys(x: Column, *names: str) -> Column:
    """A JSON object without some keys, all others with their types; what is no object gives null."""
    return rebuilt(F.map_filter(members(x), lambda k, _: ~k.isin(*names)))


def with_key(x: Column, name: str, value: Column) -> Column:
    """A JSON object with a member put in or replaced; ``value`` is JSON."""
    held = F.map_filter(members(x), lambda k, _: k != name)
    return rebuilt(F.map_concat(held, F.create_map(F.lit(name), F.parse_json(value))))


def entries(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` once for each member of the JSON object, or item of the array, in ``column``: with position, key (null in an array), value (JSON; a text is bare) and type.

    Broken JSON, scalars and nulls give no rows, as do empty objects.
    """
    held = rows.withColumn("__v", F.try_parse_json(column))
    inside = held.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    kind = F.regexp_extract(F.schema_of_variant("value"), r"^\w+", 0)
    named = F.when(kind == "OBJECT", "object").when(kind == "ARRAY", "array").when(kind == "VOID", "null").when(kind == "STRING", "text").when(kind == "BOOLEAN", F.to_json("value")).when(kind == "BIGINT", "integer").otherwise("real")
    text = F.when(kind == "STRING", F.expr("variant_get(value, '$', 'string')")).otherwise(F.to_json("value"))
    return inside.select(*[F.col(c) for c in rows.columns], F.col("pos").cast("int").alias("position"), "key", F.when(kind != "VOID", text).alias("value"), named.alias("type"))


def scores_without_reasons(x: Column) -> Column:
    """The member ``scores`` with every score's reasons emptied; null unless it is an object of objects."""
    scores = members(F.get_json_object(x, "$.scores"))
    emptied = lambda v: F.to_variant_object(F.map_concat(F.map_filter(v.cast(_MAP), lambda k, _: k != "reasons"), F.create_map(F.lit("reasons"), F.parse_json(F.lit("[]")))))
    fine = F.forall(F.map_values(scores), is_object)
    return F.when(fine, rebuilt(F.transform_values(F.when(fine, scores), lambda _, v: emptied(v))))


def occurrence_ids(x: Column) -> Column:
    """The ids of a payload's occurrences that are texts; what can't be read gives none."""
    found = F.try_variant_get(F.try_parse_json(x), "$.occurrences", "array<variant>")
    ids = F.transform(F.coalesce(found, F.array().cast("array<variant>")), lambda o: F.try_variant_get(o, "$.id", "variant"))
    texts = F.filter(ids, lambda i: F.coalesce(F.schema_of_variant(i) == "STRING", F.lit(False)))
    return F.transform(texts, lambda i: F.try_variant_get(i, "$", "string"))


def valid(x: Column) -> Column:
    return F.try_parse_json(x).isNotNull()


def strings(x: Column, path: str) -> Column:
    """A path's texts; broken or missing JSON gives none."""
    return F.coalesce(F.from_json(F.get_json_object(x, path), "array<string>"), F.array().cast("array<string>"))


def field_matching(fields: Column, pattern: str) -> Column:
    """The first non-empty value of a map whose key matches."""
    return F.get(F.map_values(F.map_filter(fields, lambda k, v: k.rlike(pattern) & (F.length(v) > 0))), F.lit(0))


def list_payload(x: Column) -> Column:
    """The list's part of a payload: no description, scores nor distances."""
    return without_keys(x, "description", "scores", "distances")
