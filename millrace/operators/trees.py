"""Nested JSON as rows of typed paths: walks over variants, and differences of two trees.

A value is opened level by level into its members; each level is one generator over rows, so the walk stays in the JVM and
rows of wide objects spread as rows do. A member's path says where it stands, its type what it is, so a value that changed
its type, an empty object in place of an empty list or a key that holds a dot or a quote are told apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Containers below so many others are taken whole, as canonical text with the type ``deeper``.
MAX_DEPTH = 8
OBJECT, ARRAY, NULL, DEEPER = "object", "array", "null", "deeper"
_MEMBER = "struct<path:string,key:string,type:string,value:variant>"


def type_of(value: Column) -> Column:
    """object, array, string, number, boolean or null: JSON's own types."""
    schema = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | F.is_variant_null(value), NULL).when(schema.startswith("OBJECT"), OBJECT).when(schema.startswith("ARRAY"), ARRAY)
        .when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").otherwise("number")
    )


def _step(key: Column) -> Column:
    """A key as a step of a path, quoted unless it is a plain name."""
    quoted = F.concat(F.lit('."'), F.regexp_replace(key, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), key)).otherwise(quoted)


def _member(path: Column, key: Column, kind: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), key.alias("key"), kind.alias("type"), value.alias("value")).cast(_MEMBER)


def _opened(at: Column) -> Column:
    """The members of a container that is still closed, with the container itself as done; any other row as it stands."""
    nothing = F.lit(None).cast("variant")
    self = F.array(_member(at["path"], at["key"], at["type"], nothing))
    entries = F.map_entries(F.try_variant_get(at["value"], "$", "map<string,variant>"))
    inside = F.transform(entries, lambda e: _member(F.concat(at["path"], _step(e["key"])), e["key"], type_of(e["value"]), e["value"]))
    items = F.try_variant_get(at["value"], "$", "array<variant>")
    listed = F.transform(items, lambda v, i: _member(F.concat(at["path"], F.lit("["), i.cast("string"), F.lit("]")), at["key"], type_of(v), v))
    is_open = at["value"].isNotNull()
    return (
        F.when(is_open & (at["type"] == OBJECT), F.concat(self, inside)).when(is_open & (at["type"] == ARRAY), F.concat(self, listed)).otherwise(F.array(at))
    )


def paths(rows: DataFrame, keys: Sequence[str], json: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``keys, path, key, type, text``: a row for every value anywhere in the JSON text, containers included.

    ``key`` is the nearest name of an object that leads to the value; ``text`` is null for containers and nulls. A text that is no JSON has no row.
    """
    value = F.try_parse_json(json)
    root = _member(F.lit("$"), F.lit(None).cast("string"), type_of(F.col("_v")), F.col("_v"))
    out = rows.select(*keys, value.alias("_v")).where("_v IS NOT NULL").select(*keys, root.alias("_at"))
    for _ in range(max_depth):
        out = out.select(*keys, F.explode(_opened(F.col("_at"))).alias("_at"))
    is_left = F.col("_at.type").isin(OBJECT, ARRAY) & F.col("_at.value").isNotNull()
    text = F.when(is_left, F.to_json("_at.value")).when(~F.col("_at.type").isin(OBJECT, ARRAY, NULL), F.try_variant_get("_at.value", "$", "string"))
    return out.select(*keys, "_at.path", "_at.key", F.when(is_left, DEEPER).otherwise(F.col("_at.type")).alias("type"), text.alias("text"))


def differences(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where two tables of paths() differ: ``keys, path, field, expected, actual``; ``field`` is missing, extra, type or value.

    What lies under a missing or extra container is not told again. Keys and values are compared with nulls as values.
    """
    left, right = (df.select(*keys, "path", F.struct("type", "text").alias(side)) for df, side in ((expected, "_e"), (actual, "_a")))
    right = right.withColumnsRenamed({c: f"_{c}" for c in (*keys, "path")})
    on = F.lit(True)
    for c in (*keys, "path"):
        on &= left[c].eqNullSafe(right[f"_{c}"])
    met = left.join(right, on, "full")
    named = [F.when(F.col("_e").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in (*keys, "path")]
    field = (
        F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_e.type") != F.col("_a.type"), "type")
        .when(~F.col("_e.text").eqNullSafe(F.col("_a.text")), "value")
    )
    shown = lambda side: F.coalesce(F.col(f"{side}.text"), F.col(f"{side}.type"))
    found = met.select(*named, field.alias("field"), shown("_e").alias("expected"), shown("_a").alias("actual")).where("field IS NOT NULL")
    # The parent of a path that only one side has is named there too, unless it is on both sides or of another type.
    parent = F.regexp_replace("path", r'(\.[A-Za-z_][A-Za-z0-9_]*|\."(?:[^"\\]|\\.)*"|\[[0-9]+\])$', "")
    tops = found.where("field IN ('missing', 'extra')").select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("path").alias("_parent"), F.col("field").alias("_field"))
    same = (parent == F.col("_parent")) & (F.col("field") == F.col("_field"))
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return found.join(tops, same, "left_anti")


def references(found: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """The texts under keys that end in ``suffix``, or in it with an s, wherever they stand: ``keys, ids``, sorted and once each."""
    named = (F.col("type") == "string") & (F.col("key").endswith(suffix) | F.col("key").endswith(f"{suffix}s"))
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(named, F.col("text")))).alias("ids"))


def usable(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, usable``: whether the JSON holds, at any depth, a number, a boolean or a text that is not blank."""
    counts = F.col("type").isin("number", "boolean") | ((F.col("type") == "string") & (F.trim("text", F.lit(" \t\n\r\x0b\f")) != ""))
    return found.groupBy(*keys).agg(F.max(F.coalesce(counts, F.lit(False))).alias("usable"))
