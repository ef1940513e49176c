"""Open JSON objects held as text: read, merge, set and delete keys, as Postgres does with jsonb."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = "map<string,string>"


def field(c: Column, key: str) -> Column:
    """c ->> key."""
    return F.get_json_object(c, f"$.{key}")


def as_map(c: Column) -> Column:
    return F.coalesce(F.from_json(c, SHAPE), F.from_json(F.lit("{}"), SHAPE))


def merged(c: Column, other: Column) -> Column:
    """c || other: keys of other win. Values are kept as text."""
    a, b = as_map(c), as_map(other)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def without(c: Column, *keys: str) -> Column:
    return F.to_json(F.map_filter(as_map(c), lambda k, _: ~k.isin(*keys)))


def with_field(c: Column, key: str, value: Column) -> Column:
    return merged(c, F.to_json(F.create_map(F.lit(key), value.cast("string"))))
