"""JSON-LD columns over the script bodies of a page: everything stays inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlscope import constants as C

_IS_OBJECT = "schema_of_variant({0}) LIKE 'OBJECT%'"
_NODES = f"""
flatten(transform(
  filter(
    flatten(transform(filter(transform({{bodies}}, b -> try_parse_json(coalesce(nullif(b, ''), '{{{{}}}}'))), v -> v IS NOT NULL),
                      v -> coalesce(try_variant_get(v, '$', 'array<variant>'), array(v)))),
    c -> {_IS_OBJECT.format('c')}),
  c -> coalesce(try_variant_get(c, '$[\\'@graph\\']', 'array<variant>'), array(c))))
"""


def node_texts(bodies: str) -> Column:
    """JSON text of every object node of the page, one level of @graph opened."""
    nodes = _NODES.format(bodies=bodies)
    return F.expr(f"transform(filter({nodes}, n -> {_IS_OBJECT.format('n')}), n -> to_json(n))")


def has_errors(bodies: str) -> Column:
    """True when any script body is not valid JSON."""
    return F.expr(f"exists({bodies}, b -> try_parse_json(coalesce(nullif(b, ''), '{{}}')) IS NULL)")


def node_types(node: Column) -> Column:
    """The @type of one node text as a list, whether written as a scalar or a list."""
    raw = F.get_json_object(node, "$['@type']")
    listed = F.from_json(raw, "array<string>")
    return (
        F.when(raw.isNull(), F.array().cast("array<string>"))
        .when(raw.startswith("["), F.coalesce(listed, F.array().cast("array<string>")))
        .otherwise(F.array(raw))
    )


def _prefixed(prefix: Column):
    return lambda key: F.concat(prefix, key)


def node_fields(node: Column) -> Column:
    """Names of the plain fields of one node text and, for a few containers, of their own fields."""

    def plain(keys: Column) -> Column:
        return F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: ~k.startswith("@"))

    own = plain(F.json_object_keys(node))
    nested = []
    for name in C.NESTED_SCHEMA_FIELDS:
        child = F.get_json_object(node, f"$['{name}']")
        first = F.when(F.trim(child).startswith("["), F.get_json_object(child, "$[0]")).otherwise(child)
        is_object = F.trim(first).startswith("{")
        keys = plain(F.when(is_object, F.json_object_keys(first)))
        prefix = F.lit(f"{name}.")
        nested.append(F.transform(keys, _prefixed(prefix)))
    return F.array_sort(F.array_distinct(F.concat(own, *nested)))
