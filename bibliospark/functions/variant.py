"""Column helpers over VARIANT values parsed from landed JSON.

Landed documents are polymorphic - the same path holds an object in one record,
an array or a string in another - so they are parsed with ``try_parse_json``
and inspected with these helpers instead of being forced into a StructType.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# kinds reported by vkind()
MISSING, NULL, OBJECT, ARRAY, STRING, NUMBER, BOOLEAN = (
    "MISSING", "NULL", "OBJECT", "ARRAY", "STRING", "NUMBER", "BOOLEAN")


def key_path(*keys: str) -> str:
    """JSON path with bracket-quoted keys (handles ``dc:identifier``, ``@id``, ``$``)."""
    return "$" + "".join("['" + k.replace("'", "\\'") + "']" for k in keys)


def vget(v: Column, *keys: str) -> Column:
    """Raw child value: SQL NULL when a key is missing or ``v`` is not an object."""
    return F.try_variant_get(v, key_path(*keys), "variant")


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def is_object(v: Column) -> Column:
    """Object test without copying: a cast to the empty struct only checks
    the value's type header."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def vkind(v: Column) -> Column:
    """The JSON kind of a value; objects and arrays are recognised by
    casts, so the subtree is not serialised. ``v`` should be a column or a
    lambda variable (it is referenced several times)."""
    sch = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(MISSING))
            .when(F.is_variant_null(v), F.lit(NULL))
            .when(is_object(v), F.lit(OBJECT))
            .when(as_array(v).isNotNull(), F.lit(ARRAY))
            .when(sch == "STRING", F.lit(STRING))
            .when(sch == "BOOLEAN", F.lit(BOOLEAN))
            .otherwise(F.lit(NUMBER)))


# kind by the head of schema_of_variant's answer; other heads are numbers
_SCHEMA_HEADS = (("VOID", NULL), ("STRING", STRING), ("BOOLEAN", BOOLEAN), ("OBJECT", OBJECT), ("ARRAY", ARRAY))


def vkind_leaf(v: Column) -> Column:
    """``vkind`` for values expected to be scalars (an id, a name, a keyword):
    one ``schema_of_variant`` call, looked up by its head (``VOID`` is JSON
    null, every numeric schema is a number). It walks the value, so it is
    not for whole documents or lists; ``vkind`` is."""
    heads = F.create_map(*[F.lit(x) for pair in _SCHEMA_HEADS for x in pair])
    head = F.substring_index(F.schema_of_variant(v), "<", 1)
    return F.when(v.isNull(), F.lit(MISSING)).otherwise(
        F.coalesce(F.element_at(heads, head), F.lit(NUMBER)))


def truthy(v: Column, k: Column) -> Column:
    """Python truthiness of a JSON value of kind ``k``: missing, null, '', 0,
    false, [] and {} are falsy."""
    return (F.when(k.isin(MISSING, NULL), F.lit(False))
            .when(k == STRING, F.try_variant_get(v, "$", "string") != "")
            .when(k == NUMBER, F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(True)))
            .when(k == BOOLEAN, F.try_variant_get(v, "$", "boolean"))
            .when(k == ARRAY, F.size(as_array(v)) > 0)
            .when(k == OBJECT, F.size(as_object(v)) > 0)
            .otherwise(F.lit(False)))


def as_list(v: Column, k: Column, string_as: Column | None = None) -> Column:
    """Object -> [object]; array -> itself; string -> ``string_as`` (an
    array<variant> Column, default empty); anything else -> empty."""
    empty = F.array().cast("array<variant>")
    return (F.when(k == OBJECT, F.array(v))
            .when(k == ARRAY, as_array(v))
            .when(k == STRING, string_as if string_as is not None else empty)
            .otherwise(empty))


def id_key(v: Column, k: Column) -> Column:
    """Key for null-safe id equality: missing and JSON null are both NULL; any
    other value compares by its JSON text (so "7" differs from 7)."""
    return F.when(~k.isin(MISSING, NULL), F.to_json(v))


def string_or(v: Column, k: Column, missing_default: str | None, null_value: str | None = None) -> Column:
    """A scalar string field: the string itself, ``missing_default`` when the
    key is absent, ``null_value`` for JSON null; other kinds give NULL."""
    return (F.when(k == STRING, F.try_variant_get(v, "$", "string"))
            .when(k == MISSING, F.lit(missing_default))
            .when(k == NULL, F.lit(null_value)))


def scalar_text(v: Column, k: Column) -> Column:
    """Text of a value used in string formatting: strings as is, JSON null and
    missing as '', anything else as its JSON text."""
    return (F.when(k == STRING, F.try_variant_get(v, "$", "string"))
            .when(k.isin(MISSING, NULL), F.lit(""))
            .otherwise(F.to_json(v)))
