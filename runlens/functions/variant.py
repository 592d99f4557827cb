"""Helpers over VARIANT documents that mirror Python dict semantics.

The run document is free-form JSON. Three states of a key must be told apart:
absent (``d.get(k)`` default applies), present-null (``None``) and present with a value.
``variant_get(v, path, 'variant')`` is SQL NULL only when the path is absent; a JSON null
comes back as a variant null (``is_variant_null``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sub(v, path: str) -> Column:
    """Sub-document at ``path`` (``$.a.b``) as VARIANT; SQL NULL if absent."""
    return F.variant_get(_c(v), path, "variant")


def fields(v, names: list[str]) -> Column:
    """Struct of an object's members of these names, as VARIANT, in one pass over the object.

    A member is SQL NULL if absent, and a variant null if it is a JSON null; of what is no object all are NULL.
    """
    return F.try_variant_get(_c(v), "$", "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">")


def present(v, path: str) -> Column:
    """Key present (value may be JSON null)."""
    return sub(v, path).isNotNull()


def nonnull(v, path: str) -> Column:
    """Key present and not JSON null (``d.get(k) is not None``)."""
    s = sub(v, path)
    return s.isNotNull() & ~F.is_variant_null(s)


def kind(v) -> Column:
    """Top-level JSON kind of a variant: OBJECT, ARRAY, STRING, BOOLEAN, NUMBER, NULL; NULL if absent."""
    s = F.schema_of_variant(_c(v))
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(s, r"^([A-Z]+)", 1), "^VOID$", "NULL"),
                            "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)$", "NUMBER")


def is_object(v) -> Column:
    """``isinstance(x, dict)`` (one reference to ``v``)."""
    return F.try_variant_get(_c(v), "$", "struct<>").isNotNull()


def filled_object(v) -> Column:
    """A JSON object that is not empty (members are counted, not rendered); absent -> False."""
    return F.coalesce(F.size(F.try_variant_get(_c(v), "$", "map<string,struct<>>")) > 0, F.lit(False))


def is_string(v) -> Column:
    return F.coalesce(F.schema_of_variant(_c(v)) == "STRING", F.lit(False))


def as_string(v, path: str = "$") -> Column:
    """String value if the JSON value is a string, else NULL (``isinstance(x, str)``)."""
    s = sub(v, path) if path != "$" else _c(v)
    return F.when(is_string(s), F.variant_get(s, "$", "string"))


def text_at(v, path: str = "$") -> Column:
    """Strings as they are, other JSON values as JSON text; NULL if the key is absent or holds a JSON null."""
    s = sub(v, path) if path != "$" else _c(v)
    return F.when(~F.is_variant_null(s), F.coalesce(as_string(s), F.to_json(s)))


# JSON texts of the falsy values: null, false, "", {}, [], numeric zero
_FALSY_JSON = r'^(?:null|false|""|\{\}|\[\]|-?0(?:\.0*)?(?:[eE][+-]?[0-9]+)?)$'


def truthy(v) -> Column:
    """Python truthiness of a JSON value; absent or null -> False. One reference to ``v``."""
    return F.coalesce(~F.to_json(_c(v)).rlike(_FALSY_JSON), F.lit(False))


def truthy_at(v, path: str) -> Column:
    return truthy(sub(v, path))


def obj_or_empty(v, path: str) -> Column:
    """``d.get(k, {}) or {}`` restricted to objects: the sub-object if it is a non-null object, else NULL."""
    s = sub(v, path)
    return F.when(is_object(s), s)


def to_double(v, path: str) -> Column:
    """``float(x)`` for numbers, booleans and numeric strings, else NULL (ValueError/TypeError -> None)."""
    x = sub(v, path)
    s = F.trim(F.variant_get(x, "$", "string"))
    # a cast also takes the suffixes d and f, as in 0.9d
    return F.when(is_string(x), F.when(~s.rlike("(?i)[0-9.][df]$"), s.try_cast("double"))) \
        .otherwise(F.try_variant_get(x, "$", "double"))
