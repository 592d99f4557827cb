"""The typed record of a run. Its 38 fields are columns; free-form ones stay VARIANT.

Input are the rows of ``landing.to_records``, whose ``doc`` is the run's document. Every field is one path of it, so the
record is a projection. A missing field, a JSON null and a value that the field's type cannot hold give NULL, except
that the fields of ``EMPTY_OBJECT`` and ``EMPTY_LIST`` take an empty object or list for every falsy value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import variant as V

# The fields of a record by kind. ``to_records`` gives the first ones.
KEYS = ("run_id", "trace_id", "parent_run_id", "name", "status", "error", "start_time")
TEXT = ("run_type", "session_id", "dotted_order", "reference_example_id", "app_path", "manifest_id")
TIME = ("end_time", "first_token_time")
COUNT = ("total_tokens", "prompt_tokens", "completion_tokens")
COST = ("total_cost", "prompt_cost", "completion_cost")
FLAG = ("in_dataset",)
IDS = ("child_run_ids", "parent_run_ids")
EMPTY_OBJECT = ("extra", "inputs", "outputs", "attachments")
EMPTY_LIST = ("events",)
FREE = ("serialized", "feedback_stats", "child_runs", "completion_cost_details", "completion_token_details",
        "prompt_cost_details", "prompt_token_details", "feedback_records")

COST_TYPE = "decimal(38,12)"


def iso_time(value) -> Column:
    """An ISO time (Z, offset or none) as a timestamp; NULL for other texts and values."""
    return F.regexp_replace(V.as_string(value), "Z$", "+00:00").try_cast("timestamp")


def _exact(value, kind: str) -> Column:
    """A number, or a text that holds one."""
    return F.coalesce(V.as_string(value).try_cast(kind), F.try_variant_get(value, "$", kind))


def _texts(value) -> Column:
    """A list as texts; an empty one for every other value."""
    return F.coalesce(F.try_variant_get(value, "$", "array<string>"), F.array().cast("array<string>"))


def _or_empty(value, empty: str) -> Column:
    return F.when(V.truthy(value), value).otherwise(F.parse_json(F.lit(empty)))


def typed_fields(doc: str | Column = "doc") -> Column:
    """The fields that ``to_records`` does not give, as a list of one struct; the document is opened once for all of them."""
    names = (*TEXT, *TIME, *COUNT, *COST, *FLAG, *IDS, "tags", *EMPTY_OBJECT, *EMPTY_LIST, *FREE)
    opened = F.try_variant_get(doc, "$", "struct<" + ",".join(f"{n}:variant" for n in names) + ">")

    def typed(fields: Column) -> Column:
        found = {n: V.text_at(fields[n]) for n in TEXT}
        found |= {n: iso_time(fields[n]) for n in TIME}
        found |= {n: _exact(fields[n], "bigint") for n in COUNT}
        found |= {n: _exact(fields[n], COST_TYPE) for n in COST}
        found |= {n: F.try_variant_get(fields[n], "$", "boolean") for n in FLAG}
        found |= {n: _texts(fields[n]) for n in (*IDS, "tags")}
        found |= {n: _or_empty(fields[n], "{}") for n in EMPTY_OBJECT}
        found |= {n: _or_empty(fields[n], "[]") for n in EMPTY_LIST}
        found |= {n: F.when(~F.is_variant_null(fields[n]), fields[n]) for n in FREE}
        return F.struct(*[c.alias(n) for n, c in found.items()])

    return F.transform(F.array(opened), typed)


def typed_records(records: DataFrame) -> DataFrame:
    """Records with all fields as columns and without the document that they came from."""
    return records.select("*", F.inline(typed_fields())).drop("doc")
