"""Recursive merge of JSON objects: the documents of a key folded in order, object into object.

Folding is done by paths, not by documents. Every document becomes rows (path, order, value), level by level; for a
path the last value that is no object and the last object are aggregates, combined map-side. Written later at a path
or above it, a value that is no object wipes out what lies there; an object is merged into an object. So a path's
value is alive if nothing above it was wiped out later, which one join for each level tells, and the merged document
is put together from the deepest level upwards.

A key's documents never meet in one task; one *merged* document does, as one value of the result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import variant as V
from runlens.session import staged


def path_writes(docs: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``(keys..., path, ord, obj, text)`` for every path of ``docs(keys..., ord, doc)``, and the depth of the deepest.

    Documents that are no objects write nothing. ``text`` is the JSON of a value that is no object.
    """
    levels = []
    above = docs.select(*keys, "ord", F.array().cast("array<string>").alias("path"), F.col("doc").alias("value"))
    while True:
        fields = F.explode(F.try_variant_get("value", "$", "map<string,variant>")).alias("name", "value")
        level = staged(above.where(V.is_object("value")).select(*keys, "ord", "path", fields)
                       .select(*keys, "ord", F.concat("path", F.array("name")).alias("path"), "value"), "merge-level")
        if level.isEmpty():
            break
        levels.append(level)
        above = level
    if not levels:
        return level.select(*keys, "path", "ord", F.lit(False).alias("obj"), F.lit("").alias("text")), 0
    rows = functools.reduce(DataFrame.union, levels)
    obj = V.is_object("value")
    return rows.select(*keys, "path", "ord", obj.alias("obj"),
                       F.when(~obj, F.to_json("value")).alias("text")), len(levels)


def _later(one: Column, other: Column) -> Column:
    """``one`` is there and later than ``other``, or ``other`` is not there."""
    return one.isNotNull() & (other.isNull() | (one > other))


def deep_merge(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., doc)``: for every key the documents of ``docs(keys..., ord, doc)`` merged in the order of ``ord``.

    A later value replaces an earlier one unless both are objects, which are merged in the same way at any depth.
    ``doc`` is VARIANT; a key whose documents are all empty, or no objects, has ``{}``. ``ord`` may be of any type
    that has an order, and is unique within a key; null keys are keys like any other.
    """
    everyone = docs.select(*keys).distinct()
    writes, depth = path_writes(docs, keys)
    nodes = staged(writes.groupBy(*keys, "path").agg(
        F.max(F.when(~F.col("obj"), F.col("ord"))).alias("plain"), F.max(F.when(F.col("obj"), F.col("ord"))).alias("object"),
        F.max_by("text", F.when(~F.col("obj"), F.col("ord"))).alias("text")), "merge-paths")

    def same(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
        return functools.reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in on])

    alive, wiped = [], None
    for level in range(1, depth + 1):
        here = nodes.where(F.size("path") == level).withColumn("up", F.slice("path", 1, level - 1))
        if wiped is None:
            here = here.withColumn("above", F.lit(None).cast(nodes.schema["plain"].dataType))
        else:
            kept = [here[c] for c in here.columns]
            here = here.join(wiped, same(here, wiped, [*keys, "up"]), "left").select(*kept, wiped["above"])
        here = staged(here, "merge-alive")
        leaf = _later(F.col("plain"), F.col("object")) & _later(F.col("plain"), F.col("above"))
        branch = _later(F.col("object"), F.col("plain")) & _later(F.col("object"), F.col("above"))
        alive.append(here.where(leaf | branch).select(*keys, "path", "up", branch.alias("branch"), "text"))
        wiped = here.where("object IS NOT NULL").select(*keys, F.col("path").alias("up"), F.greatest("plain", "above").alias("above"))
    inner = None
    for level in reversed(alive):
        if inner is not None:
            kept = [level[c] for c in level.columns]
            level = level.join(inner, same(level, inner, [*keys, "path"]), "left").select(*kept, inner["inside"])
        else:
            level = level.withColumn("inside", F.lit(None).cast("string"))
        name = F.to_json(F.array(F.element_at("path", -1)))
        text = F.when(F.col("branch"), F.coalesce("inside", F.lit("{}"))).otherwise(F.col("text"))
        member = F.concat(F.regexp_extract(name, r"(?s)^\[(.*)\]$", 1), F.lit(":"), text)
        inner = level.select(*keys, F.col("up").alias("path"), member.alias("_member")).groupBy(*keys, "path").agg(
            F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("_member")), ","), F.lit("}")).alias("inside"))
    if inner is None:
        return everyone.withColumn("doc", F.parse_json(F.lit("{}")))
    found = everyone.join(inner, same(everyone, inner, keys), "left")
    return found.select(*[everyone[c] for c in keys], F.parse_json(F.coalesce("inside", F.lit("{}"))).alias("doc"))
