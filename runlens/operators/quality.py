"""Data-quality checks (V2-V5)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import variant as V

EVAL_TYPES = ("token_name", "website", "availability")


def consistency_violations(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """V2: document keys that disagree with the table keys (``data->>'k' = k``); a missing or null
    document key passes, as a SQL CHECK does."""
    by = by if by is not None else ["project"]
    d = F.col("doc")
    aggs = [F.count(F.lit(1)).alias("n_runs")]
    for k in ("run_id", "trace_id", "project", "run_date"):
        dv = V.text_at(d, "$." + k)
        bad = dv.isNotNull() & (dv != F.col(k).cast("string"))
        aggs.append(F.count_if(F.coalesce(bad, F.lit(False))).alias(f"{k}_mismatch"))
    return runs.groupBy(*by).agg(*aggs)


def example_schema_ok(examples: DataFrame, eval_type: str) -> bool:
    """V3: the formatted example columns are exactly the ones of ``eval_type`` with boolean outputs."""
    from runlens.operators.evaluation import FORMAT_COLUMNS
    ins, outs = FORMAT_COLUMNS[eval_type]
    types = dict(examples.dtypes)
    for f in ins + outs:
        if f not in types:
            return False
    return all(types[f] == "boolean" for f in outs if f != "notes")


def _named(part, problem):
    return lambda name: F.struct(part.alias("part"), problem.alias("problem"), name.alias("name"))


def example_schema_violations(lines: DataFrame, eval_type: str, line_col: str = "line") -> DataFrame:
    """V3 over written examples: a row for each violation, with the columns of ``lines`` and ``part`` (inputs,
    outputs), ``problem`` (missing key, extra key, wrong type) and ``name``.

    A line must have exactly the keys of ``eval_type``, and booleans for its outputs but ``notes``, which is text.
    A line that is no JSON object, or has no object for a part, misses all keys of that part.
    """
    from runlens.operators.evaluation import FORMAT_COLUMNS
    doc = F.try_parse_json(line_col)
    found = []
    for part, names in zip(("inputs", "outputs"), FORMAT_COLUMNS[eval_type]):
        fields = F.coalesce(F.try_variant_get(doc, f"$.{part}", "map<string,variant>"),
                            F.create_map().cast("map<string,variant>"))
        keys, wanted = F.map_keys(fields), F.array(*[F.lit(n) for n in names])
        kinds = [(F.lit("missing key"), F.array_except(wanted, keys)), (F.lit("extra key"), F.array_except(keys, wanted))]
        if part == "outputs":
            right = {n: "STRING" if n == "notes" else "BOOLEAN" for n in names}
            wrong = [F.when(F.array_contains(keys, n) & (F.coalesce(F.schema_of_variant(F.try_element_at(fields, F.lit(n))),
                                                                    F.lit("")) != kind), F.lit(n)) for n, kind in right.items()]
            kinds.append((F.lit("wrong type"), F.array_compact(F.array(*wrong))))
        for problem, bad in kinds:
            found.append(F.transform(bad, _named(F.lit(part), problem)))
    return lines.select("*", F.inline(F.flatten(F.array(*found))))


def validate_params(date: str | None = None, start: str | None = None, end: str | None = None,
                    eval_type: str | None = None, best_100: bool = False) -> tuple[str, str]:
    """V5: YYYY-MM-DD dates, exactly one of date / start, end defaults to start, eval_type known,
    ``best_100`` only for availability."""
    if (date is None) == (start is None):
        raise ValueError("give either a date or a start date")
    s = date or start
    e = end or s
    for x in (s, e):
        try:
            _dt.date.fromisoformat(x)
        except (TypeError, ValueError):
            raise ValueError(f"invalid date {x!r}, expected YYYY-MM-DD") from None
    if eval_type is not None and eval_type not in EVAL_TYPES:
        raise ValueError(f"eval_type must be one of {EVAL_TYPES}")
    if best_100 and eval_type != "availability":
        raise ValueError("--best-100 is only available for availability datasets")
    return s, e
