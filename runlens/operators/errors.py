"""Scraper-error analytics: nested-run flattening, daily error rates, error hierarchy.

Input is the run table (one row per stored run) with at least
``run_id, trace_id, project, run_date, name, status, error, ord`` and optionally ``parent_run_id``,
``start_time`` and a ``doc`` VARIANT (free-form run document, may carry nested ``child_runs``).

Scale notes
* Every trace-level step is a ``groupBy`` with partial-aggregable functions (count, count_if,
  max_by/min_by, bool_or), so a trace or day holding a third of all runs is combined map-side
  before the shuffle; no window and no ``collect_list`` runs over a trace.
* Error facts are attached to their trace root with an equi-join against a one-row-per-trace table;
  AQE broadcasts it when its measured size is small and splits skewed keys otherwise.
* Nested ``child_runs`` are flattened level by level, to any depth: each round explodes the children of
  the level before, which is written to the shared folder and shrinks; no shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import text as T
from runlens.functions import variant as V
from runlens.session import staged

KEYS = ["project", "run_date", "trace_id"]


# ------------------------------------------------------------------------------------------ N1
def _children(arr_or_run: Column) -> Column:
    """Object children of a run's ``child_runs`` list (non-objects skipped, non-lists -> empty)."""
    arr = F.coalesce(F.try_variant_get(arr_or_run, "$.child_runs", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(arr, lambda c: V.is_object(c))


def nested_runs(runs: DataFrame, doc_col: str = "doc", keep: list[str] | None = None) -> DataFrame:
    """One typed row per nested descendant run found in ``doc.child_runs`` at any depth.

    Output: the stored run's ``keep`` columns (default keys + run_id as ``stored_run_id`` + ord), ``depth`` (1 = direct
    child), ``place`` (positions of the descendant and of those above it, which sort as the tree is walked), the
    descendant's ``id, name, status, error, start_time``, its own ``symbol`` (P13) and ``target_url`` (P14).

    Levels are written one by one until one is empty. A level holds its runs' typed fields and, of their documents,
    only the ``child_runs`` that are left; reports read the typed columns and no document. Ingest stores this table
    once, beside the runs.
    """
    keep = keep or [c for c in KEYS + ["run_id", "ord"] if c in runs.columns]
    ch = F.col("child")
    levels = []
    above, children = runs.withColumns({"depth": F.lit(0), "place": F.array().cast("array<int>")}), _children(F.col(doc_col))
    while not levels or not levels[-1].isEmpty():
        # no filter on the children: pushed below, it would build and search every document a second time
        rows = above.select(*keep, (F.col("depth") + 1).alias("depth"), "place",
                            F.posexplode(children).alias("at", "child"))
        opened = rows.withColumn("m", V.fields(ch, ["id", "name", "status", "error", "start_time"]))
        typed = opened.select(
            *keep, "depth", F.concat("place", F.array("at")).alias("place"), V.text_at("m.id").alias("id"),
            V.as_string("m.name").alias("name"), V.as_string("m.status").alias("status"),
            V.text_at("m.error").alias("error"), V.as_string("m.start_time").alias("start_time"),
            T.target_url(ch).alias("target_url"), ch)
        levels.append(staged(typed.select(
            *[c for c in typed.columns if c != "child"], T.crypto_symbol(ch, F.col("name"), F.col("error")).alias("symbol"),
            _children(ch).alias("children")), "children"))
        above, children = levels[-1], F.col("children")
    out = functools.reduce(DataFrame.union, levels[:-1] or levels).drop("children")
    return out.withColumnRenamed("run_id", "stored_run_id") if "run_id" in keep else out


def flatten_children(runs: DataFrame, doc_col: str = "doc", keep: list[str] | None = None) -> DataFrame:
    """The same rows without the columns that only the error hierarchy needs."""
    return nested_runs(runs, doc_col, keep).drop("place", "symbol", "target_url")


def _nested_of(runs: DataFrame, nested: DataFrame | bool | None) -> DataFrame | None:
    """The nested runs to use: the stored table if it is given, else found in the documents, if there are any."""
    if isinstance(nested, DataFrame):
        return nested
    wanted = ("doc" in runs.columns) if nested is None else nested
    return nested_runs(runs) if wanted else None


# ------------------------------------------------------------------------------------------ A3
def _filter(runs: DataFrame, project=None, run_date=None, start=None, end=None) -> DataFrame:
    r = runs.where(F.col("trace_id").isNotNull())
    if project is not None:
        r = r.where(F.col("project") == project)
    if run_date is not None:
        r = r.where(F.col("run_date") == F.lit(run_date).cast("date"))
    if start is not None:
        r = r.where(F.col("run_date") >= F.lit(start).cast("date"))
    if end is not None:
        r = r.where(F.col("run_date") <= F.lit(end).cast("date"))
    return r


def trace_error_counts(runs: DataFrame, predicate=T.is_rate_error, nested: DataFrame | bool | None = None) -> DataFrame:
    """Per trace (project, run_date, trace_id): stored run count and error count of the trace as the
    table-mode analysis reconstructs it (root + stored children + their nested children; the root's
    own nested children only when it is the trace's single stored run). ``nested`` is the stored table of
    ``nested_runs``; without it they are read from the documents."""
    found = _nested_of(runs, nested)
    per_trace = runs.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(predicate(F.col("name"), F.col("status"))).alias("n_errors"),
        F.max_by(F.col("run_id"), F.struct((F.col("run_id") == F.col("trace_id")), -F.col("ord"))).alias("root_run_id"),
    )
    if found is None:
        return per_trace.drop("root_run_id")
    nested_err = (found.where(predicate(F.col("name"), F.col("status")))
                  .groupBy(*KEYS, "stored_run_id").agg(F.count(F.lit(1)).alias("n")))
    j = per_trace.join(nested_err, KEYS, "left")
    keep = F.col("stored_run_id").isNotNull() & (
        (F.col("n_runs") == 1) | (F.col("stored_run_id") != F.col("root_run_id")))
    return (j.groupBy(*KEYS).agg(F.first("n_runs").alias("n_runs"), F.first("n_errors").alias("n_errors"),
                                 F.sum(F.when(keep, F.col("n")).otherwise(0)).alias("n_nested"))
            .select(*KEYS, "n_runs", (F.col("n_errors") + F.col("n_nested")).alias("n_errors")))


def daily_error_report(runs: DataFrame, project: str | None = None, run_date=None,
                       start=None, end=None, nested: DataFrame | bool | None = None) -> DataFrame:
    """A3+A4 (table mode): per (project, run_date): total_traces = distinct traces,
    zenrows_errors = scraper errors in those traces, error_rate.

    With both ``project`` and ``run_date`` given, exactly one row is returned even for an empty day.
    """
    r = _filter(runs, project, run_date, start, end)
    per_trace = trace_error_counts(r, T.is_rate_error, nested)
    if project is not None and run_date is not None:
        agg = per_trace.agg(F.count(F.lit(1)).alias("total_traces"),
                            F.coalesce(F.sum("n_errors"), F.lit(0)).cast("bigint").alias("zenrows_errors"))
        agg = agg.select(F.lit(project).alias("project"), F.lit(run_date).cast("date").alias("run_date"), "*")
    else:
        agg = per_trace.groupBy("project", "run_date").agg(
            F.count(F.lit(1)).alias("total_traces"), F.sum("n_errors").cast("bigint").alias("zenrows_errors"))
    return agg.withColumn("error_rate", T.error_rate(F.col("zenrows_errors"), F.col("total_traces")))


def daily_error_report_rootmode(runs: DataFrame, project: str | None = None, run_date=None,
                                nested: DataFrame | bool | None = None, date_col: str = "run_date") -> DataFrame:
    """A2 (file mode): total_traces = runs without parent_run_id; errors counted over every stored run
    and all of its nested children. ``date_col`` is the day key (F5 of start_time for landed files), which a stored
    table of nested runs has, too."""
    r = runs
    if project is not None:
        r = r.where(F.col("project") == project)
    if run_date is not None:
        r = r.where(F.col(date_col) == F.lit(str(run_date)).cast(r.schema[date_col].dataType))
    err = T.is_rate_error(F.col("name"), F.col("status"))
    base = r.select("project", F.col(date_col).alias("_day"),
                    F.col("parent_run_id").isNull().cast("int").alias("root"), err.cast("int").alias("err"))
    found = nested if isinstance(nested, DataFrame) else None
    if found is not None and project is not None:
        found = found.where(F.col("project") == project)
    if found is not None and run_date is not None:
        found = found.where(F.col(date_col) == F.lit(str(run_date)).cast(found.schema[date_col].dataType))
    if found is None and (("doc" in runs.columns) if nested is None else nested):
        found = nested_runs(r, keep=["project", date_col])
    if found is not None:
        ne = (found.where(T.is_rate_error(F.col("name"), F.col("status")))
              .select("project", F.col(date_col).alias("_day"), F.lit(0).alias("root"), F.lit(1).alias("err")))
        base = base.unionByName(ne)
    out = base.groupBy("project", "_day").agg(F.sum("root").cast("bigint").alias("total_traces"),
                                              F.sum("err").cast("bigint").alias("zenrows_errors"))
    return (out.withColumnRenamed("_day", date_col)
            .withColumn("error_rate", T.error_rate(F.col("zenrows_errors"), F.col("total_traces"))))


def merge_projects(report: DataFrame, date_col: str = "run_date") -> DataFrame:
    """A5: all-projects report = per-day sums over the per-project rows, rate recomputed."""
    return (report.groupBy(date_col)
            .agg(F.sum("total_traces").cast("bigint").alias("total_traces"),
                 F.sum("zenrows_errors").cast("bigint").alias("zenrows_errors"))
            .withColumn("error_rate", T.error_rate(F.col("zenrows_errors"), F.col("total_traces"))))


def summary_stats(report: DataFrame, date_col: str = "run_date") -> DataFrame:
    """One row: total_days, total_traces, total_zenrows_errors, overall_error_rate,
    worst_day (max rate, earliest on ties), best_day (min rate below 101, earliest on ties)."""
    d = F.col(date_col).cast("string")
    rate = F.col("error_rate")
    agg = report.agg(
        F.count(F.lit(1)).alias("total_days"),
        F.coalesce(F.sum("total_traces"), F.lit(0)).cast("bigint").alias("total_traces"),
        F.coalesce(F.sum("zenrows_errors"), F.lit(0)).cast("bigint").alias("total_zenrows_errors"),
        F.max_by(d, F.struct(rate, F.datediff(F.lit("9999-12-31").cast("date"), F.col(date_col).cast("date")))).alias("worst_day"),
        F.min_by(d, F.struct(rate, F.col(date_col))).alias("_best"),
        F.min(rate).alias("_min_rate"),
    )
    return agg.select(
        "total_days", "total_traces", "total_zenrows_errors",
        T.error_rate(F.col("total_zenrows_errors"), F.col("total_traces")).alias("overall_error_rate"),
        "worst_day",
        F.when(F.col("_min_rate") < 101, F.col("_best")).alias("best_day"))


# ------------------------------------------------------------------------------------------ A8
def _doc_or_none(df: DataFrame, col: str = "doc"):
    return F.col(col) if col in df.columns else None


FACTS = [*KEYS, "symbol", "root_id", "error_id", "error_symbol", "error_message", "start_time", "target_url", "name",
         "depth", "not_root", "ord", "place", "root_name", "root_start_time"]


def _typed(runs: DataFrame) -> DataFrame:
    """Keys and the fields that the hierarchy needs of every stored run; the symbol is found once, here."""
    doc = _doc_or_none(runs)
    st = (F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if "start_time" in runs.columns
          and dict(runs.dtypes)["start_time"].startswith("timestamp") else F.col("start_time")) \
        if "start_time" in runs.columns else F.lit(None).cast("string")
    depth = V.to_double(doc, "$.extra.metadata.ls_run_depth") if doc is not None else F.lit(None).cast("double")
    return runs.select(*KEYS, "run_id", "ord", "name", "status", "error", st.alias("start_time"),
                       T.target_url(doc).alias("target_url"), depth.alias("run_depth"),
                       T.crypto_symbol(doc, F.col("name"), F.col("error")).alias("run_symbol"))


def _error_rows(typed: DataFrame, nested: DataFrame | None) -> DataFrame:
    """Errors (P4b) of the stored runs and of the runs nested in them, each with the stored run it belongs to."""
    failed = T.is_detail_error(F.col("name"), F.col("status"))
    rows = typed.where(failed).select(
        *KEYS, "ord", F.col("run_id").alias("error_id"), F.col("run_id").alias("stored_run_id"),
        F.col("run_symbol").alias("own_symbol"), F.col("error").alias("error_message"), "start_time", "target_url",
        "name", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("place"))
    if nested is None:
        return rows
    return rows.unionByName(nested.where(failed).select(
        *KEYS, "ord", F.col("id").alias("error_id"), "stored_run_id", F.col("symbol").alias("own_symbol"),
        F.col("error").alias("error_message"), "start_time", "target_url", "name", "depth", "place"))


def error_facts(runs: DataFrame, project=None, run_date=None, nested: DataFrame | bool | None = None) -> DataFrame:
    """A8 flat facts of the error hierarchy (table mode, P4b errors).

    One row per error: project, run_date, trace_id, symbol (P13 of the trace root, the group key), root_id with the
    root's name and start time (its metadata), error_id, error_symbol (own P13, else the root's), error_message
    (raw), start_time, target_url (P14), name, depth (0 = stored run), and ``not_root, ord, place``, which put the
    errors of a trace in the order in which it has them: the root's own, then run by run, each tree as it is walked.
    """
    r = _filter(runs, project, run_date)
    found = _nested_of(r, nested)
    if isinstance(nested, DataFrame):
        found = _filter(found, project, run_date)
    typed = _typed(r)
    roots = typed.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.max_by(F.struct(F.col("run_id").alias("root_id"), F.col("run_symbol").alias("symbol"),
                          F.col("name").alias("root_name"), F.col("start_time").alias("root_start_time")),
                 F.struct(F.col("run_id") == F.col("trace_id"), -F.col("ord"))).alias("root"))
    j = _error_rows(typed, found).join(roots.select(*KEYS, "n_runs", "root.*"), KEYS, "inner")
    # the root's own nested children are dropped when the trace has other stored runs (Q15)
    j = j.where((F.col("depth") == 0) | (F.col("n_runs") == 1) | (F.col("stored_run_id") != F.col("root_id")))
    own = F.when((F.col("error_id") == F.col("root_id")) & (F.col("depth") == 0), F.col("symbol")) \
        .when(F.col("own_symbol") != T.UNKNOWN_SYMBOL, F.col("own_symbol")).otherwise(F.col("symbol"))
    return j.withColumns({"error_symbol": own, "not_root": F.col("stored_run_id") != F.col("root_id")}).select(*FACTS)


def error_facts_file_mode(runs: DataFrame, nested: DataFrame | bool | None = None) -> DataFrame:
    """J2 + A8, file mode: every landed run stands alone, and its root is looked up among all of them.

    The run whose id is the error's ``trace_id`` is the root if its document says ``ls_run_depth`` 0; otherwise the
    run that holds the error is its own root. Of runs that landed several times the last one (by ``ord``) is looked
    up, while all of them are searched for errors. The lookup table has a row for each root, aggregated map-side;
    the join is a plain one, whose large partitions Spark splits when a trace is hot.
    """
    found = _nested_of(runs, nested)
    typed = _typed(runs)
    root = F.struct(F.col("run_symbol").alias("symbol"), F.col("name").alias("root_name"),
                    F.col("start_time").alias("root_start_time"), "run_depth")
    lookup = (typed.where("run_id IS NOT NULL").groupBy(F.col("run_id").alias("root_id")).agg(F.max_by(root, "ord").alias("r"))
              .where("r.run_depth = 0").select("root_id", "r.symbol", "r.root_name", "r.root_start_time"))
    holder = typed.select(*KEYS, "ord", F.col("run_id").alias("stored_run_id"), F.col("run_symbol").alias("holder_symbol"),
                          F.col("name").alias("holder_name"), F.col("start_time").alias("holder_time"))
    errors = _error_rows(typed, found)
    same = [errors[c].eqNullSafe(holder[c]) for c in [*KEYS, "ord", "stored_run_id"]]
    errors = errors.join(holder, functools.reduce(lambda a, b: a & b, same)).select(
        *[errors[c] for c in errors.columns], "holder_symbol", "holder_name", "holder_time")
    j = errors.join(lookup, errors["trace_id"] == lookup["root_id"], "left")
    known = F.col("root_id").isNotNull()
    own = F.when(F.col("depth") == 0, F.col("holder_symbol")).when(F.col("own_symbol") != T.UNKNOWN_SYMBOL, F.col("own_symbol")) \
        .otherwise(F.col("holder_symbol"))
    return j.withColumns({
        "error_symbol": own, "symbol": F.when(known, F.col("symbol")).otherwise(F.col("holder_symbol")),
        "root_name": F.when(known, F.col("root_name")).otherwise(F.col("holder_name")),
        "root_start_time": F.when(known, F.col("root_start_time")).otherwise(F.col("holder_time")),
        "root_id": F.coalesce("root_id", "stored_run_id"), "not_root": F.lit(False)}).select(*FACTS)


def merge_project_facts(facts: DataFrame) -> DataFrame:
    """Q18: all-projects detail; the same (day, symbol, root) in several projects keeps only the
    last project in name order (the later project's list replaces the earlier one)."""
    last = facts.groupBy("run_date", "symbol", "root_id").agg(F.max("project").alias("project"))
    return facts.join(last, ["run_date", "symbol", "root_id", "project"], "left_semi")


def detail_summary(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per symbol: errors and distinct root traces (errors_by_crypto, total_traces inputs)."""
    by = by if by is not None else ["project", "run_date"]
    return facts.groupBy(*by, "symbol").agg(
        F.count(F.lit(1)).alias("total_errors"), F.count_distinct("root_id").alias("total_traces"))


def detail_totals(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A9 summary block: total_errors, total_traces (sum of roots per symbol), crypto_symbols."""
    by = by if by is not None else ["project", "run_date"]
    s = detail_summary(facts, by)
    return s.groupBy(*by).agg(F.sum("total_errors").cast("bigint").alias("total_errors"),
                              F.sum("total_traces").cast("bigint").alias("total_traces"),
                              F.count(F.lit(1)).alias("crypto_symbols"))


def error_signatures(runs: DataFrame, predicate=None) -> DataFrame:
    """Frequency of cleaned error signatures (F3) over error runs."""
    r = runs.where(F.lower("status") == "error") if predicate is None else runs.where(predicate)
    return r.groupBy(T.clean_error(F.col("error")).alias("signature")).agg(F.count(F.lit(1)).alias("n"))
