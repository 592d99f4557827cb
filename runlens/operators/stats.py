"""Listings, lookups and storage statistics over the run table."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import variant as V

# Fixed value (must equal the run documents' key): metadata key naming a run's project.
PROJECT_METADATA_KEY = "LANGSMITH_PROJECT"


def scan(runs: DataFrame, project: str | None = None, start=None, end=None) -> DataFrame:
    """S3: runs of a project in an inclusive date range. On a table partitioned by (project, run_date)
    both predicates prune directories; nothing else is read."""
    r = runs
    if project is not None:
        r = r.where(F.col("project") == project)
    if start is not None:
        r = r.where(F.col("run_date") >= F.lit(str(start)).cast("date"))
    if end is not None or start is not None:
        r = r.where(F.col("run_date") <= F.lit(str(end or start)).cast("date"))
    return r


def inclusive_day_window(start, end=None):
    """[start 00:00, end 23:59:59.999999] as a half-open [start, end + 1 day) pair of timestamps.
    A datetime end at exactly midnight is widened to the whole day, as the reference does."""
    def as_date(x):
        if isinstance(x, _dt.datetime):
            return x.date()
        if isinstance(x, _dt.date):
            return x
        return _dt.date.fromisoformat(str(x)[:10])
    s = as_date(start)
    e = as_date(end if end is not None else start)
    return (_dt.datetime.combine(s, _dt.time()), _dt.datetime.combine(e + _dt.timedelta(days=1), _dt.time()))


def search_runs(runs: DataFrame, project: str | None = None, start=None, end=None,
                root_only: bool = True, limit: int | None = None) -> DataFrame:
    """Runs of a project whose start_time falls in the inclusive day window; roots only by default."""
    r = runs
    if project is not None:
        r = r.where(F.col("project") == project)
    if start is not None:
        lo, hi = inclusive_day_window(start, end)
        # run_date predicate lets partition pruning drop other days; start_time is exact
        r = r.where(F.col("run_date").between(F.lit(lo.date()), F.lit((hi - _dt.timedelta(days=1)).date())))
        r = r.where((F.col("start_time") >= F.lit(lo)) & (F.col("start_time") < F.lit(hi)))
    if root_only:
        r = r.where(F.col("parent_run_id").isNull())
    return r.limit(limit) if limit else r


def project_dates(runs: DataFrame, project: str | None = None) -> DataFrame:
    """Available (project, run_date) pairs; a partition listing on a partitioned table."""
    r = runs if project is None else runs.where(F.col("project") == project)
    return r.select("project", "run_date").distinct()


def projects_of_date(runs: DataFrame, run_date) -> DataFrame:
    """DISTINCT projects of a date."""
    return runs.where(F.col("run_date") == F.lit(str(run_date)).cast("date")).select("project").distinct()


def recent_runs(runs: DataFrame, project: str, start=None, end=None, limit: int | None = None) -> DataFrame:
    """L1: runs of a project, newest day first then run_id; with a limit this is a distributed
    top-k (TakeOrderedAndProject), not a global sort."""
    r = scan(runs, project, start, end) if (start or end) else runs.where(F.col("project") == project)
    if start is None and end is not None:
        r = runs.where((F.col("project") == project) & (F.col("run_date") <= F.lit(str(end)).cast("date")))
    r = r.orderBy(F.col("run_date").desc(), F.col("run_id").asc())
    return r.limit(limit) if limit else r


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    """P12 point lookup (files sorted by trace/run id within partitions keep this to few row groups)."""
    return runs.where(F.col("run_id") == run_id)


def runs_of_trace(runs: DataFrame, trace_id: str | Column) -> DataFrame:
    """All runs of one trace ordered by run_id."""
    return runs.where(F.col("trace_id") == trace_id).orderBy("run_id")


def storage_stats(runs: DataFrame, project: str | None = None) -> DataFrame:
    """total_runs, total_traces, [total_projects when unfiltered], earliest_date, latest_date."""
    r = runs if project is None else runs.where(F.col("project") == project)
    aggs = [F.count(F.lit(1)).alias("total_runs"), F.count_distinct("trace_id").alias("total_traces")]
    if project is None:
        aggs.append(F.count_distinct("project").alias("total_projects"))
    aggs += [F.min("run_date").alias("earliest_date"), F.max("run_date").alias("latest_date")]
    return r.agg(*aggs)


def storage_stats_by_project(runs: DataFrame) -> DataFrame:
    """A7 per project in one pass (the reference issues one query per project)."""
    return runs.groupBy("project").agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_distinct("trace_id").alias("total_traces"),
        F.min("run_date").alias("earliest_date"), F.max("run_date").alias("latest_date"))


def fetch_stats(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Root runs, total runs and average runs per trace (integer division, 0 without roots)."""
    by = by if by is not None else ["project", "run_date"]
    g = runs.groupBy(*by).agg(F.count_if(F.col("parent_run_id").isNull()).alias("root_runs_fetched"),
                              F.count(F.lit(1)).alias("total_runs_fetched"))
    return g.withColumn("avg_runs_per_trace",
                        F.when(F.col("root_runs_fetched") > 0,
                               F.expr("total_runs_fetched div root_runs_fetched")).otherwise(F.lit(0).cast("bigint")))


def resolve_trace_project(runs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Per trace, the first run's (by ord) extra.metadata.<PROJECT_METADATA_KEY> if any run has the
    key, else the first run's session_id, else 'unknown'."""
    doc = F.col(doc_col)
    meta = V.obj_or_empty(V.obj_or_empty(doc, "$.extra"), "$.metadata")
    path = "$." + PROJECT_METADATA_KEY
    has = V.present(meta, path)
    pval = V.text_at(meta, path)
    sess_present = V.present(doc, "$.session_id")
    sess = F.when(sess_present, V.as_string(doc, "$.session_id")).otherwise(F.lit("unknown"))
    g = runs.groupBy("trace_id").agg(
        F.min_by(pval, F.when(has, F.col("ord"))).alias("_p"),
        F.max(has).alias("_has"),
        F.min_by(sess, F.col("ord")).alias("_s"))
    return g.select("trace_id", F.when(F.col("_has"), F.col("_p")).otherwise(F.col("_s")).alias("resolved_project"))
