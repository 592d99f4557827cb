"""Driver query catalog: each entry runs a runlens operator over the whole derived tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> DuckDB SQL``. Outputs are flat
scalar columns (dates as ISO strings) so that both engines hash the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import text as T
from runlens.operators import errors as E
from runlens.plans import oracle as O
from runlens.sources import fixtures as FX

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _d(c: str = "run_date"):
    return F.col(c).cast("string").alias(c)


RUNS = O.RUNS_CTE
FB = O.FEEDBACK_CTE
URLS = O.URL_EXAMPLES_CTE


# ----------------------------------------------------------------------------- error reports
@register("daily_error_report", O.with_ctes(f"""
SELECT project, CAST(run_date AS VARCHAR) AS run_date, CAST(count(*) AS BIGINT) AS total_traces,
       CAST(sum(n_err) AS BIGINT) AS zenrows_errors, {O.rate('sum(n_err)', 'count(*)')} AS error_rate
FROM (SELECT project, run_date, trace_id, count(*) FILTER (WHERE {O.rate_error()}) AS n_err
      FROM runs WHERE trace_id IS NOT NULL GROUP BY ALL) t
GROUP BY project, run_date""", RUNS))
def q_daily_error_report(spark: SparkSession, sf: str) -> DataFrame:
    rep = E.daily_error_report(FX.runs(spark, sf))
    return rep.select("project", _d(), "total_traces", "zenrows_errors", "error_rate")


@register("daily_error_report_rootmode", O.with_ctes(f"""
SELECT project, CAST(run_date AS VARCHAR) AS run_date,
       CAST(count(*) FILTER (WHERE parent_run_id IS NULL) AS BIGINT) AS total_traces,
       CAST(count(*) FILTER (WHERE {O.rate_error()}) AS BIGINT) AS zenrows_errors,
       {O.rate('count(*) FILTER (WHERE ' + O.rate_error() + ')', 'count(*) FILTER (WHERE parent_run_id IS NULL)')} AS error_rate
FROM runs GROUP BY project, run_date""", RUNS))
def q_daily_error_report_rootmode(spark: SparkSession, sf: str) -> DataFrame:
    rep = E.daily_error_report_rootmode(FX.runs(spark, sf))
    return rep.select("project", _d(), "total_traces", "zenrows_errors", "error_rate")


_ALL_PROJECTS_SQL = f"""
daily AS (
  SELECT run_date, CAST(sum(nt) AS BIGINT) AS total_traces, CAST(sum(ne) AS BIGINT) AS zenrows_errors
  FROM (SELECT project, run_date, count(*) AS nt, sum(n_err) AS ne
        FROM (SELECT project, run_date, trace_id, count(*) FILTER (WHERE {O.rate_error()}) AS n_err
              FROM runs WHERE trace_id IS NOT NULL GROUP BY ALL) t GROUP BY ALL) p
  GROUP BY run_date),
rated AS (SELECT *, {O.rate('zenrows_errors', 'total_traces')} AS error_rate FROM daily)"""


@register("error_report_all_projects", O.with_ctes("""
SELECT CAST(run_date AS VARCHAR) AS run_date, total_traces, zenrows_errors, error_rate FROM rated""",
                                                   RUNS, _ALL_PROJECTS_SQL))
def q_error_report_all_projects(spark: SparkSession, sf: str) -> DataFrame:
    rep = E.merge_projects(E.daily_error_report(FX.runs(spark, sf)))
    return rep.select(_d(), "total_traces", "zenrows_errors", "error_rate")


@register("error_summary", O.with_ctes(f"""
SELECT CAST(count(*) AS BIGINT) AS total_days, CAST(sum(total_traces) AS BIGINT) AS total_traces,
       CAST(sum(zenrows_errors) AS BIGINT) AS total_zenrows_errors,
       {O.rate('sum(zenrows_errors)', 'sum(total_traces)')} AS overall_error_rate,
       CAST(first(run_date ORDER BY error_rate DESC, run_date ASC) AS VARCHAR) AS worst_day,
       CAST(first(run_date ORDER BY error_rate ASC, run_date ASC) FILTER (WHERE error_rate < 101) AS VARCHAR) AS best_day
FROM rated""", RUNS, _ALL_PROJECTS_SQL))
def q_error_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.summary_stats(E.merge_projects(E.daily_error_report(FX.runs(spark, sf))))


# ----------------------------------------------------------------------------- scalars
@register("symbol_of_run", O.with_ctes(f"""
SELECT run_id, {O.symbol_scan()} AS symbol FROM runs""", RUNS))
def q_symbol_of_run(spark: SparkSession, sf: str) -> DataFrame:
    r = FX.runs(spark, sf)
    return r.select("run_id", T.crypto_symbol(None, F.col("name"), F.col("error")).alias("symbol"))


@register("error_signatures", O.with_ctes(f"""
SELECT {O.clean_error()} AS signature, CAST(count(*) AS BIGINT) AS n
FROM runs WHERE lower(status) = 'error' GROUP BY 1""", RUNS))
def q_error_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return E.error_signatures(FX.runs(spark, sf))


# ----------------------------------------------------------------------------- error hierarchy
_FACTS_SQL = f"""
sym AS (SELECT *, {O.symbol_scan()} AS run_symbol FROM runs WHERE trace_id IS NOT NULL),
roots AS (
  SELECT project, run_date, trace_id,
         arg_max(run_id, (CASE WHEN run_id = trace_id THEN 1 ELSE 0 END, -ord)) AS root_id,
         arg_max(run_symbol, (CASE WHEN run_id = trace_id THEN 1 ELSE 0 END, -ord)) AS symbol
  FROM sym GROUP BY ALL),
facts AS (
  SELECT s.project, s.run_date, s.trace_id, r.symbol, r.root_id, s.run_id AS error_id,
         CASE WHEN s.run_id = r.root_id THEN r.symbol WHEN s.run_symbol <> 'Unknown' THEN s.run_symbol
              ELSE r.symbol END AS error_symbol,
         s.error AS error_message, strftime(s.start_time, '%Y-%m-%dT%H:%M:%S.%f') AS start_time, s.name
  FROM sym s JOIN roots r USING (project, run_date, trace_id)
  WHERE {O.detail_error('s.name', 's.status')})"""


@register("error_detail", O.with_ctes("""
SELECT project, CAST(run_date AS VARCHAR) AS run_date, trace_id, symbol, root_id, error_id, error_symbol,
       error_message, start_time, name FROM facts""", RUNS, _FACTS_SQL))
def q_error_detail(spark: SparkSession, sf: str) -> DataFrame:
    f = E.error_facts(FX.runs(spark, sf))
    return f.select("project", _d(), "trace_id", "symbol", "root_id", "error_id", "error_symbol",
                    "error_message", "start_time", "name")


@register("error_detail_summary", O.with_ctes("""
SELECT project, CAST(run_date AS VARCHAR) AS run_date, symbol, CAST(count(*) AS BIGINT) AS total_errors,
       CAST(count(DISTINCT root_id) AS BIGINT) AS total_traces
FROM facts GROUP BY ALL""", RUNS, _FACTS_SQL))
def q_error_detail_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = E.detail_summary(E.error_facts(FX.runs(spark, sf)))
    return s.select("project", _d(), "symbol", "total_errors", "total_traces")


# ----------------------------------------------------------------------------- stats & listings
from runlens.operators import stats as S  # noqa: E402
from runlens.operators import evaluation as EV  # noqa: E402


@register("storage_stats", O.with_ctes("""
SELECT CAST(count(*) AS BIGINT) AS total_runs, CAST(count(DISTINCT trace_id) AS BIGINT) AS total_traces,
       CAST(count(DISTINCT project) AS BIGINT) AS total_projects,
       CAST(min(run_date) AS VARCHAR) AS earliest_date, CAST(max(run_date) AS VARCHAR) AS latest_date
FROM runs""", RUNS))
def q_storage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.storage_stats(FX.runs(spark, sf)).select(
        "total_runs", "total_traces", "total_projects", _d("earliest_date"), _d("latest_date"))


@register("storage_stats_by_project", O.with_ctes("""
SELECT project, CAST(count(*) AS BIGINT) AS total_runs, CAST(count(DISTINCT trace_id) AS BIGINT) AS total_traces,
       CAST(min(run_date) AS VARCHAR) AS earliest_date, CAST(max(run_date) AS VARCHAR) AS latest_date
FROM runs GROUP BY project""", RUNS))
def q_storage_stats_by_project(spark: SparkSession, sf: str) -> DataFrame:
    return S.storage_stats_by_project(FX.runs(spark, sf)).select(
        "project", "total_runs", "total_traces", _d("earliest_date"), _d("latest_date"))


@register("project_dates", O.with_ctes("""
SELECT DISTINCT project, CAST(run_date AS VARCHAR) AS run_date FROM runs""", RUNS))
def q_project_dates(spark: SparkSession, sf: str) -> DataFrame:
    return S.project_dates(FX.runs(spark, sf)).select("project", _d())


@register("recent_runs", O.with_ctes("""
SELECT run_id, trace_id, project, CAST(run_date AS VARCHAR) AS run_date FROM runs
WHERE project = 'proj0' ORDER BY run_date DESC, run_id LIMIT 100""", RUNS))
def q_recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    # L1 is a top-k listing: the limit is the feature (newest 100 runs of a project)
    return S.recent_runs(FX.runs(spark, sf), "proj0", limit=100).select("run_id", "trace_id", "project", _d())


@register("runs_per_trace", O.with_ctes("""
SELECT project, CAST(run_date AS VARCHAR) AS run_date,
       CAST(count(*) FILTER (WHERE parent_run_id IS NULL) AS BIGINT) AS root_runs_fetched,
       CAST(count(*) AS BIGINT) AS total_runs_fetched,
       CAST(CASE WHEN count(*) FILTER (WHERE parent_run_id IS NULL) > 0
                 THEN count(*) // count(*) FILTER (WHERE parent_run_id IS NULL) ELSE 0 END AS BIGINT) AS avg_runs_per_trace
FROM runs GROUP BY project, run_date""", RUNS))
def q_runs_per_trace(spark: SparkSession, sf: str) -> DataFrame:
    return S.fetch_stats(FX.runs(spark, sf)).select(
        "project", _d(), "root_runs_fetched", "total_runs_fetched", "avg_runs_per_trace")


@register("search_root_runs", O.with_ctes("""
SELECT run_id, strftime(start_time, '%Y-%m-%d %H:%M:%S.%f') AS start_time FROM runs
WHERE project = 'proj1' AND start_time >= TIMESTAMP '2024-01-03 00:00:00' AND start_time < TIMESTAMP '2024-01-06 00:00:00'
  AND parent_run_id IS NULL""", RUNS))
def q_search_root_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = S.search_runs(FX.runs(spark, sf), "proj1", "2024-01-03", "2024-01-05", root_only=True)
    return r.select("run_id", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_time"))


@register("trace_project", O.with_ctes("""
SELECT trace_id, coalesce(arg_min(project, ord) FILTER (WHERE ord % 8 = 6),
                          arg_min('sess' || CAST(u % 4 AS VARCHAR), ord)) AS resolved_project
FROM runs GROUP BY trace_id""", RUNS))
def q_trace_project(spark: SparkSession, sf: str) -> DataFrame:
    return S.resolve_trace_project(FX.run_documents(spark, sf))


# ----------------------------------------------------------------------------- feedback & evaluation
@register("feedback_enrichment", O.with_ctes("""
SELECT r.run_id, r.trace_id, CAST(count(f.run_id) AS BIGINT) AS n_feedback,
       CAST(count(*) FILTER (WHERE f.verdict = 'PASS') AS BIGINT) AS n_pass
FROM runs r LEFT JOIN feedback f USING (run_id) GROUP BY r.run_id, r.trace_id""", RUNS, FB))
def q_feedback_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    j = EV.attach_feedback(FX.runs(spark, sf).select("run_id", "trace_id"), FX.feedback(spark, sf))
    return j.select("run_id", "trace_id", F.size("feedback_records").cast("bigint").alias("n_feedback"),
                    F.size(F.filter("feedback_records", lambda x: x["verdict"] == "PASS")).cast("bigint").alias("n_pass"))


@register("qualified_traces", O.with_ctes("""
SELECT trace_id, project, CAST(run_date AS VARCHAR) AS run_date, true AS has_ai_output,
       bool_or(verdict IS NOT NULL) AS has_human_feedback
FROM rf GROUP BY trace_id, project, run_date HAVING bool_or(meets_strict)""", RUNS, FB, O.run_fields_cte()))
def q_qualified_traces(spark: SparkSession, sf: str) -> DataFrame:
    t = EV.qualified_traces(FX.run_documents(spark, sf))
    return t.select("trace_id", "project", _d(), "has_ai_output", "has_human_feedback")


@register("dedup_requests", O.with_ctes("""
SELECT request_id AS dedup_key, first(trace_id ORDER BY start_time, ord) AS trace_id,
       min(start_time) AS start_time, CAST(first(runs_processed ORDER BY start_time, ord) AS BIGINT) AS runs_processed
FROM (SELECT trace_id, min(strftime(start_time, '%Y-%m-%dT%H:%M:%S.%fZ')) AS start_time,
             arg_min(request_id, ord) AS request_id, min(ord) AS ord, count(*) AS runs_processed
      FROM runs GROUP BY trace_id) t
WHERE trace_id IN (SELECT trace_id FROM rf GROUP BY trace_id HAVING bool_or(meets_strict))
GROUP BY request_id""", RUNS, FB, O.run_fields_cte()))
def q_dedup_requests(spark: SparkSession, sf: str) -> DataFrame:
    t = EV.dedup_by_request(EV.file_trace_summary(FX.run_documents(spark, sf)))
    return t.select("dedup_key", "trace_id", "start_time", F.col("runs_processed").cast("bigint"))


_KEPT_SQL = """
kept AS (SELECT rf.* FROM rf JOIN (SELECT trace_id, project, run_date FROM rf GROUP BY ALL HAVING bool_or(meets_strict)) q
         USING (trace_id, project, run_date))"""


def _last(f: str, cond: str | None = None) -> str:
    c = f"{f}_p" if cond is None else cond
    return f"arg_max({f}, ord) FILTER (WHERE {c})"


@register("dataset_token_name", O.with_ctes(f"""
SELECT trace_id, project, CAST(run_date AS VARCHAR) AS run_date,
       coalesce({_last('name_v', 'name_p')}, '') AS name, coalesce({_last('symbol')}, '') AS symbol,
       coalesce({_last('description')}, '') AS description,
       arg_max(is_meme, ord) AS is_meme, arg_max(is_explicit, ord) AS is_explicit,
       arg_max(has_conflict, ord) AS has_conflict, CAST(count(*) AS BIGINT) AS runs_count
FROM rf GROUP BY trace_id, project, run_date HAVING bool_or(meets_strict)""", RUNS, FB, O.run_fields_cte()))
def q_dataset_token_name(spark: SparkSession, sf: str) -> DataFrame:
    return EV.build_dataset(FX.run_documents(spark, sf), "token_name").withColumn("run_date", F.col("run_date").cast("string")).drop("reference", "inputs_json")


@register("dataset_website", O.with_ctes(f"""
SELECT trace_id, project, CAST(run_date AS VARCHAR) AS run_date,
       coalesce({_last('name_v', 'name_p')}, '') AS name, coalesce({_last('symbol')}, '') AS symbol,
       '' AS network, coalesce({_last('description')}, '') AS description,
       coalesce({_last('website_url')}, '') AS website_url, {O.MERGED_PROFILES} AS social_profiles, '' AS contract_address,
       arg_max(is_meme, ord) AS is_meme, arg_max(is_explicit, ord) AS is_explicit,
       coalesce({_last('is_available')}, true) AS is_available,
       coalesce({_last('is_malicious')}, false) AS is_malicious,
       arg_max(has_conflict, ord) AS has_trademark_conflict, CAST(count(*) AS BIGINT) AS runs_count
FROM rf GROUP BY trace_id, project, run_date HAVING bool_or(meets_strict)""", RUNS, FB, O.run_fields_cte()))
def q_dataset_website(spark: SparkSession, sf: str) -> DataFrame:
    return EV.build_dataset(FX.run_documents(spark, sf), "website").withColumn("run_date", F.col("run_date").cast("string")).drop("reference", "inputs_json")


@register("dataset_availability", O.with_ctes("""
SELECT trace_id, project, CAST(run_date AS VARCHAR) AS run_date,
       coalesce(arg_max(website_url, prio) FILTER (WHERE website_url_p), '') AS website_url,
       coalesce(arg_min(is_available, prio) FILTER (WHERE is_available_p), false) AS is_available,
       coalesce(arg_min(notes, prio), '') AS notes, CAST(count(*) AS BIGINT) AS runs_count
FROM rf GROUP BY trace_id, project, run_date HAVING bool_or(meets_avail)""", RUNS, FB, O.run_fields_cte()))
def q_dataset_availability(spark: SparkSession, sf: str) -> DataFrame:
    return EV.build_dataset(FX.run_documents(spark, sf), "availability").withColumn("run_date", F.col("run_date").cast("string")).drop("reference", "inputs_json")


@register("dataset_website_lines", O.with_ctes(f"""
SELECT trace_id, project, CAST(run_date AS VARCHAR) AS run_date,
       '{{"inputs":{{"name":' || to_json(coalesce({_last('name_v', 'name_p')}, '')) || ',"symbol":'
       || to_json(coalesce({_last('symbol')}, '')) || ',"network":"","description":' || to_json(coalesce({_last('description')}, ''))
       || ',"website_url":' || to_json(coalesce({_last('website_url')}, '')) || ',"social_profiles":' || {O.MERGED_PROFILES}
       || ',"contract_address":""}},"outputs":{{"is_meme":' || arg_max(is_meme, ord) || ',"is_explicit":' || arg_max(is_explicit, ord)
       || ',"is_available":' || coalesce({_last('is_available')}, true) || ',"is_malicious":' || coalesce({_last('is_malicious')}, false)
       || ',"has_trademark_conflict":' || arg_max(has_conflict, ord) || '}},"metadata":{{"trace_id":"' || trace_id || '","project":"'
       || project || '","date":"' || CAST(run_date AS VARCHAR) || '","eval_type":"website"}}}}' AS line
FROM rf GROUP BY trace_id, project, run_date HAVING bool_or(meets_strict)""", RUNS, FB, O.run_fields_cte()))
def q_dataset_website_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = SK.dataset_lines(EV.build_dataset(FX.run_documents(spark, sf), "website"), "website")
    return lines.select("trace_id", "project", _d(), "line")


@register("dataset_file_mode", O.with_ctes(f"""
SELECT trace_id, project, CAST(run_date AS VARCHAR) AS run_date,
       coalesce({_last('name_v', 'name_p')}, '') AS name, coalesce({_last('symbol')}, '') AS symbol,
       coalesce({_last('description')}, '') AS description,
       arg_max(is_meme, ord) AS is_meme, arg_max(is_explicit, ord) AS is_explicit,
       arg_max(has_conflict, ord) AS has_conflict, CAST(count(*) AS BIGINT) AS runs_count
FROM kept WHERE trace_id IN (
  SELECT first(trace_id ORDER BY st, o) FROM (
    SELECT trace_id, min(strftime(start_time, '%Y-%m-%dT%H:%M:%S.%fZ')) AS st, arg_min(request_id, ord) AS rid, min(ord) AS o
    FROM kept GROUP BY trace_id) GROUP BY rid)
GROUP BY trace_id, project, run_date""", RUNS, FB, O.run_fields_cte(), _KEPT_SQL))
def q_dataset_file_mode(spark: SparkSession, sf: str) -> DataFrame:
    d = EV.build_dataset_file_mode(FX.run_documents(spark, sf), "token_name")
    return d.select("trace_id", "project", _d(), "name", "symbol", "description", "is_meme", "is_explicit",
                    "has_conflict", "runs_count")


# ----------------------------------------------------------------------------- URLs & curation
from runlens.operators import curation as C  # noqa: E402


@register("url_features", O.with_ctes(f"""
SELECT pos, {O.normalize_url('website_url')} AS norm_url, {O.url_domain('website_url')} AS domain,
       CAST({O.quality('website_url', 'is_available', 'notes')} AS INTEGER) AS score FROM url_examples""", URLS))
def q_url_features(spark: SparkSession, sf: str) -> DataFrame:
    return C.annotate(FX.url_examples(spark, sf)).select("pos", "norm_url", "domain", "score")


@register("curate_best_100", O.with_ctes("""
SELECT * FROM curated""", URLS, O.CURATION_CTE))
def q_curate_best_100(spark: SparkSession, sf: str) -> DataFrame:
    return C.curate(FX.url_examples(spark, sf), target_size=100)


@register("curation_stats", O.with_ctes("""
SELECT CAST(count(*) AS BIGINT) AS total_examples,
       CAST(count(*) FILTER (WHERE NOT coalesce(is_available, false)) AS BIGINT) AS negative_examples,
       CAST(count(*) FILTER (WHERE coalesce(is_available, false)) AS BIGINT) AS positive_examples,
       CAST(count(DISTINCT domain) FILTER (WHERE coalesce(is_available, false)) AS BIGINT) AS unique_domains,
       CASE WHEN count(*) FILTER (WHERE coalesce(is_available, false)) > 0 THEN
            count(DISTINCT domain) FILTER (WHERE coalesce(is_available, false))
            / count(*) FILTER (WHERE coalesce(is_available, false)) END AS diversity_ratio
FROM curated""", URLS, O.CURATION_CTE))
def q_curation_stats(spark: SparkSession, sf: str) -> DataFrame:
    return C.curation_stats(C.curate(FX.url_examples(spark, sf), target_size=100))


@register("curate_target_300", O.with_ctes("""
SELECT * FROM curated""", URLS, O.CURATION_CTE.replace("100 - (SELECT count(*) FROM negs)", "300 - (SELECT count(*) FROM negs)")))
def q_curate_target_300(spark: SparkSession, sf: str) -> DataFrame:
    # same operator with a larger target so that the positive ranking (W3, W4, L2) is exercised
    return C.curate(FX.url_examples(spark, sf), target_size=300)


# ----------------------------------------------------------------------------- nesting, upsert, quality, sinks
from runlens.operators import quality as Q  # noqa: E402
from runlens.sources import runtable as RT  # noqa: E402
from runlens.sources import sinks as SK  # noqa: E402


@register("flatten_children", O.with_ctes("""
SELECT run_id AS stored_run_id, 1 AS depth, run_id || '-c1' AS id, name || '_retry' AS name, status FROM runs
UNION ALL
SELECT run_id, 2, run_id || '-c2', 'zenrows_scraper_inner', CASE WHEN u % 2 = 0 THEN 'error' ELSE 'success' END FROM runs
""", RUNS))
def q_flatten_children(spark: SparkSession, sf: str) -> DataFrame:
    f = E.flatten_children(FX.nested_run_documents(spark, sf))
    return f.select("stored_run_id", "depth", "id", "name", "status")


@register("daily_error_report_nested", O.with_ctes(f"""
SELECT project, CAST(run_date AS VARCHAR) AS run_date, CAST(count(*) AS BIGINT) AS total_traces,
       CAST(sum(n_err) AS BIGINT) AS zenrows_errors, {O.rate('sum(n_err)', 'count(*)')} AS error_rate
FROM (SELECT project, run_date, trace_id,
             count(*) FILTER (WHERE {O.rate_error()})
             + count(*) FILTER (WHERE {O.rate_error()} AND (n_runs = 1 OR run_id <> root_id))
             + count(*) FILTER (WHERE u % 2 = 0 AND (n_runs = 1 OR run_id <> root_id)) AS n_err
      FROM (SELECT *, count(*) OVER w AS n_runs,
                   arg_max(run_id, (CASE WHEN run_id = trace_id THEN 1 ELSE 0 END, -ord)) OVER w AS root_id
            FROM runs WINDOW w AS (PARTITION BY project, run_date, trace_id)) x
      GROUP BY ALL) t
GROUP BY project, run_date""", RUNS))
def q_daily_error_report_nested(spark: SparkSession, sf: str) -> DataFrame:
    # as ingest does it: nested runs are typed once, the report reads no documents
    rep = E.daily_error_report(FX.runs(spark, sf), nested=E.nested_runs(FX.nested_run_documents(spark, sf)))
    return rep.select("project", _d(), "total_traces", "zenrows_errors", "error_rate")


@register("upsert_latest", O.with_ctes("""
SELECT run_id, trace_id, project, CAST(run_date AS VARCHAR) AS run_date, status, error, ingest_seq,
       strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM (SELECT *, min(created_at) OVER (PARTITION BY run_id) AS first_created FROM log) l
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ingest_seq DESC) = 1""".replace(
    "strftime(created_at,", "strftime(first_created,"), RUNS, """
log AS (
  SELECT run_id, trace_id, project, run_date, status, error, ord AS ingest_seq, start_time AS created_at FROM runs
  UNION ALL
  SELECT run_id, trace_id, project, run_date, 'success', NULL, 1000000000000 + ord, start_time + INTERVAL 1 HOUR
  FROM runs JOIN events ON CAST(events.event_id AS VARCHAR) = runs.run_id WHERE events.event_type = 'error')"""))
def q_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    t = RT.latest(FX.run_log(spark, sf))
    return t.select("run_id", "trace_id", "project", _d(), "status", "error", "ingest_seq",
                    F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))


@register("consistency_check", O.with_ctes("""
SELECT project, CAST(count(*) AS BIGINT) AS n_runs, CAST(0 AS BIGINT) AS run_id_mismatch,
       CAST(0 AS BIGINT) AS trace_id_mismatch, CAST(0 AS BIGINT) AS project_mismatch, CAST(0 AS BIGINT) AS run_date_mismatch
FROM runs GROUP BY project""", RUNS))
def q_consistency_check(spark: SparkSession, sf: str) -> DataFrame:
    return Q.consistency_violations(FX.run_documents(spark, sf))


@register("error_report_csv", O.with_ctes("""
SELECT CAST(run_date AS VARCHAR) AS date,
       CAST(run_date AS VARCHAR) || ',' || CAST(total_traces AS VARCHAR) || ',' || CAST(zenrows_errors AS VARCHAR)
       || ',' || printf('%.1f', error_rate) || '%' AS line
FROM rated""", RUNS, _ALL_PROJECTS_SQL))
def q_error_report_csv(spark: SparkSession, sf: str) -> DataFrame:
    return SK.csv_lines(E.merge_projects(E.daily_error_report(FX.runs(spark, sf))))


# ----------------------------------------------------------------------------- detail reports, file mode, versions
import datetime as dt  # noqa: E402
import os  # noqa: E402
import uuid  # noqa: E402

from pyspark.sql import Column  # noqa: E402

from runlens.session import checkpoint_dir, staged  # noqa: E402
from runlens.sources import reports as R  # noqa: E402
from runlens.sources import versions as VT  # noqa: E402

_TREE_SQL = f"""
sym AS (SELECT *, {O.symbol_scan()} AS run_symbol FROM runs WHERE trace_id IS NOT NULL),
roots AS (
  SELECT project, run_date, trace_id, count(*) AS n_runs,
         arg_max(run_id, (CASE WHEN run_id = trace_id THEN 1 ELSE 0 END, -ord)) AS root_id,
         arg_max(run_symbol, (CASE WHEN run_id = trace_id THEN 1 ELSE 0 END, -ord)) AS symbol
  FROM sym GROUP BY ALL),
errs AS (
  SELECT *, run_id AS error_id, run_symbol AS own, error AS message, name AS error_name, 0 AS d, NULL AS url,
         strftime(start_time, '%Y-%m-%dT%H:%M:%S.%f') AS st FROM sym WHERE {O.detail_error()}
  UNION ALL
  SELECT *, run_id || '-c1', {O.symbol_scan("name || '_retry'", "error")}, error, name || '_retry', 1,
         CASE WHEN u % 3 = 0 THEN 'https://t' || (u % 5) || '.example' END, NULL
  FROM sym WHERE {O.detail_error("name || '_retry'", "status")}
  UNION ALL
  SELECT *, run_id || '-c2', {O.symbol_scan("'zenrows_scraper_inner'", "CAST(NULL AS VARCHAR)")}, NULL,
         'zenrows_scraper_inner', 2, NULL, NULL FROM sym WHERE u % 2 = 0),
tree AS (
  SELECT e.*, r.symbol, r.root_id, e.run_id <> r.root_id AS not_root,
         CASE WHEN e.d = 0 AND e.run_id = r.root_id THEN r.symbol WHEN e.own <> 'Unknown' THEN e.own ELSE r.symbol END AS error_symbol
  FROM errs e JOIN roots r USING (project, run_date, trace_id)
  WHERE e.d = 0 OR r.n_runs = 1 OR e.run_id <> r.root_id)"""


def _nested_facts(spark: SparkSession, sf: str) -> DataFrame:
    return E.error_facts(FX.runs(spark, sf), nested=E.nested_runs(FX.nested_run_documents(spark, sf)))


@register("error_hierarchy_lines", O.with_ctes(f"""
SELECT symbol, 0 AS tail, '' AS root_id, 0 AS level, CAST(NULL AS BOOLEAN) AS not_root, CAST(NULL AS BIGINT) AS ord,
       CAST(NULL AS INTEGER) AS depth, 0 AS line_no, symbol || ':' AS line FROM tree GROUP BY symbol
UNION ALL SELECT symbol, 1, '', 0, NULL, NULL, NULL, 0, '' FROM tree GROUP BY symbol
UNION ALL SELECT symbol, 0, root_id, 1, NULL, NULL, NULL, 0, '  ' || root_id || ':' FROM tree GROUP BY symbol, root_id
UNION ALL SELECT symbol, 0, root_id, 2, not_root, ord, d, 0, '    Error: ' || {O.clean_error('message')} FROM tree
UNION ALL SELECT symbol, 0, root_id, 2, not_root, ord, d, 1,
       '      Time: ' || coalesce(strftime(start_time, '%Y-%m-%d %H:%M:%S') || CASE WHEN st IS NULL THEN NULL ELSE ' UTC' END, '') FROM tree
UNION ALL SELECT symbol, 0, root_id, 2, not_root, ord, d, 2, '      URL: ' || coalesce(url, '') FROM tree""", RUNS, _TREE_SQL))
def q_error_hierarchy_lines(spark: SparkSession, sf: str) -> DataFrame:
    return R.hierarchy_lines(_nested_facts(spark, sf)).select(
        "symbol", "tail", "root_id", "level", "place.not_root", F.col("place.ord").cast("long").alias("ord"),
        F.when(F.col("place").isNotNull(), F.size("place.place")).alias("depth"), "line_no", "line")


@register("error_detail_documents", O.with_ctes("""
SELECT symbol, root_id, not_root, ord, d AS depth,
       CAST(to_json({'trace_id': error_id, 'root_trace_id': root_id, 'crypto_symbol': error_symbol, 'error_message': message,
                     'start_time': st, 'target_url': url, 'name': error_name}) AS VARCHAR) AS document FROM tree""", RUNS, _TREE_SQL))
def q_error_detail_documents(spark: SparkSession, sf: str) -> DataFrame:
    return R.error_documents(_nested_facts(spark, sf)).select(
        "symbol", "root_id", "not_root", "ord", F.size("place").alias("depth"), "document")


def _document_symbol(scan: str) -> str:
    return f"""CASE ord % 8 WHEN 0 THEN 'S' || (u % 7) WHEN 4 THEN 'SITE' || (u % 11) ELSE {scan} END"""


@register("error_detail_file_mode", O.with_ctes(f"""
SELECT s.project, CAST(s.run_date AS VARCHAR) AS run_date, s.run_id AS error_id, s.symbol AS error_symbol,
       CASE WHEN r.run_id IS NULL THEN s.symbol ELSE r.symbol END AS symbol, coalesce(r.run_id, s.run_id) AS root_id,
       CASE WHEN r.run_id IS NULL THEN s.name ELSE r.name END AS root_name
FROM sym s LEFT JOIN sym r ON r.run_id = s.trace_id AND r.ord % 8 = 0 AND r.u % 9 <> 0
WHERE {O.detail_error('s.name', 's.status')}""", RUNS, f"""
sym AS (SELECT *, {_document_symbol(O.symbol_scan())} AS symbol FROM runs)"""))
def q_error_detail_file_mode(spark: SparkSession, sf: str) -> DataFrame:
    f = E.error_facts_file_mode(FX.run_documents(spark, sf), nested=False)
    return f.select("project", _d(), "error_id", "error_symbol", "symbol", "root_id", "root_name")


def _moved(project: Column) -> Column:
    return F.when(F.col("run_id").cast("long") % 3 == 0, F.concat(project, F.lit("m"))).otherwise(project)


@register("merge_versions", O.with_ctes("""
SELECT run_id, trace_id, project, CAST(run_date AS VARCHAR) AS run_date, status, error,
       strftime(first_created, '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM (SELECT *, min(created_at) OVER (PARTITION BY run_id) AS first_created FROM log) l
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) = 1""", RUNS, """
log AS (
  SELECT run_id, trace_id, project, run_date, status, error, ord AS seq, start_time AS created_at FROM runs
  UNION ALL
  SELECT run_id, trace_id, CASE WHEN ord % 3 = 0 THEN project || 'm' ELSE project END, run_date, 'success', NULL,
         1000000000000 + ord, start_time + INTERVAL 1 HOUR FROM runs WHERE status = 'error')"""))
def q_merge_versions(spark: SparkSession, sf: str) -> DataFrame:
    # two ingest batches, merged one after the other; the second moves runs to other projects
    log = staged(FX.run_log(spark, sf), "run-log")
    base = os.path.join(checkpoint_dir(spark), f"versions-{uuid.uuid4().hex}")
    second = F.col("ingest_seq") >= 10 ** 12
    batches = (log.where(~second), log.where(second).withColumn("project", _moved(F.col("project"))))
    for number, rows in enumerate(batches, 1):
        RT.append_batch(rows, f"{base}/log", number)
        VT.merge_batches(spark, f"{base}/log", f"{base}/table")
    return VT.read_version(spark, f"{base}/table").select(
        "run_id", "trace_id", "project", _d(), "status", "error",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))


# ----------------------------------------------------------------------------- landed files, times, schema
from runlens.functions import times as X  # noqa: E402
from runlens.sources import landing as L  # noqa: E402
from runlens.sources import records as REC  # noqa: E402


def _uuid_sql(number: str) -> str:
    return f"'00000000-0000-4000-8000-' || lpad(CAST({number} AS VARCHAR), 12, '0')"


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    """The stand-in files, written once as a landing area is; their text is parsed when they are read."""
    files = FX.landed_files(spark, sf)
    return staged(files, "landed-files").withColumn("v", F.try_parse_json("text")).drop("text")


@register("landing_records", O.with_ctes(f"""
SELECT {_uuid_sql('ord')} AS run_id, CASE WHEN ord % 10 = 4 THEN {_uuid_sql('ord')} ELSE {_uuid_sql('ord - ord % 8')} END AS trace_id,
       '#' || project || '!' AS project, CAST(run_date AS VARCHAR) AS run_date,
       CASE ord % 10 WHEN 0 THEN 'enhanced' WHEN 1 THEN 'wrapped' ELSE 'bare' END AS format,
       CASE WHEN ord % 10 = 9 THEN 'refetched' ELSE status END AS status, error, 'chain' AS run_type,
       CASE WHEN ord % 10 <> 7 THEN strftime(start_time, '%Y-%m-%d %H:%M:%S.%f') END AS start_time,
       CAST(u AS BIGINT) AS total_tokens, CASE WHEN u % 2 = 0 THEN printf('0.%03d000000000', u % 1000) END AS total_cost,
       CASE WHEN u % 2 = 1 THEN printf('0.%03d000000000', u % 1000) END AS prompt_cost,
       CASE WHEN u % 2 = 0 THEN 't,' || (u % 5) ELSE '' END AS tags, CASE WHEN u % 3 = 0 THEN u % 6 = 0 END AS in_dataset,
       '{{"input_data":{{"request_id":"' || request_id || '"}}}}' AS inputs, '{{}}' AS outputs, '{{}}' AS extra, '[]' AS events,
       CASE WHEN ord % 10 = 0 THEN {_uuid_sql('ord + 1')} ELSE '' END AS child_run_ids,
       CASE WHEN ord % 10 = 0 THEN '[{{"score":1}}]' END AS feedback_records
FROM runs WHERE ord % 10 NOT IN (2, 3, 6, 8)""", RUNS))
def q_landing_records(spark: SparkSession, sf: str) -> DataFrame:
    landed = L.landed_records(_landed(spark, sf)).where("reason IS NULL").drop("reason")
    r = REC.typed_records(L.latest_file_per_run(landed))
    free = [F.to_json(c).alias(c) for c in ("inputs", "outputs", "extra", "events", "feedback_records")]
    return r.select(
        "run_id", "trace_id", "project", _d(), "format", "status", "error", "run_type",
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_time"), "total_tokens",
        F.col("total_cost").cast("string").alias("total_cost"), F.col("prompt_cost").cast("string").alias("prompt_cost"),
        F.array_join("tags", ",").alias("tags"), "in_dataset", F.array_join("child_run_ids", ",").alias("child_run_ids"), *free)


@register("landing_write_manifest", O.with_ctes("""
SELECT project, CAST(run_date AS VARCHAR) AS run_date, CAST(sum(ok + bad) AS BIGINT) AS total,
       CAST(sum(ok) AS BIGINT) AS successful, CAST(sum(bad) AS BIGINT) AS failed
FROM (SELECT project, run_date, CASE WHEN ord % 10 IN (0, 1, 4, 5, 7) THEN 1 WHEN ord % 10 = 9 THEN 2 ELSE 0 END AS ok,
             CASE WHEN ord % 10 IN (3, 6, 8) THEN 1 ELSE 0 END AS bad FROM runs WHERE ord % 10 <> 2) f
GROUP BY ALL""", RUNS))
def q_landing_write_manifest(spark: SparkSession, sf: str) -> DataFrame:
    # every landed file is written, the bad ones with their reason; the manifest counts what stands there
    out = os.path.join(checkpoint_dir(spark), f"landed-{uuid.uuid4().hex}")
    SK.write_runs_json(L.landed_records(_landed(spark, sf)), out)
    found = SK.manifest(SK.read_runs_json(spark, out, "written"), SK.read_runs_json(spark, out, "failed"))
    return found.select("project", _d(), "total", "successful", "failed")


@register("landing_failures", O.with_ctes("""
SELECT project, CASE WHEN ord % 10 = 6 THEN 'not JSON' ELSE 'invalid legacy run' END AS reason, CAST(count(*) AS BIGINT) AS n
FROM runs WHERE ord % 10 IN (3, 6, 8) GROUP BY ALL""", RUNS))
def q_landing_failures(spark: SparkSession, sf: str) -> DataFrame:
    out = os.path.join(checkpoint_dir(spark), f"landed-{uuid.uuid4().hex}")
    SK.write_runs_json(L.landed_records(_landed(spark, sf)), out)
    return SK.read_runs_json(spark, out, "failed").groupBy("project", "reason").agg(F.count(F.lit(1)).alias("n"))


@register("run_times", O.with_ctes("""
SELECT run_id, CASE WHEN ord % 5 = 4 THEN CAST(run_date AS VARCHAR) END AS day,
       strftime(x, '%Y-%m-%d %H:%M:%S') || ' UTC' AS shown,
       strftime(CASE WHEN ord % 5 IN (0, 2) THEN x + INTERVAL 8 HOUR ELSE x END, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS legacy,
       CAST(CAST(CASE WHEN ord % 5 = 3 THEN x ELSE start_time + INTERVAL 1 DAY END AS DATE) AS VARCHAR) AS created
FROM timed WHERE ord % 11 <> 0
UNION ALL
SELECT run_id, NULL, NULL, NULL, CAST(CAST(start_time + INTERVAL 1 DAY AS DATE) AS VARCHAR) FROM timed WHERE ord % 11 = 0""",
    RUNS, """
timed AS (SELECT *, CASE ord % 5 WHEN 2 THEN start_time - INTERVAL 2 HOUR WHEN 4 THEN CAST(run_date AS TIMESTAMP)
                                 ELSE start_time END AS x FROM runs)"""))
def q_run_times(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return FX.written_times(spark, sf).select(
        "run_id", X.parse_date(t).cast("string").alias("day"), X.display(X.to_utc(t)).alias("shown"),
        X.legacy_time(t).alias("legacy"), X.creation_date(t, F.col("ingest_time")).cast("string").alias("created"))


@register("key_consistency", O.with_ctes("""
SELECT project, CAST(count(*) AS BIGINT) AS n_runs, CAST(count(*) FILTER (WHERE ord % 13 = 0) AS BIGINT) AS run_id_mismatch,
       CAST(count(*) FILTER (WHERE ord % 17 = 0) AS BIGINT) AS trace_id_mismatch,
       CAST(count(*) FILTER (WHERE ord % 19 = 0 AND ord % 7 <> 0 AND ord % 11 <> 0) AS BIGINT) AS project_mismatch,
       CAST(count(*) FILTER (WHERE ord % 23 = 0) AS BIGINT) AS run_date_mismatch
FROM runs GROUP BY project""", RUNS))
def q_key_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return Q.consistency_violations(FX.key_documents(spark, sf))


@register("example_schema_violations", O.with_ctes("""
SELECT trace_id, project, run_date, part, problem, name
FROM (SELECT trace_id, project, CAST(run_date AS VARCHAR) AS run_date, (CAST(trace_id AS BIGINT) // 8) % 4 AS kind
      FROM rf GROUP BY trace_id, project, rf.run_date HAVING bool_or(meets_avail)) e
JOIN (VALUES (1, 'outputs', 'wrong type', 'is_available'), (2, 'inputs', 'extra key', 'x'),
             (3, 'outputs', 'missing key', 'notes'), (3, 'outputs', 'extra key', 'remark')) v(kind, part, problem, name) USING (kind)""",
    RUNS, FB, O.run_fields_cte()))
def q_example_schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    lines = SK.dataset_lines(EV.build_dataset(FX.run_documents(spark, sf), "availability"), "availability")
    kind, line = F.expr("CAST(trace_id AS BIGINT) div 8 % 4"), F.col("line")
    spoilt = (F.when(kind == 1, F.regexp_replace(line, '"is_available":(true|false)', '"is_available":"yes"'))
              .when(kind == 2, F.regexp_replace(line, r'^\{"inputs":\{', '{"inputs":{"x":1,'))
              .when(kind == 3, F.regexp_replace(line, '"notes":', '"remark":')).otherwise(line))
    found = Q.example_schema_violations(lines.withColumn("line", spoilt), "availability")
    return found.select("trace_id", "project", _d(), "part", "problem", "name")


@register("runs_of_trace", O.with_ctes("""
SELECT run_id, trace_id, project, CAST(run_date AS VARCHAR) AS run_date, name, status, error FROM runs
WHERE trace_id = (SELECT trace_id FROM runs WHERE run_id = '13')""", RUNS))
def q_runs_of_trace(spark: SparkSession, sf: str) -> DataFrame:
    # A run by its id, then the runs of its trace; both are lookups by key
    runs = FX.runs(spark, sf)
    trace = S.get_run(runs, "13").select("trace_id").scalar()
    return S.runs_of_trace(runs, trace).select("run_id", "trace_id", "project", _d(), "name", "status", "error")


# ----------------------------------------------------------------------------- every branch of the rules
_JUDGED_CTE = """
judged AS (SELECT * EXCLUDE (confidence), ord % 8 AS k, CASE WHEN u % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS even,
                  CAST(u % 100 AS DOUBLE) / 100 AS share FROM runs),
flags AS (
  SELECT *, k NOT IN (0, 7) AS has_ai_output, k NOT IN (0, 2) AS has_human_feedback, k IN (3, 4, 5) AS has_final_verdict,
         CASE WHEN k IN (3, 5) THEN 'PASS' WHEN k = 4 THEN 'FAIL' END AS verdict,
         CASE WHEN k IN (2, 5, 6) THEN 'PASS' WHEN k = 3 THEN even WHEN k = 4 THEN 'FAIL' END AS decision,
         CASE k WHEN 3 THEN 0.8e0 WHEN 4 THEN 0.7e0 WHEN 5 THEN share WHEN 6 THEN 1e0 END AS confidence,
         k = 4 OR (k = 3 AND even = 'PASS') OR (k = 5 AND share >= 0.7e0) AS meets_criteria
  FROM judged)"""


@register("qualification_branches", O.with_ctes("""
SELECT run_id, has_ai_output, has_human_feedback, has_final_verdict, verdict, decision, confidence, meets_criteria FROM flags""",
                                                RUNS, _JUDGED_CTE))
def q_qualification_branches(spark: SparkSession, sf: str) -> DataFrame:
    decision, confidence = EV.decision_and_confidence()
    return EV.stage(FX.judged_documents(spark, sf)).select(
        "run_id", EV.has_ai_output().alias("has_ai_output"), EV.has_human_feedback().alias("has_human_feedback"),
        EV.has_final_verdict_feedback().alias("has_final_verdict"), EV.feedback_verdict().alias("verdict"),
        decision.alias("decision"), confidence.alias("confidence"), EV.meets_criteria().alias("meets_criteria"))


@register("dataset_reference", O.with_ctes("""
SELECT trace_id, project, CAST(run_date AS VARCHAR) AS run_date,
       max(CASE WHEN k = 3 THEN CAST(u % 5 AS VARCHAR) END) AS feedback_score, CAST(NULL AS VARCHAR) AS feedback_value,
       max(CASE WHEN k = 3 AND u % 2 = 0 THEN '"c' || (u % 3) || '"' END) AS feedback_comment,
       CASE WHEN bool_or(k = 6) THEN 'null' WHEN bool_or(k = 4) THEN '"FAIL"' END AS human_verdict,
       CAST(count(*) AS BIGINT) AS runs_count
FROM flags GROUP BY trace_id, project, run_date HAVING bool_or(meets_criteria)""", RUNS, _JUDGED_CTE))
def q_dataset_reference(spark: SparkSession, sf: str) -> DataFrame:
    # The last object of the feedback list, and the verdict of a person
    d = EV.build_dataset(FX.judged_documents(spark, sf), "token_name")
    return d.select("trace_id", "project", _d(), *[F.to_json(f"reference.{f}").alias(f) for f in EV.REFERENCE_FIELDS], "runs_count")


@register("availability_notes", O.with_ctes(f"""
SELECT run_id, CASE WHEN k IN (0, 2, 3, 5, 7) THEN true WHEN k IN (4, 6, 8) THEN false END AS is_available,
       CASE WHEN k IN (0, 4) THEN false WHEN k = 7 THEN true END AS is_malicious,
       CASE k WHEN 0 THEN 'down ' || u WHEN 1 THEN 'seen' WHEN 2 THEN '{EV.NOTE_SCRAPED}' WHEN 3 THEN '{EV.NOTE_ANALYSIS_OK}'
              WHEN 4 THEN '{EV.NOTE_ANALYSIS_NOT}' WHEN 5 THEN '{EV.NOTE_PASS}' WHEN 6 THEN '{EV.NOTE_FAIL}'
              WHEN 7 THEN '{EV.NOTE_APPEARS}' WHEN 8 THEN '{EV.NOTE_ERRORS}' ELSE '{EV.NOTE_UNCLEAR}' END AS notes
FROM (SELECT *, ord % 10 AS k FROM runs) r""", RUNS))
def q_availability_notes(spark: SparkSession, sf: str) -> DataFrame:
    # Whether the site was there, and the note that says so
    fields = EV.run_fields(FX.availability_documents(spark, sf))
    return fields.select("run_id", *[F.when(F.col(f + "_p"), F.col(f)).alias(f) for f in ("is_available", "is_malicious", "notes")])


# ----------------------------------------------------------------------------- stored nested runs, compaction, read back
@register("merge_versions_nested_report", O.with_ctes(f"""
SELECT project, CAST(run_date AS VARCHAR) AS run_date, CAST(count(*) AS BIGINT) AS total_traces,
       CAST(sum(n_err) AS BIGINT) AS zenrows_errors, {O.rate('sum(n_err)', 'count(*)')} AS error_rate
FROM (SELECT project, run_date, trace_id,
             count(*) FILTER (WHERE {O.rate_error()})
             + sum(CASE WHEN n_runs > 1 AND run_id = root_id THEN 0 WHEN ord % 3 = 0 THEN 1
                        ELSE CAST({O.rate_error()} AS INTEGER) + CAST(u % 2 = 0 AS INTEGER) END) AS n_err
      FROM (SELECT *, count(*) OVER w AS n_runs,
                   arg_max(run_id, (CASE WHEN run_id = trace_id THEN 1 ELSE 0 END, -ord)) OVER w AS root_id
            FROM moved WINDOW w AS (PARTITION BY project, run_date, trace_id)) x
      GROUP BY ALL) t
GROUP BY project, run_date""", RUNS, """
moved AS (SELECT * REPLACE (CASE WHEN ord % 3 = 0 THEN project || 'm' ELSE project END AS project) FROM runs)"""))
def q_merge_versions_nested_report(spark: SparkSession, sf: str) -> DataFrame:
    # the merge stores nested runs with their partitions; the report reads these and no documents
    base = os.path.join(checkpoint_dir(spark), f"versions-{uuid.uuid4().hex}")
    for number, rows in enumerate(FX.refetched_documents(spark, sf), 1):
        RT.append_batch(rows, f"{base}/log", number)
        VT.merge_batches(spark, f"{base}/log", f"{base}/table")
    runs, nested = VT.read_runs(spark, f"{base}/table")
    return E.daily_error_report(runs, nested=nested).select("project", _d(), "total_traces", "zenrows_errors", "error_rate")


@register("compact_restore_day", O.with_ctes("""
SELECT run_id, trace_id, project, CAST(run_date AS VARCHAR) AS run_date, name, status, error FROM runs
WHERE project = 'proj0' AND run_date BETWEEN (SELECT max(run_date) - 6 FROM runs WHERE project = 'proj0')
                                         AND (SELECT max(run_date) FROM runs WHERE project = 'proj0')""", RUNS))
def q_compact_restore_day(spark: SparkSession, sf: str) -> DataFrame:
    # S8 twice, the second table without the last day of a project; S9 brings that day back; S3 reads a week
    base = os.path.join(checkpoint_dir(spark), f"compacted-{uuid.uuid4().hex}")
    runs = staged(FX.runs(spark, sf).select("run_id", "trace_id", "project", "run_date", "name", "status", "error"), "runs")
    own = F.col("project") == "proj0"
    last = runs.where(own).agg(F.max("run_date")).first()[0]
    RT.compact(runs, f"{base}/archive")
    RT.compact(runs.where(~(own & (F.col("run_date") == F.lit(last)))), f"{base}/table")
    RT.restore_partition(spark, f"{base}/archive", f"{base}/table", "proj0", str(last))
    week = RT.read_table(spark, f"{base}/table", "proj0", last - dt.timedelta(days=6), last)
    return week.select("run_id", "trace_id", "project", _d(), "name", "status", "error")


@register("dataset_read_back", O.with_ctes(f"""
SELECT trace_id, project, CAST(run_date AS VARCHAR) AS date, 'token_name' AS eval_type,
       coalesce({_last('name_v', 'name_p')}, '') AS name, coalesce({_last('symbol')}, '') AS symbol,
       coalesce({_last('description')}, '') AS description, arg_max(is_meme, ord) AS is_meme,
       arg_max(is_explicit, ord) AS is_explicit, arg_max(has_conflict, ord) AS has_conflict
FROM rf GROUP BY trace_id, project, run_date HAVING bool_or(meets_strict)""", RUNS, FB, O.run_fields_cte()))
def q_dataset_read_back(spark: SparkSession, sf: str) -> DataFrame:
    # S11 writes JSONL files, S12 finds their format and reads them
    path = os.path.join(checkpoint_dir(spark), f"dataset-{uuid.uuid4().hex}")
    SK.write_dataset_jsonl(EV.build_dataset(FX.run_documents(spark, sf), "token_name"), path, "token_name")
    ins, outs = EV.FORMAT_COLUMNS["token_name"]
    return SK.read_dataset(spark, path).select(
        "metadata.trace_id", "metadata.project", "metadata.date", "metadata.eval_type",
        *[f"inputs.{c}" for c in ins], *[f"outputs.{c}" for c in outs])


@register("curation_problems", O.with_ctes(f"""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT {O.normalize_url('website_url')}) AS BIGINT) AS repeated,
       CAST(count(*) FILTER (WHERE pos % 10 = 0 OR length(website_url) = 0) AS BIGINT) AS no_url,
       CAST(count(*) FILTER (WHERE pos % 7 = 0 OR is_available IS NULL) AS BIGINT) AS no_flag
FROM url_examples""", URLS))
def q_curation_problems(spark: SparkSession, sf: str) -> DataFrame:
    # V1 on examples that have all of its problems
    pos = F.col("pos")
    spoilt = C.annotate(FX.url_examples(spark, sf)).withColumns({
        "website_url": F.when(pos % 10 != 0, F.col("website_url")), "is_available": F.when(pos % 7 != 0, F.col("is_available"))})
    return C.problems(spoilt)
