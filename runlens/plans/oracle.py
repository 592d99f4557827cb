"""DuckDB restatement of the derived fixture tables, used as the correctness oracle.

Every oracle query is ``WITH <fixture CTEs> SELECT ...`` over the driver's pre-registered views.
Must stay in step with ``runlens.sources.fixtures``.
"""

from __future__ import annotations

from runlens.sources import fixtures as FX


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_text(s: str) -> str:
    """SQL literal for a Python string that may contain newlines."""
    parts = s.split("\n")
    return " || chr(10) || ".join(_q(p) for p in parts)


def _case(idx: str, values) -> str:
    return "CASE " + idx + " " + " ".join(f"WHEN {i} THEN {_sql_text(v)}" for i, v in enumerate(values)) + " END"


RUNS_CTE = f"""
runs AS (
  SELECT CAST(event_id AS VARCHAR) AS run_id,
         CAST(event_id - event_id % 8 AS VARCHAR) AS trace_id,
         CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST(event_id - event_id % 8 AS VARCHAR) END AS parent_run_id,
         'proj' || CAST(((event_id - event_id % 8) // 8) % 5 AS VARCHAR) AS project,
         ts AS start_time,
         CAST(ts AS DATE) AS run_date,
         {_case('event_id % 8', FX.RUN_NAMES)} AS name,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
         CASE WHEN event_type = 'error' THEN {_case('event_id % 4', FX.ERROR_TEXTS)} END AS error,
         'req' || CAST(user_id AS VARCHAR) AS request_id,
         CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS confidence,
         event_id AS ord,
         user_id AS u, value AS v, event_type AS etype
  FROM events)"""

FEEDBACK_CTE = """
feedback AS (
  SELECT CAST(doc_id AS VARCHAR) AS run_id,
         CASE WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END AS verdict,
         CASE WHEN toxic = 0 THEN 'PASS' ELSE 'FAIL' END AS final_decision
  FROM labels)"""

URL_EXAMPLES_CTE = f"""
url_examples AS (
  SELECT page_id * 2 AS pos, url AS website_url, page_id % 4 <> 0 AS is_available,
         {_case('page_id % 5', FX.NOTES)} AS notes
  FROM pages
  UNION ALL
  SELECT page_id * 2 + 1 AS pos, upper(url) || '/' AS website_url, page_id % 3 <> 0 AS is_available,
         'ok, content found' AS notes
  FROM pages)"""


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def round1(x: str) -> str:
    """Python round(x, 1) on doubles: printf rounds the exact binary value."""
    return f"CAST(printf('%.1f', {x}) AS DOUBLE)"


def rate(e: str, t: str) -> str:
    return f"CASE WHEN {t} = 0 THEN 0.0 ELSE {round1(f'(CAST({e} AS DOUBLE) / {t}) * 100')} END"


def rate_error(name: str = "name", status: str = "status") -> str:
    return f"(coalesce(contains(lower({name}), 'zenrows_scraper') AND lower({status}) = 'error', false))"


def detail_error(name: str = "name", status: str = "status") -> str:
    return (f"(coalesce((contains(lower({name}), 'zenrows') OR contains(lower({name}), 'scraper'))"
            f" AND lower({status}) = 'error', false))")


def symbol_scan(name: str = "name", error: str = "error") -> str:
    from runlens.functions.text import SYMBOL_FAMILIES, SYMBOL_LITERALS, UNKNOWN_SYMBOL
    t = f"upper(coalesce({name}, 'None') || ' ' || coalesce({error}, 'None'))"
    whens = []
    for s in SYMBOL_LITERALS:
        whens.append(f"WHEN contains({t}, '{s}_') OR contains({t}, '{s}-') "
                     f"OR regexp_matches({t}, '\\b{s}\\b') THEN '{s}'")
    for s, pats in SYMBOL_FAMILIES:
        cond = " OR ".join(f"contains({t}, '{p.upper()}')" for p in pats)
        whens.append(f"WHEN {cond} THEN '{s}'")
    return "CASE " + " ".join(whens) + f" ELSE '{UNKNOWN_SYMBOL}' END"


def clean_error(e: str = "error") -> str:
    """F3 restated for the fixture's error texts."""
    hp = f"(split_part({e}, '''' || ')Traceback', 1) || '''' || ')')"
    et = f"regexp_replace(split_part({hp}, 'HTTPError(''', 2), '[''\\)]+$', '')"
    status = f"split_part({et}, ' for url: ', 1)"
    urlp = f"substr({et}, strpos({et}, ' for url: ') + 10)"
    net = f"regexp_extract(split_part({urlp}, '&', 1), '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"
    http_ok = f"(contains({e}, 'HTTPError(') AND contains({e}, ''')Traceback') AND contains({hp}, 'HTTPError('''))"
    line = (f"list_filter(string_split({e}, chr(10)), lambda x: contains(x, 'Error:') OR contains(x, 'Exception:')"
            f" OR contains(x, 'Timeout'))[1]")
    return (f"CASE WHEN {e} IS NULL OR length({e}) = 0 THEN 'Unknown error' "
            f"WHEN {http_ok} AND contains({et}, ' for url: ') THEN {status} || ' - ' || {net} "
            f"WHEN {http_ok} THEN {et} "
            f"WHEN contains({e}, 'Error:') AND contains({e}, 'Traceback') AND {line} IS NOT NULL THEN trim({line}) "
            f"WHEN contains({e}, 'ReadTimeout') OR contains(lower({e}), 'timeout') THEN 'Request timeout' "
            f"WHEN length({e}) > 150 THEN substr({e}, 1, 147) || '...' "
            f"ELSE {e} END")


def _notes():
    from runlens.operators import evaluation as EV
    return EV


def run_fields_cte() -> str:
    """Per-run extracted dataset fields of the fixture documents (see fixtures.run_documents)."""
    EV = _notes()
    return f"""
rf AS (
  SELECT r.*, f.verdict, f.final_decision, r.ord % 8 AS k,
         r.ord % 8 IN (0, 4) AS name_p,
         CASE r.ord % 8 WHEN 0 THEN 'Token' || CAST(r.u % 17 AS VARCHAR) WHEN 4 THEN 'Site' || CAST(r.u % 11 AS VARCHAR) END AS name_v,
         r.ord % 8 = 0 AS description_p, 'desc ' || r.etype AS description,
         r.ord % 8 = 0 AS symbol_p, 's' || CAST(r.u % 7 AS VARCHAR) AS symbol,
         r.ord % 8 IN (0, 4) AS website_url_p,
         'https://www.site' || CAST(r.u % 23 AS VARCHAR) || '.example.com/p' || CAST(r.ord % 3 AS VARCHAR) AS website_url,
         CASE r.ord % 8 WHEN 0 THEN '{{"links":{{"a":' || (r.u % 3) || '}},"x":"x' || (r.u % 5) || '"}}'
                        WHEN 4 THEN '{{"links":{{"b":' || (r.ord % 3) || '}},"tg":"t' || (r.u % 6) || '"}}'
                        WHEN 7 THEN CASE WHEN r.u % 4 = 0 THEN '["l' || r.u || '"]' END END AS profiles,
         r.ord % 8 = 7 AND r.v > 50 AS is_meme,
         r.ord % 8 = 7 AND r.etype = 'purchase' AS is_explicit,
         r.ord % 8 = 7 AND r.u % 2 = 0 AS has_conflict,
         r.ord % 8 = 4 AS is_malicious_p, r.v > 90 AS is_malicious,
         (r.ord % 8 IN (4, 7) OR f.final_decision IS NOT NULL) AS is_available_p,
         CASE WHEN r.ord % 8 = 4 THEN r.etype <> 'error' WHEN r.ord % 8 = 7 THEN true
              WHEN f.final_decision = 'PASS' THEN true ELSE false END AS is_available,
         CASE WHEN r.ord % 8 = 4 AND r.u % 3 = 0 THEN 'checked ' || r.etype
              WHEN r.ord % 8 = 4 AND r.etype <> 'error' THEN {_q(EV.NOTE_ANALYSIS_OK)}
              WHEN r.ord % 8 = 4 THEN {_q(EV.NOTE_ANALYSIS_NOT)}
              WHEN r.ord % 8 = 7 THEN {_q(EV.NOTE_ANALYSIS_OK)}
              WHEN f.final_decision = 'PASS' THEN {_q(EV.NOTE_PASS)}
              WHEN f.final_decision = 'FAIL' THEN {_q(EV.NOTE_FAIL)}
              ELSE {_q(EV.NOTE_UNCLEAR)} END AS notes,
         coalesce(f.verdict = f.final_decision AND r.confidence >= 0.7 AND NOT isnan(r.confidence), false) AS meets_strict,
         r.ord % 8 IN (0, 4) AS meets_avail,
         (CASE WHEN r.run_id = r.trace_id THEN 0 ELSE 1 END) * 10000000000000 + r.ord AS prio
  FROM runs r LEFT JOIN feedback f USING (run_id))"""


#: the profiles of a trace, over rows of ``rf``: a list replaces objects, two objects are merged
MERGED_PROFILES = """CASE WHEN max(profiles) FILTER (WHERE k = 7) IS NOT NULL THEN max(profiles) FILTER (WHERE k = 7)
            WHEN count(*) FILTER (WHERE k IN (0, 4)) = 2 THEN
                 '{"links":{"a":' || max(u % 3) FILTER (WHERE k = 0) || ',"b":' || max(ord % 3) FILTER (WHERE k = 4)
                 || '},"tg":"t' || max(u % 6) FILTER (WHERE k = 4) || '","x":"x' || max(u % 5) FILTER (WHERE k = 0) || '"}'
            ELSE coalesce(max(profiles), '[]') END"""


def normalize_url(u: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({u}, ''))), '^https?://', ''),"
            f" '^www\\.', ''), '/$', '')")


def url_domain(u: str) -> str:
    full = f"(CASE WHEN starts_with({u}, 'http://') OR starts_with({u}, 'https://') THEN {u} ELSE 'https://' || {u} END)"
    net = f"lower(regexp_extract({full}, '^https?://([^/?#]*)', 1))"
    host = f"regexp_replace(split_part({net}, ':', 1), '^www\\.', '')"
    return (f"(CASE WHEN {u} IS NULL THEN 'unknown' WHEN {net} = '' OR NOT contains({net}, '.') THEN 'unknown' "
            f"WHEN {host} = '' THEN 'unknown' ELSE {host} END)")


def quality(url: str, avail: str, notes: str) -> str:
    n = f"lower(coalesce({notes}, ''))"
    return (f"((CASE WHEN length(coalesce({url}, '')) > 0 THEN 10 ELSE 0 END)"
            f" + (CASE WHEN {avail} IS NOT NULL THEN 10 ELSE 0 END)"
            f" + (CASE WHEN length(trim(coalesce({notes}, ''))) > 10 THEN 5 ELSE 0 END)"
            f" + (CASE WHEN contains({n}, 'success') OR contains({n}, 'completed') OR contains({n}, 'found') THEN 3 ELSE 0 END)"
            f" + (CASE WHEN contains({n}, 'error') OR contains({n}, 'failed') OR contains({n}, 'timeout') THEN 2 ELSE 0 END))")


CURATION_CTE = f"""
ann AS (SELECT *, {normalize_url('website_url')} AS norm_url, {url_domain('website_url')} AS domain,
               CAST({quality('website_url', 'is_available', 'notes')} AS INTEGER) AS score FROM url_examples),
negs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY norm_url ORDER BY pos) AS rn
                                     FROM ann WHERE NOT coalesce(is_available, false)) WHERE rn = 1),
pos0 AS (SELECT * FROM ann WHERE coalesce(is_available, false) AND norm_url NOT IN (SELECT norm_url FROM negs)),
posd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY norm_url ORDER BY score DESC, pos) AS rn,
                                            min(pos) OVER (PARTITION BY norm_url) AS url_pos FROM pos0) WHERE rn = 1),
ranked AS (SELECT *, min(url_pos) OVER (PARTITION BY domain) AS domain_pos,
                  row_number() OVER (PARTITION BY domain ORDER BY score DESC, url_pos) = 1 AS is_winner FROM posd),
ordered AS (SELECT *, row_number() OVER (ORDER BY is_winner DESC, CASE WHEN is_winner THEN domain_pos END ASC NULLS LAST,
                                         score DESC, url_pos) AS k FROM ranked),
curated AS (
  SELECT pos, website_url, is_available, notes, norm_url, domain, score, 'negative' AS kind FROM negs
  UNION ALL
  SELECT pos, website_url, is_available, notes, norm_url, domain, score, 'positive' AS kind FROM ordered
  WHERE k <= greatest(0, 100 - (SELECT count(*) FROM negs)))"""
