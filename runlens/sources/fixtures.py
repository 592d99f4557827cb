"""Run, feedback and URL-example tables derived from the driver's test tables.

The trace engine works on *runs* (spans). The test data has no runs, so they are derived
deterministically from ``events`` (one run per event, eight runs per trace), ``labels``
(human verdicts) and ``pages`` (website URLs). The same definitions are restated in SQL for the
DuckDB oracle (``runlens.plans.oracle``); both must stay in step.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.stats import PROJECT_METADATA_KEY

# --------------------------------------------------------------------------------------------
# Fixed values of the derived fixture (shared with the SQL oracle).
RUN_NAMES = [
    "due_diligence", "zenrows_scraper", "Zenrows_Scraper_BTC", "ETH-USD_scraper",
    "website_analysis", "solana_scraper", "zenrows_probe", "name_analysis",
]
ERROR_TEXTS = [
    "HTTPError('422 Client Error for url: https://api.example.com/v1/?a=1&url=x')"
    "Traceback (most recent call last):\n  File \"scraper.py\", line 10, in fetch",
    "ReadTimeout",
    "ValueError: bad\nTraceback (most recent call last):\n  File \"x.py\", line 1",
    "x" * 200,
]
NOTES = [
    "Website accessible - analysis completed successfully", "timeout", "", "found",
    "request failed with error",
]
RUNS_PER_TRACE = 8
N_PROJECTS = 5
# --------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one test table, with the splits that its files have."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pick(idx_col, values):
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx_col == i, F.lit(v)) if expr is None else expr.when(idx_col == i, F.lit(v))
    return expr


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat run table (silver layout): typed keys + the hot scalar fields.

    Columns: run_id, trace_id, parent_run_id, project, start_time, run_date, name, status, error,
    request_id, confidence, ord (the merge/order key standing for (created_at, ingest_seq)).
    """
    return _runs_of(_events(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("run_id", F.col("event_id").cast("string"))


def _runs_of(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    t0 = e - e % RUNS_PER_TRACE
    return events.select(
        "run_id",
        t0.cast("string").alias("trace_id"),
        F.when(e % RUNS_PER_TRACE == 0, F.lit(None).cast("string")).otherwise(t0.cast("string")).alias("parent_run_id"),
        F.concat(F.lit("proj"), (F.expr(f"(event_id - event_id % {RUNS_PER_TRACE}) div {RUNS_PER_TRACE}")
                                 % N_PROJECTS).cast("string")).alias("project"),
        F.col("ts").cast("timestamp").alias("start_time"),
        F.col("ts").cast("date").alias("run_date"),
        _pick(e % RUNS_PER_TRACE, RUN_NAMES).alias("name"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.when(F.col("event_type") == "error", _pick(e % 4, ERROR_TEXTS)).alias("error"),
        F.concat(F.lit("req"), F.col("user_id").cast("string")).alias("request_id"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"),
        e.alias("ord"),
        # extra columns used to derive the run documents
        F.col("user_id").alias("_user"), F.col("value").alias("_value"), F.col("event_type").alias("_etype"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human verdicts: one per labelled run; final_decision is what the AI output said."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("run_id"),
        F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("verdict"),
        F.when(F.col("toxic") == 0, "PASS").otherwise("FAIL").alias("final_decision"),
    )


def url_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability examples in dataset order ``pos``: every page twice (as is, and upper-cased + '/')."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    pid = F.col("page_id")
    a = p.select((pid * 2).alias("pos"), F.col("url").alias("website_url"),
                 (pid % 4 != 0).alias("is_available"), _pick(pid % 5, NOTES).alias("notes"))
    b = p.select((pid * 2 + 1).alias("pos"), F.concat(F.upper("url"), F.lit("/")).alias("website_url"),
                 (pid % 3 != 0).alias("is_available"), F.lit("ok, content found").alias("notes"))
    return a.unionByName(b)


def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their free-form JSON document (``doc`` VARIANT), as the run table stores them.

    Document shape by ``event_id % 8`` (k); u = user_id, v = value:
      all runs      inputs.input_data.request_id, outputs.confidence, extra.metadata.ls_run_depth
      k = 0 (root)  input_data.{name: 'Token<u%17>', crypto_symbol: 's<u%7>', description, website_url}
      k = 4         input_data.{name: 'Site<u%11>', website_url}; outputs.website_analysis
                    {is_available: not error, malicious_check.is_dangerous: v > 90, notes if u%3=0}
      k = 7         outputs.name_analysis.{meme_check.is_meme: v > 50, explicit_check.is_explicit:
                    purchase, trademark_check.has_conflict: u even}
      k = 6         extra.metadata.<project key> = project; all runs session_id 'sess<u%4>'
      profiles      input_data.social_profiles: k = 0 {x, links: {a}}, k = 4 {tg, links: {b}}, k = 7 and u%4=0 a list
      depth         ls_run_depth 0 for k = 0 (2 where u%9=0), else 1
      labelled runs outputs.final_decision + feedback_stats.final_verdict.comments ['Human verdict: X']
    """
    # events are dealt by their run's id as the file has them: it may have few splits, so that not even the columns of
    # a run are worked out before
    r = _runs_of(_events(spark, sf_dir).repartition("run_id"))
    fb = feedback(spark, sf_dir)
    k = F.col("ord") % RUNS_PER_TRACE
    u = F.col("_user")
    url = F.concat(F.lit("https://www.site"), (u % 23).cast("string"), F.lit(".example.com/p"),
                   (F.col("ord") % 3).cast("string"))
    input_data = F.struct(
        F.col("request_id").alias("request_id"),
        F.when(k == 0, F.concat(F.lit("Token"), (u % 17).cast("string")))
         .when(k == 4, F.concat(F.lit("Site"), (u % 11).cast("string"))).alias("name"),
        F.when(k == 0, F.concat(F.lit("s"), (u % 7).cast("string"))).alias("crypto_symbol"),
        F.when(k == 0, F.concat(F.lit("desc "), F.col("_etype"))).alias("description"),
        F.when((k == 0) | (k == 4), url).alias("website_url"),
        F.when(k == 0, F.parse_json(F.to_json(F.struct(F.concat(F.lit("x"), (u % 5).cast("string")).alias("x"),
                                          F.struct((u % 3).alias("a")).alias("links")))))
         .when(k == 4, F.parse_json(F.to_json(F.struct(F.concat(F.lit("t"), (u % 6).cast("string")).alias("tg"),
                                          F.struct((F.col("ord") % 3).alias("b")).alias("links")))))
         .when((k == 7) & (u % 4 == 0), F.parse_json(F.to_json(F.array(F.concat(F.lit("l"), u.cast("string")))))).alias("social_profiles"),
    )
    website_analysis = F.when(k == 4, F.struct(
        (F.col("_etype") != "error").alias("is_available"),
        F.struct((F.col("_value") > 90).alias("is_dangerous")).alias("malicious_check"),
        F.when(u % 3 == 0, F.concat(F.lit("checked "), F.col("_etype"))).alias("notes"),
    ))
    name_analysis = F.when(k == 7, F.struct(
        F.struct((F.col("_value") > 50).alias("is_meme")).alias("meme_check"),
        F.struct((F.col("_etype") == "purchase").alias("is_explicit")).alias("explicit_check"),
        F.struct((u % 2 == 0).alias("has_conflict")).alias("trademark_check"),
    ))
    outputs = F.struct(
        F.col("final_decision"), F.col("confidence"),
        website_analysis.alias("website_analysis"), name_analysis.alias("name_analysis"))
    feedback_stats = F.when(F.col("verdict").isNotNull(), F.struct(F.struct(
        F.array(F.concat(F.lit("Human verdict: "), F.col("verdict"))).alias("comments")).alias("final_verdict")))
    doc = F.struct(
        F.col("run_id").alias("id"), F.col("trace_id"), F.col("parent_run_id"), F.col("name"),
        F.col("status"), F.col("error"),
        F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("start_time"),
        F.struct(input_data.alias("input_data")).alias("inputs"),
        outputs.alias("outputs"),
        feedback_stats.alias("feedback_stats"),
        F.concat(F.lit("sess"), (u % 4).cast("string")).alias("session_id"),
        F.struct(F.struct(F.when((k == 0) & (u % 9 == 0), 2).when(k == 0, 0).otherwise(1).alias("ls_run_depth"),
                          F.when(k == 6, F.col("project")).alias(PROJECT_METADATA_KEY)).alias("metadata")).alias("extra"),
    )
    # labels is small relative to runs but grows with the data: a plain equi-join, AQE decides
    # broadcast vs. sort-merge from the measured size.
    return (r.join(fb, "run_id", "left")
            .select(*[c for c in r.columns if not c.startswith("_")],
                    F.parse_json(F.to_json(doc)).alias("doc")))


def nested_run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose documents carry nested ``child_runs`` (built row by row, no grouping):

      run.child_runs = [c1, "x"]     c1 = {id: '<run>-c1', name: name + '_retry', status, error,
                                           inputs.url where user_id is a multiple of 3}
      c1.child_runs  = [c2, 42]      c2 = {id: '<run>-c2', name: 'zenrows_scraper_inner',
                                           status: 'error' if user_id even else 'success'}
    Non-object list items are there to be skipped, as the nested search does."""
    r = runs(spark, sf_dir)
    strip = lambda c: F.regexp_replace(F.to_json(c), "}$", "")
    c2 = F.to_json(F.struct(F.concat("run_id", F.lit("-c2")).alias("id"), F.lit("zenrows_scraper_inner").alias("name"),
                            F.when(F.col("_user") % 2 == 0, "error").otherwise("success").alias("status")))
    url = F.concat(F.lit("https://t"), (F.col("_user") % 5).cast("string"), F.lit(".example"))
    c1 = F.concat(strip(F.struct(F.concat("run_id", F.lit("-c1")).alias("id"),
                                 F.concat("name", F.lit("_retry")).alias("name"), "status", "error",
                                 F.when(F.col("_user") % 3 == 0, F.struct(url.alias("url"))).alias("inputs"))),
                  F.lit(',"child_runs":['), c2, F.lit(",42]}"))
    doc = F.concat(strip(F.struct(F.col("run_id").alias("id"), "trace_id", "name", "status", "error")),
                   F.lit(',"child_runs":['), c1, F.lit(',"x"]}'))
    return r.select(*[c for c in r.columns if not c.startswith("_")], F.parse_json(doc).alias("doc"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ingest batches of the run table: every run (seq = ord), then a re-fetch of every failed
    run now reported as succeeded (seq = 10^12 + ord, one hour later)."""
    r = runs(spark, sf_dir)
    base = ["run_id", "trace_id", "parent_run_id", "project", "run_date", "name"]
    b1 = r.select(*base, "status", "error", F.col("ord").alias("ingest_seq"), F.col("start_time").alias("created_at"))
    b2 = r.where(F.col("_etype") == "error").select(
        *base, F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"),
        (F.lit(10 ** 12) + F.col("ord")).alias("ingest_seq"),
        (F.col("start_time") + F.expr("INTERVAL 1 HOUR")).alias("created_at"))
    return b1.unionByName(b2)


def _uuid(number) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))


def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed files as ``landing.scan_files`` gives them, but with their ``text``, one for each event. By ``c = event_id % 10``:

      0 wrapped with enhanced feedback   1 wrapped       2 metadata alone          3 an id that is no UUID
      4 no trace_id                      5 start time written at +08:00            6 text that is no JSON
      7 no start time                    8 a start time that is none               9 landed twice, status changed
    Costs are texts where user_id is even, numbers else; ``extra`` is null, ``outputs`` absent, tags every other user's."""
    r = runs(spark, sf_dir)
    c, u = F.col("ord") % 10, F.col("_user")
    twice = F.explode(F.when(c == 9, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    r = r.withColumn("_n", twice)
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    started = (F.when(c == 5, F.concat(F.date_format(F.col("start_time") + F.expr("INTERVAL 8 HOURS"), iso), F.lit("+08:00")))
               .when(c == 8, "yesterday").when(c != 7, F.concat(F.date_format("start_time", iso), F.lit("Z"))))
    cost = F.concat(F.lit("0."), F.lpad((u % 1000).cast("string"), 3, "0"))
    run = F.to_json(F.struct(
        F.when(c == 3, F.concat(F.lit("bad-"), "run_id")).otherwise(_uuid(F.col("ord"))).alias("id"),
        F.when(c != 4, _uuid(F.col("ord") - F.col("ord") % RUNS_PER_TRACE)).alias("trace_id"), "name",
        F.when(F.col("_n") == 2, "refetched").otherwise(F.col("status")).alias("status"), "error",
        F.lit("chain").alias("run_type"), started.alias("start_time"), u.alias("total_tokens"),
        F.when(u % 2 == 0, cost).alias("total_cost"), F.when(u % 2 == 1, cost.cast("decimal(10,3)")).alias("prompt_cost"),
        F.when(u % 2 == 0, F.array(F.lit("t"), (u % 5).cast("string"))).alias("tags"),
        F.when(u % 3 == 0, u % 6 == 0).alias("in_dataset"),
        F.struct(F.struct("request_id").alias("input_data")).alias("inputs"),
        F.when(c == 0, F.array(_uuid(F.col("ord") + 1))).alias("child_run_ids"),
        F.when(c == 0, F.array(F.struct(F.lit(1).alias("score")))).alias("feedback_records")))
    with_null = F.regexp_replace(run, r"\}$", ',"extra":null}')
    text = (F.when(c == 0, F.concat(F.lit('{"metadata":{"enhanced_feedback":true},"trace":'), with_null, F.lit("}")))
            .when(c == 1, F.concat(F.lit('{"metadata":{},"trace":'), with_null, F.lit("}")))
            .when(c == 2, F.lit('{"metadata":{"n":1}}')).when(c == 6, F.lit('{"id": ')).otherwise(with_null))
    stamp = F.lpad(F.col("_n").cast("string"), 6, "0")
    day = F.col("run_date").cast("string")
    return r.select(
        F.concat_ws("/", F.lit("landing"), "project", day, F.concat("run_id", F.lit("_"), stamp, F.lit(".json"))).alias("file_path"),
        F.concat(F.lit("#"), "project", F.lit("!")).alias("path_project"), day.alias("path_date"),
        stamp.alias("extracted_hhmmss"), F.expr("timestampadd(DAY, _n - 1, start_time)").alias("file_mtime"),
        text.alias("text"))


def key_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose documents repeat the keys, some of them wrongly: the run where event_id is a multiple of 13, the trace
    of 17, the project of 19, the day of 23. The project is left out where it is one of 7, and null where one of 11."""
    r, e = runs(spark, sf_dir), F.col("ord")
    wrong = lambda n, c: F.when(e % n == 0, F.lit("other")).otherwise(F.col(c).cast("string")).alias(c)
    doc = F.to_json(F.struct(wrong(13, "run_id"), wrong(17, "trace_id"), wrong(23, "run_date"),
                             F.when((e % 7 != 0) & (e % 11 != 0), wrong(19, "project")).alias("project")))
    doc = F.when((e % 11 == 0) & (e % 7 != 0), F.regexp_replace(doc, r"\}$", ',"project":null}')).otherwise(doc)
    return r.select("run_id", "trace_id", "project", "run_date", F.parse_json(doc).alias("doc"))


def written_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as texts: by event_id % 5 with Z, without offset, at +02:00, in the stored format, a day alone; every
    eleventh is null. ``ingest_time`` is a day later."""
    e, t = F.col("ord"), F.col("start_time")
    iso = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    texts = (F.when(e % 11 == 0, None).when(e % 5 == 0, F.concat(iso, F.lit("Z"))).when(e % 5 == 1, iso)
             .when(e % 5 == 2, F.concat(iso, F.lit("+02:00"))).when(e % 5 == 3, F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
             .otherwise(F.date_format(t, "yyyy-MM-dd")))
    return runs(spark, sf_dir).select("run_id", texts.alias("text"), (t + F.expr("INTERVAL 1 DAY")).alias("ingest_time"))


def _shaped(index: Column, shapes: list) -> Column:
    """JSON text by number: a format and the columns that fill it."""
    out = None
    for i, (text, *values) in enumerate(shapes):
        filled = F.format_string(text, *values) if values else F.lit(text)
        out = F.when(index == i, filled) if out is None else out.when(index == i, filled)
    return out


def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with documents of eight shapes by ``ord % 8``: every place that outputs, feedback and verdicts come from.

      0  empty outputs                                1  outputs of ``run``, reference with a null human_feedback
      2  confidence '0.9d', empty feedback list       3  feedback list: object, text, object with a verdict
      4  verdict key, human_verdict FAIL              5  two comments and a verdict key
      6  empty final_verdict, human_verdict null      7  null outputs, feedback that is no list
    """
    r = runs(spark, sf_dir)
    u = F.col("_user").cast("long")
    even = F.when(u % 2 == 0, "PASS").otherwise("FAIL")
    comment = F.when(u % 2 == 0, F.concat(F.lit(',"comment":"c'), (u % 3).cast("string"), F.lit('"'))).otherwise("")
    shapes = [
        ('{"outputs":{}}',),
        ('{"run":{"outputs":{"a":1}},"reference":{"human_feedback":null}}',),
        ('{"outputs":{"final_decision":"PASS","confidence":"0.9d"},"feedback":[]}',),
        ('{"outputs":{"final_decision":"%s","confidence":"0.8"},"feedback":[{"score":7,"value":0,"comment":"c"},"x",'
         '{"final_verdict":{"verdict":"PASS"},"score":%d%s}]}', even, u % 5, comment),
        ('{"outputs":{"final_decision":"FAIL","confidence":0.7,"human_verdict":"FAIL"},'
         '"feedback_stats":{"final_verdict":{"verdict":"FAIL"}}}',),
        ('{"outputs":{"final_decision":"PASS","confidence":%s},"feedback_stats":{"final_verdict":{"verdict":"FAIL",'
         '"comments":["Human verdict: maybe","seen. Human verdict: PASS "]}}}', ((u % 100) / F.lit(100)).cast("string")),
        ('{"outputs":{"final_decision":"PASS","confidence":true,"human_verdict":null},"feedback_stats":{"final_verdict":{}}}',),
        ('{"outputs":null,"feedback":{"a":1}}',),
    ]
    return r.select(*[c for c in r.columns if not c.startswith("_")],
                    F.parse_json(_shaped(F.col("ord") % 8, shapes)).alias("doc"))


def availability_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with outputs of ten shapes by ``ord % 10``: a note of its own (two places), and each inferred note."""
    r = runs(spark, sf_dir)
    outputs = [
        ('{"website_analysis":{"error_message":"down %d"}}', F.col("_user").cast("long")), ('{"notes":"seen"}',),
        ('{"project_info":{"a":1}}',), ('{"name_analysis":{"x":1}}',), ('{"website_analysis":{"is_available":false}}',),
        ('{"final_decision":"PASS"}',), ('{"final_decision":"FAIL"}',), ('{"is_available":true,"is_malicious":true}',),
        ('{"log":"Connection Timeout"}',), ('{"other":1}',)]
    doc = F.concat(F.lit('{"outputs":'), _shaped(F.col("ord") % 10, outputs), F.lit("}"))
    return r.select(*[c for c in r.columns if not c.startswith("_")], F.parse_json(doc).alias("doc"))


def refetched_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two ingest batches of documents with nested runs: all runs, then every third one of another project, whose
    document now holds one failed nested run."""
    first = nested_run_documents(spark, sf_dir).withColumnRenamed("ord", "ingest_seq")
    doc = F.parse_json(F.concat(F.lit('{"id":"'), "run_id", F.lit('","child_runs":[{"id":"'), "run_id",
                                F.lit('-d","name":"zenrows_scraper","status":"error"}]}')))
    again = first.where(F.col("ingest_seq") % 3 == 0).withColumns({
        "project": F.concat("project", F.lit("m")), "doc": doc, "ingest_seq": F.col("ingest_seq") + 10 ** 12})
    return first, again
