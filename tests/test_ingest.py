"""Landing ingest, upsert log, compaction, restore, sinks (temp folders as in the reference tests)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from runlens.operators import errors as E
from runlens.sources import landing as L
from runlens.sources import runtable as RT
from runlens.sources import reports as R
from runlens.sources import sinks as SK

U = "00000000-0000-0000-0000-{:012d}"


def write(root, project, day, name, obj):
    d = os.path.join(root, project, day)
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as f:
        f.write(obj if isinstance(obj, str) else json.dumps(obj))


@pytest.fixture
def landing():
    root = tempfile.mkdtemp(prefix="runlens-landing-")
    day = "2025-08-29"
    write(root, "projA", day, f"{U.format(1)}_100000.json",
          {"metadata": {"project_name": "projA"},
           "trace": {"id": U.format(1), "trace_id": U.format(1), "name": "due_diligence", "status": "success",
                     "start_time": "2025-08-29T06:44:12.622037Z",
                     "child_runs": [{"id": "c", "name": "zenrows_scraper", "status": "error", "error": "e"}]}})
    # a re-fetch of the same run lands a second file: the newest one is kept
    write(root, "projA", day, f"{U.format(1)}_120000.json",
          {"metadata": {"project_name": "projA"},
           "trace": {"id": U.format(1), "trace_id": U.format(1), "name": "due_diligence", "status": "success",
                     "start_time": "2025-08-29T06:44:12.622037Z",
                     "child_runs": [{"id": "c", "name": "zenrows_scraper", "status": "error", "error": "e"}]}})
    write(root, "projA", day, f"{U.format(2)}_100000.json",
          {"metadata": {}, "trace": {"id": U.format(2), "trace_id": U.format(2), "name": "x", "status": "success",
                                     "start_time": "2025-08-29 07:00:00", "child_runs": None}})
    write(root, "projA", day, "bad_100000.json", "{not json")
    write(root, "projA", day, "meta_100000.json", {"metadata": {"project_name": "projA"}})
    write(root, "projA", day, "legacy_100000.json", {"id": "not-a-uuid", "name": "x", "status": "error"})
    write(root, "projA", day, "_summary.json", {"total": 3})
    return root, day


def test_scan_reconcile_and_file_mode_report(spark, landing):
    root, day = landing
    files = L.scan_files(spark, root)
    assert L.bad_records(files).count() == 1
    fmt = dict(L.reconcile(files).groupBy("format").count().collect())
    assert fmt == {"wrapped": 3, "bare": 1}
    runs = L.file_mode_runs(spark, root, "projA", day)
    assert runs.count() == 2  # re-fetched duplicate dropped, bare file not a trace file
    rep = E.daily_error_report_rootmode(runs, date_col="date_key").first()
    assert (rep["date_key"], rep["total_traces"], rep["zenrows_errors"], rep["error_rate"]) == (day, 2, 1, 50.0)


def test_ingest_upsert_compact_restore(spark, landing):
    root, day = landing
    recs, rejected = L.ingest_records(spark, root)
    assert recs.count() == 2 and rejected.count() == 1
    base = tempfile.mkdtemp(prefix="runlens-table-")
    log = os.path.join(base, "log")
    c1 = RT.append_batch(recs, log, batch=1, ingest_ts="2025-08-30 00:00:00")
    assert c1 == {"stored": 2, "skipped": 0}
    # batch 2 updates run 2 (status) - last write wins, created_at stays the first one
    upd = recs.where(F.col("run_id") == U.format(2)).withColumn("status", F.lit("error"))
    RT.append_batch(upd, log, batch=2, ingest_ts="2025-08-31 00:00:00")
    cur = RT.latest(RT.read_log(spark, log))
    got = {r["run_id"]: (r["status"], str(r["created_at"])) for r in cur.collect()}
    assert got[U.format(2)] == ("error", "2025-08-30 00:00:00")
    # idempotent: replaying batch 2 changes nothing
    RT.append_batch(upd, log, batch=3, ingest_ts="2025-09-01 00:00:00")
    again = {r["run_id"]: (r["status"], str(r["created_at"])) for r in RT.latest(RT.read_log(spark, log)).collect()}
    assert again == got
    table = os.path.join(base, "v1")
    RT.compact(cur, table)
    t = RT.read_table(spark, table, "projA", day)
    assert t.count() == 2
    rep = E.daily_error_report(t, project="projA", run_date=day).first()
    assert (rep["total_traces"], rep["zenrows_errors"]) == (2, 1)
    # restore refuses to overwrite unless forced
    with pytest.raises(Exception):
        RT.restore_partition(spark, table, table, "projA", day)
    other = os.path.join(base, "restored")
    assert RT.restore_partition(spark, table, other, "projA", day) == 2
    assert RT.restore_partition(spark, table, other, "projA", day, force=True) == 2
    with pytest.raises(ValueError):
        RT.compact(cur.limit(0), os.path.join(base, "empty"))


def test_partition_stats(spark, landing):
    root, day = landing
    st = RT.partition_stats(spark, root).first()
    assert st["project"] == "projA" and st["date"] == day and st["run_files"] == 6


def test_csv_and_detail_sinks(spark, docs_df):
    rep = spark.createDataFrame([("2025-01-02", 3, 1, 33.3), ("2025-01-01", 10, 2, 20.0)],
                                "run_date string, total_traces long, zenrows_errors long, error_rate double")
    assert SK.csv_report(rep) == ("Date,Total Traces,Zenrows Errors,Error Rate\n"
                                  "2025-01-01,10,2,20.0%\n2025-01-02,3,1,33.3%\n")
    runs = [{"id": "T", "trace_id": "T", "name": "due_diligence", "status": "success",
             "inputs": {"input_data": {"crypto_symbol": "btc"}}},
            {"id": "a", "trace_id": "T", "name": "zenrows_scraper", "status": "error", "error": "ReadTimeout",
             "start_time": "2025-08-29T10:00:00Z", "inputs": {"url": "https://x.com"}}]
    df = docs_df(runs).withColumn("start_time", F.lit("2025-08-29T10:00:00Z"))
    facts = E.error_facts(df)
    out = tempfile.mkdtemp(prefix="runlens-detail-")
    R.write_json(facts, f"{out}/json", "2025-08-29")
    report = spark.read.json(f"{out}/json/report").first()
    assert (report["report_type"], report["project"], report["total_errors"], report["total_traces"], report["crypto_symbols"]) \
        == ("zenrows_detail", "all", 1, 1, 1)
    assert [tuple(r) for r in spark.read.json(f"{out}/json/symbols").select("symbol", "total_errors").collect()] == [("BTC", 1)]
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{out}/json/errors").collect()]
    assert lines == [{"symbol": "BTC", "root_trace_id": "T", "error": {
        "trace_id": "a", "root_trace_id": "T", "crypto_symbol": "BTC", "error_message": "ReadTimeout",
        "start_time": "2025-08-29T10:00:00Z", "target_url": "https://x.com", "name": "zenrows_scraper"}}]
    R.write_text(facts, f"{out}/text")
    assert report_lines(f"{out}/text") == [
        "Zenrows Error Detail Report", "=" * 40, "", "BTC:", "  T:", "    Error: Request timeout",
        "      Time: 2025-08-29 10:00:00 UTC", "      URL: https://x.com", ""]
    R.write_text(facts.limit(0), f"{out}/none")
    assert report_lines(f"{out}/none") == ["No zenrows errors found for the specified date."]


def report_lines(path):
    """The lines of a written report: its files in the order of their names."""
    found = []
    for name in sorted(n for n in os.listdir(path) if n.startswith("part-")):
        with open(os.path.join(path, name)) as lines:
            found += lines.read().splitlines()
    return found


def test_dataset_jsonl_roundtrip(spark, docs_df):
    from runlens.operators import evaluation as EV
    runs = [{"id": "T", "trace_id": "T", "inputs": {"input_data": {"website_url": "https://a.com"}},
             "outputs": {"final_decision": "PASS"}}]
    ex = EV.build_dataset(docs_df(runs), "availability")
    out = os.path.join(tempfile.mkdtemp(prefix="runlens-ds-"), "ds")
    SK.write_dataset_jsonl(ex, out, "availability")
    back = SK.read_dataset(spark, out).first()
    assert back["inputs"]["website_url"] == "https://a.com" and back["outputs"]["is_available"] is True
    assert back["metadata"]["eval_type"] == "availability"


def test_streaming_ingest_available_now(spark, landing):
    from runlens.streaming import landing_stream as LS
    root, day = landing
    base = tempfile.mkdtemp(prefix="runlens-stream-")
    q = LS.start(spark, root, os.path.join(base, "log"), os.path.join(base, "ckpt"), trigger_once=True)
    q.awaitTermination(300)
    cur = RT.latest(RT.read_log(spark, os.path.join(base, "log")))
    assert cur.count() == 2


def test_jobs_end_to_end(spark, landing):
    from runlens.plans import jobs
    root, day = landing
    base = tempfile.mkdtemp(prefix="runlens-jobs-")
    log = os.path.join(base, "log")
    for _ in range(2):  # a replay of a batch replaces it
        counts = jobs.ingest(spark, root, log, batch=1700000000999, ingest_ts="2025-08-30 00:00:00")
        assert counts == {"stored": 2, "skipped": 0, "rejected": 1}
    assert spark.read.parquet(log).count() == 2
    table = os.path.join(base, "v1")
    RT.compact(RT.latest(RT.read_log(spark, log)), table)
    assert jobs.error_report(spark, table, day, "projA") == \
        "Date,Total Traces,Zenrows Errors,Error Rate\n2025-08-29,2,1,50.0%\n"
    assert jobs.error_report(spark, table, day) == \
        "Date,Total Traces,Zenrows Errors,Error Rate\n2025-08-29,2,1,50.0%\n"
    jobs.error_detail_report(spark, table, day, os.path.join(base, "report"))
    assert "    Error: e" in report_lines(os.path.join(base, "report"))
    ds = jobs.create_dataset(spark, table, "projA", "token_name", day)
    assert ds.count() == 0
    with pytest.raises(ValueError):
        jobs.create_dataset(spark, table, "projA", "token_name", day, best_100=True)


def test_undated_runs_take_the_day_of_their_file(spark):
    root, log = tempfile.mkdtemp(prefix="runlens-landing-"), os.path.join(tempfile.mkdtemp(prefix="runlens-log-"), "log")
    for i, start in ((71, None), (72, "soon"), (73, "2025-03-04T05:06:07Z")):
        write(root, "007", "2025-03-04", f"{U.format(i)}_080000.json",
              {"metadata": {"enhanced_feedback": True}, "trace": {"id": U.format(i), "start_time": start}})
    recs, _ = L.ingest_records(spark, root)
    assert RT.append_batch(recs, log, batch=1) == {"stored": 3, "skipped": 0}
    written = {r["run_id"]: str(r["run_date"]) for r in RT.read_log(spark, log).collect()}
    wrote = str(recs.select(F.to_date("file_mtime")).first()[0])
    assert written == {U.format(71): wrote, U.format(72): wrote, U.format(73): "2025-03-04"}
    dated, _ = L.ingest_records(spark, root, ingest_date="2025-03-09")
    assert dated.where("run_date = DATE'2025-03-09'").count() == 2
    # a project's name stays text, though it looks like a number
    table = os.path.join(log + "-table")
    RT.compact(RT.latest(RT.read_log(spark, log)), table)
    assert {r["project"] for r in RT.read_table(spark, table, "007").collect()} == {"007"}


def test_ingest_order_follows_from_the_row(spark):
    base = tempfile.mkdtemp(prefix="runlens-order-")
    rows = spark.range(900).select(
        F.col("id").cast("string").alias("run_id"), F.lit("t").alias("trace_id"), F.lit("p").alias("project"),
        F.lit("2025-01-01").cast("date").alias("run_date"),
        F.timestamp_seconds(F.col("id") % 7 + 1_700_000_000).alias("start_time"))
    found = []
    for i, parts in enumerate((300, 4)):
        log = os.path.join(base, str(i))
        RT.append_batch(rows.repartition(parts), log, batch=3)
        found.append({r["run_id"]: r["ingest_seq"] for r in RT.read_log(spark, log).collect()})
    assert found[0] == found[1] and len(set(found[0].values())) == 900
    by_seq = sorted(found[0], key=found[0].get)
    assert [int(x) % 7 for x in by_seq] == sorted(int(x) % 7 for x in by_seq)
    log = os.path.join(base, "0")
    RT.append_batch(rows.withColumn("trace_id", F.lit("later")).limit(5), log, batch=4)
    assert RT.latest(RT.read_log(spark, log)).where("trace_id = 'later'").count() == 5


def test_busy_day_is_split_into_files(spark):
    table = os.path.join(tempfile.mkdtemp(prefix="runlens-busy-"), "t")
    rows = spark.range(20_000).select(
        F.col("id").cast("string").alias("run_id"), F.col("id").cast("string").alias("trace_id"),
        F.lit("p").alias("project"), F.lit("2025-01-01").cast("date").alias("run_date"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with more data
    try:
        RT.compact(rows, table)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = os.listdir(os.path.join(table, "project=p", "run_date=2025-01-01"))
    assert sum(f.endswith(".parquet") for f in files) > 1 and RT.read_table(spark, table).count() == 20_000


def test_best_100_dataset_has_whole_examples(spark):
    from runlens.plans import jobs
    from runlens.sources import fixtures as FX
    base = tempfile.mkdtemp(prefix="runlens-best-")
    docs = FX.run_documents(spark, "/root/testdata/sf0.001")
    RT.compact(docs, os.path.join(base, "t"))
    days = docs.agg(F.min("run_date"), F.max("run_date")).first()
    table, span = os.path.join(base, "t"), (str(days[0]), str(days[1]))
    for project in sorted(r[0] for r in docs.select("project").distinct().collect()):
        every = jobs.create_dataset(spark, table, project, "availability", *span)
        best = jobs.create_dataset(spark, table, project, "availability", *span, best_100=True, out=base) \
            if every.where("website_url <> ''").count() else None
        if best is not None:
            assert best.columns == every.columns
            rows = [r["trace_id"] for r in best.collect()]
            assert rows and set(rows) <= {r["trace_id"] for r in every.collect()}
            back = SK.read_dataset(spark, f"{base}/{project}_availability_{span[0]}_{span[1]}_best100")
            assert back.count() == len(rows)
            return
    pytest.fail("no example")


def test_files_without_an_id_stay_runs_of_their_own(spark):
    from runlens.sources.landing import latest_file_per_run

    rows = [(None, 1, "100000", "a"), (None, 1, "100000", "b"), (None, 2, None, "c"), ("x", 1, None, "d"), ("x", 2, None, "e")]
    df = spark.createDataFrame(rows, "run_id string, file_mtime long, extracted_hhmmss string, file_path string")
    assert sorted(r["file_path"] for r in latest_file_per_run(df).collect()) == ["a", "b", "c", "e"]


def test_batch_numbers_in_milliseconds_keep_their_order(spark):
    log = os.path.join(tempfile.mkdtemp(prefix="runlens-log-"), "log")
    rows = spark.createDataFrame([("r", "t", "p", "2025-01-01", "a")], "run_id string, trace_id string, project string, run_date string, status string")
    rows = rows.withColumn("run_date", F.col("run_date").cast("date"))
    for batch, status in ((1700000000999, "new"), (1700000000000, "old")):
        RT.append_batch(rows.withColumn("status", F.lit(status)), log, batch, "2025-01-02 00:00:00")
    assert RT.latest(RT.read_log(spark, log)).first()["status"] == "new"
    with pytest.raises(Exception, match="no room"):
        RT.append_batch(rows, log, 10 ** 14, "2025-01-02 00:00:00")


def test_merge_rewrites_only_touched_partitions(spark):
    from runlens.sources import versions as VT
    base = tempfile.mkdtemp(prefix="runlens-versions-")
    log, table = os.path.join(base, "log"), os.path.join(base, "table")
    schema = "run_id string, trace_id string, project string, run_date string, status string"

    def batch(number, rows):
        df = spark.createDataFrame(rows, schema).withColumn("run_date", F.col("run_date").cast("date"))
        RT.append_batch(df, log, number, f"2025-02-0{number} 00:00:00")
        return VT.merge_batches(spark, log, table)

    assert batch(1, [("a", "t", "p", "2025-01-01", "x"), ("b", "t", "p", "2025-01-02", "x"),
                     ("c", "u", "007", "2025-01-03", "x")])["partitions"] == 3
    done = batch(2, [("a", "t", "p", "2025-01-02", "y"), ("d", "v", "q", "2025-01-04", "y")])  # a moves, d is new
    assert (done["version"], done["batch"], done["partitions"]) == (2, 2, 2)
    rows = VT.read_version(spark, table).select("run_id", "project", F.col("run_date").cast("string"), "status",
                                                F.col("created_at").cast("string")).collect()
    assert sorted(map(tuple, rows)) == [
        ("a", "p", "2025-01-02", "y", "2025-02-01 00:00:00"), ("b", "p", "2025-01-02", "x", "2025-02-01 00:00:00"),
        ("c", "007", "2025-01-03", "x", "2025-02-01 00:00:00"), ("d", "q", "2025-01-04", "y", "2025-02-02 00:00:00")]
    listed = {(r["project"], str(r["run_date"]), r["written"]) for r in VT.version_list(spark, table).collect()}
    assert listed == {("p", "2025-01-02", 2), ("q", "2025-01-04", 2), ("007", "2025-01-03", 1)}
    assert VT.merge_batches(spark, log, table) == {"version": 2, "batch": 2, "partitions": 0, "runs": 0}
