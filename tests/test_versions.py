"""Stored nested runs of the versioned table, jobs over it, feedback at ingest, counts of landed folders."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from runlens.operators import errors as E
from runlens.operators import evaluation as EV
from runlens.plans import jobs
from runlens.sources import runtable as RT
from runlens.sources import versions as VT

SCHEMA = "run_id string, trace_id string, project string, run_date string, name string, status string, error string, doc string"


def child(i, *below, status="error"):
    return {"id": i, "name": "zenrows_scraper", "status": status, **({"child_runs": list(below)} if below else {})}


def run(i, trace, project, day, *children, name="chain", status="success"):
    doc = {"id": i, "trace_id": trace, "name": name, "status": status, "child_runs": list(children)}
    return (i, trace, project, day, name, status, None, json.dumps(doc))


@pytest.fixture
def merged(spark):
    base = tempfile.mkdtemp(prefix="runlens-nested-")
    log, table = os.path.join(base, "log"), os.path.join(base, "table")

    def batch(number, *rows, documents=True, log=log):
        df = spark.createDataFrame(list(rows), SCHEMA).withColumn("run_date", F.col("run_date").cast("date"))
        df = df.withColumn("doc", F.parse_json("doc")) if documents else df.drop("doc")
        RT.append_batch(df, log, number, f"2025-02-0{number} 00:00:00")
        return VT.merge_batches(spark, log, table)
    return batch, table


def stored(nested):
    return {(r["project"], str(r["run_date"]), r["stored_run_id"], r["id"], r["depth"]) for r in nested.collect()}


def test_nested_runs_are_stored_with_their_partition(spark, merged):
    batch, table = merged
    batch(1, run("a", "a", "p", "2025-01-01", child("a1", child("a2"))), run("b", "b", "p", "2025-01-02", child("b1")),
          run("c", "c", "007", "2025-01-03"))
    runs, nested = VT.read_runs(spark, table)
    assert stored(nested) == {("p", "2025-01-01", "a", "a1", 1), ("p", "2025-01-01", "a", "a2", 2), ("p", "2025-01-02", "b", "b1", 1)}
    untouched = sorted(os.listdir(os.path.join(table, "nested", "v1", "project=p", "run_date=2025-01-02")))
    # a moves to another project and has other nested runs; b is not touched
    batch(2, run("a", "a", "q", "2025-01-01", child("a3", status="success")))
    runs, nested = VT.read_runs(spark, table)
    assert stored(nested) == {("q", "2025-01-01", "a", "a3", 1), ("p", "2025-01-02", "b", "b1", 1)}
    assert not os.path.exists(os.path.join(table, "nested", "v2", "project=p"))
    assert sorted(os.listdir(os.path.join(table, "nested", "v1", "project=p", "run_date=2025-01-02"))) == untouched
    assert stored(VT.read_runs(spark, table, "p", "2025-01-01", "2025-01-02")[1]) == {("p", "2025-01-02", "b", "b1", 1)}
    assert [part.count() for part in VT.read_runs(spark, table, "nobody")] == [0, 0]


def test_jobs_read_stored_nested_runs_and_no_documents(spark, merged):
    batch, table = merged
    batch(1, run("a", "a", "p", "2025-01-01", child("a1", child("a2"), child("a4", status="success"))),
          run("b", "b", "q", "2025-01-01", child("b1")), run("d", "b", "q", "2025-01-01", child("d1"), name="zenrows_scraper", status="error"))
    text = "Date,Total Traces,Zenrows Errors,Error Rate\n2025-01-01,{}\n"
    # the nested runs of b go, since the root's trace has another stored run
    assert jobs.error_report(spark, table, "2025-01-01", "q") == text.format("1,2,200.0%")
    assert jobs.error_report(spark, table, "2025-01-01") == text.format("2,4,200.0%")
    runs, nested = VT.read_runs(spark, table, "p", "2025-01-01")
    plan = E.daily_error_report(runs, nested=nested)._jdf.queryExecution().executedPlan().toString()
    assert "doc" not in plan and "v1/" not in plan.replace("data/v1", "").replace("nested/v1", "")
    from_documents = E.daily_error_report(runs).collect()
    assert E.daily_error_report(runs, nested=nested).collect() == from_documents
    out = os.path.join(os.path.dirname(table), "detail")
    jobs.error_detail_report(spark, table, "2025-01-01", out, "p")
    lines = [r["value"] for r in spark.read.text(out).collect()]
    assert sum(line.startswith("    Error:") for line in lines) == 2


def test_a_table_without_documents_stores_no_nested_runs(spark, merged):
    batch, table = merged
    batch(1, run("a", "a", "p", "2025-01-01", child("a1")), documents=False)
    runs, nested = VT.read_runs(spark, table)
    assert runs.count() == 1 and nested is None
    # documents that come later bring the nested runs of the partitions they touch; the rest has none to read
    batch(2, run("b", "b", "q", "2025-01-01", child("b1")), log=table + "-log")  # a log has one set of columns
    assert VT.read_runs(spark, table)[1] is None
    assert stored(VT.read_runs(spark, table, "q")[1]) == {("q", "2025-01-01", "b", "b1", 1)}
    assert jobs.error_report(spark, table, "2025-01-01", "q").endswith("2025-01-01,1,1,100.0%\n")
    assert VT.read_runs(spark, table + "-none") is None


def test_feedback_goes_into_documents(spark):
    texts = {"a": '{"id":"a","feedback_records":[{"old":1}],"n":null,"x":{"y":[1,"2"]}}', "b": '{"id":"b"}', "c": "[1]", "d": "{}", None: "{}"}
    runs = spark.createDataFrame(list(texts.items()), "run_id string, t string").withColumn("doc", F.parse_json("t")).drop("t")
    feedback = spark.createDataFrame([("a", "k2", None), ("a", "k1", 0.5), ("a", "k1", 0.5), ("c", "k", 1.0), ("d", None, None),
                                      (None, "k", 1.0), ("gone", "k", 1.0)], "run_id string, key string, score double")
    found = EV.feedback_in_documents(runs, feedback)
    assert found.columns == runs.columns
    got = {r["run_id"]: json.loads(r["j"]) for r in found.select("run_id", F.to_json("doc").alias("j")).collect()}
    records = [{"run_id": "a", "key": "k1", "score": 0.5}] * 2 + [{"run_id": "a", "key": "k2", "score": None}]
    assert got == {"a": {"id": "a", "n": None, "x": {"y": [1, "2"]}, "feedback_records": records}, "b": {"id": "b"}, "c": [1],
                   "d": {"feedback_records": [{"run_id": "d", "key": None, "score": None}]}, None: {}}
    none = EV.feedback_in_documents(runs, feedback.limit(0))
    assert none.where("run_id = 'a'").select(F.to_json("doc")).first()[0].count("old") == 1


def landed(root, project, day, name, value):
    folder = os.path.join(root, project, day)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(json.dumps(value))


def test_ingest_reads_files_once_and_takes_feedback(spark):
    base = tempfile.mkdtemp(prefix="runlens-feedback-")
    ids = [f"00000000-0000-4000-8000-00000000000{i}" for i in range(3)]
    for i in ids[:2]:
        landed(f"{base}/in", "p", "2025-01-01", f"{i}_100000.json", {"trace": {"id": i, "name": "x"}})
    landed(f"{base}/in", "p", "2025-01-01", "bad_100000.json", {"id": "bad"})
    feedback = spark.createDataFrame([(ids[0], "PASS"), (ids[2], "FAIL")], "run_id string, verdict string")
    counts = jobs.ingest(spark, f"{base}/in", f"{base}/log", 1, ingest_ts="2025-01-02 00:00:00", feedback=feedback)
    assert counts == {"stored": 2, "skipped": 0, "rejected": 1}
    docs = {r["run_id"]: json.loads(r["doc"]) for r in spark.read.parquet(f"{base}/log").select("run_id", "doc").collect()}
    assert docs == {ids[0]: {"id": ids[0], "name": "x", "feedback_records": [{"run_id": ids[0], "verdict": "PASS"}]},
                    ids[1]: {"id": ids[1], "name": "x"}}


def test_folder_counts_see_summaries(spark):
    root = tempfile.mkdtemp(prefix="runlens-counts-")
    for project, day, name in (("p", "2025-01-01", "a_1.json"), ("p", "2025-01-01", "b_1.json"), ("p", "2025-01-01", "_summary.json"),
                               ("p", "2025-01-01", "_other.json"), ("p", "2025-01-02", "_summary.json"), ("q q", "2025-01-01", "c_1.json"),
                               ("q q", "2025-01-01", "note.txt")):
        landed(root, project, day, name, {"n": 1})
    got = {(r["project"], r["date"]): (r["run_files"], r["summary_files"], r["total_bytes"]) for r in RT.partition_stats(spark, root).collect()}
    size = len('{"n": 1}')
    assert got[("p", "2025-01-01")] == (2, 2, 2 * size) and got[("p", "2025-01-02")] == (0, 1, 0)
    assert sorted(v for k, v in got.items() if k[0] != "p") == [(1, 0, size)]


def test_compaction_never_replaces_a_version(spark):
    path = tempfile.mkdtemp(prefix="runlens-compact-")
    rows = spark.createDataFrame([("a", "a", "p", "2025-01-01")], "run_id string, trace_id string, project string, run_date string")
    RT.compact(rows, f"{path}/v1")
    with pytest.raises(ValueError, match="new folder"):
        RT.compact(rows.limit(0), f"{path}/v1", mode="overwrite")
    assert spark.read.parquet(f"{path}/v1").count() == 1
