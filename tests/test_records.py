"""Typed records, reasons of landed files, and the writer that keeps the rows it cannot write."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from runlens.sources import landing as L
from runlens.sources import records as REC
from runlens.sources import sinks as SK

UUID = "00000000-0000-4000-8000-00000000000"


def _files(spark, texts):
    rows = [(f"p/2025-01-02/{i}_00000{i}.json", "my proj!", f"{i:06d}", dt.datetime(2025, 1, 2, i), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "file_path string, path_project string, extracted_hhmmss string, file_mtime timestamp, t string")
    return df.withColumn("v", F.try_parse_json("t")).drop("t")


def _record(spark, run):
    landed = L.landed_records(_files(spark, [json.dumps(run)]))
    return landed, REC.typed_records(landed.drop("reason"))


def test_a_record_has_the_38_fields(spark):
    kinds = (REC.KEYS, REC.TEXT, REC.TIME, REC.COUNT, REC.COST, REC.FLAG, REC.IDS, ("tags",), REC.EMPTY_OBJECT, REC.EMPTY_LIST, REC.FREE)
    names = [n for kind in kinds for n in kind]
    assert len(names) == len(set(names)) == 38
    landed, typed = _record(spark, {"id": UUID + "1"})
    assert set(names) <= set(typed.columns) and "doc" not in typed.columns


def test_values_of_a_record(spark):
    _, typed = _record(spark, {
        "id": UUID + "1", "start_time": "2025-01-02T01:00:00+02:00", "end_time": "2025-01-02T01:00:00Z", "total_tokens": 7,
        "prompt_tokens": "8", "total_cost": "0.000000000001", "prompt_cost": 0.5, "tags": ["a", 1], "child_run_ids": None,
        "in_dataset": False, "extra": None, "inputs": {"k": None}, "outputs": [], "events": {}, "serialized": None,
        "manifest_id": 5, "child_runs": [{"id": "x"}]})
    json_of = ["extra", "inputs", "outputs", "events", "attachments", "serialized", "child_runs", "feedback_stats"]
    r = typed.withColumns({n: F.to_json(n) for n in json_of}).first()
    assert [r[n] for n in json_of] == ["{}", '{"k":null}', "{}", "[]", "{}", None, '[{"id":"x"}]', None]
    assert r["end_time"] - r["start_time"] == dt.timedelta(hours=2)
    assert (r["total_tokens"], r["prompt_tokens"], r["completion_tokens"]) == (7, 8, None)
    assert (r["total_cost"], r["prompt_cost"], r["completion_cost"]) == (Decimal("0.000000000001"), Decimal("0.5"), None)
    assert (r["tags"], r["child_run_ids"], r["in_dataset"], r["manifest_id"]) == (["a", "1"], [], False, "5")
    assert (str(r["run_date"]), r["trace_id"]) == ("2025-01-01", UUID + "1")


@pytest.mark.parametrize("run", [[], 42, "text", {"id": UUID + "1", "tags": "a", "total_tokens": "many", "start_time": None}])
def test_values_of_other_kinds_give_a_record(spark, run):
    r = _record(spark, run)[1].first()
    assert (r["tags"], r["total_tokens"], r["end_time"]) == ([], None, None)


LANDED = ['{"id": ', "null", '{"metadata": {"n": 1}}', '{"name": "no id"}', '{"id": "bad"}',
          json.dumps({"id": UUID + "1", "start_time": "yesterday"}),
          json.dumps({"metadata": {"enhanced_feedback": True}, "trace": {"id": "any"}}),
          json.dumps({"metadata": {}, "trace": {"id": UUID + "2", "session_id": None}})]


def test_reasons_of_landed_files(spark):
    got = L.landed_records(_files(spark, LANDED)).select("extracted_hhmmss", "reason").collect()
    assert {int(r[0]): r[1] for r in got} == {
        0: "not JSON", 1: "no run id", 3: "no run id", 4: "invalid legacy run", 5: "invalid legacy run", 6: None, 7: None}


def test_the_writer_keeps_what_it_cannot_write(spark, tmp_path):
    out = str(tmp_path / "runs")
    landed = L.landed_records(_files(spark, LANDED))
    assert SK.write_runs_json(landed, out) == {"written": 2, "failed": 5}
    written, failed = (SK.read_runs_json(spark, out, o) for o in ("written", "failed"))
    got = written.select("run_id", "project", F.col("run_date").cast("string"), F.to_json("doc"), "reason").collect()
    assert sorted(tuple(r) for r in got) == [
        (UUID + "2", "myproj", "2025-01-02", '{"id":"%s2","session_id":null}' % UUID, None), ("any", "myproj", "2025-01-02", '{"id":"any"}', None)]
    assert sorted(r[0] for r in failed.select("reason").collect()) == [
        "invalid legacy run", "invalid legacy run", "no run id", "no run id", "not JSON"]
    assert [tuple(r)[2:] for r in SK.manifest(written, failed).collect()] == [(7, 2, 5)]


def test_the_writer_names_the_lacking_key(spark, tmp_path):
    rows = [("a", None, "2025-01-02", "{}"), (None, "p", "2025-01-02", "{}"), ("b", "p", None, "{}"), ("c", "p", "2025-01-02", None)]
    df = spark.createDataFrame(rows, "run_id string, project string, run_date string, j string")
    df = df.select("run_id", "project", F.col("run_date").cast("date").alias("run_date"), F.parse_json("j").alias("doc"))
    out = str(tmp_path / "runs")
    assert SK.write_runs_json(df, out) == {"written": 1, "failed": 3}
    assert [r["project"] for r in SK.read_runs_json(spark, out, "written").collect()] == ["unknown-project"]
    failed = SK.read_runs_json(spark, out, "failed").select("run_id", "reason").collect()
    assert sorted((r[1], r[0]) for r in failed) == [("no day", "b"), ("no document", "c"), ("no run id", None)]
    empty = str(tmp_path / "none")
    assert SK.write_runs_json(df.limit(0), empty) == {"written": 0, "failed": 0}
