"""A JSON null in a document is SQL NULL on every path, never the text "null"."""

from pyspark.sql import functions as F

from runlens.functions import variant as V
from runlens.operators import evaluation as EV
from runlens.sources import landing


def test_text_at(spark):
    df = spark.createDataFrame([('{"a": null, "b": "x", "c": 7, "d": {"e": [1]}}',)], "j string")
    doc = F.parse_json("j")
    got = df.select(*[V.text_at(doc, f"$.{k}").alias(k) for k in "abcdz"]).first()
    assert tuple(got) == (None, "x", "7", '{"e":[1]}', None)


def test_landed_root_with_null_parent(spark):
    run = '{"id": "r1", "trace_id": null, "parent_run_id": null, "start_time": "2025-03-04T05:06:07Z", "name": "n"}'
    df = spark.createDataFrame([(run, "p")], "j string, path_project string").withColumn("run", F.parse_json("j"))
    for column in ("path", "path_date", "format", "has_trace"):
        if column not in df.columns:
            df = df.withColumn(column, F.lit(None).cast("string"))
    got = landing.to_records(df).first()
    assert (got["run_id"], got["trace_id"], got["parent_run_id"]) == ("r1", "r1", None)


def test_null_request_ids_stay_apart_and_unqualified_traces_go(spark):
    rows = [("t1", None, "2025-01-01", 1, True), ("t2", None, "2025-01-01", 2, True),
            ("t3", "q", "2025-01-01", 3, False), ("t4", "q", "2025-01-02", 4, True)]
    df = spark.createDataFrame(rows, "trace_id string, request_id string, start_time string, ord long, meets_criteria boolean")
    got = EV.dedup_by_request(df).collect()
    assert sorted((r["dedup_key"], r["trace_id"]) for r in got) == [("q", "t4"), ("t1", "t1"), ("t2", "t2")]
