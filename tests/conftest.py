import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from runlens.session import build_session
    s = build_session("local[4]", 4, app_name="runlens-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def docs_df(spark):
    """Build a run DataFrame from Python dicts: typed keys + the document as VARIANT."""
    from pyspark.sql import functions as F

    def make(runs, project="p", run_date="2025-08-29"):
        rows = []
        for i, r in enumerate(runs):
            rows.append((str(r.get("id")), str(r.get("trace_id") or r.get("id")), r.get("parent_run_id"),
                         project, run_date, r.get("name"), r.get("status"), r.get("error"), i, json.dumps(r)))
        df = spark.createDataFrame(rows, "run_id string, trace_id string, parent_run_id string, project string, "
                                         "run_date string, name string, status string, error string, ord long, j string")
        return df.withColumn("run_date", F.col("run_date").cast("date")).withColumn("doc", F.parse_json("j")).drop("j")
    return make
