"""Time functions, and the exact schema of written examples."""

import json

from pyspark.sql import functions as F

from runlens.functions import times as X
from runlens.operators import quality as Q


def test_times(spark):
    texts = ["2025-03-01T23:30:00Z", "2025-03-01T23:30:00", "2025-03-01T23:30:00.250000+02:00", "2025-03-01 10:00:00.5",
             "2025-03-01", "March", "", None]
    now = F.lit("2025-06-07 01:02:03").cast("timestamp")
    t = F.col("t")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select(
        "i", X.parse_date(t).cast("string"), X.display(X.to_utc(t)), X.legacy_time(t),
        X.creation_date(t, now).cast("string")).collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == [
        (None, "2025-03-01 23:30:00 UTC", "2025-03-02T07:30:00+08:00", "2025-06-07"),
        (None, "2025-03-01 23:30:00 UTC", "2025-03-01T23:30:00+08:00", "2025-06-07"),
        (None, "2025-03-01 21:30:00 UTC", "2025-03-02T05:30:00+08:00", "2025-06-07"),
        (None, "2025-03-01 10:00:00 UTC", "2025-03-01T10:00:00+08:00", rows[3][4]),
        ("2025-03-01", "2025-03-01 00:00:00 UTC", "2025-03-01T00:00:00+08:00", "2025-06-07"),
        (None, None, None, "2025-06-07"), (None, None, None, "2025-06-07"), (None, None, None, "2025-06-07")]
    dated = spark.createDataFrame([("2025-03-01 10:00:00",), ("2025-03-02 10:00:00.123456",)], "t string")
    assert [str(r[0]) for r in dated.select(X.creation_date(t, now)).collect()] == ["2025-03-01", "2025-03-02"]


def test_violations_of_an_example_schema(spark):
    good = {"inputs": {"website_url": "u"}, "outputs": {"is_available": True, "notes": ""}, "metadata": {}}
    lines = [good, {**good, "outputs": {"is_available": "yes", "notes": ""}}, {**good, "inputs": {"website_url": "u", "x": 1}},
             {**good, "outputs": {"notes": "n"}}, {"outputs": good["outputs"]}]
    rows = [(i, json.dumps(x)) for i, x in enumerate(lines)] + [(5, "no json")]
    found = Q.example_schema_violations(spark.createDataFrame(rows, "n int, line string"), "availability")
    assert sorted(tuple(r) for r in found.select("n", "part", "problem", "name").collect()) == [
        (1, "outputs", "wrong type", "is_available"), (2, "inputs", "extra key", "x"),
        (3, "outputs", "missing key", "is_available"), (4, "inputs", "missing key", "website_url"),
        (5, "inputs", "missing key", "website_url"), (5, "outputs", "missing key", "is_available"),
        (5, "outputs", "missing key", "notes")]
