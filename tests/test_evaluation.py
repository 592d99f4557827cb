"""Verdicts, criteria, extraction, merges and curation (reference unit cases)."""

import json

import pytest
from pyspark.sql import functions as F

from runlens.functions import variant as V
from runlens.operators import curation as C
from runlens.operators import evaluation as EV
from runlens.session import staged
from runlens.sources import fixtures as FX


def verdict_run(verdict_comment, decision, confidence, rid="r"):
    return {"id": rid, "trace_id": rid, "outputs": {"final_decision": decision, "confidence": confidence},
            "feedback_stats": {"final_verdict": {"comments": [verdict_comment]}}}


def test_criteria_pass_pass(spark, docs_df):
    df = EV.run_flags(docs_df([verdict_run("Human verdict: PASS", "PASS", 0.8)]))
    r = df.first()
    assert r["meets_criteria"] and r["has_ai_output"] and r["has_human_feedback"]


def test_criteria_failures(spark, docs_df):
    runs = [verdict_run("Human verdict: PASS", "FAIL", 0.9, "a"),
            verdict_run("Human verdict: PASS", "PASS", 0.5, "b"),
            verdict_run("Human verdict: MAYBE", "PASS", 0.9, "c"),
            verdict_run("Human verdict: PASS", "PASS", "0.75", "d"),
            verdict_run("Human verdict: PASS", "PASS", "NaN", "e"),
            {"id": "f", "outputs": {"final_decision": "PASS", "confidence": 0.9},
             "feedback_stats": {"final_verdict": {"verdict": "PASS"}}}]
    got = dict(EV.run_flags(docs_df(runs)).select("run_id", "meets_criteria").collect())
    assert got == {"a": False, "b": False, "c": False, "d": True, "e": False, "f": True}


def test_availability_criteria_website_url(spark, docs_df):
    runs = [{"id": "a", "inputs": {"website_url": "x"}}, {"id": "b", "inputs": {"input_data": {"website_url": "x"}}},
            {"id": "c", "inputs": {"input_data": {"name": "x"}}}]
    got = dict(EV.run_flags(docs_df(runs), "availability").select("run_id", "meets_criteria").collect())
    assert got == {"a": True, "b": True, "c": False}


def test_boolean_output_extraction(spark, docs_df):
    runs = [{"id": "a", "outputs": {"name_analysis": {"meme_check": {"is_meme": True}, "trademark_check": {"has_conflict": True}},
                                    "website_analysis": {"is_available": False, "malicious_check": {"is_dangerous": True}}}},
            {"id": "b", "outputs": None},
            {"id": "c", "outputs": {"meme_check": False, "is_meme": True, "explicit_check": 1}}]
    f = EV.run_fields(docs_df(runs)).select("run_id", "is_meme", "is_explicit", "has_conflict", "is_available",
                                             "is_available_p", "is_malicious", "notes")
    got = {r["run_id"]: r for r in f.collect()}
    assert (got["a"]["is_meme"], got["a"]["has_conflict"], got["a"]["is_available"], got["a"]["is_malicious"]) == \
        (True, True, False, True)
    assert got["a"]["notes"] == "Website not accessible - analysis completed"
    assert (got["b"]["is_meme"], got["b"]["is_available_p"], got["b"]["notes"]) == \
        (False, False, "Website availability status unclear")
    assert (got["c"]["is_meme"], got["c"]["is_explicit"]) == (False, True)


def test_root_priority_merge(spark, docs_df):
    # Protected is_available/notes from the root; other fields from the last child; gaps filled
    runs = [{"id": "T", "trace_id": "T", "inputs": {"input_data": {"website_url": "https://root.com"}},
             "outputs": {"website_analysis": {"is_available": True, "notes": "root note"}}},
            {"id": "c1", "trace_id": "T", "inputs": {"input_data": {"website_url": "https://child.com"}},
             "outputs": {"website_analysis": {"is_available": False, "notes": "child note"}}}]
    ex = EV.build_dataset(docs_df(runs), "availability").first()
    assert (ex["website_url"], ex["is_available"], ex["notes"]) == ("https://child.com", True, "root note")


def test_last_wins_merge_token_name(spark, docs_df):
    runs = [dict(verdict_run("Human verdict: PASS", "PASS", 0.9, "T"),
                 inputs={"input_data": {"name": "First", "crypto_symbol": "AAA", "description": "d"}}),
            {"id": "c", "trace_id": "T", "inputs": {"input_data": {"name": "Second"}},
             "outputs": {"name_analysis": {"meme_check": {"is_meme": True}}}}]
    ex = EV.build_dataset(docs_df(runs), "token_name").first()
    assert (ex["name"], ex["symbol"], ex["description"], ex["is_meme"], ex["runs_count"]) == \
        ("Second", "AAA", "d", True, 2)


def _examples(spark, rows):
    return spark.createDataFrame([(i,) + r for i, r in enumerate(rows)],
                                 "pos long, website_url string, is_available boolean, notes string")


def test_curation_negatives_and_dedup(spark):
    rows = [("https://a.com", False, "error"), ("http://www.a.com/", False, "timeout"),
            ("https://b.com", True, "found it here"), ("https://b.com/", True, "Website accessible - ok"),
            ("https://c.org", True, "ok"), ("https://a.com", True, "should be excluded")]
    cur = C.curate(_examples(spark, rows), target_size=3).collect()
    kinds = sorted((r["kind"], r["norm_url"]) for r in cur)
    assert kinds == [("negative", "a.com"), ("positive", "b.com"), ("positive", "c.org")]
    C.validate(C.curate(_examples(spark, rows), target_size=3))


def test_winners_of_domains_come_first_then_scores(spark):
    # by hand: 10 for a URL, 10 for a flag, 5 for notes of more than ten characters, 3 for a word of success
    rows = [("shop.example/a", True, ""), ("https://shop.example/b", True, "found the whole page"), ("https://news.example/x", True, ""),
            ("https://shop.example/c", True, "plain notes only"), ("https://gone.example", None, ""), ("HTTPS://WWW.GONE.EXAMPLE/", True, "found"),
            ("https://news.example/y", True, "found")]
    found = {}
    for target in (0, 1, 2, 3, 4, 9):
        cur = C.curate(_examples(spark, rows), target_size=target).collect()
        assert [r["pos"] for r in cur if r["kind"] == "negative"] == [4]
        found[target] = sorted(r["pos"] for r in cur if r["kind"] == "positive")
    # shop.example is seen first and is won by row 1, news.example by row 6; then row 3 (25) before rows 0 and 2 (20)
    assert found == {0: [], 1: [], 2: [1], 3: [1, 6], 4: [1, 3, 6], 9: [0, 1, 2, 3, 6]}


def test_curation_of_no_rows_and_of_negatives_alone(spark):
    empty = spark.createDataFrame([], "pos long, website_url string, is_available boolean, notes string")
    assert C.curate(empty).count() == 0
    only_negatives = _examples(spark, [(None, None, None), ("https://a.example", False, None), ("a.example", True, None)])
    assert sorted(r["pos"] for r in C.curate(only_negatives).collect()) == [0, 1]


def test_dedup_by_request_keeps_earliest(spark):
    t = spark.createDataFrame([("t1", "2025-01-01T10:00:00", "req", 1), ("t2", "2025-01-01T09:00:00", "req", 2),
                               ("t3", "2025-01-01T08:00:00", None, 3)],
                              "trace_id string, start_time string, request_id string, ord long")
    got = dict(EV.dedup_by_request(t).select("dedup_key", "trace_id").collect())
    assert got == {"req": "t2", "t3": "t3"}


def test_attach_feedback_keeps_runs_without(spark):
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    fb = spark.createDataFrame([("a", "PASS"), ("a", "FAIL")], "run_id string, verdict string")
    got = dict(EV.attach_feedback(runs, fb).select("run_id", F.size("feedback_records")).collect())
    assert got == {"a": 2, "b": 0}


@pytest.mark.parametrize("build", [EV.build_dataset, EV.build_dataset_file_mode])
@pytest.mark.parametrize("eval_type", EV.EVAL_TYPES)
def test_every_document_is_built_once(spark, build, eval_type):
    built = spark.sparkContext.accumulator(0)

    def text(i):
        built.add(1)
        outputs = {"final_decision": "PASS", "confidence": 0.9, "website_analysis": {"is_available": True}}
        return json.dumps({"id": str(i), "inputs": {"input_data": {
            "name": f"n{i}", "website_url": f"https://{i}.example", "request_id": f"r{i // 4}",
            "social_profiles": {"x": i}}}, "outputs": outputs,
            "feedback_stats": {"final_verdict": {"comments": ["Human verdict: PASS"]}}})

    i = F.col("id")
    runs = spark.range(0, 40, 1, 4).select(
        i.cast("string").alias("run_id"), (i - i % 4).cast("string").alias("trace_id"), F.lit("p").alias("project"),
        F.lit("2025-08-29").cast("date").alias("run_date"), i.alias("ord"),
        F.parse_json(F.udf(text, "string")("id")).alias("doc"))
    rows = build(runs, eval_type).select("trace_id", "runs_count", "reference").collect()
    assert len(rows) == 10 and {r["runs_count"] for r in rows} == {4}
    assert built.value == 40


def test_members_of_an_object_in_one_pass(spark):
    texts = ['{"a":1,"b":null,"B":{}}', "{}", "[]", "[1]", '"a"', "null", '{"a":{"x":[]}}', None]
    doc = F.parse_json("j")
    got = (spark.createDataFrame([(t,) for t in texts], "j string").select("j", doc.alias("d"))
           .select("j", V.filled_object("d").alias("filled"), V.fields("d", ["a", "b"]).alias("f"), "d")
           .select("j", "filled", *[F.to_json(f"f.{k}").alias(k) for k in "ab"],
                   *[F.to_json(V.sub("d", f"$.{k}")).alias("sub_" + k) for k in "ab"]).collect())
    assert [r["filled"] for r in got] == [True, False, False, False, False, False, True, False]
    assert [(r["a"], r["b"]) for r in got] == [(r["sub_a"], r["sub_b"]) for r in got]
    assert (got[0]["a"], got[0]["b"], got[6]["a"]) == ("1", "null", '{"x":[]}')


def test_staging_many_rules_leaves_the_session_as_it_was(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    assert staged(spark.range(3), "many", many_rules=True).count() == 3
    with pytest.raises(Exception, match="boom"):
        staged(spark.range(3).select(F.raise_error(F.lit("boom")).alias("x")), "many", many_rules=True)
    assert spark.conf.get(key) == before


def test_documents_of_one_split_are_built_in_many_tasks(spark, tmp_path):
    spark.range(0, 64, 1, 1).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 5 AS user_id", "'view' AS event_type",
        "CAST(id AS double) AS value", "'{\"k\": 80}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(0, 8, 1, 1).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which joins tasks of so few rows
    try:
        rows = FX.run_documents(spark, str(tmp_path)).select("run_id", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(rows) == 64
    assert len({r["task"] for r in rows}) > 1


def test_events_are_dealt_before_the_columns_of_runs_are_worked_out(spark, tmp_path):
    spark.sql("SELECT 1L AS event_id, timestamp_ntz'2024-01-01 00:00:00' AS ts, 1L AS user_id, 'view' AS event_type, "
              "1D AS value, '{\"k\": 80}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    spark.sql("SELECT 1L AS doc_id, 1L AS quality, 0L AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    plan = FX.run_documents(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("RepartitionByExpression")
    assert "get_json_object" in above and "date_format" in above
    assert below and "get_json_object" not in below


def test_website_url_in_inputs_of_any_shape(spark):
    inputs = ['{"website_url":null}', '{"input_data":{"website_url":"u"}}', '{"x":{"website_url":null},"y":1}',
              '{"x":[{"website_url":"u"}],"y":"website_url"}', '{"input_data":{"z":{"website_url":"u"}}}', "[]", '"a"', "{}", "null"]
    runs = spark.createDataFrame([(str(i), '{"inputs":%s}' % t) for i, t in enumerate(inputs)] + [("none", "{}"), ("list", "[1]")],
                                 "run_id string, j string").withColumn("doc", F.parse_json("j"))
    got = {r["run_id"] for r in EV.run_flags(runs, "availability").where("meets_criteria").collect()}
    assert got == {"0", "1", "2"}


def test_inputs_are_opened_once_for_all_rules(spark, docs_df):
    runs = docs_df([{"id": "a", "inputs": {"input_data": {"website_url": "u"}, "name": "n"}}])
    fields = EV.run_fields(runs, "doc", "availability", EV.format_fields("availability"))
    plan = fields._jdf.queryExecution().optimizedPlan().toString()
    assert "map<string,variant>" not in plan and "MapType(StringType,VariantType" not in plan


@pytest.mark.parametrize("feedback, expected", [
    ('[{"score":1},"x",{"score":null,"value":0}]', (True, "null", "0", None)), ('["x"]', (False, None, None, None)),
    ("[]", (False, None, None, None)), ('{"score":1}', (False, None, None, None)), ("[{}]", (True, None, None, None))])
def test_reference_of_the_last_feedback_object(spark, feedback, expected):
    runs = spark.createDataFrame([("a", "a", "p", 1, '{"feedback":%s}' % feedback)],
                                 "run_id string, trace_id string, project string, ord long, j string")
    runs = runs.withColumns({"run_date": F.lit("2025-08-29").cast("date"), "doc": F.parse_json("j")})
    row = EV.run_fields(runs).select("feedback_score_p", *[F.to_json(f"feedback_{f}") for f in ("score", "value", "comment")]).first()
    assert tuple(row) == expected
