"""Recursive merges, nested profiles, file-mode datasets and root lookup against plain restatements."""

import json
import random

from pyspark.sql import functions as F

from runlens.operators import errors as E
from runlens.operators import evaluation as EV
from runlens.operators import merge as M
from runlens.sources import sinks as SK


def folded(documents):
    """Plain fold of dicts in order."""
    def into(target, source):
        for key, value in source.items():
            if isinstance(target.get(key), dict) and isinstance(value, dict):
                into(target[key], value)
            else:
                target[key] = json.loads(json.dumps(value))
    out = {}
    for document in documents:
        into(out, document)
    return out


def made_up(draw, depth):
    kinds = [1, "x", None, [1, {"a": 2}], True, {}]
    return {draw.choice(["a", "b", "c'd", 'e"f', "g.h"]): made_up(draw, depth - 1) if depth and draw.random() < 0.6
            else draw.choice(kinds) for _ in range(draw.randint(0, 3))}


def test_deep_merge_is_a_fold_in_order(spark):
    draw = random.Random(21)
    rows = [(draw.choice(["k", "l", "m", None]), i, made_up(draw, 3)) for i in range(60)] + [("empty", 0, {})]
    df = spark.createDataFrame([(k, i, json.dumps(d)) for k, i, d in rows], "field string, ord long, j string").repartition(5)
    got = {r["field"]: json.loads(r["j"]) for r in
           M.deep_merge(df.select("field", "ord", F.parse_json("j").alias("doc")), ["field"])
           .select("field", F.to_json("doc").alias("j")).collect()}
    assert got == {k: folded([d for key, _, d in rows if key == k]) for k in {r[0] for r in rows}}


def profile(i, value, trace="T", **more):
    return {"id": i, "trace_id": trace, "inputs": {"input_data": {"website_url": "u", "name": "n", "social_profiles": value}},
            "outputs": {"final_decision": "PASS", "confidence": 0.9},
            "feedback_stats": {"final_verdict": {"comments": ["Human verdict: PASS"]}}, **more}


def inputs_of(examples, eval_type):
    return {r["trace_id"]: json.loads(r["line"])["inputs"] for r in SK.dataset_lines(examples, eval_type).collect()}


def test_profiles_of_several_runs_are_merged_and_lists_stay_lists(spark, docs_df):
    runs = [profile("T", {"x": 1, "in": {"a": 1}}), profile("b", {"tg": 2, "in": {"b": None}}),
            profile("U", {"x": 1}, "U"), profile("c", ["l"], "U"), profile("V", [], "V"),
            profile("W", {"x": 1}, "W"), profile("d", 5, "W"), profile("e", {"y": {}}, "W")]
    got = inputs_of(EV.build_dataset(docs_df(runs), "website"), "website")
    assert {k: v["social_profiles"] for k, v in got.items()} == {
        "T": {"x": 1, "tg": 2, "in": {"a": 1, "b": None}}, "U": ["l"], "V": [], "W": {"y": {}}}
    assert got["T"]["network"] == "" and got["T"]["name"] == "n"


def test_file_mode_folds_whole_values_of_one_trace_for_each_request(spark, docs_df):
    def landed(i, trace, start, value, request="q"):
        run = profile(i, value, trace, start_time=start)
        run["inputs"]["input_data"]["request_id"] = request
        return run
    runs = [landed("a", "T", "2025-01-02", {"x": 1}), landed("b", "T", "2025-01-02", {"y": 2}),
            landed("c", "U", "2025-01-01", {"z": 3}), landed("d", "V", "2025-01-05", ["v"], "r")]
    examples = EV.build_dataset_file_mode(docs_df(runs), "website")
    assert {k: v["social_profiles"] for k, v in inputs_of(examples, "website").items()} == {"U": {"z": 3}, "V": ["v"]}
    alone = EV.build_dataset_file_mode(docs_df(runs[:2]), "website")
    assert inputs_of(alone, "website")["T"]["social_profiles"] == {"y": 2} and alone.first()["runs_count"] == 2


def test_roots_of_landed_runs(spark, docs_df):
    def run(i, trace, depth, symbol, status="error", **more):
        return {"id": i, "trace_id": trace, "name": "zenrows_scraper", "status": status, "error": "e",
                "inputs": {"input_data": {"crypto_symbol": symbol}}, "extra": {"metadata": {"ls_run_depth": depth}}, **more}
    runs = [run("R", "R", 0, "btc", "success"), run("a", "R", 1, "eth"), run("S", "S", 2, "sol", "success"),
            run("b", "S", 1, "ada"), run("c", "gone", 1, "dot"), run("R", "R", 0, "doge", "success"),
            run("d", "R", 1, "bnb", "success", child_runs=[{"id": "n", "name": "scraper", "status": "error"}])]
    got = {r["error_id"]: (r["symbol"], r["root_id"], r["error_symbol"], r["root_name"]) for r in
           E.error_facts_file_mode(docs_df(runs)).collect()}
    name = "zenrows_scraper"
    assert got == {"a": ("DOGE", "R", "ETH", name), "b": ("ADA", "b", "ADA", name), "c": ("DOT", "c", "DOT", name),
                   "n": ("DOGE", "R", "BNB", name)}


def test_errors_of_a_trace_keep_its_order_and_stored_nested_runs_serve_all_reports(spark, docs_df):
    deep = {"id": "n2", "name": "scraper", "status": "error"}
    runs = [{"id": "z", "trace_id": "T", "name": "scraper", "status": "error",
             "child_runs": [{"id": "n0", "name": "scraper", "status": "error"},
                            {"id": "n1", "name": "zenrows_scraper", "status": "error", "child_runs": [deep]}]},
            {"id": "b", "trace_id": "T", "name": "scraper", "status": "error"},
            {"id": "T", "trace_id": "T", "name": "scraper", "status": "error"}]
    df = docs_df(runs)
    nested = E.nested_runs(df)
    facts = E.error_facts(df.drop("doc"), nested=nested)
    order = [r["error_id"] for r in facts.orderBy("not_root", "ord", "place").collect()]
    assert order == ["T", "z", "n0", "n1", "n2", "b"]
    report = E.daily_error_report(df.drop("doc"), nested=nested)
    assert report.select("total_traces", "zenrows_errors").first() == (1, 1)
    assert "child_runs" not in report._jdf.queryExecution().toString()
    assert E.daily_error_report(df).first() == report.first()
