"""Error analytics over nested, flat and malformed traces."""

import json

from pyspark.sql import functions as F

from runlens.functions import text as T
from runlens.operators import errors as E


def test_nested_errors_count_against_traces(spark, docs_df):
    # 3 traces; failures at depth 1 and 2 of one and depth 1 of another: 3 of 3, though one trace has none
    bad = {"id": "b", "name": "zenrows_scraper", "status": "error"}
    mid = {"id": "m", "name": "Zenrows_Scraper_x", "status": "error", "child_runs": [bad, {**bad, "status": "success"}]}
    runs = [{"id": "p", "name": "root", "status": "success", "child_runs": [mid]}, {"id": "q", "name": "root", "status": "error"},
            {"id": "s", "name": "root", "status": "success", "child_runs": [{**bad, "name": "scraper"}, bad]}]
    rep = E.daily_error_report_rootmode(docs_df(runs)).first()
    assert (rep["total_traces"], rep["zenrows_errors"], rep["error_rate"]) == (3, 3, 100.0)


def test_wide_trace_counts_failed_scrapers_alone(spark, docs_df):
    # every name meets every status; the expected count is worked out from the rule
    names, states = ["zenrows_scraper", "my Zenrows_Scraper 2", "fetch", None], ["error", "success", "Error", None, "ERROR"]
    kids = [{"id": f"{n}/{s}", "name": n, "status": s} for n in names for s in states] * 7
    wanted = sum("zenrows_scraper" in (k["name"] or "").lower() and (k["status"] or "").lower() == "error" for k in kids)
    runs = [{"id": "wide", "name": "root", "status": "success", "child_runs": kids}]
    assert wanted == 2 * 3 * 7
    assert E.daily_error_report_rootmode(docs_df(runs)).first()["zenrows_errors"] == wanted


def test_children_that_are_no_runs_are_skipped(spark, docs_df):
    failed = {"id": "f", "name": "zenrows_scraper", "status": "error"}
    lists = [[failed, None, 7, "zenrows_scraper", [failed]], None, {"0": failed}, "error", [], [failed, failed]]
    runs = [{"id": f"m{i}", "name": "root", "status": "success", "child_runs": kids} for i, kids in enumerate(lists)]
    rep = E.daily_error_report_rootmode(docs_df(runs)).first()
    assert (rep["total_traces"], rep["zenrows_errors"], rep["error_rate"]) == (6, 3, 50.0)


def test_flat_runs_count_traces_by_root(spark, docs_df):
    # trace i has i stored children of which every second fails: 0, 0, 1, 1, 2 errors; one trace lacks its root
    runs = [{"id": f"r{i}", "trace_id": f"r{i}", "name": "root", "status": "success"} for i in range(4)]
    runs += [{"id": f"r{i}.{k}", "trace_id": f"r{i}", "parent_run_id": f"r{i}", "name": "zenrows_scraper",
              "status": "error" if k % 2 else "success"} for i in range(5) for k in range(i)]
    rep = E.daily_error_report_rootmode(docs_df(runs)).first()
    assert (rep["total_traces"], rep["zenrows_errors"], rep["error_rate"]) == (4, 4, 100.0)
    tab = E.daily_error_report(docs_df(runs), project="p", run_date="2025-08-29").first()
    assert (tab["total_traces"], tab["zenrows_errors"], tab["error_rate"]) == (5, 4, 80.0)


def test_empty_day_still_reports_a_row(spark, docs_df):
    runs = [{"id": "t1", "trace_id": "t1", "name": "root", "status": "success"}]
    rep = E.daily_error_report(docs_df(runs), project="p", run_date="2025-08-30").collect()
    assert len(rep) == 1 and rep[0]["total_traces"] == 0 and rep[0]["error_rate"] == 0.0


def test_nesting_of_any_depth(spark, docs_df):
    def tree(depth):
        node = {"id": f"leaf{depth}", "name": "zenrows_scraper", "status": "error"}
        for i in range(depth - 1):
            node = {"id": f"n{depth}.{i}", "name": "mid", "status": "success", "child_runs": [node, None, "x"]}
        return {"id": f"r{depth}", "name": "root", "status": "success", "child_runs": [node]}

    runs = [tree(20), tree(1), tree(3), {"id": "flat", "name": "root", "status": "success", "child_runs": []}]
    flat = E.flatten_children(docs_df(runs)).collect()
    assert sorted((r["stored_run_id"], r["depth"]) for r in flat) == sorted(
        (f"r{n}", d) for n in (20, 1, 3) for d in range(1, n + 1))
    assert {(r["id"], r["depth"]) for r in flat if r["status"] == "error"} == {("leaf20", 20), ("leaf1", 1), ("leaf3", 3)}
    assert E.flatten_children(docs_df(runs[3:])).count() == 0


def test_signatures_of_errors_in_any_case(spark):
    rows = spark.createDataFrame([("ERROR", "boom"), ("error", "boom"), ("success", "boom")], "status string, error string")
    assert [tuple(r) for r in E.error_signatures(rows).collect()] == [("boom", 2)]


def test_error_hierarchy_symbol_and_root(spark, docs_df):
    # A9-style: root symbol from inputs, children keep their own symbol else the root's
    runs = [{"id": "T", "trace_id": "T", "name": "due_diligence", "status": "success",
             "inputs": {"input_data": {"crypto_symbol": "btc"}}},
            {"id": "a", "trace_id": "T", "name": "ETH_scraper", "status": "error", "error": "x",
             "inputs": {"url": "https://e.com"}},
            {"id": "b", "trace_id": "T", "name": "zenrows_scraper", "status": "error", "error": "y"},
            {"id": "c", "trace_id": "T", "name": "other", "status": "error"}]
    facts = E.error_facts(docs_df(runs)).collect()
    got = {r["error_id"]: (r["symbol"], r["root_id"], r["error_symbol"], r["target_url"]) for r in facts}
    assert got == {"a": ("BTC", "T", "ETH", "https://e.com"), "b": ("BTC", "T", "BTC", None)}


def test_summary_best_worst(spark):
    rep = spark.createDataFrame([("2025-01-01", 10, 2, 20.0), ("2025-01-02", 10, 5, 50.0), ("2025-01-03", 10, 2, 20.0)],
                                "run_date string, total_traces long, zenrows_errors long, error_rate double")
    s = E.summary_stats(rep.withColumn("run_date", F.col("run_date").cast("date"))).first()
    assert (s["total_days"], s["total_traces"], s["total_zenrows_errors"]) == (3, 30, 9)
    assert (s["overall_error_rate"], s["worst_day"], s["best_day"]) == (30.0, "2025-01-02", "2025-01-01")


def test_nested_runs_build_every_document_once(spark):
    built = spark.sparkContext.accumulator(0)

    def text(i):
        built.add(1)
        inner = {"id": f"{i}-c2", "name": "zenrows_scraper", "status": "error"}
        return json.dumps({"id": str(i), "child_runs": [{"id": f"{i}-c1", "name": "a", "child_runs": [inner, 42]}, "x"]})

    runs = spark.range(0, 20, 1, 2).select(
        F.col("id").cast("string").alias("run_id"), F.col("id").alias("ord"), F.parse_json(F.udf(text, "string")("id")).alias("doc"))
    rows = E.nested_runs(runs).collect()
    assert sorted(r["id"] for r in rows) == sorted(f"{i}-c{k}" for i in range(20) for k in (1, 2))
    assert built.value == 20


def test_symbol_scan_tries_patterns_where_a_literal_is(spark):
    cases = {"BTC_x": "BTC", "x eth-usd": "ETH", "my sol run": "SOL", "shiba": "DOGE", "dotty": "Unknown", "abtc": "BTC",
             "polkadot_x": "DOT", "plain": "Unknown", "cardano": "CARDANO", "xlink": "Unknown", "": "Unknown"}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    got = {r["name"]: r["s"] for r in df.select("name", T.crypto_symbol(None, F.col("name"), F.lit("")).alias("s")).collect()}
    assert got == cases
